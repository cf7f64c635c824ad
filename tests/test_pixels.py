"""The pixels of one key do not meet in one task."""

from pyspark.sql import functions as F

from framefusion.operators import pixels as px


def test_colour_mask_deals_the_pixels_of_a_key_to_many_tasks(spark):
    pixels = spark.range(4000).select(
        F.lit("k").alias("key"), (F.col("id") % 5).alias("frame"), (F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"),
        *[(F.col("id") % n).cast("int").alias(c) for n, c in ((251, "r"), (127, "g"), (63, "b"))])
    colours = spark.createDataFrame([("k", 200, 100, 50, 20, 30, 10)],
                                    "key string, font_r int, font_g int, font_b int, back_r int, back_g int, back_b int")
    away = lambda *c: sum((F.col(n) - v) * (F.col(n) - v) for n, v in zip("rgb", c))
    expected = sorted(map(tuple, pixels.where(away(200, 100, 50) < away(20, 30, 10)).collect()))
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = [spark.conf.get(n) for n in names]
    try:
        for threshold in (before[0], "-1"):
            spark.conf.set(names[0], threshold)
            spark.conf.set(names[1], "false")
            rows = px.colour_mask(pixels, colours, ["key"])
            tasks = {r[0] for r in rows.select(F.spark_partition_id()).distinct().collect()}
            assert sorted(map(tuple, rows.collect())) == expected and len(tasks) == 4
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)
