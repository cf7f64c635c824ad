"""Frames, readings and detections projected from the order tables: an order is a frame, a customer a sequence and a
lineitem a reading. `FIXTURE_SQL` is the same projection as a `WITH` prefix for the checking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefusion.operators.skew import HOT_ROWS, rank_within

WIDTH, HEIGHT = 1280, 720


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _value(key: str) -> F.Column:
    return ((F.col(key) * 37) % 997 + 1).cast("string")


def frames(spark: SparkSession, folder: str, limit: int = HOT_ROWS) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    ranked = rank_within(
        orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "frame_index",
        bucket=[F.to_date("o_orderdate")], limit=limit)
    key = F.col("o_orderkey")
    truth = (
        F.when(key % 10 == 9, "")
        .when(key % 7 == 0, F.concat(F.lit("0"), _value("o_orderkey")))
        .otherwise(_value("o_orderkey"))
    )
    return ranked.select(
        key.alias("image_id"), F.col("o_custkey").alias("sequence_id"), "frame_index",
        F.col("o_orderpriority").alias("provider"),
        F.when(key % 10 < 6, "train").when(key % 10 < 9, "val").otherwise("no_ui_val").alias("split"),
        F.lit(WIDTH).alias("image_width"), F.lit(HEIGHT).alias("image_height"), truth.alias("gt_text"))


def _raw(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate",
        "l_discount", "l_tax", "l_linestatus")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    ranked = rank_within(
        lines, ["l_orderkey"], [F.col(c) for c in order], "candidate_index",
        bucket=[F.col("l_linenumber"), F.floor(F.col("l_partkey") / 64)], limit=limit)
    kind = F.col("l_partkey") % 10
    supp, line = F.col("l_suppkey"), F.col("l_linenumber")
    own, other = _value("l_orderkey"), ((supp * 13) % 1000).cast("string")
    text = (
        F.when(kind < 3, own)
        .when(kind == 3, F.concat(F.lit("0"), own))
        .when(kind == 4, F.concat(F.lit("CH "), own))
        .when(kind == 5, F.concat((supp % 24).cast("string"), F.lit(":"), (10 + supp % 50).cast("string")))
        .when(kind == 6, "News")
        .when(kind == 7, F.concat(F.lit("KBS"), other, F.lit(" Sports")))
        .when(kind == 8, other)
        .otherwise(F.concat(F.lit("12/"), (1 + supp % 28).cast("string")))
    )
    source = (
        F.when(supp % 6 == 0, "original_ocr").when(supp % 6 == 1, "refined_numeric_substring")
        .when(supp % 6 == 2, "paddleocr_channel_recheck").when(supp % 6 == 3, "crop_variant_numeric_recheck")
        .when(supp % 6 == 4, "digit_sequence_trim").otherwise("slot_proposal_recheck")
    )
    row = F.when(line % 4 <= 1, 560).when(line % 4 == 2, 80).otherwise(330)
    return ranked.select(
        F.col("l_orderkey").alias("image_id"), "candidate_index", text.alias("text"), source.alias("source"),
        (64 + 300 * (line % 4) + F.col("l_partkey") % 11).alias("bx"), (row + supp % 7).alias("by"),
        (24 + supp % 5).alias("bh"), (F.lit(1.0) - 8 * F.col("l_discount")).alias("ocr_conf"),
        "l_partkey", "l_suppkey", "l_linestatus", "l_tax")


def candidates(spark: SparkSession, folder: str, limit: int = HOT_ROWS) -> DataFrame:
    x, y = F.col("bx"), F.col("by")
    return _raw(spark, folder, limit).select(
        "image_id", "candidate_index", "text", "source",
        x.cast("double").alias("x1"), y.cast("double").alias("y1"),
        (x + 14 * F.length("text")).cast("double").alias("x2"), (y + F.col("bh")).cast("double").alias("y2"),
        "ocr_conf", F.lit(WIDTH).alias("image_width"), F.lit(HEIGHT).alias("image_height"))


def detections(spark: SparkSession, folder: str, limit: int = HOT_ROWS) -> DataFrame:
    x, y = F.col("bx"), F.col("by")
    return _raw(spark, folder, limit).where("l_linestatus = 'O'").select(
        "image_id", F.col("candidate_index").alias("detection_index"),
        ((F.col("l_partkey") + F.col("l_suppkey")) % 4).cast("int").alias("class_id"),
        (x - 3 + F.col("l_suppkey") % 5).cast("double").alias("x1"), (y - 2).cast("double").alias("y1"),
        (x + 52).cast("double").alias("x2"), (y + F.col("bh") + 2).cast("double").alias("y2"),
        (F.lit(0.95) - 10 * F.col("l_tax")).alias("conf"),
        F.lit(WIDTH).alias("image_width"), F.lit(HEIGHT).alias("image_height"))


def ground_truth(spark: SparkSession, folder: str) -> DataFrame:
    """Truth per frame; `frame_index` is not needed here, so no window runs."""
    key = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        key.alias("image_id"), F.col("o_custkey").alias("sequence_id"), F.col("o_orderpriority").alias("provider"),
        F.when(key % 10 < 6, "train").when(key % 10 < 9, "val").otherwise("no_ui_val").alias("split"),
        F.when(key % 10 == 9, "").when(key % 7 == 0, F.concat(F.lit("0"), _value("o_orderkey")))
        .otherwise(_value("o_orderkey")).alias("gt_text"))


FIXTURE_SQL = """WITH RECURSIVE frames AS (
  SELECT o_orderkey AS image_id, o_custkey AS sequence_id,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS frame_index,
         o_orderpriority AS provider,
         CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'val' ELSE 'no_ui_val' END AS split,
         1280 AS image_width, 720 AS image_height,
         CASE WHEN o_orderkey % 10 = 9 THEN ''
              WHEN o_orderkey % 7 = 0 THEN '0' || CAST((o_orderkey * 37) % 997 + 1 AS STRING)
              ELSE CAST((o_orderkey * 37) % 997 + 1 AS STRING) END AS gt_text
  FROM orders),
raw AS (
  SELECT l_orderkey AS image_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS candidate_index,
         CASE WHEN l_partkey % 10 < 3 THEN CAST((l_orderkey * 37) % 997 + 1 AS STRING)
              WHEN l_partkey % 10 = 3 THEN '0' || CAST((l_orderkey * 37) % 997 + 1 AS STRING)
              WHEN l_partkey % 10 = 4 THEN 'CH ' || CAST((l_orderkey * 37) % 997 + 1 AS STRING)
              WHEN l_partkey % 10 = 5 THEN CAST(l_suppkey % 24 AS STRING) || ':' || CAST(10 + l_suppkey % 50 AS STRING)
              WHEN l_partkey % 10 = 6 THEN 'News'
              WHEN l_partkey % 10 = 7 THEN 'KBS' || CAST((l_suppkey * 13) % 1000 AS STRING) || ' Sports'
              WHEN l_partkey % 10 = 8 THEN CAST((l_suppkey * 13) % 1000 AS STRING)
              ELSE '12/' || CAST(1 + l_suppkey % 28 AS STRING) END AS text,
         CASE l_suppkey % 6 WHEN 0 THEN 'original_ocr' WHEN 1 THEN 'refined_numeric_substring'
              WHEN 2 THEN 'paddleocr_channel_recheck' WHEN 3 THEN 'crop_variant_numeric_recheck'
              WHEN 4 THEN 'digit_sequence_trim' ELSE 'slot_proposal_recheck' END AS source,
         64 + 300 * (l_linenumber % 4) + l_partkey % 11 AS x1,
         CASE l_linenumber % 4 WHEN 0 THEN 560 WHEN 1 THEN 560 WHEN 2 THEN 80 ELSE 330 END + l_suppkey % 7 AS y1,
         24 + l_suppkey % 5 AS h,
         1.0 - 8 * l_discount AS ocr_conf, l_partkey, l_suppkey, l_linestatus, l_tax
  FROM lineitem),
candidates AS (
  SELECT image_id, candidate_index, text, source, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1,
         CAST(x1 + 14 * length(text) AS DOUBLE) AS x2, CAST(y1 + h AS DOUBLE) AS y2, CAST(ocr_conf AS DOUBLE) AS ocr_conf
  FROM raw),
detections AS (
  SELECT image_id, candidate_index AS detection_index, CAST((l_partkey + l_suppkey) % 4 AS INT) AS class_id,
         CAST(x1 - 3 + l_suppkey % 5 AS DOUBLE) AS x1, CAST(y1 - 2 AS DOUBLE) AS y1,
         CAST(x1 + 52 AS DOUBLE) AS x2, CAST(y1 + h + 2 AS DOUBLE) AS y2, CAST(0.95 - 10 * l_tax AS DOUBLE) AS conf
  FROM raw WHERE l_linestatus = 'O')"""
