"""Files written and read back."""

import os
import tempfile

from pyspark.sql import functions as F

from framefusion.sources import readers as rd
from framefusion.sources import writers as wr


def test_images_are_named_by_folder_and_stem(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    os.makedirs(os.path.join(root, "a b"))
    for name in ("a b/150.jpg", "a b/150.png", "041.jpg", "note.txt"):
        with open(os.path.join(root, name), "wb") as handle:
            handle.write(b"x")
    got = sorted(r["image_id"] for r in rd.scan_images(spark, root).select("image_id").collect())
    assert got == ["(root)__041", "a_b__150", "a_b__150_x"]


def test_labels_and_csv(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    with open(os.path.join(root, "f1.txt"), "w") as handle:
        handle.write("0 0.5 0.5 0.1 0.2 0.9\n9 0.5 0.5 0.1 0.2\nbad\n3 0.25 0.25 0.5 0.5\n")
    frames = spark.createDataFrame([("f1", "f1", 100, 50)], "image_id string, stem string, image_width int, image_height int")
    got = [tuple(r) for r in rd.read_detections(spark, root, frames).orderBy("detection_index").select("detection_index", "class_id", "x1", "y2", "conf").collect()]
    assert got == [(1, 0, 45.0, 30.0, 0.9), (4, 3, 0.0, 25.0, 1.0)]
    out = os.path.join(root, "csv")
    wr.write_csv(out, spark.range(1).select(F.lit("x").alias("a")), spark.range(1).select(F.lit("y").alias("b")))
    back = rd.read_feature_csv(spark, out)
    assert set(back.columns) == {"a", "b"} and back.count() == 2


def test_outputs(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    p = spark.createDataFrame([("g", "i1", "12", 1), ("g", "i2", "13", 0)], "folder string, image_id string, prediction string, exact int")
    wr.write_outputs(p, p.groupBy("folder").count(), p.agg(F.count("*").alias("n")), root, by_folder=True)
    assert spark.read.parquet(f"{root}/predictions").count() == 2 and spark.read.json(f"{root}/failures").count() == 1
    wr.write_debug_log(p.withColumn("sequence_id", F.col("folder")), f"{root}/log")
    assert spark.read.json(f"{root}/log").count() == 2
