"""Base tables to files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detection_lines(detections: DataFrame, min_conf: float = 0.05) -> DataFrame:
    """One text per frame: centre-normalised lines with eight decimals, most confident first. `detections` carry sizes."""
    w, h = F.col("image_width"), F.col("image_height")
    line = F.format_string(
        "%d %.8f %.8f %.8f %.8f %.8f", "class_id", (F.col("x1") + F.col("x2")) / 2.0 / w, (F.col("y1") + F.col("y2")) / 2.0 / h,
        (F.col("x2") - F.col("x1")) / w, (F.col("y2") - F.col("y1")) / h, "conf")
    rows = detections.where(F.col("conf") >= min_conf).select("image_id", F.struct((-F.col("conf")).alias("o"), "detection_index", line.alias("line")).alias("s"))
    return rows.groupBy("image_id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"])).alias("value"))


def write_detections(detections: DataFrame, path: str, min_conf: float = 0.05) -> None:
    """Label texts as a table (image_id, value); every reader here takes it back."""
    detection_lines(detections, min_conf).write.mode("overwrite").parquet(path)


def candidate_documents(candidates: DataFrame) -> DataFrame:
    """One JSON document per frame, readings in arrival order."""
    item = F.struct("candidate_index", F.struct(
        F.col("candidate_index").cast("string").alias("id"), "text", F.array(*[F.round(c, 3) for c in ("x1", "y1", "x2", "y2")]).alias("bbox_xyxy"),
        F.round("ocr_conf", 6).alias("ocr_conf"), "source").alias("c"))
    frames = candidates.groupBy("image_id", "image_width", "image_height").agg(F.array_sort(F.collect_list(item)).alias("_c"))
    image = F.struct(F.col("image_id").cast("string").alias("image_id"), "image_width", "image_height",
                     F.transform("_c", lambda s: s["c"]).alias("candidates"))
    return frames.select("image_id", F.to_json(F.struct(F.array(image).alias("images"))).alias("value"))


def write_csv(path: str, *parts: DataFrame) -> None:
    """CSV with a header over the union of all columns; missing values are blank."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows.write.mode("overwrite").option("header", "true").option("emptyValue", "").option("nullValue", "").csv(path)


def write_outputs(predictions: DataFrame, per_folder: DataFrame, summary: DataFrame, path: str, by_folder: bool = False) -> None:
    """Predictions, failures, per-frame, per-folder and summary tables; one directory per folder on request."""
    writer = predictions.write.mode("overwrite")
    (writer.partitionBy("folder") if by_folder else writer).parquet(f"{path}/predictions")
    predictions.where("exact = 0").write.mode("overwrite").json(f"{path}/failures")
    write_csv(f"{path}/per_frame", predictions.select("folder", "image_id", "prediction"))
    write_csv(f"{path}/per_folder", per_folder)
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_debug_log(frames: DataFrame, path: str) -> None:
    """One JSON line per frame, one directory per sequence."""
    frames.write.mode("overwrite").partitionBy("sequence_id").json(path)


def label_lines(manifest: DataFrame) -> DataFrame:
    """`path<TAB>label` rows of a crop manifest."""
    name = F.concat(F.lit("images/"), "label", F.lit("_"), F.substring(F.md5(F.col("image_id").cast("string")), 1, 10), F.lit(".jpg"))
    return manifest.select(F.concat_ws("\t", name, "label").alias("value"))
