"""Files to base tables. Each `read_*` loads with Spark and hands a DataFrame to the `parse_*` of the same name."""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framefusion.functions import text as tx
from framefusion.operators.frames import manifest_sequences
from framefusion.operators.skew import rank_within
from framefusion.schema import CANDIDATES, conform

IMAGE_GLOB = "*.{jpg,jpeg,png,bmp,webp,JPG,JPEG,PNG,BMP,WEBP}"
CANDIDATE_ITEM = (
    "struct<id:string,candidate_id:string,text:string,bbox_xyxy:array<double>,bbox:array<double>,ocr_conf:double,confidence:double,"
    "detection_conf:double,source:string,raw_source:string,parent_id:string,parent_text:string,metadata:map<string,string>>")
DOCUMENT = (
    f"struct<images:array<struct<image_id:string,image_path:string,image_width:int,image_height:int,candidates:array<{CANDIDATE_ITEM}>>>>")


def frame_names(files: DataFrame, root: str) -> DataFrame:
    """Folder, stem and unique id of image files (`path`): folder and stem joined by `__`, with `_x` per earlier file of
    the same name."""
    base = root.rstrip("/") + "/"
    local = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    rel = F.when(F.startswith(local, F.lit(base)), F.substring(local, len(base) + 1, 1_000_000)).otherwise(local)
    rows = files.withColumn("_rel", rel)
    folder = F.when(F.contains("_rel", F.lit("/")), F.regexp_extract("_rel", r"^(.*)/[^/]*$", 1)).otherwise("(root)")
    stem = F.regexp_replace(F.regexp_extract("_rel", r"([^/]+)$", 1), r"\.[^.]*$", "")
    rows = rows.withColumn("folder", folder).withColumn("stem", stem)
    uid = F.replace(F.replace(F.concat_ws("__", "folder", "stem"), F.lit("/"), F.lit("__")), F.lit(" "), F.lit("_"))
    ranked = rank_within(rows.withColumn("_uid", uid), ["_uid"], [F.col("path")], "_copy", bucket=[F.col("path")])
    return ranked.withColumn("image_id", F.concat("_uid", F.repeat(F.lit("_x"), F.col("_copy") - 1))).drop("_uid", "_copy", "_rel")


def scan_images(spark: SparkSession, root: str) -> DataFrame:
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_GLOB).load(root)
        .select("path", "length", "modificationTime"))
    return frame_names(files, root)


def split_decodable(spark: SparkSession, frames: DataFrame, root: str, decode: Callable[[bytes], tuple[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(decodable frames with their size, rejected frames). Without `decode` Spark's image source is the judge."""
    if decode is None:
        images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)
        good = images.select(F.col("image.origin").alias("path"), F.col("image.width").alias("image_width"), F.col("image.height").alias("image_height"))
    else:
        content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", IMAGE_GLOB).load(root).select("path", "content")

        def run(batches):
            for pdf in batches:
                out = []
                for path, data in zip(pdf["path"], pdf["content"]):
                    try:
                        out.append((path, *decode(data)))
                    except Exception:
                        continue
                yield pd.DataFrame(out, columns=["path", "image_width", "image_height"])

        good = content.mapInPandas(run, "path string, image_width int, image_height int")
    plain = lambda c: F.regexp_replace(c, r"^[a-z]+:/*", "/")
    good = good.withColumn("_p", plain(F.col("path"))).drop("path")
    rows = frames.withColumn("_p", plain(F.col("path")))
    return rows.join(good, "_p").drop("_p"), rows.join(good, "_p", "left_anti").drop("_p")


def parse_candidates(documents: DataFrame) -> DataFrame:
    """One row per reading of each document (`value` as JSON), in order; frames without readings give no row."""
    doc = documents.select(F.from_json("value", DOCUMENT).alias("d")).select(F.explode("d.images").alias("i"))
    rows = doc.select("i.image_id", "i.image_width", "i.image_height", F.posexplode("i.candidates").alias("_pos", "c"))
    box = F.coalesce("c.bbox_xyxy", "c.bbox")
    index = F.col("_pos") + 1
    ident = F.coalesce("c.candidate_id", "c.id", F.concat(F.lit("candidate_"), F.lpad(index.cast("string"), 4, "0")))
    flat = rows.select(
        "image_id", index.alias("candidate_index"), ident.alias("candidate_id"), F.coalesce("c.text", F.lit("")).alias("text"),
        *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
        F.coalesce("c.ocr_conf", "c.confidence", F.lit(0.5)).alias("ocr_conf"), F.col("c.detection_conf").alias("detection_conf"),
        F.coalesce("c.source", F.lit("")).alias("source"), "c.raw_source", "c.parent_id", "c.parent_text", "image_width", "image_height",
        F.col("c.metadata").alias("meta"))
    return conform(flat, CANDIDATES)


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    return parse_candidates(spark.read.text(path, wholetext=True))


def parse_detections(files: DataFrame, frames: DataFrame, classes: tuple[int, ...] = (0, 1, 2, 3), need_conf: bool = False) -> DataFrame:
    """Label lines `class cx cy w h [conf]` (columns stem, value) to pixel boxes with three decimals. Short lines and other
    classes are skipped, yet every line counts for the number. `frames`: image_id, stem, sizes."""
    lines = files.select("stem", F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("_pos", "line"))
    part = F.split(tx.strip(F.col("line")), r"\s+")
    rows = lines.withColumn("p", part).where(F.size("p") >= (6 if need_conf else 5))
    num = lambda i: F.get("p", F.lit(i)).try_cast("double")
    rows = rows.withColumn("class_id", num(0).cast("int")).where(F.col("class_id").isin(*classes)).join(
        frames.select("image_id", "stem", "image_width", "image_height"), "stem")
    w, h = F.col("image_width"), F.col("image_height")
    r3 = lambda c: F.round(c, 3)
    return rows.select(
        "image_id", (F.col("_pos") + 1).alias("detection_index"), "class_id", r3((num(1) - num(3) / 2) * w).alias("x1"),
        r3((num(2) - num(4) / 2) * h).alias("y1"), r3((num(1) + num(3) / 2) * w).alias("x2"), r3((num(2) + num(4) / 2) * h).alias("y2"),
        F.coalesce(num(5), F.lit(1.0)).alias("conf"), "image_width", "image_height")


def read_detections(spark: SparkSession, folder: str, frames: DataFrame, **options) -> DataFrame:
    text = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt")
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)
    return parse_detections(text.select(stem.alias("stem"), "value"), frames, **options)


def parse_ground_truth(documents: DataFrame, strict: bool = True) -> DataFrame:
    """Values per frame from a map id -> value or a list of records; the strict form drops blank values."""
    text = F.trim("value")
    pairs = documents.where(F.startswith(text, F.lit("{"))).select(F.explode(F.from_json("value", "map<string,string>")).alias("image_id", "v")).select(
        "image_id", F.col("v").alias("value"))
    item = "array<struct<image_id:string,id:string,channel_number:string,ground_truth_channel_number:string>>"
    records = documents.where(F.startswith(text, F.lit("["))).select(F.inline(F.from_json("value", item)))
    value = F.coalesce(F.nullif("channel_number", F.lit("")), "ground_truth_channel_number")
    rows = pairs.unionByName(records.select(F.coalesce("image_id", "id").alias("image_id"), value.alias("value")).where("value IS NOT NULL"))
    if not strict:
        return rows
    return rows.withColumn("value", tx.strip(F.col("value"))).where("value <> '' AND image_id <> ''")


def read_ground_truth(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse_ground_truth(spark.read.text(path, wholetext=True), strict)


def parse_gt_boxes(documents: DataFrame) -> DataFrame:
    """Boxes per frame; a single `bbox` is accepted in place of `bboxes`."""
    kind = "array<struct<image_id:string,image_name:string,provider_or_ui:string,bboxes:array<array<double>>,bbox:array<double>>>"
    wrapped = F.coalesce(F.from_json("value", f"struct<images:{kind}>")["images"], F.from_json("value", kind))
    rows = documents.select(F.explode(wrapped).alias("r"))
    boxes = F.when(F.size("r.bboxes") > 0, F.col("r.bboxes")).otherwise(F.array("r.bbox"))
    ident = F.coalesce(F.nullif("r.image_id", F.lit("")), F.regexp_replace("r.image_name", r"\.[^.]*$", ""))
    out = rows.select(ident.alias("image_id"), F.coalesce("r.provider_or_ui", F.lit("")).alias("provider_or_ui"), F.posexplode(boxes).alias("truth_index", "b"))
    return out.where(F.size("b") >= 4).select("image_id", "provider_or_ui", "truth_index", *[
        F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def read_gt_boxes(spark: SparkSession, path: str) -> DataFrame:
    return parse_gt_boxes(spark.read.text(path, wholetext=True))


def read_sequences(spark: SparkSession, path: str | None, frames: DataFrame) -> DataFrame:
    """Manifest order; without a manifest one sequence ordered by id."""
    if path is None:
        ranked = rank_within(frames.select("image_id", F.lit("default").alias("sequence_id")), ["sequence_id"], [F.col("image_id")],
                             "frame_index", bucket=[F.substring(F.col("image_id").cast("string"), 1, 6)])
        return ranked.select("sequence_id", F.lit("").alias("group_key"), "frame_index", "image_id")
    kind = "struct<sequences:array<struct<sequence_id:string,group_key:string,images:array<string>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)["sequences"]).alias("_pos", "s"))
    name = F.coalesce(F.nullif("s.sequence_id", F.lit("")), F.concat(F.lit("sequence_"), F.lpad((F.col("_pos") + 1).cast("string"), 4, "0")))
    manifest = doc.select(name.alias("sequence_id"), F.coalesce("s.group_key", F.lit("")).alias("group_key"), F.col("s.images").alias("images"))
    return manifest_sequences(manifest, frames)


def read_feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a byte order mark is dropped and all columns stay text, to be cast where they are used."""
    df = spark.read.option("header", "true").option("encoding", "UTF-8").csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def _xyxy(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def _points(text: Column) -> Column:
    """Polygon from JSON: a list of points, or four numbers."""
    polygon = tx.bind(F.filter(F.from_json(text, "array<array<double>>"), lambda p: F.size(p) >= 2),
                      lambda p: F.when(F.size(p) >= 2, p))
    corners = tx.bind(F.from_json(text, "array<double>"), lambda v: F.when(
        F.size(v) == 4, F.array(*[F.array(v[i], v[j]) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))])))
    return F.coalesce(polygon, corners)


def normalize_ocr_output(raw: DataFrame, min_conf: float = 0.0) -> DataFrame:
    """Recogniser output as JSON (`image_id`, `value`) in list form, batch form or single-item form to (box, text, conf).
    Blank texts and low confidence are dropped; numbers count all items."""
    text = F.trim("value")
    # List form: [[polygon, [text, conf]], …], possibly inside one page. Each level is parsed once, in its own column.
    page = lambda v: F.from_json(v, "array<string>")
    listed = raw.where(F.startswith(text, F.lit("["))).withColumn("_top", page(F.col("value")))
    listed = listed.withColumn("_first", page(F.get("_top", F.lit(0))))
    head = F.get("_first", F.lit(0))
    is_page = (F.size("_top") == 1) & F.startswith(head, F.lit("[[["))
    items = listed.select("image_id", F.posexplode(F.when(F.coalesce(is_page, F.lit(False)), F.col("_first")).otherwise(F.col("_top"))).alias("_pos", "_e"))
    pairs = items.where(F.startswith("_e", F.lit("["))).withColumn("_pair", page(F.col("_e"))).withColumn("_said", page(F.get("_pair", F.lit(1))))
    from_list = pairs.select(
        "image_id", "_pos", _points(F.get("_pair", F.lit(0))).alias("points"), F.get("_said", F.lit(0)).alias("text"),
        F.get("_said", F.lit(1)).try_cast("double").alias("conf"))
    # Mapping forms, alone or as list entries.
    maps = raw.where(F.startswith(text, F.lit("{"))).select("image_id", F.lit(0).alias("_pos"), F.col("value").alias("_m")).unionByName(
        items.where(F.startswith("_e", F.lit("{"))).select("image_id", "_pos", F.col("_e").alias("_m")))
    maps = maps.withColumn("_k", F.from_json("_m", "map<string,string>"))
    pick = lambda *names: F.coalesce(*[F.col("_k")[n] for n in names])
    maps = maps.select("image_id", "_pos", "_k", pick("rec_texts", "texts").alias("_t"), pick("rec_scores", "scores").alias("_s"),
                       pick("rec_polys", "dt_polys", "boxes", "polys").alias("_p"))
    many = F.col("_t").isNotNull() & F.col("_p").isNotNull()
    batched = maps.where(many).select("image_id", "_pos", F.posexplode(F.arrays_zip(
        page(F.col("_t")).alias("t"), page(F.col("_p")).alias("p"), page(F.col("_s")).alias("s"))).alias("_i", "z"))
    from_batch = batched.select("image_id", (F.shiftleft(F.col("_pos").cast("long"), 31) + F.col("_i")).alias("_pos"), _points(F.col("z.p")).alias("points"),
                                F.col("z.t").alias("text"), F.coalesce(F.col("z.s").try_cast("double"), F.lit(1.0)).alias("conf"))
    single = maps.where(~many).select(
        "image_id", "_pos", _points(pick("points", "bbox", "box")).alias("points"), pick("text", "rec_text").alias("text"),
        F.coalesce(pick("confidence", "score", "rec_score").try_cast("double"), F.lit(1.0)).alias("conf"))
    rows = from_list.unionByName(from_batch).unionByName(single.where("text IS NOT NULL")).where("points IS NOT NULL")
    rows = rows.withColumn("text", tx.strip(F.col("text"))).where((F.col("text") != "") & (F.col("conf") >= min_conf))
    return rows.select("image_id", F.col("_pos").cast("long").alias("item"), _xyxy(F.col("points")).alias("b"), "text", "conf").select(
        "image_id", F.format_string("ocr_%04d", F.col("item") + 1).alias("candidate_id"), "item", "b.*", "text", F.col("conf").alias("ocr_conf"),
        F.col("conf").alias("detection_conf"))


def parse_bbox(record: Column) -> Column:
    """Box of a JSON record under bbox_xyxy, bbox, box, xyxy or full_bbox: a list, a string of numbers, corner or edge names."""
    names = ("bbox_xyxy", "bbox", "box", "xyxy", "full_bbox")

    def from_text(raw: Column) -> Column:
        cut = F.transform(F.split(F.regexp_replace(raw, r"[\[\]\"]", " "), r"[,;\s]+"), lambda s: s.try_cast("double"))
        return tx.bind(F.filter(cut, lambda v: v.isNotNull()), lambda v: F.when(F.size(v) >= 4, F.slice(v, 1, 4)))

    def from_names(raw: Column) -> Column:
        kind = "struct<x1:double,y1:double,x2:double,y2:double,left:double,top:double,right:double,bottom:double>"
        corner = lambda e: F.array(*[F.coalesce(e[a], e[b]) for a, b in (("x1", "left"), ("y1", "top"), ("x2", "right"), ("y2", "bottom"))])
        return tx.bind(F.from_json(raw, kind), corner)

    raw = tx.bind(F.from_json(record, "map<string,string>"), lambda m: F.coalesce(*[m[k] for k in names]))
    values = tx.bind(raw, lambda r: F.when(F.startswith(F.trim(r), F.lit("{")), from_names(r)).otherwise(from_text(r)))
    box = lambda v: F.struct(*[v[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
    return tx.bind(values, lambda v: F.when(F.forall(v, lambda x: x.isNotNull()), box(v)))


MANIFEST = T.StructType([T.StructField("sequence_id", T.StringType()), T.StructField("group_key", T.StringType()),
                         T.StructField("images", T.ArrayType(T.StringType()))])
