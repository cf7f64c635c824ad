"""Queries that turn the tables into the file formats and parse them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from framefusion.plans import fixtures as fx
from framefusion.plans.registry import q6, query, r6, rounded
from framefusion.sources import readers as rd
from framefusion.sources import writers as wr


def _frames(spark, folder):
    return fx.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.col("o_orderkey").cast("string").alias("stem"), F.lit(fx.WIDTH).alias("image_width"), F.lit(fx.HEIGHT).alias("image_height"))


@query("read_detections", f"""SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, detection_index) AS INT) AS detection_index, class_id, {q6('round(x1)')} AS x1, {q6('round(y2)')} AS y2, {q6('conf')} AS conf
  FROM detections WHERE conf >= 0.25""")
def read_detections(spark, folder):
    """Detections to label texts and back."""
    texts = wr.detection_lines(fx.detections(spark, folder), 0.25).select(F.col("image_id").cast("string").alias("stem"), "value")
    out = rd.parse_detections(texts, _frames(spark, folder))
    return rounded(out.select("image_id", "detection_index", "class_id", F.round("x1").alias("x1"), F.round("y2").alias("y2"), "conf"))


@query("read_candidates", f"SELECT CAST(image_id AS STRING) AS image_id, candidate_index, text, source, x1, y2, {q6('round(ocr_conf, 6)')} AS ocr_conf FROM candidates")
def read_candidates(spark, folder):
    docs = wr.candidate_documents(fx.candidates(spark, folder)).select("value")
    return rounded(rd.parse_candidates(docs).select("image_id", "candidate_index", "text", "source", "x1", "y2", "ocr_conf"))


@query("read_ground_truth", "SELECT CAST(image_id AS STRING) AS image_id, gt_text AS value FROM frames WHERE gt_text <> ''")
def read_ground_truth(spark, folder):
    """Truth as one small JSON text per frame: a map for even ids, a record list for odd ones."""
    key, value = F.col("image_id").cast("string"), F.col("gt_text")
    record = F.to_json(F.array(F.struct(key.alias("image_id"), value.alias("channel_number"))))
    doc = F.when(F.col("image_id") % 2 == 0, F.to_json(F.create_map(key, value))).otherwise(record)
    return rd.parse_ground_truth(fx.ground_truth(spark, folder).select(doc.alias("value")))


@query("read_gt_boxes", "SELECT CAST(image_id AS STRING) AS image_id, x1, y1, x2, y2 FROM candidates WHERE candidate_index = 1 OR (candidate_index = 2 AND image_id % 2 = 0)")
def read_gt_boxes(spark, folder):
    rows = fx.candidates(spark, folder).where("candidate_index = 1 OR (candidate_index = 2 AND image_id % 2 = 0)")
    boxes = rows.groupBy("image_id").agg(F.collect_list(F.array("x1", "y1", "x2", "y2")).alias("b"))
    key = F.col("image_id").cast("string").alias("image_id")
    many = F.to_json(F.struct(F.array(F.struct(key, F.col("b").alias("bboxes"))).alias("images")))
    one = F.to_json(F.struct(F.array(F.struct(key, F.col("b")[0].alias("bbox"))).alias("images")))
    return rd.parse_gt_boxes(boxes.select(F.when(F.size("b") > 1, many).otherwise(one).alias("value"))).select("image_id", "x1", "y1", "x2", "y2")


@query("normalize_ocr_output", "SELECT image_id, candidate_index, text, x1, y1, x2, y2 FROM candidates WHERE ocr_conf >= 0.3")
def normalize_ocr_output(spark, folder):
    """Readings wrapped in each of the recogniser's output forms."""
    c = F.col
    poly = F.array(F.array("x1", "y1"), F.array("x2", "y1"), F.array("x2", "y2"), F.array("x1", "y2"))
    listed = F.concat(F.lit("[["), F.to_json(poly), F.lit(", ["), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit(", "),
                      c("ocr_conf").cast("string"), F.lit("]]]"))
    batch = F.to_json(F.struct(F.array("text").alias("rec_texts"), F.array("ocr_conf").alias("rec_scores"), F.array(poly).alias("rec_polys")))
    single = F.to_json(F.struct("text", c("ocr_conf").alias("confidence"), F.array("x1", "y1", "x2", "y2").alias("bbox")))
    form = c("candidate_index") % 3
    rows = fx.candidates(spark, folder).select(F.struct("image_id", "candidate_index").alias("image_id"), F.when(form == 0, listed).when(form == 1, batch).otherwise(single).alias("value"))
    return rd.normalize_ocr_output(rows, 0.3).select("image_id.*", "text", "x1", "y1", "x2", "y2")


@query("parse_bbox", "SELECT image_id, candidate_index, x1, y1, x2, y2 FROM candidates")
def parse_bbox(spark, folder):
    c = F.col
    form = c("candidate_index") % 4
    s = lambda n: c(n).cast("string")
    listed = F.to_json(F.struct(F.array("x1", "y1", "x2", "y2").alias("bbox_xyxy")))
    text = F.to_json(F.struct(F.concat_ws(", ", *[s(n) for n in ("x1", "y1", "x2", "y2")]).alias("box")))
    corners = F.to_json(F.struct(F.struct("x1", "y1", "x2", "y2").alias("bbox")))
    edges = F.to_json(F.struct(F.struct(c("x1").alias("left"), c("y1").alias("top"), c("x2").alias("right"), c("y2").alias("bottom")).alias("full_bbox")))
    record = F.when(form == 0, listed).when(form == 1, text).when(form == 2, corners).otherwise(edges)
    return fx.candidates(spark, folder).select("image_id", "candidate_index", rd.parse_bbox(record).alias("b")).select("image_id", "candidate_index", "b.*")


@query("frame_names", """SELECT o_orderkey, 'f' || (o_custkey % 50) || '__a_b__' || CAST(o_orderkey // 2 AS STRING) || CASE WHEN row_number() OVER (PARTITION BY o_custkey % 50, o_orderkey // 2 ORDER BY o_orderkey) > 1 THEN '_x' ELSE '' END AS image_id FROM orders""", fixture=False)
def frame_names(spark, folder):
    """Paths made of the order keys; two neighbouring keys of a folder share a stem and differ in the suffix."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    half = F.floor(key / 2).cast("string")
    path = F.concat(F.lit("file:/data/in/f"), (cust % 50).cast("string"), F.lit("/a b/"), half, F.when(key % 2 == 0, ".jpg").otherwise(".png"))
    files = fx.table(spark, folder, "orders").select("o_orderkey", path.alias("path"))
    return rd.frame_names(files, "/data/in").select("o_orderkey", "image_id")


@query("label_lines", """SELECT 'images/' || v || '_' || substr(md5(CAST(image_id AS STRING)), 1, 10) || '.jpg' || chr(9) || v AS value FROM (SELECT image_id, ltrim(gt_text, '0') AS v FROM frames WHERE gt_text <> '')""")
def label_lines(spark, folder):
    rows = fx.ground_truth(spark, folder).where("gt_text <> ''")
    return wr.label_lines(rows.select("image_id", F.ltrim("gt_text", F.lit("0")).alias("label")))
