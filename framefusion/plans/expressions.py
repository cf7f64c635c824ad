"""Queries that project the column rules over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from framefusion.functions import boxes as bx
from framefusion.functions import text as tx
from framefusion.plans import fixtures as fx
from framefusion.plans.registry import (
    q6, query, r6, rounded, sql_best_digit, sql_class, sql_digits, sql_distance, sql_inter, sql_iou, sql_overlap, sql_runs,
    sql_strip)
from framefusion.plans.relations import KEY, OWN, POSITION, QUALITY, TOKEN

W, H = fx.WIDTH, fx.HEIGHT
TEXTS = """SELECT 'd' AS kind, doc_id AS id, 0::BIGINT AS part, text FROM documents
  UNION ALL SELECT 'c', conv_id, turn, text FROM conversations UNION ALL SELECT 'p', page_id, 0, html FROM pages"""


def texts(spark, folder):
    """Whole texts of three tables under one key."""
    t = lambda name, kind, key, part, text: fx.table(spark, folder, name).select(
        F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id"), part.cast("long").alias("part"),
        F.col(text).alias("text"))
    zero = F.lit(0)
    return t("documents", "d", "doc_id", zero, "text").unionByName(
        t("conversations", "c", "conv_id", F.col("turn"), "text")).unionByName(t("pages", "p", "page_id", zero, "html"))


@query("digit_rules", f"""WITH t AS ({TEXTS}) SELECT kind, id, part, length({sql_digits('text')}) AS n_digits,
  md5({sql_digits('text')}) AS head, length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) AS n_any,
  md5({sql_strip(sql_digits('text'))}) AS equiv, regexp_matches(text, '\\p{{L}}') AS has_alpha,
  regexp_matches(text, '^\\s*[0-9]{{1,5}}\\s*$') AS plain FROM t""", fixture=False)
def digit_rules(spark, folder):
    c = F.col("text")
    return texts(spark, folder).select(
        "kind", "id", "part", F.length(tx.digits(c)).cast("long").alias("n_digits"),
        F.md5(tx.digits(c)).alias("head"), F.length(tx.digits_any(c)).cast("long").alias("n_any"),
        F.md5(tx.strip_zeros(tx.digits(c))).alias("equiv"), tx.has_alpha(c).alias("has_alpha"),
        tx.is_plain_numeric(c).alias("plain"))


TEXT_COLUMNS = ["text_len", "digit_count", "alpha_count", "digit_ratio", "alpha_ratio", "candidate_digit_len",
                "is_plain_numeric", "has_alpha", "has_colon", "has_pm_am", "has_sign_or_slash", "starts_with_digit",
                "ends_with_digit"]


@query("text_features", f"""WITH t AS (SELECT kind, id, part, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM ({TEXTS}))
 SELECT kind, id, part, length(s)::DOUBLE AS text_len, length(regexp_replace(s, '[^\\p{{Nd}}]', '', 'g'))::DOUBLE AS digit_count,
  length(regexp_replace(s, '[^\\p{{L}}]', '', 'g'))::DOUBLE AS alpha_count,
  {q6("length(regexp_replace(s, '[^\\p{Nd}]', '', 'g')) / greatest(1, length(s))")} AS digit_ratio,
  {q6("length(regexp_replace(s, '[^\\p{L}]', '', 'g')) / greatest(1, length(s))")} AS alpha_ratio,
  length({sql_digits('text')})::DOUBLE AS candidate_digit_len, CAST(regexp_matches(s, '^[0-9]{{1,5}}$') AS DOUBLE) AS is_plain_numeric,
  CAST(regexp_matches(s, '\\p{{L}}') AS DOUBLE) AS has_alpha, CAST(contains(s, ':') AS DOUBLE) AS has_colon,
  CAST(regexp_matches(s, '(?i)\\b[ap]m\\b') AS DOUBLE) AS has_pm_am, CAST(regexp_matches(s, '[-/.,\\[\\]()]') AS DOUBLE) AS has_sign_or_slash,
  CAST(regexp_matches(s, '^\\p{{Nd}}') AS DOUBLE) AS starts_with_digit, CAST(regexp_matches(s, '\\p{{Nd}}$') AS DOUBLE) AS ends_with_digit FROM t""",
       fixture=False)
def text_features(spark, folder):
    out = texts(spark, folder).select("kind", "id", "part", *[v.alias(k) for k, v in tx.text_features(F.col("text")).items()])
    return rounded(out)


ALIAS_SQL = "CASE source WHEN 'ocr' THEN 'original_ocr' ELSE source END"


@query("source_alias", f"""SELECT source, alias, region, count(*) AS n, {', '.join(f"CAST(sum(CASE WHEN alias = '{o}' THEN 1 ELSE 0 END) AS DOUBLE) AS source_detail_{o}" for o in tx.SOURCE_DETAILS)}
 FROM (SELECT source, source AS alias, CASE WHEN source = 'original_ocr' THEN 'ocr_neighbor' WHEN source = 'paddleocr_channel_recheck' THEN 'ocr_neighbor' ELSE 'unknown' END AS region
   FROM candidates) GROUP BY source, alias, region""")
def source_alias(spark, folder):
    rows = fx.candidates(spark, folder).withColumn("alias", tx.source_alias(F.col("source"))).withColumn(
        "region", tx.broad_region(F.col("source")))
    flags = tx.flags("source_detail", F.col("alias"), tx.SOURCE_DETAILS)
    return rows.groupBy("source", "alias", "region").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(k) for k, v in flags.items()])


@query("best_digit", f"""WITH t AS ({TEXTS}), runs AS (SELECT kind, id, part, text, {sql_runs('text')} AS r FROM t)
 SELECT kind, id, part, len(r) AS n_runs, coalesce(list_filter(r, lambda x: length(x) = list_max(list_transform(r, lambda y: length(y))))[1], '') AS best,
  CASE WHEN len(r) > 0 THEN list_filter(r, lambda x: length(x) = list_max(list_transform(r, lambda y: length(y))))[1] ELSE substr({sql_digits('text')}, 1, 5) END AS forced,
  coalesce(r[1], '') AS first_run FROM runs""", fixture=False)
def best_digit(spark, folder):
    c = F.col("text")
    return texts(spark, folder).select(
        "kind", "id", "part", F.size(tx.short_runs(c)).cast("long").alias("n_runs"), tx.best_digit(c).alias("best"),
        tx.best_digit_forced(c).alias("forced"), tx.first_run(c).alias("first_run"))


@query("classify", f"""SELECT image_id, candidate_index, {sql_class('text')} AS kind, {sql_best_digit('text')} AS best,
  CASE WHEN {sql_class('text')} = 'channelnum' THEN {sql_strip(sql_best_digit('text'))} END AS channel_value FROM candidates""")
def classify(spark, folder):
    c = F.col("text")
    return fx.candidates(spark, folder).select(
        *KEY, tx.classify(c).alias("kind"), tx.best_digit(c).alias("best"), tx.channel_value(c).alias("channel_value"))


NAME_SQL = """CASE o_orderkey % 5 WHEN 0 THEN '0' || o_orderkey || '_x' WHEN 1 THEN 'Ch0' || o_orderkey || '__a_' || o_custkey
   WHEN 2 THEN 'frame_channel_' || o_orderkey || '_7' WHEN 3 THEN o_orderkey || '_' || (o_custkey % 10) ELSE 'x' || o_orderkey END"""


def names(spark, folder):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda c: c.cast("string")
    name = (
        F.when(key % 5 == 0, F.concat(F.lit("0"), s(key), F.lit("_x")))
        .when(key % 5 == 1, F.concat(F.lit("Ch0"), s(key), F.lit("__a_"), s(cust)))
        .when(key % 5 == 2, F.concat(F.lit("frame_channel_"), s(key), F.lit("_7")))
        .when(key % 5 == 3, F.concat(s(key), F.lit("_"), s(cust % 10))).otherwise(F.concat(F.lit("x"), s(key))))
    return fx.table(spark, folder, "orders").select("o_orderkey", "o_custkey", name.alias("name"))


@query("gt_from_name", f"""WITH n AS (SELECT o_orderkey, {NAME_SQL} AS name FROM orders)
 SELECT o_orderkey, regexp_extract(name, '^\\s*([0-9]+)', 1) AS leading,
  {sql_strip("CASE WHEN regexp_matches(name, '^\\s*[Cc][Hh][0-9]+') THEN regexp_extract(name, '^\\s*[Cc][Hh]([0-9]+)', 1) ELSE regexp_extract(name, '^\\s*([0-9]+)', 1) END")} AS ch_prefix,
  regexp_extract(name, '(?i)channel[_-]?([0-9]+)', 1) AS tagged, {sql_strip(sql_digits('name'))} AS all_digits FROM n""", fixture=False)
def gt_from_name(spark, folder):
    c = F.col("name")
    return names(spark, folder).select(
        "o_orderkey", tx.name_leading_digits(c).alias("leading"), tx.name_ch_prefix(c).alias("ch_prefix"),
        tx.name_channel_tag(c).alias("tagged"), tx.name_all_digits(c).alias("all_digits"))


@query("capture_key", """WITH n AS (SELECT o_orderkey, 'Ch' || (o_orderkey % 90) || '__captured_Ch' || (o_custkey % 30) || '_findPosition' || (o_orderkey % 4) || '_d' || o_orderkey AS name FROM orders)
 SELECT o_orderkey, regexp_extract(name, '^(Ch[0-9]+)', 1) AS truth, regexp_extract(name, 'captured_(Ch[0-9]+)_', 1) AS slot,
  regexp_extract(name, '(findPosition[0-9]+)', 1) AS position FROM n""", fixture=False)
def capture_key(spark, folder):
    key = F.col("o_orderkey")
    name = F.concat(F.lit("Ch"), (key % 90).cast("string"), F.lit("__captured_Ch"), (F.col("o_custkey") % 30).cast("string"),
                    F.lit("_findPosition"), (key % 4).cast("string"), F.lit("_d"), key.cast("string"))
    return fx.table(spark, folder, "orders").select("o_orderkey", tx.capture_key(name).alias("k")).select("o_orderkey", "k.*")


PAIR = ", ".join([f"{q6(sql_iou('c', 'd'))} AS iou", f"{q6(sql_overlap('c', 'd'))} AS overlap",
                  f"{q6(sql_distance('c', 'd'))} AS distance", f"{q6(sql_inter('c', 'd'))} AS inter"])


@query("box_algebra", f"""SELECT c.image_id, c.candidate_index, {PAIR},
  (d.x1 <= (c.x1 + c.x2) / 2 AND (c.x1 + c.x2) / 2 <= d.x2 AND d.y1 <= (c.y1 + c.y2) / 2 AND (c.y1 + c.y2) / 2 <= d.y2) AS inside,
  {q6('0.65 * c.x1 + 0.35 * d.x1')} AS smooth_x1 FROM candidates c JOIN detections d ON c.image_id = d.image_id AND c.candidate_index = d.detection_index""")
def box_algebra(spark, folder):
    """Each reading against the detection made from the same line."""
    d = fx.detections(spark, folder).select(
        "image_id", F.col("detection_index").alias("candidate_index"), *[F.col(n).alias(f"d_{n}") for n in ("x1", "y1", "x2", "y2")])
    a, b = bx.cols(), bx.cols("d_")
    out = fx.candidates(spark, folder).join(d, list(KEY)).select(
        *KEY, bx.iou(a, b).alias("iou"), bx.overlap_min(a, b).alias("overlap"), bx.center_distance(a, b, W, H).alias("distance"),
        bx.intersection(a, b).alias("inter"), bx.contains_point(b, bx.center_x(a), bx.center_y(a)).alias("inside"),
        bx.blend(a, b, 0.35).x1.alias("smooth_x1"))
    return rounded(out)


def _clamp(v: str, top: int) -> str:
    return f"greatest(0.0, least({top}.0, {v}))"


@query("box_edits", f"""SELECT image_id, candidate_index,
  {q6(_clamp('x1 - 40', W))} AS ex1, {q6(_clamp('y2 + 9', H))} AS ey2,
  {q6(_clamp('(x1 + x2) / 2 - greatest(1.0, (x2 - x1) * 1.25 / 2)', W))} AS sx1, {q6(_clamp('(y1 + y2) / 2 + greatest(1.0, (y2 - y1) * 1.18 / 2)', H))} AS sy2,
  {q6(_clamp('(x1 + x2) / 2 + greatest(6.0, x2 - x1) * 1.35 / 2', W))} AS mx2, {q6('x1 - greatest(0.0, (y2 - y1) * 3 - (x2 - x1)) / 2')} AS px1,
  {q6('x1 + greatest(1.0, x2 - x1) * 0.12')} AS wx1 FROM candidates""")
def box_edits(spark, folder):
    b = bx.cols()
    out = fx.candidates(spark, folder).select(
        *KEY, bx.expand(b, W, H, 40.0, 9.0).x1.alias("ex1"), bx.expand(b, W, H, 40.0, 9.0).y2.alias("ey2"),
        bx.scale_center(b, W, H, 1.25, 1.18).x1.alias("sx1"), bx.scale_center(b, W, H, 1.25, 1.18).y2.alias("sy2"),
        bx.scale_min_size(b, W, H, 1.35, 1.6).x2.alias("mx2"), bx.pad_to_aspect(b).x1.alias("px1"),
        bx.sub_window(b, 0.12, 0.0, 0.52, 1.0).x1.alias("wx1"))
    return rounded(out)


@query("normalized_geometry", f"""SELECT image_id, candidate_index, {q6('x1 / 1280')} AS bbox_x1_norm, {q6('y1 / 720')} AS bbox_y1_norm, {q6('x2 / 1280')} AS bbox_x2_norm,
  {q6('y2 / 720')} AS bbox_y2_norm, {q6('(x1 + x2) / 2 / 1280')} AS bbox_cx_norm, {q6('(y1 + y2) / 2 / 720')} AS bbox_cy_norm, {q6('(x2 - x1) / 1280')} AS bbox_w_norm,
  {q6('(y2 - y1) / 720')} AS bbox_h_norm, {q6('(x2 - x1) * (y2 - y1) / (1280 * 720)')} AS bbox_area_norm, {q6('(x2 - x1) * (y2 - y1) / (1280 * 720)')} AS bbox_area_ratio,
  {q6('(x2 - x1) / greatest(1.0, y2 - y1)')} AS bbox_aspect,
  CASE WHEN (y1 + y2) / 2 / 720 < 0.4 THEN 'top' WHEN (y1 + y2) / 2 / 720 > 0.6 THEN 'bottom' ELSE 'mid' END || '-' ||
  CASE WHEN (x1 + x2) / 2 / 1280 < 0.4 THEN 'left' WHEN (x1 + x2) / 2 / 1280 > 0.6 THEN 'right' ELSE 'center' END AS position_bin FROM candidates""")
def normalized_geometry(spark, folder):
    out = fx.candidates(spark, folder).select(
        *KEY, *[v.alias(k) for k, v in bx.normalized_geometry(bx.cols(), W, H).items()],
        bx.position_bin(bx.cols(), W, H).alias("position_bin"))
    return rounded(out)


@query("reading_rules", f"""{OWN} SELECT c.image_id, c.candidate_index, {q6(POSITION)} AS position_score, {q6(QUALITY)} AS text_quality,
  c.recheck, c.original, c.alpha_only, {TOKEN} AS token, (c.alpha AND NOT c.plain AND NOT {TOKEN}) AS mixed_alpha,
  (c.plain AND length(c.value) BETWEEN 2 AND 5) AS trusted, (length(c.value) BETWEEN 1 AND 4 AND NOT regexp_matches(c.text, '(?i)\\b[0-9]{{1,2}}\\s*:\\s*[0-9]{{2}}\\b|am|pm')) AS numeric_like,
  (regexp_matches(c.text, '[0-9]{{1,2}}\\s*:\\s*[0-9]{{2}}') OR regexp_matches(c.text, '[0-9]{{1,4}}\\s*[/.\\-]\\s*[0-9]{{1,2}}')) AS clock_or_date FROM own c""")
def reading_rules(spark, folder):
    t, s, no_parent = F.col("text"), F.col("source"), F.lit(None).cast("string")
    out = fx.candidates(spark, folder).select(
        *KEY, bx.position_score(bx.cols(), W, H).alias("position_score"), tx.text_quality(s, t, no_parent).alias("text_quality"),
        tx.is_recheck_source(s).alias("recheck"), tx.is_original(s).alias("original"), tx.is_alpha_only(t).alias("alpha_only"),
        tx.has_numeric_token(t, tx.digits(t)).alias("token"), tx.mixed_alpha(t).alias("mixed_alpha"),
        tx.trusted_numeric(s, t, no_parent).alias("trusted"), tx.is_numeric_like(t).alias("numeric_like"),
        tx.is_time_or_date(t).alias("clock_or_date"))
    return rounded(out)


@query("noise_context", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN v || 'poR' WHEN l_suppkey % 3 = 1 THEN 'x ' || v ELSE 'CNN ' || v || ' later today' END AS parent,
   length(v) BETWEEN 3 AND 5 AND l_suppkey % 3 < 2 AS noise FROM (SELECT *, CAST(l_partkey % 2000 AS STRING) AS v FROM lineitem)""", fixture=False)
def noise_context(spark, folder):
    """Refined tokens of parents that end in noise letters, start with one, or are long titles."""
    v = (F.col("l_partkey") % 2000).cast("string")
    kind = F.col("l_suppkey") % 3
    parent = F.when(kind == 0, F.concat(v, F.lit("poR"))).when(kind == 1, F.concat(F.lit("x "), v)).otherwise(
        F.concat(F.lit("CNN "), v, F.lit(" later today")))
    return fx.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", parent.alias("parent"),
        tx.noise_context(F.lit("refined_numeric_substring"), v, parent).alias("noise"))


@query("elongated_penalty", f"""SELECT image_id, candidate_index, CASE WHEN regexp_matches(text, '^\\s*[0-9]{{1,5}}\\s*$') AND
  greatest(1.0, (x2 - x1) * 3) / greatest(1, length({sql_digits('text')})) / greatest(1.0, y2 - y1) > 1.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS penalty FROM candidates""")
def elongated_penalty(spark, folder):
    """Readings without a source, three times as wide as drawn."""
    wide = (F.col("x2") - F.col("x1")) * 3
    return fx.candidates(spark, folder).select(*KEY, tx.elongated_penalty(
        F.lit(""), F.col("text"), wide, F.col("y2") - F.col("y1")).alias("penalty"))


@query("misread_bucket", f"""SELECT image_id, candidate_index, {sql_strip(sql_digits('gt_text'))} AS truth, {sql_strip(sql_digits('text'))} AS pred,
  CASE WHEN {sql_digits('text')} = '' THEN 'unread' WHEN {sql_strip(sql_digits('text'))} = {sql_strip(sql_digits('gt_text'))} THEN 'correct'
   WHEN length({sql_strip(sql_digits('text'))}) < length({sql_strip(sql_digits('gt_text'))}) THEN 'len_short' WHEN length({sql_strip(sql_digits('text'))}) > length({sql_strip(sql_digits('gt_text'))}) THEN 'len_long'
   WHEN hamming({sql_strip(sql_digits('text'))}, {sql_strip(sql_digits('gt_text'))}) = 1 THEN 'sub1' ELSE 'subN' END AS bucket
  FROM candidates JOIN frames USING (image_id) WHERE gt_text <> ''""")
def misread_bucket(spark, folder):
    truth = fx.ground_truth(spark, folder).where("gt_text <> ''").select("image_id", "gt_text")
    want, got = tx.numeric_equiv(F.col("gt_text")), tx.numeric_equiv(F.col("text"))
    return fx.candidates(spark, folder).join(truth, "image_id").select(
        *KEY, want.alias("truth"), got.alias("pred"), tx.misread_bucket(want, got).alias("bucket"))


@query("hash_partition", """SELECT o_orderkey, CASE WHEN CAST('0x' || substr(sha1(CAST(o_orderkey AS STRING)), 1, 8) AS BIGINT) % 100 < 60 THEN 'no_ui_gate_train' ELSE 'no_ui_val' END AS part FROM orders""", fixture=False)
def hash_partition(spark, folder):
    return fx.table(spark, folder, "orders").select(
        "o_orderkey", tx.hash_partition(F.col("o_orderkey").cast("string"), 60).alias("part"))


@query("policy_text", """SELECT page_id, contains(replace(replace(replace(replace(lower(url || html), 'no_example', ''), 'no-example', ''), 'non_example', ''), 'non-example', ''), 'example') AS mentions,
  length(replace(replace(replace(replace(lower(url), 'no_example', ''), 'no-example', ''), 'non_example', ''), 'non-example', '')) AS n FROM pages""", fixture=False)
def policy_text(spark, folder):
    whole = F.concat("url", "html")
    return fx.table(spark, folder, "pages").select(
        "page_id", tx.mentions(whole, "example").alias("mentions"),
        F.length(tx.policy_text(F.col("url"), "example")).cast("long").alias("n"))


@query("provider_of", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'LG_U+' WHEN 1 THEN 'DishTV_no_ui' WHEN 2 THEN 'Other' ELSE 'unknown' END AS provider FROM orders""", fixture=False)
def provider_of(spark, folder):
    key = F.col("o_orderkey")
    name = F.when(key % 4 == 0, F.concat(F.lit("LG_U+_"), key.cast("string"))).when(
        key % 4 == 1, F.concat(F.lit("dishtv-"), key.cast("string"))).when(
        key % 4 == 2, F.concat(F.lit("Other_x_"), key.cast("string"))).otherwise(F.concat(F.lit("z"), key.cast("string")))
    return fx.table(spark, folder, "orders").select("o_orderkey", tx.provider_of(name).alias("provider"))


@query("safe_float", f"""SELECT event_id, {q6("coalesce(CASE WHEN isfinite(TRY_CAST(s AS DOUBLE)) THEN TRY_CAST(s AS DOUBLE) END, 0)")} AS v
 FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(value AS STRING) WHEN 1 THEN 'nan' WHEN 2 THEN props ELSE 'infinity' END AS s FROM events)""", fixture=False)
def safe_float(spark, folder):
    kind = F.col("event_id") % 4
    s = F.when(kind == 0, F.col("value").cast("string")).when(kind == 1, "nan").when(kind == 2, F.col("props")).otherwise("infinity")
    return fx.table(spark, folder, "events").select("event_id", r6(tx.safe_float(s)).alias("v"))
