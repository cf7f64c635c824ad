"""Queries over generated rows: tokens, regions, windows, suppression, matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from framefusion.functions import text as tx
from framefusion.operators import box_sets as bs
from framefusion.operators import generate as gen
from framefusion.operators import learn
from framefusion.plans import fixtures as fx
from framefusion.plans.registry import q6, query, r6, rounded, sql_class, sql_digits, sql_iou, sql_runs, sql_strip
from framefusion.plans.relations import KEY
from framefusion.plans.selection import LABELLED, selected

START = f"(strpos(text, {sql_digits('text')}) - 1)"


@query("refine_numeric", f""", m AS (SELECT *, {sql_digits('text')} AS d, {START} AS s, length(text) AS n, x2 - x1 AS w FROM candidates WHERE {sql_digits('text')} <> ''
    AND NOT regexp_matches(text, '^[0-9\\s:.\\-/]+$')),
  p AS (SELECT *, x1 + w * (s / n) AS sx, x1 + w * ((s + length(d)) / n) AS ex FROM m)
  SELECT image_id, candidate_index, 'ocr_' || lpad(CAST(candidate_index AS STRING), 4, '0') || '_num_01' AS candidate_id, d AS text,
   {q6('round(greatest(0.0, sx - greatest(2.0, (ex - sx) * 0.12)), 3)')} AS x1, {q6('round(ex + greatest(2.0, (ex - sx) * 0.12), 3)')} AS x2, {q6('ocr_conf * 0.94')} AS ocr_conf, text AS parent_text FROM p""")
def refine_numeric(spark, folder):
    out = gen.refine_numeric(fx.candidates(spark, folder))
    return rounded(out.select(*KEY, "candidate_id", "text", "x1", "x2", "ocr_conf", "parent_text"))


SPLIT = f""", m AS (SELECT *, {sql_digits('text')} AS d, {START} AS s, length(text) AS n, x2 - x1 AS w, starts_with(text, 'CH ') AS prefix FROM candidates
   WHERE len({sql_runs('text')}) = 1 AND coalesce(nullif(ocr_conf, 0), 0.5) >= 0.3 AND NOT regexp_matches(text, '[0-9]{{1,2}}\\s*:\\s*[0-9]{{2}}|[0-9]{{1,4}}\\s*[/.\\-]\\s*[0-9]{{1,2}}')),
 cut AS (SELECT *, regexp_replace(text, '[0-9\\s]', '', 'g') <> '' AND NOT prefix AS had_text FROM m),
 split AS (SELECT image_id, candidate_index, d AS raw, {sql_strip('d')} AS value, CASE WHEN had_text THEN x1 + w * (s / n) ELSE x1 END AS bx1,
   CASE WHEN had_text THEN x1 + w * ((s + length(d)) / n) ELSE x2 END AS bx2, y1, y2, coalesce(nullif(ocr_conf, 0), 0.5) AS conf, had_text, prefix AS had_prefix,
   CASE WHEN prefix THEN 1.0 ELSE length(d) / greatest(1, length(regexp_replace(text, '[^0-9A-Za-z]', '', 'g'))) END::DOUBLE AS purity FROM cut)"""


@query("split_mixed", f"""{SPLIT} SELECT image_id, candidate_index, raw, value, {q6('bx1')} AS x1, {q6('bx2')} AS x2, {q6('(bx1 + bx2) / 2 / 1280')} AS cx, {q6('(y2 - y1) / 720')} AS h,
  had_text, had_prefix, {q6('purity')} AS purity FROM split""")
def split_mixed(spark, folder):
    out = gen.split_mixed(fx.candidates(spark, folder))
    return rounded(out.select(*KEY, "raw", "value", "x1", "x2", "cx", "h", "had_text", "had_prefix", "purity"))


@query("explode_tokens", f"""WITH t AS (SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{{1,2}}\\s*:\\s*[0-9]{{2}}') THEN [] ELSE {sql_runs('text')} END AS r FROM documents)
  SELECT doc_id, CAST(i - 1 AS INT) AS token_index, r[i] AS text FROM (SELECT doc_id, r, unnest(range(1, len(r) + 1)) AS i FROM t)""", fixture=False)
def explode_tokens(spark, folder):
    return gen.explode_tokens(fx.table(spark, folder, "documents").select("doc_id", "text"))


def _grid_sql() -> str:
    rows = [f"({i}, {j}, {a}, {t}, {b}, {d})" for i, (a, b) in enumerate(gen.X_SPANS) for j, (t, d) in enumerate(gen.Y_SPANS)]
    return ", ".join(rows)


@query("geometric_windows", f""", g(i, j, a, t, b, d) AS (VALUES {_grid_sql()}),
 w AS (SELECT image_id, detection_index, 'geometric_window' AS kind, 0.35 - 0.01 * (i + j) AS score, greatest(0, least(1280, x1 + (x2 - x1) * a)) AS wx1, greatest(0, least(720, y1 + (y2 - y1) * t)) AS wy1,
   greatest(0, least(1280, x1 + (x2 - x1) * b)) AS wx2, greatest(0, least(720, y1 + (y2 - y1) * d)) AS wy2 FROM detections, g)
 SELECT image_id, detection_index, kind, {q6('score')} AS score, {q6('wx1')} AS x1, {q6('wy1')} AS y1, {q6('wx2')} AS x2, {q6('wy2')} AS y2 FROM w WHERE wx2 - wx1 >= 14 AND wy2 - wy1 >= 10
 UNION ALL SELECT image_id, detection_index, 'region_full', 0.38::DOUBLE, x1, y1, x2, y2 FROM detections""")
def geometric_windows(spark, folder):
    return gen.once_per_box(fx.detections(spark, folder), ["image_id", "detection_index"], lambda regions, keys: rounded(
        gen.geometric_windows(regions).select(*keys, "kind", "score", "x1", "y1", "x2", "y2"), *keys))


def _frames(spark, folder):
    return fx.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("image_id"), F.lit(fx.WIDTH).alias("image_width"), F.lit(fx.HEIGHT).alias("image_height"))


@query("search_regions")
def search_regions(spark, folder):
    return gen.search_regions(_frames(spark, folder), fx.detections(spark, folder), fx.candidates(spark, folder), slot_bands=True)


@query("broad_regions")
def broad_regions(spark, folder):
    return gen.broad_regions(_frames(spark, folder), fx.detections(spark, folder), fx.candidates(spark, folder))


def _regions(spark, folder):
    return fx.detections(spark, folder).where("class_id IN (0, 3)").withColumn("region_index", F.col("detection_index"))


def _proposals(regions, keys):
    return bs.greedy_nms(gen.geometric_windows(regions), keys, "score", 0.68, arrival=["window_index"], limit=None)


def sql_walk(rows: str, keys: str, order: str, threshold: float, extra: str = "") -> str:
    """Views that walk the boxes of a key one by one; `walked` has those that stay."""
    same = sql_iou("p", "q").replace("q.", "boxes[k + 1].")
    return f""", ord AS (SELECT {keys}, list({{x1: x1, y1: y1, x2: x2, y2: y2{extra}}} ORDER BY {order}) AS boxes FROM {rows} WHERE (x2 - x1) * (y2 - y1) > 0 GROUP BY {keys}),
 walk AS (SELECT {keys}, boxes, 1 AS k, [boxes[1]] AS kept FROM ord UNION ALL
   SELECT {keys}, boxes, k + 1, CASE WHEN len(list_filter(kept, lambda p: {same} > {threshold})) = 0 THEN list_append(kept, boxes[k + 1]) ELSE kept END
   FROM walk WHERE k < len(boxes)),
 walked AS (SELECT {keys}, unnest(kept, recursive := true) FROM walk WHERE k = len(boxes))"""


WINDOWED = f""", g(i, j, a, t, b, d) AS (VALUES {_grid_sql()}),
 regions AS (SELECT image_id, detection_index AS region_index, x1, y1, x2, y2 FROM detections WHERE class_id IN (0, 3)),
 win AS (SELECT image_id, region_index, 'geometric_window' AS kind, 0.35 - 0.01 * (i + j) AS score, 1 + 4 * i + j AS pos, greatest(0.0, least(1280, x1 + (x2 - x1) * a)) AS x1, greatest(0.0, least(720, y1 + (y2 - y1) * t)) AS y1,
   greatest(0.0, least(1280, x1 + (x2 - x1) * b)) AS x2, greatest(0.0, least(720, y1 + (y2 - y1) * d)) AS y2 FROM regions, g),
 prop AS (SELECT * FROM win WHERE x2 - x1 >= 14 AND y2 - y1 >= 10 UNION ALL SELECT image_id, region_index, 'region_full', 0.38::DOUBLE, 0, x1, y1, x2, y2 FROM regions)
 {sql_walk('prop', 'image_id, region_index', 'score DESC, (x2 - x1) * (y2 - y1) DESC, pos', 0.68, ', kind: kind, score: score')}"""


@query("greedy_nms", f"""{WINDOWED} SELECT image_id, region_index, kind, {q6('score')} AS score, {q6('x1')} AS x1, {q6('y1')} AS y1, {q6('x2')} AS x2, {q6('y2')} AS y2 FROM walked""")
def greedy_nms(spark, folder):
    return gen.once_per_box(_regions(spark, folder), ["image_id", "region_index"], lambda regions, keys: rounded(
        _proposals(regions, keys).select(*keys, "kind", "score", "x1", "y1", "x2", "y2"), *keys))


@query("repair_windows")
def repair_windows(spark, folder):
    return gen.once_per_box(_regions(spark, folder), ["image_id", "region_index"],
                            lambda regions, keys: gen.repair_windows(_proposals(regions, keys), keys))


@query("history_windows")
def history_windows(spark, folder):
    locks = fx.detections(spark, folder).where("class_id = 0")
    return gen.history_windows(locks, ["image_id", "detection_index"])


@query("component_spans")
def component_spans(spark, folder):
    """Detections stand in for glyph components; the frame is the region."""
    return gen.component_spans(fx.detections(spark, folder), ["image_id"])


@query("consensus_values", f"""{LABELLED}, e AS (SELECT image_id, prediction AS v, length(prediction) AS n FROM sel)
  SELECT DISTINCT image_id, part FROM (SELECT image_id, v AS part FROM e UNION ALL SELECT image_id, substr(v, 1, 3) FROM e WHERE n > 3 UNION ALL SELECT image_id, right(v, 3) FROM e WHERE n > 3
   UNION ALL SELECT image_id, substr(v, 1, 2) FROM e WHERE n > 2 UNION ALL SELECT image_id, right(v, 2) FROM e WHERE n > 2)""")
def consensus_values(spark, folder):
    return selected(spark, folder).select("image_id", F.explode(gen.consensus_values(F.col("prediction"))).alias("part"))


@query("threshold_grid", f"""{LABELLED}, q AS (SELECT unnest(quantile_cont(score, [i / 20.0 for i in range(0, 21)])) AS t FROM sel)
  SELECT DISTINCT {q6('t')} AS threshold FROM q UNION SELECT 'inf'::DOUBLE UNION SELECT '-inf'::DOUBLE""")
def threshold_grid(spark, folder):
    grid = learn.threshold_grid(selected(spark, folder), "score", 21)
    return rounded(spark.createDataFrame([(t,) for t in grid], "threshold double")).distinct()


HITS = """, hits AS (SELECT image_id, candidate_index AS hit_index, regexp_replace(text, '[^0-9]', '', 'g') AS text, source, ocr_conf, ocr_conf / 2 AS proposal_score,
   CAST(round(x1 / 40) * 40 AS INT) AS k1, CAST(round(y1 / 40) * 40 AS INT) AS k2 FROM candidates WHERE regexp_matches(text, '[0-9]'))"""


def _hits(spark, folder):
    """Readings as recogniser hits on boxes snapped to a coarse grid, so that boxes coincide."""
    snap = lambda c: F.round(F.col(c) / 40) * 40
    return fx.candidates(spark, folder).withColumn("text", tx.digits(F.col("text"))).where("text <> ''").select(
        "image_id", F.col("candidate_index").alias("hit_index"), "text", "source", "ocr_conf", (F.col("ocr_conf") / 2).alias("proposal_score"),
        snap("x1").alias("x1"), snap("y1").alias("y1"), (snap("x1") + 80).alias("x2"), (snap("y1") + 40).alias("y2"))


@query("keep_best_hit", f"""{HITS} SELECT image_id, text, hit_index, {q6('ocr_conf')} AS ocr_conf FROM (SELECT *, row_number() OVER (PARTITION BY image_id, text, k1, k2 ORDER BY ocr_conf DESC, hit_index) AS rn FROM hits) WHERE rn = 1""")
def keep_best_hit(spark, folder):
    return rounded(gen.keep_best_hit(_hits(spark, folder), ["image_id"]).select("image_id", "text", "hit_index", "ocr_conf"))


@query("keep_best_hit_combined", f"""{HITS} SELECT image_id, source, text, hit_index, {q6('round(ocr_conf * 0.72 + proposal_score * 0.28, 6)')} AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY image_id, text, k1, k2, source ORDER BY ocr_conf DESC, hit_index) AS rn FROM hits) WHERE rn = 1""")
def keep_best_hit_combined(spark, folder):
    out = gen.keep_best_hit(_hits(spark, folder), ["image_id"], by_source=True, combined=True)
    return rounded(out.select("image_id", "source", "text", "hit_index", "score"))


@query("region_hits")
def region_hits(spark, folder):
    hits = gen.keep_best_hit(_hits(spark, folder), ["image_id"]).withColumn("region_index", (F.col("x1") / 300).cast("int"))
    return gen.region_hits(hits.drop("hit_index"), 35)


def _truth_boxes(spark, folder):
    """Readings of the first source stand in for annotated boxes."""
    return fx.candidates(spark, folder).where("source = 'original_ocr'").select(
        "image_id", F.col("candidate_index").alias("truth_index"), "x1", "y1", "x2", "y2")


MATCHED = f""", truth AS (SELECT image_id, candidate_index AS truth_index, x1, y1, x2, y2 FROM candidates WHERE source = 'original_ocr'),
 level(threshold) AS (VALUES (0.5::DOUBLE), (0.75::DOUBLE)),
 pair AS (SELECT image_id, threshold, detection_index, truth_index, conf, {sql_iou('d', 't')} AS overlap FROM detections d JOIN truth t USING (image_id), level),
 por AS (SELECT image_id, threshold, list({{d: detection_index, t: truth_index}} ORDER BY conf DESC, detection_index, overlap DESC, truth_index) AS pairs
   FROM pair WHERE overlap >= threshold AND overlap > 0 GROUP BY image_id, threshold),
 take AS (SELECT image_id, threshold, pairs, 1 AS k, [pairs[1]] AS got FROM por UNION ALL
   SELECT image_id, threshold, pairs, k + 1, CASE WHEN len(list_filter(got, lambda p: p.d = pairs[k + 1].d OR p.t = pairs[k + 1].t)) = 0 THEN list_append(got, pairs[k + 1]) ELSE got END
   FROM take WHERE k < len(pairs)),
 taken AS (SELECT image_id, threshold, unnest(got, recursive := true) FROM take WHERE k = len(pairs))"""


@query("match_boxes", f"""{MATCHED} SELECT a.image_id, a.detection_index, l.threshold, t.t AS truth_index, CAST(t.t IS NOT NULL AS INT) AS tp, {q6('a.conf')} AS conf
 FROM detections a CROSS JOIN level l LEFT JOIN taken t ON a.image_id = t.image_id AND a.detection_index = t.d AND l.threshold = t.threshold""")
def match_boxes(spark, folder):
    out = bs.match_boxes(fx.detections(spark, folder), _truth_boxes(spark, folder), (0.5, 0.75))
    return rounded(out.select("image_id", "detection_index", "threshold", "truth_index", "tp", "conf"), "threshold")


@query("detection_metrics")
def detection_metrics(spark, folder):
    return bs.detection_metrics(fx.detections(spark, folder), _truth_boxes(spark, folder), _frames(spark, folder))


@query("pr_curve", f""", m AS (SELECT image_id, detection_index, conf, CASE WHEN class_id = 0 THEN 1 ELSE 0 END AS tp FROM detections),
 r AS (SELECT *, sum(tp) OVER w AS ts, row_number() OVER w AS rk FROM m WINDOW w AS (ORDER BY conf DESC, image_id, detection_index ROWS UNBOUNDED PRECEDING)),
 p AS (SELECT *, ts / rk AS precision FROM r)
 SELECT image_id, detection_index, CAST(ts AS BIGINT) AS tp_sum, rk AS rank, {q6('precision')} AS precision, {q6('ts / (SELECT sum(tp) FROM m)')} AS recall,
  {q6('max(precision) OVER (ORDER BY conf DESC, image_id, detection_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS interpolated FROM p""")
def pr_curve(spark, folder):
    """Channel boxes count as true positives, every other class as false."""
    rows = fx.detections(spark, folder).select("image_id", "detection_index", "conf", (F.col("class_id") == 0).cast("int").alias("tp"),
                                               F.lit(0.5).alias("threshold"))
    total = rows.agg(F.sum("tp")).collect()[0][0]
    return rounded(bs.pr_curve(rows, total).select("image_id", "detection_index", "tp_sum", "rank", "precision", "recall", "interpolated"))
