"""Queries over training rows, weights, sweeps and fitted models; sequences, merges and leakage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from framefusion.functions import text as tx
from framefusion.functions.linear import linear_score
from framefusion.operators import frames as fr
from framefusion.operators import learn
from framefusion.operators import slots as sl
from framefusion.plans import fixtures as fx
from framefusion.plans.registry import q6, query, r6, rounded, sql_class, sql_best_digit, sql_digits, sql_strip
from framefusion.plans.relations import KEY
from framefusion.plans.selection import LABELLED, evaluation_sql, labelled, selected
from framefusion.plans.temporal import READ

FEATURES = ["ocr_conf", "candidate_digit_len", "plain", "left"]


def _training(spark, folder):
    rows = labelled(spark, folder).where("split = 'train'")
    return rows.withColumn("plain", tx.is_plain_numeric(F.col("text")).cast("double")).withColumn("left", (F.col("x1") / 1280))


TRAIN = f"""{LABELLED}, tr AS (SELECT *, length(digits)::DOUBLE AS candidate_digit_len, CAST(regexp_matches(text, '^\\s*[0-9]{{1,5}}\\s*$') AS DOUBLE) AS plain, x1 / 1280 AS "left" FROM lab WHERE split = 'train')"""


@query("standardize_fit", f"""{TRAIN} SELECT {', '.join(f'{q6(f"avg({chr(34)}{c}{chr(34)})")} AS mean_{c}, {q6(f"CASE WHEN stddev_pop({chr(34)}{c}{chr(34)}) < 1e-8 THEN 1 ELSE stddev_pop({chr(34)}{c}{chr(34)}) END")} AS std_{c}' for c in FEATURES)} FROM tr""")
def standardize_fit(spark, folder):
    return rounded(learn.standardize_table(_training(spark, folder), FEATURES))


@query("frame_balanced_weights", f"""{TRAIN}, c AS (SELECT *, sum(label_exact) OVER (PARTITION BY image_id) AS p, count(*) OVER (PARTITION BY image_id) AS n FROM tr),
  w AS (SELECT *, CASE WHEN p > 0 AND n - p > 0 THEN CASE WHEN label_exact = 1 THEN 0.5 / p ELSE 0.5 / (n - p) END ELSE 1.0 / n END AS raw FROM c)
  SELECT image_id, candidate_index, {q6('raw / (SELECT avg(raw) FROM w)')} AS weight FROM w""")
def frame_balanced_weights(spark, folder):
    return rounded(learn.frame_balanced_weights(_training(spark, folder)).select(*KEY, "weight"))


@query("sweep_thresholds", f"""{LABELLED}, g AS (SELECT unnest([-1.0, -0.2, 0.0, 0.3, 0.5, 0.75, 0.9, 1.1])::DOUBLE AS t),
  x AS (SELECT t AS threshold, sel.* FROM sel, g) SELECT threshold, {evaluation_sql('threshold')} FROM x GROUP BY threshold""")
def sweep_thresholds(spark, folder):
    return rounded(learn.sweep_thresholds(selected(spark, folder), [-1.0, -0.2, 0.0, 0.3, 0.5, 0.75, 0.9, 1.1]), "threshold")


@query("best_threshold", f"""{LABELLED}, g AS (SELECT unnest([-1.0, -0.2, 0.0, 0.3, 0.5, 0.75, 0.9, 1.1])::DOUBLE AS t), x AS (SELECT t AS threshold, sel.* FROM sel, g),
  e AS (SELECT threshold, {evaluation_sql('threshold')} FROM x GROUP BY threshold)
  SELECT threshold, final_exact_accuracy, no_ui_fp_rate FROM e ORDER BY CAST(no_ui_fp_rate <= 0.5 AS INT) DESC, final_exact_accuracy DESC, wrong_output_count, output_precision DESC, coverage DESC, no_ui_fp_rate, threshold LIMIT 1""")
def best_threshold(spark, folder):
    sweep = learn.sweep_thresholds(selected(spark, folder), [-1.0, -0.2, 0.0, 0.3, 0.5, 0.75, 0.9, 1.1])
    return rounded(learn.best_threshold(sweep, 0.5).select("threshold", "final_exact_accuracy", "no_ui_fp_rate"), "threshold")


@query("choose_model", f"""{LABELLED}, g(model, t) AS (VALUES ('a', 0.0), ('b', 0.5), ('c', 0.9)), x AS (SELECT model, t, sel.* FROM sel, g),
  e AS (SELECT model, sum(CASE WHEN split <> 'no_ui_val' AND score >= t THEN selected_exact ELSE 0 END) / count(*) FILTER (split <> 'no_ui_val') AS acc FROM x GROUP BY model)
  SELECT model, {q6('acc')} AS final_exact_accuracy FROM e ORDER BY acc DESC LIMIT 1""")
def choose_model(spark, folder):
    from framefusion.operators.measures import evaluate
    s = selected(spark, folder)
    rows = [evaluate(s, t).withColumn("model", F.lit(m)).withColumn("provider_worst_accuracy", F.lit(0.0)) for m, t in (("a", 0.0), ("b", 0.5), ("c", 0.9))]
    best = learn.choose_model(rows[0].unionByName(rows[1]).unionByName(rows[2]))
    return rounded(best.select("model", "final_exact_accuracy"))


@query("training_rows", f"""{LABELLED} SELECT image_id, candidate_index, split, label_exact, label_numeric_equiv FROM lab WHERE split = 'no_ui_val' OR gt_text <> ''""")
def training_rows(spark, folder):
    return learn.training_rows(fx.candidates(spark, folder), fx.ground_truth(spark, folder)).select(*KEY, "split", "label_exact", "label_numeric_equiv")


@query("training_summary", f"""{LABELLED}, h AS (SELECT image_id, max(label_exact) AS hit, count(*) AS n FROM lab WHERE split = 'no_ui_val' OR gt_text <> '' GROUP BY 1)
  SELECT split, count(*) FILTER (split = 'no_ui_val' OR gt_text <> '') AS image_count, count(*) FILTER (split <> 'no_ui_val' AND gt_text = '') AS skipped_no_gt, CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count,
   CAST(sum(CASE WHEN split <> 'no_ui_val' THEN coalesce(hit, 0) ELSE 0 END) AS BIGINT) AS oracle_hit_count, CASE WHEN split <> 'no_ui_val' THEN {q6('sum(coalesce(hit, 0)) / count(*)')} END AS oracle_accuracy FROM frames LEFT JOIN h USING (image_id) GROUP BY split""")
def training_summary(spark, folder):
    truth = fx.ground_truth(spark, folder)
    rows = learn.training_rows(fx.candidates(spark, folder), truth)
    return rounded(learn.training_summary(rows, truth))


@query("train_pointwise")
def train_pointwise(spark, folder):
    return learn.train_pointwise(_training(spark, folder), FEATURES, 0.0008).as_rows(spark)


@query("train_pairwise")
def train_pairwise(spark, folder):
    return learn.train_pairwise(_training(spark, folder), FEATURES, 0.0008).as_rows(spark)


@query("pair_differences")
def pair_differences(spark, folder):
    rows = _training(spark, folder)
    mean, std = learn.standardize_fit(rows, FEATURES)
    return learn.pair_differences(rows, FEATURES, mean, std)


@query("provider_oof")
def provider_oof(spark, folder):
    return learn.provider_oof(_training(spark, folder), FEATURES, 0.0015).select(*KEY, "provider", "oof_score")


@query("infer_features")
def infer_features(spark, folder):
    names = learn.infer_features(_training(spark, folder))
    return spark.createDataFrame([(n,) for n in sorted(names)], "feature string")


@query("embedding_scorer")
def embedding_scorer(spark, folder):
    """A pointwise model over embedding dimensions: label above the median class, one 'frame' per ten vectors."""
    rows = fx.table(spark, folder, "embeddings").select(
        (F.col("vec_id") % 50).alias("image_id"), F.col("vec_id").alias("candidate_index"), (F.col("label") % 2).cast("int").alias("label_train"),
        *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    model = learn.train_pointwise(rows, [f"e{i}" for i in range(64)], 0.01)
    return rows.select("image_id", "candidate_index", linear_score(rows, model).alias("score"))


@query("build_sequences", "SELECT CAST(sequence_id AS STRING) AS sequence_id, CAST(row_number() OVER (PARTITION BY sequence_id ORDER BY image_id) AS INT) AS frame_index, image_id FROM frames")
def build_sequences(spark, folder):
    f = fx.ground_truth(spark, folder).select(F.col("sequence_id").alias("folder"), "image_id")
    return fr.build_sequences(f).select("sequence_id", "frame_index", "image_id")


@query("read_sequences", """SELECT CAST(sequence_id AS STRING) AS sequence_id, CAST(row_number() OVER (PARTITION BY sequence_id ORDER BY image_id DESC) AS INT) AS frame_index, image_id FROM frames WHERE image_id % 4 <> 0""")
def read_sequences(spark, folder):
    """A manifest in falling order, with ids that are not among the frames."""
    f = fx.ground_truth(spark, folder).select("image_id", "sequence_id")
    pieces = f.groupBy("sequence_id", F.floor(F.col("image_id") / 1024).alias("piece")).agg(
        F.reverse(F.array_sort(F.collect_list("image_id"))).alias("images"))
    manifest = pieces.select(F.col("sequence_id").cast("string").alias("sequence_id"), F.lit("").alias("group_key"),
                             (F.col("piece") * -1024).alias("offset"), "images")
    known = f.where("image_id % 4 <> 0")
    return fr.manifest_sequences(manifest, known).select("sequence_id", "frame_index", "image_id")


@query("resume_missing", "SELECT image_id FROM frames WHERE image_id NOT IN (SELECT image_id FROM candidates WHERE candidate_index >= 4)")
def resume_missing(spark, folder):
    return fr.resume_missing(fx.ground_truth(spark, folder).select("image_id"), fx.candidates(spark, folder).where("candidate_index >= 4"))


@query("merge_partials", """SELECT f.image_id, p.text AS record FROM frames f LEFT JOIN (SELECT image_id, arg_max(text, candidate_index) AS text FROM candidates GROUP BY 1) p USING (image_id)""")
def merge_partials(spark, folder):
    partials = fx.candidates(spark, folder).select("image_id", F.col("candidate_index").alias("chunk_no"), F.col("text").alias("record"))
    return fr.merge_partials(fx.ground_truth(spark, folder).select("image_id"), partials).select("image_id", "record")


@query("status_counts", "SELECT source AS status, count(*) AS records FROM candidates GROUP BY 1")
def status_counts(spark, folder):
    return fr.status_counts(fx.candidates(spark, folder).select(F.col("source").alias("status")))


@query("union_candidates", f"""SELECT image_id, text, source, CAST(row_number() OVER (PARTITION BY image_id ORDER BY st, candidate_index) AS INT) AS candidate_index FROM (SELECT image_id, candidate_index, text, source, 0 AS st FROM candidates WHERE source <> 'slot_proposal_recheck'
   UNION ALL SELECT image_id, candidate_index, text, source, 1 FROM candidates WHERE source = 'slot_proposal_recheck')""")
def union_candidates(spark, folder):
    c = fx.candidates(spark, folder)
    out = fr.union_candidates(c.where("source <> 'slot_proposal_recheck'"), c.where("source = 'slot_proposal_recheck'"))
    return out.select("image_id", "text", "source", "candidate_index")


SIDES = f"""{READ}, p AS (SELECT image_id, arg_max(value, (conf, -candidate_index)) AS v1, max(conf) AS c1 FROM ch WHERE cx < 0.25 GROUP BY 1),
  s AS (SELECT image_id, arg_max(value, (conf, -candidate_index)) AS v2, max(conf) AS c2 FROM ch WHERE cx >= 0.25 GROUP BY 1), j AS (SELECT * FROM p FULL JOIN s USING (image_id))"""


def _sides(spark, folder):
    from framefusion.operators.skew import best_row
    from framefusion.plans.temporal import readings
    rows = sl.channel_like(readings(spark, folder)).select("image_id", "cx", "value", "conf", "candidate_index")
    best = lambda df: best_row(df, ["image_id"], [F.col("conf"), -F.col("candidate_index")]).select("image_id", "value", "conf")
    return best(rows.where("cx < 0.25")), best(rows.where("cx >= 0.25"))


@query("merge_readings", f"{SIDES} SELECT image_id, CASE WHEN v1 IS NOT NULL AND v2 IS NOT NULL AND c1 < c2 THEN v2 ELSE coalesce(v1, v2) END AS value FROM j")
def merge_readings(spark, folder):
    return fr.merge_readings(*_sides(spark, folder), mode="confident").select("image_id", "value")


@query("second_fill_correct", f"""{SIDES} SELECT image_id, CASE WHEN v1 IS NULL OR (v2 IS NOT NULL AND c1 < 0.7 AND c2 > c1) THEN v2 ELSE v1 END AS value,
   CASE WHEN v1 IS NULL THEN 'filled' WHEN v2 IS NOT NULL AND c1 < 0.7 AND c2 > c1 THEN 'corrected' ELSE 'kept' END AS action FROM j""")
def second_fill_correct(spark, folder):
    return fr.second_fill_correct(*_sides(spark, folder), conf_gate=0.7)


@query("override_with_field", f"{SIDES} SELECT image_id, coalesce(v2, v1) AS value, v1 IS NULL AS added, coalesce(v1 <> v2, false) AS overridden FROM j")
def override_with_field(spark, folder):
    return fr.override_with_field(*_sides(spark, folder))


@query("selected_box", f"""{LABELLED}, pr AS (SELECT image_id, prediction, CASE WHEN image_id % 2 = 0 THEN candidate_index END AS ci FROM sel), fi AS (SELECT image_id, {sql_digits('text')} AS prediction, arg_min(x1, candidate_index) AS fx FROM candidates GROUP BY ALL)
  SELECT pr.image_id, coalesce(c.x1, fx) AS x1 FROM pr LEFT JOIN candidates c ON pr.image_id = c.image_id AND ci = c.candidate_index LEFT JOIN fi ON fi.image_id = pr.image_id AND fi.prediction = pr.prediction""")
def selected_box(spark, folder):
    rows = selected(spark, folder).select("image_id", "prediction", F.when(F.col("image_id") % 2 == 0, F.col("candidate_index")).alias("candidate_index"))
    return fr.selected_box(rows, fx.candidates(spark, folder)).select("image_id", "x1")


@query("locked_box", "SELECT image_id, CASE WHEN image_id % 3 = 0 THEN NULL WHEN image_id % 3 = 1 THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END AS x1 FROM frames")
def locked_box(spark, folder):
    key = F.col("image_id")
    rows = fx.ground_truth(spark, folder).select(
        "image_id", *[F.when(key % 3 == 1, 10.0).alias(f"after_{c}") for c in ("x1", "y1", "x2", "y2")],
        *[F.when(key % 3 != 0, 20.0).alias(f"before_{c}") for c in ("x1", "y1", "x2", "y2")])
    return fr.locked_box(rows).select("image_id", "x1")


@query("leakage_scan", """SELECT doc_id, CASE WHEN contains(replace(replace(replace(replace(lower(text), 'no_mit', ''), 'no-mit', ''), 'non_mit', ''), 'non-mit', ''), 'mit') THEN CASE WHEN doc_id % 3 = 0 THEN 'warning' ELSE 'violation' END ELSE 'clean' END AS verdict FROM documents""", fixture=False)
def leakage_scan(spark, folder):
    """Whole documents; a third of them in an allowed role."""
    docs = fx.table(spark, folder, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "final_test").otherwise("train").alias("role"))
    return fr.leakage_scan(docs, "mit", "text").select("doc_id", "verdict")


@query("crop_manifest", f"""SELECT f.image_id, {sql_strip('gt_text')} AS label, greatest(0, CAST(trunc(c.x1 - (c.x2 - c.x1) * 0.25) AS BIGINT)) AS cx1, least(1280, CAST(trunc(c.x2 + (c.x2 - c.x1) * 0.7) AS BIGINT)) AS cx2
  FROM frames f JOIN (SELECT sequence_id, max(x1) AS x1, max(y1) AS y1, max(x1) + 60 AS x2, max(y1) + 30 AS y2 FROM candidates JOIN frames USING (image_id) GROUP BY 1) c USING (sequence_id) WHERE gt_text <> ''""")
def crop_manifest(spark, folder):
    truth = fx.ground_truth(spark, folder)
    fields = fx.candidates(spark, folder).join(truth.select("image_id", "sequence_id"), "image_id").groupBy(F.col("sequence_id").alias("folder")).agg(
        F.max("x1").alias("x1"), F.max("y1").alias("y1"), (F.max("x1") + 60).alias("x2"), (F.max("y1") + 30).alias("y2"))
    frames = truth.select(F.col("sequence_id").alias("folder"), "image_id", F.col("gt_text").alias("stem"), F.lit(1280).alias("image_width"), F.lit(720).alias("image_height"))
    return fr.crop_manifest(fields, frames).select("image_id", "label", "cx1", "cx2")
