"""Queries over selected readings: evaluation, thresholds, votes, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from framefusion.functions import text as tx
from framefusion.operators import learn, measures, rules
from framefusion.plans import fixtures as fx
from framefusion.plans.registry import q6, query, r6, rounded, sql_class, sql_best_digit, sql_digits, sql_strip
from framefusion.plans.relations import KEY

SCORE_SQL = "c.ocr_conf * 2 - 1 + CASE WHEN regexp_matches(c.text, '^\\s*[0-9]{1,5}\\s*$') THEN 0.25 ELSE 0 END"
LABELLED = f""", lab AS (
  SELECT c.*, f.split, f.provider, f.sequence_id, f.frame_index, f.gt_text, {sql_digits('c.text')} AS digits, CAST({SCORE_SQL} AS DOUBLE) AS score,
    CAST(f.gt_text <> '' AND {sql_digits('c.text')} = f.gt_text AS INT) AS label_exact,
    CAST(f.gt_text <> '' AND {sql_strip(sql_digits('c.text'))} = {sql_strip('f.gt_text')} AS INT) AS label_numeric_equiv
  FROM candidates c JOIN frames f USING (image_id) WHERE {sql_digits('c.text')} <> ''),
 sel AS (SELECT split, provider, sequence_id, frame_index, gt_text, image_id, candidate_index, score, digits AS prediction, source AS selected_source, label_exact AS selected_exact,
    label_numeric_equiv AS selected_numeric_equiv, ce AS correct_candidate_exists, ne AS numeric_equiv_candidate_exists FROM (
    SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, candidate_index) AS rn, max(label_exact) OVER (PARTITION BY image_id) AS ce,
      max(label_numeric_equiv) OVER (PARTITION BY image_id) AS ne FROM lab) WHERE rn = 1)"""


def labelled(spark, folder):
    truth = fx.frames(spark, folder).select("image_id", "split", "provider", "sequence_id", "frame_index", "gt_text")
    rows = fx.candidates(spark, folder).withColumn("digits", tx.digits(F.col("text"))).where("digits <> ''").join(truth, "image_id")
    known = F.col("gt_text") != ""
    same = tx.strip_zeros(F.col("digits")) == tx.strip_zeros(F.col("gt_text"))
    plain = F.when(tx.is_plain_numeric(F.col("text")), 0.25).otherwise(0.0)
    return (
        rows.withColumn("score", F.col("ocr_conf") * 2 - 1 + plain)
        .withColumn("label_exact", (known & (F.col("digits") == F.col("gt_text"))).cast("int"))
        .withColumn("label_numeric_equiv", (known & same).cast("int")).withColumn("label_train", F.col("label_exact"))
        .withColumn("candidate_digit_len", F.length("digits").cast("double"))
    )


def selected(spark, folder):
    best = rules.select_best(
        labelled(spark, folder), "score", correct_candidate_exists=F.max("label_exact"),
        numeric_equiv_candidate_exists=F.max("label_numeric_equiv"))
    return best.select(
        "split", "provider", "sequence_id", "frame_index", "gt_text", "image_id", "candidate_index", "score",
        F.col("digits").alias("prediction"), F.col("source").alias("selected_source"),
        F.col("label_exact").alias("selected_exact"), F.col("label_numeric_equiv").alias("selected_numeric_equiv"),
        "correct_candidate_exists", "numeric_equiv_candidate_exists")


@query("select_best", f"""{LABELLED} SELECT image_id, candidate_index, {q6('score')} AS score, prediction, selected_exact, selected_numeric_equiv,
  correct_candidate_exists, numeric_equiv_candidate_exists FROM sel""")
def select_best(spark, folder):
    return rounded(selected(spark, folder).select(
        *KEY, "score", "prediction", "selected_exact", "selected_numeric_equiv", "correct_candidate_exists",
        "numeric_equiv_candidate_exists"))


def evaluation_sql(t: str) -> str:
    v, o = "split <> 'no_ui_val'", f"score >= {t}"
    cnt = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
    tot = lambda c, x: f"CAST(sum(CASE WHEN {c} THEN {x} ELSE 0 END) AS BIGINT)"
    vc, oc = cnt(v), cnt(f"{v} AND {o}")
    ex, nu, orc = tot(f"{v} AND {o}", "selected_exact"), tot(f"{v} AND {o}", "selected_numeric_equiv"), tot(v, "correct_candidate_exists")
    un, fp = cnt(f"NOT ({v})"), cnt(f"NOT ({v}) AND {o}")
    div = lambda a, b: q6(f"{a} / greatest(1, {b})")
    return f"""{vc} AS valid_gt_count, {oc} AS output_count, {div(oc, vc)} AS coverage, {ex} AS final_exact_correct_count, {nu} AS final_numeric_equiv_correct_count,
      {div(ex, vc)} AS final_exact_accuracy, {div(nu, vc)} AS final_numeric_equiv_accuracy, {div(ex, oc)} AS output_precision, {oc} - {ex} AS wrong_output_count,
      {vc} - {oc} AS no_output_count, {div(orc, vc)} AS candidate_oracle_exact_accuracy, {orc} AS oracle_hit_count, {vc} - {orc} AS no_correct_candidate_count,
      {div(ex, orc)} AS selector_accuracy_given_correct_candidate_exists, {cnt(f'{v} AND {o} AND correct_candidate_exists = 1 AND selected_exact = 0')} AS correct_candidate_exists_but_not_selected_count,
      {cnt(f'{v} AND correct_candidate_exists = 1 AND NOT ({o})')} AS correct_candidate_exists_but_thresholded_or_rejected_count, {un} AS no_ui_image_count, {fp} AS no_ui_fp, {div(fp, un)} AS no_ui_fp_rate"""


@query("evaluate", f"{LABELLED} SELECT {evaluation_sql('0.5')}, 0.5::DOUBLE AS threshold FROM sel")
def evaluate(spark, folder):
    return rounded(measures.evaluate(selected(spark, folder), 0.5), "threshold")


@query("evaluate_by", f"""{LABELLED}, v AS (SELECT * FROM sel WHERE split <> 'no_ui_val') SELECT provider, {evaluation_sql('0.5')} FROM v GROUP BY provider
  UNION ALL SELECT NULL, {evaluation_sql('0.5')} FROM v""")
def evaluate_by(spark, folder):
    return rounded(measures.evaluate_by(selected(spark, folder), 0.5))


@query("worst_and_best", f"""{LABELLED}, p AS (SELECT provider, sum(CASE WHEN score >= 0.5 THEN selected_exact ELSE 0 END) / count(*) AS a FROM sel WHERE split <> 'no_ui_val' GROUP BY 1)
  SELECT {q6('min(a)')} AS provider_worst_accuracy, {q6('max(a)')} AS provider_best_accuracy FROM p""")
def worst_and_best(spark, folder):
    return rounded(measures.worst_and_best(measures.evaluate_by(selected(spark, folder), 0.5)))


@query("row_summary", f"""{LABELLED} SELECT 'all' AS dimension, '' AS name, count(*) AS rows FROM lab UNION ALL SELECT 'split', split, count(*) FROM lab GROUP BY 2
  UNION ALL SELECT 'provider', provider, count(*) FROM lab WHERE split IN ('train', 'val') GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM lab GROUP BY 2""")
def row_summary(spark, folder):
    return measures.row_summary(labelled(spark, folder))


@query("upper_bound", f"""{LABELLED}, f AS (SELECT split, image_id, max(label_exact) AS e, max(label_numeric_equiv) AS n FROM lab GROUP BY ALL)
  SELECT split, count(*) AS images, CAST(sum(e) AS BIGINT) AS label_exact_frames, CAST(sum(n) AS BIGINT) AS label_numeric_equiv_frames FROM f GROUP BY split""")
def upper_bound(spark, folder):
    return measures.upper_bound(labelled(spark, folder).drop("label_train"))


@query("selection_summary", f"""{LABELLED} SELECT selected_source, count(*) AS images, CAST(sum(selected_exact) AS BIGINT) AS correct,
  CAST(sum(1 - selected_exact) AS BIGINT) AS wrong FROM sel GROUP BY 1""")
def selection_summary(spark, folder):
    return measures.selection_summary(selected(spark, folder))


@query("score_threshold", f"""{LABELLED} SELECT image_id, CAST(score >= 0.8 AS INT) AS output, CASE WHEN score >= 0.8 THEN prediction ELSE '' END AS final_prediction,
  CASE WHEN score >= 0.8 THEN selected_exact ELSE 0 END AS exact_match, CASE WHEN score >= 0.8 THEN '' ELSE 'ranker_threshold' END AS reject_reason FROM sel""")
def score_threshold(spark, folder):
    out = rules.score_threshold(selected(spark, folder), "score", 0.8)
    return out.select("image_id", "output", "final_prediction", "exact_match", "reject_reason")


@query("attach_truth", f"""{LABELLED} SELECT image_id, prediction, gt_text AS ground_truth, CASE WHEN gt_text <> '' THEN CAST(prediction = gt_text AS INT) END AS exact,
  CASE WHEN gt_text <> '' THEN CAST({sql_strip('prediction')} = {sql_strip('gt_text')} AS INT) END AS numeric_exact FROM sel""")
def attach_truth(spark, folder):
    truth = fx.ground_truth(spark, folder)
    return measures.attach_truth(selected(spark, folder).select("image_id", "prediction"), truth, "gt_text").select(
        "image_id", "prediction", "ground_truth", "exact", "numeric_exact")


@query("failures", f"{LABELLED} SELECT image_id, prediction, gt_text AS ground_truth FROM sel WHERE gt_text <> '' AND prediction <> gt_text")
def failures(spark, folder):
    truth = fx.ground_truth(spark, folder)
    rows = measures.attach_truth(selected(spark, folder).select("image_id", "prediction"), truth, "gt_text")
    return measures.failures(rows).select("image_id", "prediction", "ground_truth")


@query("add_missing_frames", f"""{LABELLED} SELECT f.image_id, f.split, coalesce(s.prediction, '') AS prediction, coalesce(s.selected_exact, 0) AS selected_exact,
  s.image_id IS NULL AS missing FROM frames f LEFT JOIN sel s USING (image_id)""")
def add_missing_frames(spark, folder):
    from framefusion.operators.frames import add_missing_frames as add
    out = add(selected(spark, folder), fx.ground_truth(spark, folder))
    return out.select("image_id", "split", "prediction", "selected_exact", (F.col("score") == float("-inf")).alias("missing"))


@query("eligible_only", f"""{LABELLED}, ok AS (SELECT image_id, candidate_index FROM lab WHERE score > 0.2 AND split <> 'no_ui_val')
  SELECT l.image_id, l.candidate_index, l.split FROM lab l WHERE l.split = 'no_ui_val' OR (image_id, candidate_index) IN (SELECT (image_id, candidate_index) FROM ok)""")
def eligible_only(spark, folder):
    from framefusion.operators.frames import eligible_only as keep
    rows = labelled(spark, folder)
    listed = rows.where("score > 0.2 AND split <> 'no_ui_val'").select(*KEY, "split")
    return keep(rows, listed, list(KEY), splits_with_list=["train", "val"]).select(*KEY, "split")


@query("eligible_counts", f"""{LABELLED} SELECT split, count(*) AS input, CAST(sum(CASE WHEN split = 'no_ui_val' OR score > 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN split <> 'no_ui_val' AND score <= 0.2 THEN 1 ELSE 0 END) AS BIGINT) AS rejected FROM lab GROUP BY 1""")
def eligible_counts(spark, folder):
    from framefusion.operators.frames import eligible_counts as counts
    rows = labelled(spark, folder)
    listed = rows.where("score > 0.2 AND split <> 'no_ui_val'").select(*KEY, "split")
    return counts(rows, listed, list(KEY), splits_with_list=["train", "val"])


@query("majority_vote", f"""{LABELLED}, v AS (SELECT sequence_id, prediction, count(*) AS n, min(frame_index) AS ff FROM sel GROUP BY ALL)
  SELECT sequence_id, prediction AS value, {q6('n / t')} AS confidence, CAST(t AS BIGINT) AS n_frames FROM (SELECT *, sum(n) OVER (PARTITION BY sequence_id) AS t,
    row_number() OVER (PARTITION BY sequence_id ORDER BY n DESC, ff) AS rk FROM v) WHERE rk = 1""")
def majority_vote(spark, folder):
    return rounded(measures.majority_vote(selected(spark, folder), "sequence_id", "prediction", "frame_index"))


FOLDERS = f"""{LABELLED}, pf AS (SELECT f.sequence_id AS folder, f.frame_index, f.gt_text AS truth, CASE WHEN s.score >= 0.6 THEN s.prediction ELSE '' END AS prediction
    FROM frames f LEFT JOIN sel s USING (image_id)),
 vt AS (SELECT folder, prediction AS vote FROM (SELECT folder, prediction, row_number() OVER (PARTITION BY folder ORDER BY count(*) DESC, min(frame_index)) AS rk FROM pf
    WHERE prediction <> '' GROUP BY folder, prediction) WHERE rk = 1),
 j AS (SELECT pf.*, coalesce(vote, '') AS vote FROM pf LEFT JOIN vt USING (folder))"""


def per_frame(spark, folder):
    s = selected(spark, folder).select("image_id", F.when(F.col("score") >= 0.6, F.col("prediction")).otherwise("").alias("prediction"))
    frames = fx.frames(spark, folder).select(
        "image_id", F.col("sequence_id").alias("folder"), "frame_index", F.col("gt_text").alias("truth"))
    return frames.join(s, "image_id", "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))


P, TR, VO = (sql_strip(x) for x in ("prediction", "truth", "vote"))


@query("folder_summary", f"""{FOLDERS}, a AS (SELECT folder, max(vote) AS predicted_value, count(*) AS n_frames, count(*) FILTER (prediction <> '') AS n_read,
    count(*) FILTER (truth <> '') AS scored, count(*) FILTER (truth <> '' AND {P} = {TR}) AS success FROM j GROUP BY folder)
  SELECT folder, predicted_value, n_frames, n_read, {q6('n_read / n_frames * 100')} AS read_rate, scored, success, scored - success AS fail,
   CASE WHEN scored > 0 THEN {q6('success / scored * 100')} END AS accuracy FROM a""")
def folder_summary(spark, folder):
    return rounded(measures.folder_summary(per_frame(spark, folder)))


@query("folder_consistency", f"""{FOLDERS}, a AS (SELECT folder, max(vote) AS predicted_value, count(*) AS n_frames, count(*) FILTER (prediction <> '') AS n_read,
    count(*) FILTER (prediction <> '' AND {P} = {VO}) AS hits FROM j GROUP BY folder)
  SELECT folder, predicted_value, n_frames, n_read, {q6('n_read / n_frames * 100')} AS read_rate, CASE WHEN n_read > 0 THEN {q6('hits / n_read * 100')} ELSE 0 END AS consistency FROM a""")
def folder_consistency(spark, folder):
    return rounded(measures.folder_summary(per_frame(spark, folder), "consistency"))


def _triple(group: str) -> str:
    return f"""SELECT {group} AS folder, count(*) AS total, count(*) FILTER (prediction <> '') AS read, count(*) FILTER (prediction <> '' AND {P} = {TR}) AS correct FROM j WHERE truth <> ''"""


@query("accuracy_triple", f"""{FOLDERS}, a AS ({_triple('folder')} GROUP BY folder UNION ALL {_triple('NULL')})
  SELECT *, {q6('correct / total * 100')} AS end_to_end, {q6('read / total * 100')} AS coverage, CASE WHEN read > 0 THEN {q6('correct / read * 100')} ELSE 0 END AS when_read FROM a""")
def accuracy_triple(spark, folder):
    return rounded(measures.accuracy_triple(per_frame(spark, folder)))


@query("uncertainty_gate", f"""{LABELLED} SELECT image_id, {q6('score')} AS uncertainty_gate_score, CASE WHEN image_id % 13 = 0 THEN 'uncertainty_out_of_pool_prediction'
   WHEN score < 0.7 THEN 'uncertainty_score_below_threshold' ELSE '' END AS uncertainty_gate_reject_reason,
   CASE WHEN image_id % 13 = 0 OR score < 0.7 THEN '' ELSE prediction END AS prediction, CASE WHEN image_id % 13 = 0 OR score < 0.7 THEN prediction END AS prediction_before_uncertainty_gate FROM sel""")
def uncertainty_gate(spark, folder):
    rows = selected(spark, folder).withColumn("final_pred_in_candidate_pool", (F.col("image_id") % 13 != 0).cast("int"))
    out = measures.uncertainty_gate(rows, 0.7, reject_out_of_pool=True)
    return rounded(out.select("image_id", "uncertainty_gate_score", "uncertainty_gate_reject_reason", "prediction",
                              "prediction_before_uncertainty_gate"))


@query("gate_evaluate", f"""{FOLDERS}, a AS (SELECT count(*) AS n, count(*) FILTER (prediction <> '') AS o, count(*) FILTER (prediction <> '' AND {P} = {TR}) AS c FROM j WHERE truth <> '')
  SELECT n AS valid_gt_count, c AS final_exact_correct_count, {q6('c / n')} AS final_prediction_exact_accuracy, {q6('o / n')} AS coverage, o - c AS final_wrong_output_count,
   n - o AS final_no_output_count, {q6('c / o')} AS output_precision FROM a""")
def gate_evaluate(spark, folder):
    return rounded(measures.gate_evaluate(per_frame(spark, folder)))


@query("no_ui_summary", f"""{FOLDERS} SELECT count(*) AS images, count(*) FILTER (prediction <> '') AS outputs, {q6("count(*) FILTER (prediction <> '') / count(*)")} AS fp_rate,
   count(*) FILTER (prediction = '') AS no_output_count FROM j WHERE truth = ''""")
def no_ui_summary(spark, folder):
    return rounded(measures.no_ui_summary(per_frame(spark, folder).where("truth = ''")))


BUCKET = f"""CASE WHEN p = '' THEN 'unread' WHEN p = t THEN 'correct' WHEN length(p) < length(t) THEN 'len_short' WHEN length(p) > length(t) THEN 'len_long'
   WHEN hamming(p, t) = 1 THEN 'sub1' ELSE 'subN' END"""
MISREAD = f"{FOLDERS}, b AS (SELECT *, {BUCKET} AS bucket FROM (SELECT folder, frame_index, {TR} AS t, {P} AS p FROM j WHERE truth <> ''))"


@query("misread_report", f"""{MISREAD}, c AS (SELECT bucket, count(*) AS frames, {', '.join(f'count(*) FILTER (length(t) = {k}) AS length_{k}' for k in range(1, 6))} FROM b GROUP BY 1)
  SELECT *, {q6('frames / (SELECT sum(frames) FROM c) * 100')} AS share, CASE WHEN bucket <> 'correct' THEN {q6("frames / (SELECT sum(frames) FROM c WHERE bucket <> 'correct') * 100")} END AS share_of_errors FROM c""")
def misread_report(spark, folder):
    rows = per_frame(spark, folder).select(tx.strip_zeros(F.col("truth")).alias("truth"), tx.strip_zeros(F.col("prediction")).alias("prediction"))
    return rounded(measures.misread_report(rows))


@query("misread_examples", f"""{MISREAD} SELECT bucket, k, t AS truth, p AS prediction FROM (SELECT *, folder * 100000 + frame_index AS k,
   row_number() OVER (PARTITION BY bucket ORDER BY folder * 100000 + frame_index) AS rn FROM b WHERE bucket <> 'correct') WHERE rn <= 6""")
def misread_examples(spark, folder):
    rows = per_frame(spark, folder).select(
        (F.col("folder") * 100000 + F.col("frame_index")).alias("k"), tx.strip_zeros(F.col("truth")).alias("truth"),
        tx.strip_zeros(F.col("prediction")).alias("prediction"))
    return measures.misread_examples(rows, "k").select("bucket", "k", "truth", "prediction")


VALUE = f"CASE WHEN {sql_class('c.text')} IN ('channelnum', 'othernum') THEN {sql_strip(sql_best_digit('c.text'))} END"


@query("failure_categories", f"""{LABELLED}, pr AS (SELECT f.image_id, {sql_strip('f.gt_text')} AS truth, CASE WHEN s.score >= 0.6 THEN s.prediction ELSE '' END AS p FROM frames f LEFT JOIN sel s USING (image_id) WHERE f.gt_text <> ''),
  vals AS (SELECT image_id, {sql_class('c.text')} AS kind, {VALUE} AS v FROM candidates c),
  seen AS (SELECT image_id, v AS truth, bool_or(kind = 'channelnum') AS readable FROM vals WHERE v IS NOT NULL GROUP BY ALL)
  SELECT pr.image_id, CASE WHEN coalesce(p, '') = '' AND readable THEN 'none_but_readable' WHEN coalesce(p, '') = '' AND readable IS NOT NULL THEN 'none_gt_as_othernum' WHEN coalesce(p, '') = '' THEN 'none_not_readable'
   WHEN readable THEN 'wrong_but_readable' ELSE 'wrong_not_readable' END AS category FROM pr LEFT JOIN seen USING (image_id, truth) WHERE NOT (coalesce(p, '') <> '' AND {sql_strip('p')} = truth)""")
def failure_categories(spark, folder):
    out = measures.failure_categories(per_frame(spark, folder), fx.candidates(spark, folder))
    return out.select("image_id", "category")


@query("score_distribution", f"""{LABELLED}, s AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS k, count(*) OVER () AS n FROM sel WHERE split <> 'no_ui_val')
  SELECT n AS count, {q6('min(score)')} AS min, {q6('max(CASE WHEN k = CAST(round_even((n - 1) * 0.1, 0) AS BIGINT) THEN score END)')} AS q10,
   {q6('max(CASE WHEN k = CAST(round_even((n - 1) * 0.5, 0) AS BIGINT) THEN score END)')} AS q50, {q6('max(CASE WHEN k = CAST(round_even((n - 1) * 0.9, 0) AS BIGINT) THEN score END)')} AS q90, {q6('max(score)')} AS max FROM s GROUP BY n""")
def score_distribution(spark, folder):
    return rounded(measures.score_distribution(selected(spark, folder)))


@query("comparison_row", f"""{LABELLED}, two AS (SELECT 'ours' AS model, 0.5 AS t, * FROM sel UNION ALL SELECT 'strict', 0.9, * FROM sel)
  SELECT model, max(t)::DOUBLE AS threshold, CAST(sum(CASE WHEN split <> 'no_ui_val' THEN selected_exact ELSE 0 END) AS BIGINT) AS raw_selected_correct,
   {q6("sum(CASE WHEN split <> 'no_ui_val' THEN selected_exact ELSE 0 END) / count(*) FILTER (split <> 'no_ui_val')")} AS raw_selection_accuracy,
   {q6("sum(CASE WHEN split <> 'no_ui_val' AND score >= t THEN selected_exact ELSE 0 END) / count(*) FILTER (split <> 'no_ui_val')")} AS accuracy,
   {q6("count(*) FILTER (split <> 'no_ui_val' AND score >= t) / count(*) FILTER (split <> 'no_ui_val')")} AS coverage,
   {q6("sum(CASE WHEN split <> 'no_ui_val' AND score >= t THEN selected_exact ELSE 0 END) / greatest(1, count(*) FILTER (split <> 'no_ui_val' AND score >= t))")} AS output_precision,
   CAST(count(*) FILTER (split <> 'no_ui_val' AND score >= t) - sum(CASE WHEN split <> 'no_ui_val' AND score >= t THEN selected_exact ELSE 0 END) AS BIGINT) AS wrong,
   count(*) FILTER (split <> 'no_ui_val' AND score < t) AS no_output, count(*) FILTER (split = 'no_ui_val' AND score >= t) AS no_ui_fp,
   {q6("count(*) FILTER (split = 'no_ui_val' AND score >= t) / greatest(1, count(*) FILTER (split = 'no_ui_val'))")} AS no_ui_fp_rate FROM two GROUP BY model""")
def comparison_row(spark, folder):
    s = selected(spark, folder)
    return rounded(measures.comparison_row({"ours": (s, 0.5), "strict": (s, 0.9)}), "threshold")


@query("crop_eval", f"""SELECT count(*) AS crops, count(*) FILTER (t = p) AS correct, count(*) FILTER (t <> p) AS wrong, {q6('count(*) FILTER (t = p) / count(*) * 100')} AS accuracy
  FROM (SELECT {sql_strip('f.gt_text')} AS t, {sql_strip(sql_digits('c.text'))} AS p FROM candidates c JOIN frames f USING (image_id) WHERE c.source = 'paddleocr_channel_recheck' AND f.gt_text <> '')""")
def crop_eval(spark, folder):
    truth = fx.ground_truth(spark, folder).where("gt_text <> ''").select("image_id", "gt_text")
    crops = fx.candidates(spark, folder).where("source = 'paddleocr_channel_recheck'").join(truth, "image_id")
    return rounded(measures.crop_eval(crops.select(tx.numeric_equiv(F.col("gt_text")).alias("truth"), tx.numeric_equiv(F.col("text")).alias("value"))))


@query("sample_evenly", f"""{LABELLED}, good AS (SELECT sequence_id, frame_index, image_id, row_number() OVER (PARTITION BY sequence_id ORDER BY frame_index) AS rn, greatest(1, count(*) OVER (PARTITION BY sequence_id) // 3) AS step
    FROM sel WHERE selected_exact = 1)
  SELECT sequence_id, image_id FROM good WHERE (rn - 1) % step = 0 AND (rn - 1) // step < 3 UNION ALL SELECT sequence_id, image_id FROM sel WHERE selected_exact = 0""")
def sample_evenly(spark, folder):
    rows = selected(spark, folder).withColumn("ok", F.col("selected_exact") == 1)
    return measures.sample_evenly(rows, "sequence_id", "frame_index", "ok", 3).select("sequence_id", "image_id")


@query("hard_negatives", f"""{LABELLED} SELECT image_id, candidate_index, CAST(rk AS INT) AS hardness FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY ocr_conf DESC, abs(length(digits) - 3), candidate_index) AS rk
   FROM lab WHERE label_exact = 0) WHERE rk <= 2""")
def hard_negatives(spark, folder):
    return learn.hard_negatives(labelled(spark, folder), 2).select(*KEY, "hardness")
