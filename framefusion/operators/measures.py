"""Counts, accuracies and reports over predictions and truth."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framefusion.functions import boxes as bx
from framefusion.functions import text as tx
from framefusion.operators.skew import best_row, rank_within


def ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.lit(1), whole)


def count_if(condition: Column) -> Column:
    return F.sum(F.coalesce(condition, F.lit(False)).cast("long"))


def attach_truth(predictions: DataFrame, truth: DataFrame, value: str = "value") -> DataFrame:
    """Truth per frame with string-exact and numeric-exact flags; null flags where no truth is known."""
    t = truth.select("image_id", F.col(value).alias("ground_truth"))
    out = predictions.join(t, "image_id", "left").withColumn("ground_truth", F.coalesce("ground_truth", F.lit("")))
    want, got = tx.digits(F.col("ground_truth")), tx.digits(F.col("prediction"))
    known = want != ""
    return (
        out.withColumn("exact", F.when(known, (want == got).cast("int")))
        .withColumn("numeric_exact", F.when(known, ((got != "") & (tx.strip_zeros(want) == tx.strip_zeros(got))).cast("int")))
    )


def failures(scored: DataFrame) -> DataFrame:
    return scored.where(F.col("exact") == 0)


def evaluation_columns(threshold: Column | float) -> dict[str, Column]:
    """The evaluation fields as aggregates over selected rows; usable in any groupBy."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    valid = F.col("split") != "no_ui_val"
    out = tx.safe_float(F.col("score")) >= t
    valid_count, output = count_if(valid), count_if(valid & out)
    exact = F.sum(F.when(valid & out, F.col("selected_exact")).otherwise(0)).cast("long")
    numeric = F.sum(F.when(valid & out, F.col("selected_numeric_equiv")).otherwise(0)).cast("long")
    oracle = F.sum(F.when(valid, F.col("correct_candidate_exists")).otherwise(0)).cast("long")
    exists = F.col("correct_candidate_exists") == 1
    no_ui, no_ui_fp = count_if(~valid), count_if(~valid & out)
    return {
        "valid_gt_count": valid_count, "output_count": output, "coverage": ratio(output, valid_count),
        "final_exact_correct_count": exact, "final_numeric_equiv_correct_count": numeric,
        "final_exact_accuracy": ratio(exact, valid_count),
        "final_numeric_equiv_accuracy": ratio(numeric, valid_count),
        "output_precision": ratio(exact, output), "wrong_output_count": output - exact,
        "no_output_count": valid_count - output, "candidate_oracle_exact_accuracy": ratio(oracle, valid_count),
        "oracle_hit_count": oracle, "no_correct_candidate_count": valid_count - oracle,
        "selector_accuracy_given_correct_candidate_exists": ratio(exact, oracle),
        "correct_candidate_exists_but_not_selected_count": count_if(valid & out & exists & (F.col("selected_exact") == 0)),
        "correct_candidate_exists_but_thresholded_or_rejected_count": count_if(valid & exists & ~out),
        "no_ui_image_count": no_ui, "no_ui_fp": no_ui_fp, "no_ui_fp_rate": ratio(no_ui_fp, no_ui),
    }


def evaluate(selected: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    columns = [v.alias(k) for k, v in evaluation_columns(threshold).items()]
    out = selected.groupBy(*keys).agg(*columns) if keys else selected.agg(*columns)
    return out.withColumn("threshold", F.lit(float(threshold)))


def evaluate_by(selected: DataFrame, threshold: float, key: str = "provider") -> DataFrame:
    """Evaluation per provider and in total (null key), from one pass."""
    columns = [v.alias(k) for k, v in evaluation_columns(threshold).items()]
    valid = selected.where("split <> 'no_ui_val'").withColumn(key, F.coalesce(key, F.lit("unknown")))
    return valid.rollup(key).agg(*columns)


def worst_and_best(by_provider: DataFrame, key: str = "provider", measure: str = "final_exact_accuracy") -> DataFrame:
    return by_provider.where(F.col(key).isNotNull()).agg(
        F.coalesce(F.min(measure), F.lit(0.0)).alias("provider_worst_accuracy"),
        F.coalesce(F.max(measure), F.lit(0.0)).alias("provider_best_accuracy"))


def row_summary(rows: DataFrame) -> DataFrame:
    """Row counts by split, provider (train and val) and source as (dimension, name, rows)."""
    tuned = F.col("split").isin("train", "val")
    sets = rows.select("split", "provider", "source", F.when(tuned, F.col("provider")).alias("tuned_provider"))
    parts = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), c.alias("name")) for d, c in (
            ("all", F.lit("")), ("split", F.col("split")), ("provider", F.col("tuned_provider")),
            ("source", F.col("source")))])).alias("p")
    return sets.select(parts).where("p.name IS NOT NULL").groupBy("p.dimension", "p.name").agg(
        F.count(F.lit(1)).alias("rows"))


def upper_bound(rows: DataFrame) -> DataFrame:
    """Frames per split in which some reading carries each label."""
    labels = [c for c in rows.columns if c.startswith("label_")]
    per_frame = rows.groupBy("split", "image_id").agg(*[F.max(c).alias(c) for c in labels])
    return per_frame.groupBy("split").agg(
        F.count(F.lit(1)).alias("images"), *[F.sum(c).cast("long").alias(f"{c}_frames") for c in labels])


def selection_summary(selected: DataFrame) -> DataFrame:
    return selected.groupBy("selected_source").agg(
        F.count(F.lit(1)).alias("images"), F.sum("selected_exact").cast("long").alias("correct"),
        count_if(F.col("selected_exact") == 0).alias("wrong"))


def majority_vote(predictions: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Most frequent non-empty value per key, the first seen on ties, with its share and the number of frames."""
    votes = predictions.where(F.coalesce(value, F.lit("")) != "").groupBy(key, F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("votes"), F.min(order).alias("first_seen"))
    best = best_row(votes, [key], [F.col("votes"), -F.col("first_seen")], n_frames=F.sum("votes"))
    return best.select(key, "value", (F.col("votes") / F.col("n_frames")).alias("confidence"), "n_frames")


def folder_summary(predictions: DataFrame, mode: str = "label", numeric: bool = True) -> DataFrame:
    """Read rate per folder, with accuracy against labels (`label`), against the folder's vote (`vote`), or the share
    of readings equal to the vote (`consistency`). `predictions`: folder, frame_index, prediction[, truth]."""
    votes = majority_vote(predictions, "folder", "prediction", "frame_index").select(
        "folder", F.col("value").alias("vote"))
    rows = predictions.join(votes, "folder", "left").withColumn("vote", F.coalesce("vote", F.lit("")))
    norm = tx.strip_zeros if numeric else (lambda c: c)
    read = F.coalesce("prediction", F.lit("")) != ""
    answer = F.coalesce("truth", F.lit("")) if mode == "label" else F.col("vote")
    judged = answer != ""
    correct = judged & (norm(F.col("prediction")) == norm(answer))
    n, n_read = F.count(F.lit(1)), count_if(read)
    share = lambda a, b: F.when(b > 0, a / b * 100)
    base = [F.max("vote").alias("predicted_value"), n.alias("n_frames"), n_read.alias("n_read"),
            F.coalesce(share(n_read, n), F.lit(0.0)).alias("read_rate")]
    if mode == "consistency":
        hits = count_if(read & correct)
        return rows.groupBy("folder").agg(*base, F.coalesce(share(hits, n_read), F.lit(0.0)).alias("consistency"))
    scored, ok = count_if(judged), count_if(correct)
    return rows.groupBy("folder").agg(
        *base, scored.alias("scored"), ok.alias("success"), (scored - ok).alias("fail"), share(ok, scored).alias("accuracy"))


def accuracy_triple(predictions: DataFrame, key: str = "folder") -> DataFrame:
    """End-to-end accuracy, coverage and accuracy when read, per folder and in total (null key)."""
    rows = predictions.where(F.coalesce("truth", F.lit("")) != "")
    read = F.coalesce("prediction", F.lit("")) != ""
    right = read & (tx.strip_zeros(F.col("prediction")) == tx.strip_zeros(F.col("truth")))
    n, r, c = F.count(F.lit(1)), count_if(read), count_if(right)
    pct = lambda a, b: F.when(b > 0, a / b * 100).otherwise(0.0)
    return rows.rollup(key).agg(n.alias("total"), r.alias("read"), c.alias("correct"), pct(c, n).alias("end_to_end"),
                                pct(r, n).alias("coverage"), pct(c, r).alias("when_read"))


def uncertainty_gate(predictions: DataFrame, threshold: float, reject_out_of_pool: bool = False) -> DataFrame:
    """Blank predictions below the threshold or outside the pool; keep the originals beside them."""
    have = set(predictions.columns)
    names = [n for n in ("selected_score", "ranker_score", "selector_score", "score") if n in have]
    score = F.coalesce(*[F.when(F.coalesce(F.col(n).cast("string"), F.lit("")) != "", tx.safe_float(F.col(n))) for n in names],
                       F.lit(0.0))
    said = tx.digits(F.col("prediction")) != ""
    out_of_pool = F.lit(False)
    if reject_out_of_pool and "final_pred_in_candidate_pool" in have:
        out_of_pool = F.col("final_pred_in_candidate_pool").cast("string") == "0"
    reason = (
        F.when(said & out_of_pool, "uncertainty_out_of_pool_prediction")
        .when(said & (score < threshold), "uncertainty_score_below_threshold").otherwise(""))
    gated = predictions.withColumn("uncertainty_gate_score", score).withColumn(
        "uncertainty_gate_threshold", F.lit(float(threshold))).withColumn("uncertainty_gate_reject_reason", reason)
    rejected = F.col("uncertainty_gate_reject_reason") != ""
    return (
        gated.withColumn("uncertainty_gate_rejected", rejected.cast("int"))
        .withColumn("prediction_before_uncertainty_gate", F.when(rejected, F.col("prediction")))
        .withColumn("prediction", F.when(rejected, "").otherwise(F.col("prediction")))
    )


def gate_evaluate(predictions: DataFrame, truth: str = "truth") -> DataFrame:
    want, got = tx.digits(F.col(truth)), tx.digits(F.col("prediction"))
    rows = predictions.where(want != "")
    read = got != ""
    right = read & (tx.strip_zeros(want) == tx.strip_zeros(got))
    n, outputs, correct = F.count(F.lit(1)), count_if(read), count_if(right)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.agg(
        n.alias("valid_gt_count"), correct.alias("final_exact_correct_count"),
        share(correct, n).alias("final_prediction_exact_accuracy"), share(outputs, n).alias("coverage"),
        (outputs - correct).alias("final_wrong_output_count"), (n - outputs).alias("final_no_output_count"),
        share(correct, outputs).alias("output_precision"))


def no_ui_summary(predictions: DataFrame) -> DataFrame:
    n, outputs = F.count(F.lit(1)), count_if(tx.digits(F.col("prediction")) != "")
    return predictions.agg(n.alias("images"), outputs.alias("outputs"),
                           F.when(n > 0, outputs / n).otherwise(0.0).alias("fp_rate"), (n - outputs).alias("no_output_count"))


BUCKETS = ["correct", "unread", "len_short", "len_long", "sub1", "subN"]


def misread_report(rows: DataFrame) -> DataFrame:
    """Per bucket: frames, share of all and of errors, and frames by truth length. `rows`: truth, prediction."""
    known = rows.where(F.coalesce("truth", F.lit("")) != "").withColumn(
        "bucket", tx.misread_bucket(F.col("truth"), F.coalesce("prediction", F.lit(""))))
    counts = known.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("frames"),
        *[count_if(F.length("truth") == k).alias(f"length_{k}") for k in range(1, 6)])
    everything = Window.partitionBy()
    total = F.sum("frames").over(everything)
    wrong = F.sum(F.when(F.col("bucket") != "correct", F.col("frames")).otherwise(0)).over(everything)
    # At most six rows meet in this window.
    return counts.withColumn("share", F.col("frames") / total * 100).withColumn(
        "share_of_errors", F.when((F.col("bucket") != "correct") & (wrong > 0), F.col("frames") / wrong * 100))


def misread_examples(rows: DataFrame, order: str, n: int = 6) -> DataFrame:
    known = rows.where(F.coalesce("truth", F.lit("")) != "").withColumn(
        "bucket", tx.misread_bucket(F.col("truth"), F.coalesce("prediction", F.lit("")))).where("bucket <> 'correct'")
    w = Window.partitionBy("bucket").orderBy(order)
    return known.withColumn("example", F.row_number().over(w)).where(F.col("example") <= n)


def failure_categories(predictions: DataFrame, readings: DataFrame) -> DataFrame:
    """Failed frames by whether the truth was among the frame's readings. `predictions`: image_id, truth, prediction."""
    kind = tx.classify(F.col("text"))
    value = tx.canonical(tx.best_digit(F.col("text")))
    truth = predictions.where(F.coalesce("truth", F.lit("")) != "").withColumn("truth", tx.canonical(F.col("truth")))
    said = F.coalesce("prediction", F.lit(""))
    failed = truth.where(~((said != "") & (tx.canonical(tx.digits(said)) == F.col("truth"))))
    seen = readings.select("image_id", kind.alias("kind"), value.alias("truth")).where(
        "kind IN ('channelnum', 'othernum')").groupBy("image_id", "truth").agg(
        F.max(F.col("kind") == "channelnum").alias("readable"))
    none = said == ""
    category = (
        F.when(none & F.coalesce("readable", F.lit(False)), "none_but_readable")
        .when(none & F.col("readable").isNotNull(), "none_gt_as_othernum")
        .when(none, "none_not_readable")
        .when(F.coalesce("readable", F.lit(False)), "wrong_but_readable").otherwise("wrong_not_readable"))
    return failed.join(seen, ["image_id", "truth"], "left").withColumn("category", category).drop("readable")


def unread_reasons(unread: DataFrame, fields: DataFrame, readings: DataFrame, near: float = 0.06) -> DataFrame:
    """Why a frame stayed unread. `unread`: image_id, sequence_id; `fields`: sequence_id, field_cx, field_cy."""
    framed = unread.join(fields, "sequence_id", "left")
    cx = bx.center_x(bx.cols()) / F.col("image_width")
    cy = bx.center_y(bx.cols()) / F.col("image_height")
    around = readings.select("image_id", cx.alias("cx"), cy.alias("cy"), (tx.digits_any(F.col("text")) != "").alias("digit"))
    at_field = bx.point_distance(F.col("cx"), F.col("cy"), F.col("field_cx"), F.col("field_cy")) < near
    close = framed.join(around, "image_id").where(at_field).groupBy("image_id").agg(F.max("digit").alias("digit"))
    reason = (
        F.when(F.col("field_cx").isNull(), "no_field").when(F.col("digit").isNull(), "nothing_near_field")
        .when(~F.col("digit"), "text_only").otherwise("digit_but_rejected"))
    return framed.join(close, "image_id", "left").withColumn("reason", reason).drop("digit")


def score_distribution(selected: DataFrame, quantiles: Sequence[float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Count, least, greatest and order statistics of the finite scores; the index rounds half to even."""
    from framefusion.operators.learn import order_statistics
    scores = selected.where((F.col("split") != "no_ui_val") & (F.abs("score") != float("inf")) & ~F.isnan("score"))
    values = order_statistics(scores, "score", lambda n: [0, *[round((n - 1) * q) for q in quantiles], n - 1])
    names = ["min", *[f"q{int(q * 100)}" for q in quantiles], "max"]
    counted = scores.agg(F.count(F.lit(1)).alias("count"))
    return counted.select("count", *[F.lit(v).alias(n) for n, v in zip(names, values)])


def unpivot_strategies(frame_values: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Accuracy, and accuracy when read, of several value columns against `truth`, in one pass."""
    long = frame_values.select("truth", F.explode(F.array(*[
        F.struct(F.lit(s).alias("strategy"), F.coalesce(F.col(s), F.lit("")).alias("value")) for s in strategies])).alias("s"))
    read, right = F.col("s.value") != "", F.col("s.value") == F.col("truth")
    n, r, ok = F.count(F.lit(1)), count_if(read), count_if(read & right)
    return long.groupBy(F.col("s.strategy").alias("strategy")).agg(
        n.alias("frames"), r.alias("read"), ok.alias("correct"), (ok / n * 100).alias("accuracy"),
        F.when(r > 0, ok / r * 100).otherwise(0.0).alias("accuracy_when_read"))


def crop_eval(readings: DataFrame, truth: str = "truth", value: str = "value") -> DataFrame:
    right = F.col(truth) == F.col(value)
    n, ok = F.count(F.lit(1)), count_if(right)
    return readings.agg(n.alias("crops"), ok.alias("correct"), (n - ok).alias("wrong"),
                        F.when(n > 0, ok / n * 100).otherwise(0.0).alias("accuracy"))


def comparison_row(named: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Raw and gated accuracy of several models side by side."""
    def one(name: str, selected: DataFrame, threshold: float) -> DataFrame:
        valid = F.col("split") != "no_ui_val"
        raw = F.sum(F.when(valid, F.col("selected_exact")).otherwise(0)).cast("long")
        columns = evaluation_columns(threshold)
        keep = {"final_exact_accuracy": "accuracy", "coverage": "coverage", "output_precision": "output_precision",
                "wrong_output_count": "wrong", "no_output_count": "no_output", "no_ui_fp": "no_ui_fp",
                "no_ui_fp_rate": "no_ui_fp_rate"}
        return selected.agg(
            raw.alias("raw_selected_correct"), ratio(raw, count_if(valid)).alias("raw_selection_accuracy"),
            *[columns[k].alias(v) for k, v in keep.items()]).withColumn("model", F.lit(name)).withColumn(
            "threshold", F.lit(float(threshold)))
    return reduce(lambda a, b: a.unionByName(b), [one(n, s, t) for n, (s, t) in named.items()])


def sample_evenly(rows: DataFrame, key: str, order: str, ok: str, n: int) -> DataFrame:
    """Per key every step-th success up to `n`, and all failures. The step needs only the number of successes."""
    good = rows.where(F.col(ok))
    sizes = good.groupBy(key).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / n)).alias("_step"))
    picked = rank_within(good, [key], [F.col(order)], "_rn", bucket=[F.floor(F.col(order) / 1024)]).join(sizes, key).where(
        ((F.col("_rn") - 1) % F.col("_step") == 0) & ((F.col("_rn") - 1) / F.col("_step") < n))
    return picked.drop("_rn", "_step").unionByName(rows.where(~F.coalesce(F.col(ok), F.lit(False))))
