"""Rule score of a reading, ranking inside the frame, and the choice of one reading per frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framefusion.functions import boxes as bx
from framefusion.functions import text as tx
from framefusion.operators import evidence as ev
from framefusion.operators.relate import ARRAY_LIMIT, Fold, Get, NotSelf, relate
from framefusion.operators.skew import best_row, top_rows


def _unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def _optional(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def rule_score(candidates: DataFrame, detections: DataFrame, max_digits: int = 5, allow_single_digit: bool = False,
               suppress_hallucinations: bool = False, limit: int = ARRAY_LIMIT) -> DataFrame:
    """Readings that survive the rules, with their additive score, best detection and snapped box."""
    readable = candidates.where(F.length(tx.digits(F.col("text"))).between(1, max_digits))
    # Texts without digits still count as context, so the join sees every reading; the filter is applied after it.
    rows = ev.rule_evidence(candidates, detections, limit=limit)
    conf = F.coalesce(F.col("ocr_conf"), F.lit(0.5))
    rows = rows.where(F.length("_value").between(1, max_digits))
    rows = rows.where(~((conf < 0.35) & F.col("_recheck") & F.col("alpha_only_near")))
    rows = rows.where(ev.recheck_support_rule(allow_single_digit))
    if suppress_hallucinations:
        rows = rows.where(~ev.hallucination_rule())
    source, text, box = F.col("source"), F.col("text"), bx.cols()
    is_source = lambda name: F.coalesce(source == name, F.lit(False))
    half_day = F.contains(F.lower(text), F.lit("pm")) | F.contains(F.lower(text), F.lit("am"))
    from_history = (
        _optional(rows, "from_history_guided_slot", False) | _optional(rows, "from_history_roi_prior", False)
        | _optional(rows, "raw_source", "").isin("history_guided_slot_recheck", "history_roi_prior_recheck"))
    score = (
        F.lit(0.35) + 0.45 * _unit(conf) + bx.position_score(box, F.col("image_width"), F.col("image_height"))
        + 0.45 * _unit(_optional(rows, "history_score", 0.0))
        + F.when(F.length("_value").between(2, 3), 0.20).otherwise(0.0)
        + F.when(F.contains(text, F.lit(":")) | half_day, -0.55).otherwise(0.0)
        + F.when(is_source("refined_numeric_substring"), -0.10).otherwise(0.0)
        + F.when(F.col("_recheck"), 0.08).otherwise(0.0)
        + F.when(is_source("temporal_slot_recheck"),
                 0.35 + 0.25 * _unit(_optional(rows, "slot_profile_score", 0.0))).otherwise(0.0)
        + F.when(from_history, 0.12 + 0.20 * _unit(_optional(rows, "temporal_slot_boost", 0.0))).otherwise(0.0)
        + tx.text_quality(source, text, F.col("_parent_text"))
        + ev.location_adjustment()
        - tx.elongated_penalty(source, text, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    )
    rows = (
        rows.withColumn("digits", F.col("_value"))
        .withColumn("rule_score", score + F.coalesce(F.col("aligned.bonus"), F.lit(0.0)) - F.col("penalty"))
        .withColumn("aligned_detection", F.col("aligned.detection_index"))
        .withColumn("aligned_class", F.col("aligned.class_id"))
        .withColumn("snapped", ev.snapped())
    )
    for n in ev.BOX:
        rows = rows.withColumn(f"snap_{n}", F.when(F.col("snapped"), F.col(f"aligned.{n}")).otherwise(F.col(n)))
    keep = ["digits", "rule_score", "aligned_detection", "aligned_class", "snapped", *[f"snap_{n}" for n in ev.BOX]]
    return rows.select(*readable.columns, *keep)


def rank_candidates(scored: DataFrame, score: str = "rule_score", k: int = 20) -> DataFrame:
    return top_rows(scored, ["image_id"], [F.desc(score), F.asc("candidate_index")], k)


def select_best(scored: DataFrame, score: str, keys: tuple[str, ...] = ("image_id",), **exists: Column) -> DataFrame:
    """One row per frame with the greatest score, the first reading on ties; `exists` adds flags over the frame."""
    return best_row(scored, list(keys), [F.col(score), -F.col("candidate_index")], **exists)


def promote_three_digit(ranked: DataFrame, limit: int = ARRAY_LIMIT) -> DataFrame:
    """When the best reading has fewer than three digits, a supported three-digit reading tied with it moves first.

    `ranked` carries `rank`, `fusion_score`, `rule_score`, `digits`, `aligned_detection`, the boxes and, if known,
    `parent_text`.
    """
    best = ranked.where("rank = 1").select(
        "image_id", F.col("fusion_score").alias("_best_score"), F.col("digits").alias("_best_digits"),
        *[F.col(n).alias(f"_b_{n}") for n in ev.BOX])
    rows = ranked.join(best, "image_id")
    tied = rows.where(
        (F.length("_best_digits") < 3) & (F.length("digits") == 3) & (F.col("rank") > 1)
        & (F.col("fusion_score") >= F.col("_best_score")))

    def derive(l: Get, r: Get) -> dict[str, Column]:
        return {**ev.pair_geometry(l, r), "same": l("digits") == r("digits")}

    tied = relate(
        tied, ranked, on="image_id", derive=derive, left_cols=ev.BOX + ev.SIZE + ["digits"],
        right_cols=ev.BOX + ["digits"], reach=0.045, not_self=NotSelf("candidate_index", lambda l: F.lit(True)),
        folds={"_repeated": Fold("any", lambda p: p("same") & ev.close(p, ev.PROMOTION_PLACE), others=True)}, limit=limit)
    conf = F.coalesce(F.col("ocr_conf"), F.lit(0.0))
    source = F.coalesce(F.col("source"), F.lit("ocr"))
    parent = tx.digits(F.col("parent_text")) if "parent_text" in ranked.columns else F.lit("")
    prefix = (source == "digit_sequence_trim") & (parent != "") & F.startswith(parent, F.col("digits"))
    aligned = F.col("aligned_detection").isNotNull()
    at_best = ev.close({
        "overlap": bx.overlap_min(bx.cols("_b_"), bx.cols()),
        "distance": bx.center_distance(bx.cols("_b_"), bx.cols(), F.col("image_width"), F.col("image_height")),
    }.__getitem__, ev.PROMOTION_PLACE)
    comparable = (F.coalesce("rule_score", F.lit(0.0)) >= 0.25) & (at_best | prefix | aligned)
    crop = (source == "paddleocr_crop_variant_recheck")
    repeated = crop & (conf >= 0.80) & F.col("_repeated")
    rechecked = (crop | (source == "paddleocr_channel_recheck")) & aligned & (conf >= 0.55)
    winner = tied.where(comparable | repeated | rechecked | prefix).groupBy("image_id").agg(
        F.min("rank").alias("_promoted"))
    out = ranked.join(winner, "image_id", "left")
    moved = F.col("rank") == F.col("_promoted")
    new_rank = F.when(moved, 1).when(F.col("rank") < F.col("_promoted"), F.col("rank") + 1).otherwise(F.col("rank"))
    return out.withColumn("promoted", F.coalesce(moved, F.lit(False))).withColumn("rank", new_rank).drop("_promoted")


def score_threshold(selected: DataFrame, score: str, threshold: float) -> DataFrame:
    """Blank predictions below the threshold; flags tell output and match."""
    passed = tx.safe_float(F.col(score)) >= threshold
    return (
        selected.withColumn("threshold", F.lit(threshold)).withColumn("output", passed.cast("int"))
        .withColumn("final_prediction", F.when(passed, F.col("prediction")).otherwise(""))
        .withColumn("exact_match", F.when(passed, F.col("selected_exact")).otherwise(0).cast("int"))
        .withColumn("numeric_equiv_match", F.when(passed, F.col("selected_numeric_equiv")).otherwise(0).cast("int"))
        .withColumn("reject_reason", F.when(passed, "").otherwise("ranker_threshold"))
    )
