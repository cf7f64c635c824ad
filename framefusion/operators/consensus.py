"""One value per sequence from the values of its frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framefusion.functions import text as tx
from framefusion.operators.generate import consensus_values
from framefusion.operators.skew import best_row


def consensus_weight() -> Column:
    c = F.col
    n = F.length("_value")
    by_source = F.when(c("source") == "temporal_slot_recheck", 0.35).when(c("source") == "paddleocr_channel_recheck", 0.15).otherwise(0.0)
    by_length = F.when(n.between(2, 3), 0.25).when(n == 1, -0.20).otherwise(-0.05)
    conf = tx.sureness("conf")
    return F.greatest(F.lit(0.05), F.lit(1.0) + conf + F.coalesce("score", F.lit(0.0)) * 0.25 + by_source + by_length)


def sequence_consensus(predictions: DataFrame, key: str = "sequence_id", max_digits: int = 5) -> DataFrame:
    """Value supported by at least two frames, directly or as an affix of what they show.

    A value supports itself and its prefixes and suffixes of two or more digits: a handful of rows per frame, so support
    is one aggregate. Only values and their two- and three-digit affixes may win.
    """
    rows = predictions.withColumn("_value", tx.digits(F.col("prediction"))).where("_value <> ''").withColumn("_weight", consensus_weight())
    totals = rows.groupBy(key).agg(F.sum("_weight").alias("total"), F.count(F.lit(1)).alias("frames"))
    value, n = F.col("_value"), F.length("_value")
    lengths = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    affixes = F.flatten(F.transform(lengths, lambda k: F.array(F.substring(value, F.lit(1), k), F.substring(value, n - k + 1, k))))
    backed = F.array_distinct(F.concat(F.array(value), affixes))
    support = rows.withColumn("_may", consensus_values(value)).select(key, "_value", "_weight", "_may", F.explode(backed).alias("value")).groupBy(
        key, "value").agg(F.sum("_weight").alias("weight"), F.count(F.lit(1)).alias("supporters"),
                          F.sum((F.col("_value") == F.col("value")).cast("long")).alias("exact"),
                          F.max(F.array_contains("_may", F.col("value"))).alias("_may"))
    length = F.length("value")
    usable = support.where(F.col("_may") & (F.col("supporters") >= 2) & (length <= max_digits) & ((length > 1) | (F.col("exact") >= 2)))
    order = [F.round("weight", 9), F.col("exact"), length.between(2, 3).cast("int"), -length]
    # Among equals the smaller text wins; its reversed order is the complement of its digits.
    best = best_row(usable, [key], [*order, F.translate("value", "0123456789", "9876543210")]).join(totals, key)
    strong = (F.col("exact") >= 2) | (F.col("weight") >= F.col("total") * 0.55)
    return best.where((F.col("frames") >= 2) & strong).select(key, F.col("value").alias("consensus"), "weight", "exact", "supporters")


def apply_consensus(predictions: DataFrame, consensus: DataFrame, key: str = "sequence_id", guard: str = "off", min_agreement: int = 2,
                    protect: float = 1.25, require_support: bool = False) -> DataFrame:
    """Overwrite frame values by the consensus unless guarded. `predictions`: key, image_id, prediction, score and
    `ranked_values` (digits of the frame's first ten readings)."""
    if guard not in ("off", "conservative", "balanced"):
        raise ValueError(f"unknown guard {guard}")
    c = F.col
    rows = predictions.withColumn("_value", tx.digits(c("prediction"))).join(consensus.select(key, "consensus", c("supporters").alias("agreement")), key, "left")
    has = c("consensus").isNotNull()
    supported = F.coalesce(F.array_contains("ranked_values", c("consensus")), F.lit(False))
    differs = has & (c("_value") != "") & (c("_value") != c("consensus"))
    sure = F.coalesce("score", F.lit(0.0)) >= protect
    reason = F.when(~differs | F.lit(guard == "off"), "").when(c("agreement") < min_agreement, "low_consensus_agreement")
    if require_support:
        reason = reason.when(~supported, "no_current_frame_support_for_consensus")
    if guard == "conservative":
        reason = reason.when(sure, "protected_high_confidence_single_frame")
    if guard == "balanced":
        reason = reason.when(sure & ~supported, "protected_high_confidence_without_current_support")
    out = rows.withColumn("guard_reason", reason.otherwise("")).withColumn("consensus_applied", has & (c("guard_reason") == ""))
    return out.withColumn("prediction", F.when(c("consensus_applied"), c("consensus")).otherwise(c("prediction"))).withColumn(
        "current_support", supported).drop("_value")
