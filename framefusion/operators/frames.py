"""Frames and sequences as tables: membership, order, unions of readings, leakage checks."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framefusion.functions import boxes as bx
from framefusion.functions import text as tx
from framefusion.operators.skew import best_row, rank_within


def add_missing_frames(selected: DataFrame, universe: DataFrame) -> DataFrame:
    """Frames without any output get an empty row with score minus infinity."""
    have = selected.select("image_id")
    known = {f.name: f.dataType for f in selected.schema.fields}
    missing = universe.join(have, "image_id", "left_anti")
    blank = {"score": F.lit(float("-inf"))}
    columns = []
    for name, kind in known.items():
        if name in universe.columns:
            value = F.col(name)
        else:
            value = blank.get(name, F.lit("") if kind.typeName() == "string" else F.lit(0))
        columns.append(value.cast(kind).alias(name))
    return selected.unionByName(missing.select(*columns))


def eligible_only(rows: DataFrame, listed: DataFrame, keys: Sequence[str], splits_with_list: Sequence[str]) -> DataFrame:
    """Keep rows on the list of their split; splits without a list pass through."""
    bound = F.col("split").isin(*splits_with_list)
    kept = rows.where(bound).join(listed.select("split", *keys).distinct(), ["split", *keys], "left_semi")
    return kept.select(*rows.columns).unionByName(rows.where(~bound))


def eligible_counts(rows: DataFrame, listed: DataFrame, keys: Sequence[str], splits_with_list: Sequence[str]) -> DataFrame:
    on = listed.select("split", *keys).distinct().withColumn("_on", F.lit(1))
    bound = F.col("split").isin(*splits_with_list)
    kept = (~bound | F.col("_on").isNotNull()).cast("long")
    return rows.join(on, ["split", *keys], "left").groupBy("split").agg(
        F.count(F.lit(1)).alias("input"), F.sum(kept).alias("kept"), F.sum(1 - kept).alias("rejected"))


def build_sequences(frames: DataFrame, accumulate: bool = True) -> DataFrame:
    """A folder is one sequence ordered by frame name, or every frame its own sequence."""
    if not accumulate:
        return frames.select(F.col("image_id").cast("string").alias("sequence_id"), F.col("folder").cast("string").alias(
            "group_key"), F.lit(1).alias("frame_index"), "image_id")
    name = F.replace(F.col("folder").cast("string"), F.lit("/"), F.lit("__"))
    ranked = rank_within(frames.select("folder", "image_id"), ["folder"], [F.col("image_id")], "frame_index",
                         bucket=[F.substring(F.col("image_id").cast("string"), 1, 4)] if dict(frames.dtypes)["image_id"] == "string"
                         else [F.floor(F.col("image_id") / 1024)])
    return ranked.select(name.alias("sequence_id"), F.col("folder").cast("string").alias("group_key"), "frame_index", "image_id")


def manifest_sequences(manifest: DataFrame, frames: DataFrame) -> DataFrame:
    """Manifest order over known frames; unknown ids are dropped, and with them empty sequences. A long sequence may come
    in several rows, each with the `offset` of its first image."""
    offset = F.col("offset") if "offset" in manifest.columns else F.lit(0).cast("long")
    rows = manifest.select("sequence_id", "group_key", offset.alias("_offset"), F.posexplode("images").alias("_pos", "image_id"))
    rows = rows.select("sequence_id", "group_key", (F.col("_offset") + F.col("_pos")).alias("pos"), "image_id")
    rows = rows.join(frames.select("image_id"), "image_id", "left_semi")
    return rank_within(rows, ["sequence_id"], [F.col("pos")], "frame_index", bucket=[F.floor(F.col("pos") / 1024)]).select(
        "sequence_id", "group_key", "frame_index", "image_id")


def resume_missing(todo: DataFrame, done: DataFrame, key: str = "image_id") -> DataFrame:
    """Work not yet recorded."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def merge_partials(universe: DataFrame, partials: DataFrame, key: str = "image_id", order: str = "chunk_no") -> DataFrame:
    """The last record of each frame; frames without a record have none."""
    last = best_row(partials, [key], [F.col(order)])
    return universe.join(last, key, "left")


def status_counts(partials: DataFrame) -> DataFrame:
    return partials.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("records"))


def union_candidates(*parts: DataFrame) -> DataFrame:
    """Readings of several stages; the arrival order continues from stage to stage."""
    tagged = [p.withColumn("_stage", F.lit(i)) for i, p in enumerate(parts)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    ranked = rank_within(rows, ["image_id"], [F.col("_stage"), F.col("candidate_index")], "_arrival",
                         bucket=[F.col("_stage"), F.floor(F.col("candidate_index") / 1024)])
    return ranked.drop("candidate_index", "_stage").withColumnRenamed("_arrival", "candidate_index")


def with_priors(detections: DataFrame, locks: DataFrame) -> DataFrame:
    """Detections plus one weak area box per frame whose sequence is locked. `locks`: image_id, x1..y2, history_score."""
    prior = locks.select(
        "image_id", F.lit(3).alias("class_id"), *[F.round(F.col(c), 3).alias(c) for c in ("x1", "y1", "x2", "y2")],
        F.lit(0.0).alias("conf"), F.lit("history_roi_prior").alias("source"), F.round("history_score", 6).alias("history_score"))
    return detections.withColumn("source", F.lit("detector")).unionByName(prior, allowMissingColumns=True)


def merge_readings(primary: DataFrame, second: DataFrame, mode: str = "fill", dupes: DataFrame | None = None) -> DataFrame:
    """Primary and second value per frame: `fill` gaps, or keep the more `confident`; frame duplicates fill the rest.
    Each side: image_id, value, conf."""
    p = primary.select("image_id", F.col("value").alias("v1"), F.col("conf").alias("c1"))
    s = second.select("image_id", F.col("value").alias("v2"), F.col("conf").alias("c2"))
    rows = p.join(s, "image_id", "full")
    if dupes is not None:
        rows = rows.join(dupes.select("image_id", F.col("value").alias("vd")), "image_id", "full")
    both = F.col("v1").isNotNull() & F.col("v2").isNotNull()
    weaker = F.coalesce("c1", F.lit(0.0)) < F.coalesce("c2", F.lit(0.0))
    take_second = both & weaker if mode == "confident" else F.lit(False)
    value = F.when(take_second, F.col("v2")).otherwise(F.coalesce("v1", "v2"))
    conf = F.when(take_second, F.col("c2")).otherwise(F.coalesce("c1", "c2"))
    if dupes is not None:
        value = F.coalesce(value, F.col("vd"))
    return rows.select("image_id", value.alias("value"), conf.alias("conf"))


def second_fill_correct(primary: DataFrame, second: DataFrame, conf_gate: float) -> DataFrame:
    """The second region fills missing frames and replaces values read with low confidence."""
    p = primary.select("image_id", F.col("value").alias("v1"), F.col("conf").alias("c1"))
    s = second.select("image_id", F.col("value").alias("v2"), F.col("conf").alias("c2"))
    own = F.coalesce("c1", F.lit(1.0))
    fill = F.col("v1").isNull() & F.col("v2").isNotNull()
    fix = F.col("v1").isNotNull() & F.col("v2").isNotNull() & (own < conf_gate) & (F.col("c2") > own)
    return p.join(s, "image_id", "full").select(
        "image_id", F.when(fill | fix, F.col("v2")).otherwise(F.col("v1")).alias("value"),
        F.when(fill, "filled").when(fix, "corrected").otherwise("kept").alias("action"))


def override_with_field(current: DataFrame, field: DataFrame) -> DataFrame:
    """Values read at the field box replace the others."""
    return current.select("image_id", F.col("value").alias("v")).join(
        field.select("image_id", F.col("value").alias("f")), "image_id", "full").select(
        "image_id", F.coalesce("f", "v").alias("value"), F.col("v").isNull().alias("added"),
        F.coalesce((F.col("f") != F.col("v")), F.lit(False)).alias("overridden"))


def selected_box(predictions: DataFrame, readings: DataFrame) -> DataFrame:
    """Box of the chosen reading, else of the first reading with the predicted digits. `predictions`: image_id,
    prediction, candidate_index (may be null)."""
    box = F.struct("x1", "y1", "x2", "y2")
    chosen = readings.select("image_id", "candidate_index", box.alias("chosen"))
    digits = readings.where(tx.digits_any(F.col("text")) != "").groupBy(
        "image_id", tx.digits_any(F.col("text")).alias("prediction")).agg(F.min_by(box, "candidate_index").alias("first"))
    out = predictions.join(chosen, ["image_id", "candidate_index"], "left").join(digits, ["image_id", "prediction"], "left")
    return out.withColumn("box", F.coalesce("chosen", "first")).select(
        *predictions.columns, *[F.col(f"box.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


def locked_box(states: DataFrame) -> DataFrame:
    """Locked box after the frame, else before it."""
    return states.select("image_id", *[F.coalesce(f"after_{c}", f"before_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


# Roles in which the held-out provider may not appear, and those that allow it.
FORBIDDEN_ROLES = ("train", "training", "val", "validation", "tuning", "threshold_tuning", "feature_selection",
                   "hard_negative_mining", "temporal_tuning")
ALLOWED_ROLES = ("test", "final_test", "holdout", "holdout_test")


def role_forbids(role: Column, allowed: Sequence[str] = ALLOWED_ROLES) -> Column:
    name = F.lower(F.trim(role))
    return name.isin(*FORBIDDEN_ROLES) | ~name.isin(*allowed)


def leakage_scan(inputs: DataFrame, held_out: str, content: str, role: str = "role",
                 allowed: Sequence[str] = ALLOWED_ROLES) -> DataFrame:
    """Verdict per input: `violation` where a forbidden role mentions the held-out name, `warning` where an allowed role
    does, `clean` otherwise. Whole texts are searched."""
    hit = tx.mentions(F.col(content), held_out)
    verdict = F.when(hit & role_forbids(F.col(role), allowed), "violation").when(hit, "warning").otherwise("clean")
    return inputs.withColumn("verdict", verdict)


def assert_no_leakage(scanned: DataFrame) -> None:
    """Raise when there is a violation; only one example reaches the driver."""
    bad = scanned.where("verdict = 'violation'").limit(1).collect()
    if bad:
        raise ValueError(f"held-out name in a forbidden role: {bad[0].asDict()}")


def crop_manifest(fields: DataFrame, frames: DataFrame, pad: float = 0.25, pad_right: float = 0.7, cap: int = 0) -> DataFrame:
    """Crop box per labelled frame around its folder's field box, with a wide right side; at least four pixels.
    `fields`: folder, x1..y2; `frames`: folder, image_id, stem, image_width, image_height."""
    label = tx.strip_zeros(tx.name_leading_digits(F.col("stem")))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    whole = lambda c: c.cast("long")
    rows = frames.join(fields, "folder").withColumn("label", label).where("label <> ''").select(
        "folder", "image_id", "label",
        F.greatest(F.lit(0), whole(F.col("x1") - w * pad)).alias("cx1"),
        F.greatest(F.lit(0), whole(F.col("y1") - h * pad)).alias("cy1"),
        F.least(F.col("image_width"), whole(F.col("x2") + w * pad_right)).alias("cx2"),
        F.least(F.col("image_height"), whole(F.col("y2") + h * pad)).alias("cy2"),
    ).where("cx2 - cx1 >= 4 AND cy2 - cy1 >= 4")
    if cap <= 0:
        return rows
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy("folder").orderBy("image_id"))).where(
        F.col("_rn") <= cap).drop("_rn")
