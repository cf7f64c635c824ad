"""How readings and detections of a frame bear on each other: detector features, agreement, conflict, support."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framefusion.functions import boxes as bx
from framefusion.functions import text as tx
from framefusion.operators.blocks import Block, Pairs, unlike_numbers
from framefusion.operators.relate import ARRAY_LIMIT, Fold, Get, Nearest, NotSelf, OwnRows, PerFrame, relate

BOX = ["x1", "y1", "x2", "y2"]
SIZE = ["image_width", "image_height"]
# Detector classes and the feature prefix of each.
CHANNEL, OTHER_NUMBER, OTHER_TEXT, AREA = 0, 1, 2, 3
CLASS_PREFIX = {CHANNEL: "yolo_ch0", AREA: "yolo_area3", OTHER_NUMBER: "yolo_other_num1", OTHER_TEXT: "yolo_other_text2"}
# Overlap and distance beyond which two boxes are the same place, by rule.
SAME_PLACE = (0.45, 0.045)
RECHECK_PLACE = (0.25, 0.08)
PROMOTION_PLACE = (0.55, 0.045)
SUPPORT_STRONG = (0.12, 0.45, 0.045)
SUPPORT_CURRENT = (0.12, 0.42, 0.045)
SUPPORT_RECHECK = (0.12, 0.35, 0.08)
DETECTION_COLLAPSE = {"detection_index": F.min, "conf": F.max}


def pair_geometry(l: Get, r: Get) -> dict[str, Column]:
    a, b = bx.field(l), bx.field(r)
    return {
        "iou": bx.iou(a, b),
        "overlap": bx.overlap_min(a, b),
        "distance": bx.center_distance(a, b, l("image_width"), l("image_height")),
    }


def close(p: Get, place: tuple[float, float]) -> Column:
    return (p("overlap") > place[0]) | (p("distance") < place[1])


def supports(p: Get, place: tuple[float, float, float]) -> Column:
    return (p("iou") > place[0]) | (p("overlap") > place[1]) | (p("distance") < place[2])


def _unlike(get: Get) -> Column:
    """Rows whose boxes or frame sizes the numpy folds would not treat as the expressions do."""
    return unlike_numbers(get, *BOX) | F.coalesce((get("image_width") == 0) | (get("image_height") == 0), F.lit(False))


def _detection_block() -> Block:
    kinds = {}
    for prefix in CLASS_PREFIX.values():
        kinds |= {f"{prefix}_max_iou": "double", f"{prefix}_max_overlap_min": "double", f"{prefix}_min_center_dist": "double",
                  f"{prefix}_contains_candidate_center": "boolean"}
    return Block(own=BOX + SIZE, their=BOX + ["class_id"], kinds=kinds, folds=_detection_numbers, odd=_unlike)


def _detection_numbers(p: Pairs) -> dict[str, np.ndarray]:
    """The folds of `detection_features` over numbers."""
    place = p.geometry()
    x, y = (p.own("x1") + p.own("x2")) / 2.0, (p.own("y1") + p.own("y2")) / 2.0
    inside = (p.their("x1") <= x) & (x <= p.their("x2")) & (p.their("y1") <= y) & (y <= p.their("y2"))
    out = {}
    for cls, prefix in CLASS_PREFIX.items():
        mine = p.their("class_id") == cls
        out[f"{prefix}_max_iou"] = p.greatest(place["iou"], mine, 0.0)
        out[f"{prefix}_max_overlap_min"] = p.greatest(place["overlap"], mine, 0.0)
        out[f"{prefix}_min_center_dist"] = p.least(place["distance"], mine, 9.0)
        out[f"{prefix}_contains_candidate_center"] = p.any(mine & inside)
    return out


def detection_features(candidates: DataFrame, detections: DataFrame, limit: int = ARRAY_LIMIT) -> DataFrame:
    """Per detector class: count, best overlaps, nearest centre, best confidence, centre containment."""

    def derive(l: Get, r: Get) -> dict[str, Column]:
        own, other = bx.field(l), bx.field(r)
        return {
            "class_id": r("class_id"), "iou": bx.iou(own, other), "overlap": bx.overlap_min(own, other),
            "inside": bx.contains_point(other, bx.center_x(own), bx.center_y(own)),
        }

    folds: dict[str, Fold | Nearest | PerFrame] = {}
    for cls, prefix in CLASS_PREFIX.items():
        mine = lambda p, c=cls: p("class_id") == c
        folds[f"{prefix}_count"] = PerFrame("count", where=mine)
        folds[f"{prefix}_max_iou"] = Fold("max", lambda p: p("iou"), mine, 0.0)
        folds[f"{prefix}_max_overlap_min"] = Fold("max", lambda p: p("overlap"), mine, 0.0)
        folds[f"{prefix}_min_center_dist"] = Nearest("class_id", cls)
        folds[f"{prefix}_max_conf"] = PerFrame("max", lambda p: tx.safe_float(p("conf")), mine, 0.0)
        folds[f"{prefix}_contains_candidate_center"] = Fold("any", lambda p: p("inside"), mine)
    out = relate(candidates, detections, on="image_id", derive=derive, folds=folds, left_cols=BOX + SIZE,
                 right_cols=["class_id", "conf"] + BOX, reach=0.0, collapse={"conf": F.max}, limit=limit, block=_detection_block())
    for prefix in CLASS_PREFIX.values():
        for name in (f"{prefix}_count", f"{prefix}_contains_candidate_center"):
            out = out.withColumn(name, F.col(name).cast("double"))
    return out


def evidence_flags(df: DataFrame) -> DataFrame:
    """Flags over detector features: channel evidence near, other number or other text overlapped."""
    c = F.col
    touches = lambda prefix: (c(f"{prefix}_max_iou") > 0.03) | (c(f"{prefix}_max_overlap_min") > 0.20)
    near = (
        touches("yolo_ch0") | (c("yolo_ch0_min_center_dist") < 0.08)
        | touches("yolo_area3") | (c("yolo_area3_contains_candidate_center") > 0)
    )
    return (
        df.withColumn("near_yolo_channel_evidence", near.cast("double"))
        .withColumn("overlaps_other_number", touches("yolo_other_num1").cast("double"))
        .withColumn("overlaps_other_text", touches("yolo_other_text2").cast("double"))
    )


def _own_columns(candidates: DataFrame) -> DataFrame:
    """Columns the rules read on the candidate's own side."""
    parent = F.col("parent_text") if "parent_text" in candidates.columns else F.lit(None).cast("string")
    return (
        candidates.withColumn("_parent_text", parent)
        .withColumn("_value", tx.digits(F.col("text")))
        .withColumn("_plain", tx.is_plain_numeric(F.col("text")))
        .withColumn("_alpha", tx.has_alpha(F.col("text")))
        .withColumn("_alpha_only", tx.is_alpha_only(F.col("text")))
        .withColumn("_original", tx.is_original(F.col("source")))
        .withColumn("_recheck", tx.is_recheck_source(F.col("source")))
        .withColumn("_weak", tx.mixed_alpha(F.col("text")))
        .withColumn("_trusted", tx.trusted_numeric(F.col("source"), F.col("text"), parent))
    )


def _agreement_folds() -> dict[str, Fold]:
    text = lambda p: p("kind") == "text"
    agrees = lambda p: p("plain") & p("same_value")
    return {
        "numeric_support": Fold("any", lambda p: close(p, SAME_PLACE) & ~p("is_parent") & agrees(p), text, others=True),
        "alpha_conflict": Fold(
            "any", lambda p: close(p, SAME_PLACE) & ~p("is_parent") & ~agrees(p) & p("alpha"), text, others=True),
        "alpha_only_near": Fold("any", lambda p: close(p, SAME_PLACE) & p("alpha_only"), text),
        "text_backs_recheck": Fold("any", lambda p: close(p, RECHECK_PLACE) & (p("same_value") | p("extends")), text),
    }


def _detector_folds() -> dict[str, Fold]:
    box = lambda *classes: lambda p: (p("kind") == "box") & p("class_id").isin(*classes)
    penalty = lambda p: (F.lit(0.20) + 0.45 * p("iou")) * F.when(
        p("trusted"), F.when(p("class_id") == OTHER_NUMBER, 0.35).otherwise(0.50)).otherwise(1.0)

    def bonus(p: Get) -> Column:
        channel = p("class_id") == CHANNEL
        by_overlap = p("iou") * F.when(channel, 0.55).otherwise(0.35)
        by_distance = F.greatest(F.lit(0.0), F.when(channel, 0.25).otherwise(0.32) - p("distance"))
        return (by_overlap + by_distance) * F.when(~channel & p("weak"), 0.25).otherwise(1.0)

    def fitted(p: Get) -> Column:
        return F.struct(
            bonus(p).alias("bonus"), (-p("index")).alias("order"), p("index").alias("detection_index"),
            p("class_id").alias("class_id"), *[p(f"b{n}").alias(n) for n in BOX],
            p("iou").alias("iou"), p("distance").alias("distance"))

    return {
        "box_backs_recheck": Fold("any", lambda p: supports(p, SUPPORT_RECHECK), box(CHANNEL, AREA)),
        "strong_channel": Fold("any", lambda p: supports(p, SUPPORT_STRONG) & (p("conf") >= 0.25), box(CHANNEL)),
        "text_box_overlap": Fold("max", lambda p: p("overlap"), box(OTHER_TEXT), 0.0),
        "penalty": Fold("max", penalty, lambda p: box(OTHER_NUMBER, OTHER_TEXT)(p) & (p("iou") > 0.10), 0.0),
        "aligned": Fold("best", fitted, lambda p: box(CHANNEL, AREA)(p) & (bonus(p) > 0)),
    }


AGREEMENT = tuple(_agreement_folds())
DETECTOR = tuple(_detector_folds())
CODED = 17
"""Digits of a value that fit into its code: the number written with a 1 before them."""
_POWERS = 10 ** np.arange(CODED + 1, dtype="int64")


def _code(value: Column) -> Column:
    return F.when(F.length(value) <= CODED, F.concat(F.lit("1"), value).cast("long"))


def _rule_block(names: tuple[str, ...]) -> Block:
    """The folds of `rule_evidence` over numbers; the detection of the best pair is then read from the array."""
    kinds = {n: "double" if n in ("text_box_overlap", "penalty") else "boolean" for n in names if n != "aligned"}
    if "aligned" in names:
        kinds |= {"at": "int", "bonus": "double", "iou": "double", "distance": "double"}

    def finish(get: Get, near: Column) -> dict[str, Column]:
        out = {n: get(n) for n in names if n != "aligned"}
        if "aligned" in names:
            best = F.get(near, get("at"))
            out["aligned"] = F.when(get("at").isNotNull(), F.struct(
                get("bonus").alias("bonus"), (-best["detection_index"]).alias("order"), best["detection_index"].alias("detection_index"),
                best["class_id"].alias("class_id"), *[best[n].alias(n) for n in BOX], get("iou").alias("iou"),
                get("distance").alias("distance")))
        return out

    def odd(get: Get) -> Column:
        return _unlike(get) | F.coalesce(F.length(get("value")) > CODED, F.lit(False))

    their = BOX + ["is_text", "code", "plain", "alpha", "alpha_only", "class_id", "conf", "detection_index", "row_id"]
    return Block(own=BOX + SIZE + ["code", "row_id", "_original", "_trusted", "_weak"], their=their, kinds=kinds,
                 folds=partial(_rule_numbers, names), odd=odd, finish=finish, exact=("code",))


def _rule_numbers(names: tuple[str, ...], p: Pairs) -> dict[str, np.ndarray]:
    """`_agreement_folds` and `_detector_folds` over numbers."""
    iou, overlap, distance = (p.geometry()[n] for n in ("iou", "overlap", "distance"))
    near = lambda place: (overlap > place[0]) | (distance < place[1])
    backs = lambda place: (iou > place[0]) | (overlap > place[1]) | (distance < place[2])
    text, cls = p.their("is_text"), p.their("class_id")
    box = lambda *classes: ~text & np.isin(cls, classes)
    own, their = p.own("code"), p.their("code")
    same = text & (own == their)
    own_length, their_length = (np.searchsorted(_POWERS, v, "right") - 1 for v in (own, their))
    extra = their_length - own_length
    tail = _POWERS[own_length]
    extends = text & (own_length >= 2) & (extra >= 1) & (extra <= 2) & (
        (their // _POWERS[np.clip(extra, 0, 2)] == own) | (their % tail == own % tail))
    other = text & ~(p.own("_original") & (p.own("row_id") == p.their("row_id")))
    agrees = p.their("plain") & same
    channel = cls == CHANNEL
    folds = {
        "numeric_support": lambda: p.any(other & near(SAME_PLACE) & agrees),
        "alpha_conflict": lambda: p.any(other & near(SAME_PLACE) & ~agrees & p.their("alpha")),
        "alpha_only_near": lambda: p.any(text & near(SAME_PLACE) & p.their("alpha_only")),
        "text_backs_recheck": lambda: p.any(near(RECHECK_PLACE) & (same | extends)),
        "box_backs_recheck": lambda: p.any(box(CHANNEL, AREA) & backs(SUPPORT_RECHECK)),
        "strong_channel": lambda: p.any(box(CHANNEL) & backs(SUPPORT_STRONG) & (p.their("conf") >= 0.25)),
        "text_box_overlap": lambda: p.greatest(overlap, box(OTHER_TEXT), 0.0),
        "penalty": lambda: p.greatest(
            (0.20 + 0.45 * iou) * np.where(p.own("_trusted"), np.where(cls == OTHER_NUMBER, 0.35, 0.50), 1.0),
            box(OTHER_NUMBER, OTHER_TEXT) & (iou > 0.10), 0.0),
    }
    out = {n: folds[n]() for n in names if n != "aligned"}
    if "aligned" in names:
        bonus = (iou * np.where(channel, 0.55, 0.35) + np.fmax(0.0, np.where(channel, 0.25, 0.32) - distance)) * np.where(
            ~channel & p.own("_weak"), 0.25, 1.0)
        # The order of the struct that the expression compares.
        keys = [bonus, -p.their("detection_index"), p.their("detection_index"), cls, *[p.their(n) for n in BOX], iou, distance]
        best = p.best(box(CHANNEL, AREA) & (bonus > 0), keys)
        none = best < 0
        pick = lambda values: np.where(none, np.nan, values[best]) if len(values) else np.full(p.rows, np.nan)
        out |= {"at": np.where(none, np.nan, best - p.first), "bonus": pick(bonus), "iou": pick(iou), "distance": pick(distance)}
    return out


def rule_evidence(candidates: DataFrame, detections: DataFrame | None, folds: tuple[str, ...] | None = None,
                  limit: int = ARRAY_LIMIT) -> DataFrame:
    """Every relation the rules need, from one join: originals and detections of a frame travel together."""
    own = _own_columns(candidates)
    has_parent = "parent_id" in candidates.columns and "candidate_id" in candidates.columns
    ident = F.col("candidate_id") if has_parent else F.lit(None).cast("string")
    null = lambda kind: F.lit(None).cast(kind)
    columns = {
        "kind": F.lit("text"), "value": F.col("_value"), "plain": F.col("_plain"), "alpha": F.col("_alpha"),
        "alpha_only": F.col("_alpha_only"), "class_id": null("int"), "conf": null("double"),
        "detection_index": null("int"), "other_id": ident, "row_id": F.col("candidate_index"),
        "is_text": F.lit(True),
    }
    right = None
    if detections is not None:
        right = detections.select(
            "image_id", F.lit("box").alias("kind"), *BOX, *SIZE, null("string").alias("value"),
            null("boolean").alias("plain"), null("boolean").alias("alpha"), null("boolean").alias("alpha_only"),
            "class_id", "conf", "detection_index", null("string").alias("other_id"), null("int").alias("row_id"),
            F.lit(False).alias("is_text"), null("long").alias("code"))
    left_parent = (
        F.when(tx.noise_context(F.col("source"), F.col("text"), F.col("_parent_text")), F.col("parent_id"))
        if has_parent else F.lit(None).cast("string"))
    # The names a hot frame compares to tell a row from its copies carry the same name on both sides.
    left = (
        own.withColumn("_skip_parent", left_parent).withColumn("value", F.col("_value"))
        .withColumn("plain", F.col("_plain")).withColumn("alpha", F.col("_alpha"))
        .withColumn("alpha_only", F.col("_alpha_only")).withColumn("row_id", F.col("candidate_index"))
        .withColumn("other_id", ident).withColumn("code", _code(F.col("_value"))))

    def derive(l: Get, r: Get) -> dict[str, Column]:
        extra = F.length(r("value")) - F.length(l("value"))
        false = F.lit(False)
        return {
            **pair_geometry(l, r), "kind": r("kind"), "class_id": r("class_id"), "conf": r("conf"),
            "index": r("detection_index"), **{f"b{n}": r(n) for n in BOX},
            "plain": F.coalesce(r("plain"), false), "alpha": F.coalesce(r("alpha"), false),
            "alpha_only": F.coalesce(r("alpha_only"), false),
            "same_value": F.coalesce(r("value") == l("value"), false),
            "extends": F.coalesce(
                (F.length(l("value")) >= 2) & extra.between(1, 2)
                & (F.startswith(r("value"), l("value")) | F.endswith(r("value"), l("value"))), false),
            "is_parent": F.coalesce(r("other_id") == l("_skip_parent"), false) if has_parent else false,
            "trusted": l("_trusted"), "weak": l("_weak"),
        }

    wanted = {**_agreement_folds(), **_detector_folds()}
    names = folds or tuple(wanted)
    left_cols = BOX + SIZE + ["value", "plain", "alpha", "alpha_only", "_skip_parent", "_trusted", "_weak", "_original"]
    right_cols = ["kind"] + BOX + ["value", "plain", "alpha", "alpha_only", "class_id", "conf", "detection_index"]
    if has_parent:
        right_cols.append("other_id")
        left_cols.append("other_id")
    out = relate(
        left, right, on="image_id", derive=derive, folds={k: wanted[k] for k in names}, left_cols=left_cols,
        right_cols=right_cols, reach=0.32 if detections is not None else 0.08,
        not_self=NotSelf("row_id", lambda l: l("_original")), collapse=DETECTION_COLLAPSE,
        own_rows=OwnRows(F.col("_original"), columns), limit=limit, block=None if has_parent else _rule_block(names))
    return out.drop("code", "value", "plain", "alpha", "alpha_only", "row_id", "_skip_parent", "other_id")


def _public(df: DataFrame, candidates: DataFrame, *more: str) -> DataFrame:
    return df.select(*candidates.columns, *more)


def location_adjustment() -> Column:
    """Score change from original readings at the same place, over the agreement columns."""
    support, conflict, recheck = F.col("numeric_support"), F.col("alpha_conflict"), F.col("_recheck")
    slot = F.coalesce(F.col("source") == "temporal_slot_recheck", F.lit(False))
    conflict_cost = F.when(conflict, F.when(slot, -0.18).otherwise(-0.95)).otherwise(0.0)
    lone_conflict = F.when(conflict & recheck & ~support, -0.25).otherwise(0.0)
    unsupported = F.when(recheck & ~support, -0.12).otherwise(0.0)
    total = F.when(support, 0.22).otherwise(0.0) + conflict_cost + lone_conflict + unsupported
    return F.when(F.col("_value") == "", 0.0).otherwise(total)


def same_location_adjustment(candidates: DataFrame, limit: int = ARRAY_LIMIT) -> DataFrame:
    ev = rule_evidence(candidates, None, ("numeric_support", "alpha_conflict"), limit)
    return _public(ev.withColumn("location_adjustment", location_adjustment()), candidates,
                   "numeric_support", "alpha_conflict", "location_adjustment")


def alpha_context(candidates: DataFrame, limit: int = ARRAY_LIMIT) -> DataFrame:
    """Rechecks lying over a text without digits; `alpha_rejected` when their confidence is low as well."""
    ev = rule_evidence(candidates, None, ("alpha_only_near",), limit)
    over = F.col("_recheck") & F.col("alpha_only_near")
    return _public(ev.withColumn("alpha_context", over).withColumn("alpha_rejected", over & (F.col("ocr_conf") < 0.35)),
                   candidates, "alpha_context", "alpha_rejected")


def recheck_support_rule(allow_single_digit: bool) -> Column:
    checked = F.coalesce(F.col("source") == "paddleocr_channel_recheck", F.lit(False))
    long_enough = F.lit(True) if allow_single_digit else F.length("_value") >= 2
    backed = F.col("text_backs_recheck") | (
        F.col("box_backs_recheck") & (F.coalesce(F.col("ocr_conf"), F.lit(0.0)) >= 0.55))
    return ~checked | (long_enough & backed)


def recheck_supported(candidates: DataFrame, detections: DataFrame, allow_single_digit: bool = False,
                      limit: int = ARRAY_LIMIT) -> DataFrame:
    ev = rule_evidence(candidates, detections, ("text_backs_recheck", "box_backs_recheck"), limit)
    return _public(ev.withColumn("recheck_supported", recheck_support_rule(allow_single_digit)), candidates,
                   "recheck_supported")


def class_support(boxes: DataFrame, detections: DataFrame, class_id: int, min_conf: float = 0.25,
                  place: tuple[float, float, float] = SUPPORT_CURRENT, out: str = "supported",
                  limit: int = ARRAY_LIMIT) -> DataFrame:
    """Whether a detection of the class lies at the box."""
    right = detections.where((F.col("class_id") == class_id) & (F.coalesce("conf", F.lit(1.0)) >= min_conf))
    return relate(boxes, right, on="image_id", derive=pair_geometry,
                  folds={out: Fold("any", lambda p: supports(p, place))}, left_cols=BOX + SIZE, right_cols=BOX,
                  reach=place[2], limit=limit)


def hallucination_rule() -> Column:
    """A weak number read off a long text line with letters or text boxes around it and no channel box."""
    w = F.greatest(F.lit(1.0), F.col("x2") - F.col("x1"))
    h = F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))
    stretched = w / F.greatest(F.lit(1), F.length("_value")) / h >= 1.45
    parent = F.coalesce(F.col("_parent_text"), F.lit(""))
    mixed_parent = (parent != "") & tx.has_alpha(parent) & ~tx.has_numeric_token(parent, F.col("_value"))
    around = F.col("alpha_only_near") | mixed_parent | (F.col("text_box_overlap") >= 0.45)
    return (F.col("_value") != "") & ~F.col("strong_channel") & (
        F.coalesce("ocr_conf", F.lit(0.5)) < 0.80) & stretched & around


def drop_text_hallucinations(candidates: DataFrame, detections: DataFrame, limit: int = ARRAY_LIMIT) -> DataFrame:
    ev = rule_evidence(candidates, detections, ("alpha_only_near", "strong_channel", "text_box_overlap"), limit)
    return _public(ev.where(~hallucination_rule()), candidates)


def snapped(prefix: str = "aligned") -> Column:
    """Whether the reading takes over the box of its best detection."""
    return F.coalesce((F.col(f"{prefix}.iou") > 0.15) | (F.col(f"{prefix}.distance") < 0.06), F.lit(False))


def best_alignment(candidates: DataFrame, detections: DataFrame, limit: int = ARRAY_LIMIT) -> DataFrame:
    """Best detection bonus, worst penalty, and the box after snapping."""
    ev = rule_evidence(candidates, detections, ("penalty", "aligned"), limit)
    out = ev.withColumn("bonus", F.coalesce(F.col("aligned.bonus"), F.lit(0.0))).withColumn(
        "aligned_detection", F.col("aligned.detection_index")).withColumn("snapped", snapped())
    for n in BOX:
        out = out.withColumn(f"snap_{n}", F.when(F.col("snapped"), F.col(f"aligned.{n}")).otherwise(F.col(n)))
    return _public(out, candidates, "bonus", "penalty", "aligned_detection", "snapped", *[f"snap_{n}" for n in BOX])


def channel_frames(detections: DataFrame, min_conf: float) -> DataFrame:
    evidence = F.col("class_id").isin(CHANNEL, AREA) & (F.coalesce("conf", F.lit(1.0)) >= min_conf)
    return detections.where(evidence).select("image_id").distinct()


def require_channel_evidence(frames: DataFrame, detections: DataFrame, min_conf: float = 0.25) -> DataFrame:
    """Flag frames with a channel or area box of enough confidence; the rest carry a reject reason."""
    has = channel_frames(detections, min_conf).withColumn("_has", F.lit(True))
    return (
        frames.join(has, "image_id", "left")
        .withColumn("has_channel_evidence", F.coalesce("_has", F.lit(False)))
        .withColumn("reject_reason", F.when(F.col("has_channel_evidence"), "").otherwise("no_channel_evidence"))
        .drop("_has")
    )


def one_digit_boxes(detections: DataFrame, candidates: DataFrame, min_conf: float = 0.5, max_aspect: float = 1.6,
                    max_area: float = 0.015, limit: int = ARRAY_LIMIT) -> DataFrame:
    """Small, squarish channel boxes that no reading of two or more digits overlaps."""
    w = F.greatest(F.lit(1.0), F.col("x2") - F.col("x1"))
    h = F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))
    frame = F.greatest(F.lit(1.0), (F.col("image_width") * F.col("image_height")).cast("double"))
    boxes = detections.where(
        (F.col("class_id") == CHANNEL) & (F.coalesce("conf", F.lit(1.0)) >= min_conf)
        & (w / h <= max_aspect) & (w * h / frame <= max_area))
    many = candidates.where(F.length(tx.digits(F.col("text"))) >= 2)
    out = relate(boxes, many, on="image_id", derive=pair_geometry,
                 folds={"_covered": Fold("any", lambda p: p("overlap") > 0.45)}, left_cols=BOX + SIZE,
                 right_cols=BOX, reach=0.0, limit=limit)
    return out.where(~F.col("_covered")).drop("_covered")


def evidence_gate(history: DataFrame, current: DataFrame, detections: DataFrame, min_evidence: float = 0.35,
                  one_digit_min_evidence: float = 0.45, limit: int = ARRAY_LIMIT) -> DataFrame:
    """Accept or reject readings made in a remembered region, with the reason. `history` carries the visual measures
    visible_text_evidence_score, crop_std, edge_density, digit_like_component_count and crop_aspect_per_digit."""
    value = tx.digits(F.col("text"))
    own = history.withColumn("_value", value)
    right = current.select(
        "image_id", F.lit(-1).alias("class_id"), *BOX, *SIZE, tx.digits(F.col("text")).alias("value"),
        tx.has_alpha(F.col("text")).alias("alpha"), F.lit(1.0).alias("conf"),
    ).unionByName(detections.where(F.col("class_id").isin(CHANNEL, OTHER_TEXT)).select(
        "image_id", "class_id", *BOX, *SIZE, F.lit("").alias("value"), F.lit(False).alias("alpha"),
        F.coalesce("conf", F.lit(1.0)).alias("conf")))

    def derive(l: Get, r: Get) -> dict[str, Column]:
        return {**pair_geometry(l, r), "class_id": r("class_id"), "conf": r("conf"), "alpha": r("alpha"),
                "value": r("value"), "own": l("_value")}

    reading = lambda p: (p("class_id") == -1) & close(p, SAME_PLACE)
    at = lambda cls: lambda p: (p("class_id") == cls) & (p("conf") >= 0.25) & supports(p, SUPPORT_CURRENT)
    same = lambda p: (p("value") == p("own")) & ~p("alpha")
    rows = relate(
        own, right, on="image_id", derive=derive, left_cols=BOX + SIZE + ["_value"],
        right_cols=BOX + ["class_id", "conf", "alpha", "value"], reach=0.045, collapse={"conf": F.max}, limit=limit,
        folds={
            "_exact": Fold("any", lambda p: reading(p) & same(p)),
            "_alpha": Fold("any", lambda p: reading(p) & ~same(p) & p("alpha") & (p("value") == "")),
            "_channel": Fold("any", at(CHANNEL)),
            "_text": Fold("any", at(OTHER_TEXT)),
        })
    num = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    single = F.length("_value") == 1
    weak = num("visible_text_evidence_score") < F.when(single, one_digit_min_evidence).otherwise(min_evidence)
    flat = num("crop_std") < 6.0
    odd_edges = (num("edge_density") < 0.003) | (num("edge_density") > 0.48)
    odd_shape = single & (~num("digit_like_component_count").isin(1.0, 2.0)
                          | ~num("crop_aspect_per_digit").between(0.18, 2.20))
    supported = F.col("_channel") | F.col("_exact")
    conflict = (F.col("_alpha") | F.col("_text")) & ~supported
    reason = (
        F.when((F.col("_value") == "") | F.col("x1").isNull(), "missing_bbox_or_digits")
        .when(supported & ~(flat & odd_edges), "accepted_supported")
        .when(conflict & (weak | flat | odd_edges | odd_shape), "text_or_class2_conflict_without_channel_support")
        .when(odd_shape & ~supported, "implausible_one_digit_geometry")
        .when(flat & odd_edges, "blank_or_low_content_crop")
        .otherwise("accepted")
    )
    return rows.withColumn("gate_reason", reason).withColumn(
        "accepted", F.startswith("gate_reason", F.lit("accepted"))).drop("_value", "_exact", "_alpha", "_channel", "_text")
