"""Queries over the joins between readings, detections and truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from framefusion.operators import evidence as ev
from framefusion.operators import rules
from framefusion.plans import fixtures as fx
from framefusion.plans.registry import (
    q6, query, r6, rounded, sql_digits, sql_distance, sql_iou, sql_overlap)

KEY = ("image_id", "candidate_index")
IOU, OVERLAP, DIST = sql_iou("c", "d"), sql_overlap("c", "d"), sql_distance("c", "d")


def _detection_sql() -> str:
    out = []
    for cls, p in ev.CLASS_PREFIX.items():
        is_cls = f"CASE WHEN d.class_id = {cls} THEN"
        out += [
            f"CAST(count({is_cls} 1 END) AS DOUBLE) AS {p}_count",
            f"coalesce(max({is_cls} d.iou END), 0) AS {p}_max_iou",
            f"coalesce(max({is_cls} d.ov END), 0) AS {p}_max_overlap_min",
            f"coalesce(min({is_cls} d.dist END), 9) AS {p}_min_center_dist",
            f"coalesce(max({is_cls} d.conf END), 0) AS {p}_max_conf",
            f"CAST(coalesce(max({is_cls} d.inside END), 0) AS DOUBLE) AS {p}_contains_candidate_center",
        ]
    return ", ".join(out)


PAIRS = f""", pairs AS (
  SELECT c.image_id, c.candidate_index, d.class_id, d.conf, d.detection_index, {IOU} AS iou, {OVERLAP} AS ov, {DIST} AS dist,
         CASE WHEN d.x1 <= (c.x1 + c.x2) / 2 AND (c.x1 + c.x2) / 2 <= d.x2 AND d.y1 <= (c.y1 + c.y2) / 2
               AND (c.y1 + c.y2) / 2 <= d.y2 THEN 1 ELSE 0 END AS inside, d.x1, d.y1, d.x2, d.y2
  FROM candidates c JOIN detections d ON c.image_id = d.image_id)"""
FEATURES = f"""{PAIRS}, features AS (
  SELECT c.image_id, c.candidate_index, {_detection_sql()}
  FROM candidates c LEFT JOIN pairs d ON c.image_id = d.image_id AND c.candidate_index = d.candidate_index
  GROUP BY c.image_id, c.candidate_index)"""
FLAGS = """CAST(yolo_ch0_max_iou > 0.03 OR yolo_ch0_max_overlap_min > 0.20 OR yolo_ch0_min_center_dist < 0.08
    OR yolo_area3_max_iou > 0.03 OR yolo_area3_max_overlap_min > 0.20 OR yolo_area3_contains_candidate_center > 0 AS DOUBLE) AS near_yolo_channel_evidence,
  CAST(yolo_other_num1_max_iou > 0.03 OR yolo_other_num1_max_overlap_min > 0.20 AS DOUBLE) AS overlaps_other_number,
  CAST(yolo_other_text2_max_iou > 0.03 OR yolo_other_text2_max_overlap_min > 0.20 AS DOUBLE) AS overlaps_other_text"""


DETECTOR_COLUMNS = [f"{p}_{m}" for p in ev.CLASS_PREFIX.values() for m in (
    "count", "max_iou", "max_overlap_min", "min_center_dist", "max_conf", "contains_candidate_center")]


@query("detection_features", f"""{FEATURES} SELECT image_id, candidate_index,
  {', '.join(f'{q6(c)} AS {c}' for c in DETECTOR_COLUMNS)} FROM features""")
def detection_features(spark, folder):
    out = ev.detection_features(fx.candidates(spark, folder), fx.detections(spark, folder))
    return rounded(out.select(*KEY, *DETECTOR_COLUMNS))


@query("evidence_flags", f"{FEATURES} SELECT image_id, candidate_index, {FLAGS} FROM features")
def evidence_flags(spark, folder):
    out = ev.evidence_flags(ev.detection_features(fx.candidates(spark, folder), fx.detections(spark, folder)))
    return out.select(*KEY, "near_yolo_channel_evidence", "overlaps_other_number", "overlaps_other_text")


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


from framefusion.functions import text as tx  # noqa: E402

OWN = f""", own AS (
  SELECT *, {sql_digits('text')} AS value, regexp_matches(text, '^\\s*[0-9]{{1,5}}\\s*$') AS plain,
         regexp_matches(text, '[A-Za-z]') AS alpha, regexp_matches(text, '[A-Za-z]') AND {sql_digits('text')} = '' AS alpha_only,
         source NOT IN {_in(tx.DERIVED_SOURCES)} AS original, source IN {_in(tx.RECHECK_SOURCES)} AS recheck
  FROM candidates)"""
SAME = f"({OVERLAP} > 0.45 OR {DIST} < 0.045)"
WIDE = f"({OVERLAP} > 0.25 OR {DIST} < 0.08)"
EXTENDS = """(length(c.value) >= 2 AND length(d.value) - length(c.value) BETWEEN 1 AND 2
   AND (starts_with(d.value, c.value) OR ends_with(d.value, c.value)))"""
AGREE = f"""{OWN}, agree AS (
  SELECT c.image_id, c.candidate_index,
    coalesce(bool_or(d.candidate_index <> c.candidate_index AND {SAME} AND d.plain AND d.value = c.value), false) AS numeric_support,
    coalesce(bool_or(d.candidate_index <> c.candidate_index AND {SAME} AND NOT (d.plain AND d.value = c.value) AND d.alpha), false) AS alpha_conflict,
    coalesce(bool_or({SAME} AND d.alpha_only), false) AS alpha_only_near,
    coalesce(bool_or({WIDE} AND (d.value = c.value OR {EXTENDS})), false) AS text_backs
  FROM own c LEFT JOIN own d ON c.image_id = d.image_id AND d.original GROUP BY ALL)"""
ADJUST = """CASE WHEN c.value = '' THEN 0 ELSE
    CASE WHEN a.numeric_support THEN 0.22 ELSE 0 END
    + CASE WHEN a.alpha_conflict THEN CASE WHEN c.source = 'temporal_slot_recheck' THEN -0.18 ELSE -0.95 END ELSE 0 END
    + CASE WHEN a.alpha_conflict AND c.recheck AND NOT a.numeric_support THEN -0.25 ELSE 0 END
    + CASE WHEN c.recheck AND NOT a.numeric_support THEN -0.12 ELSE 0 END END"""


@query("same_location_adjustment", f"""{AGREE} SELECT c.image_id, c.candidate_index, a.numeric_support, a.alpha_conflict,
  {q6(f'CAST({ADJUST} AS DOUBLE)')} AS location_adjustment FROM own c JOIN agree a USING (image_id, candidate_index)""")
def same_location_adjustment(spark, folder):
    out = ev.same_location_adjustment(fx.candidates(spark, folder))
    return rounded(out.select(*KEY, "numeric_support", "alpha_conflict", "location_adjustment"))


@query("alpha_context", f"""{AGREE} SELECT c.image_id, c.candidate_index, c.recheck AND a.alpha_only_near AS alpha_context,
  c.recheck AND a.alpha_only_near AND c.ocr_conf < 0.35 AS alpha_rejected FROM own c JOIN agree a USING (image_id, candidate_index)""")
def alpha_context(spark, folder):
    return ev.alpha_context(fx.candidates(spark, folder)).select(*KEY, "alpha_context", "alpha_rejected")


BOXED = f"""{AGREE}, boxed AS (
  SELECT c.image_id, c.candidate_index,
    coalesce(bool_or(d.class_id IN (0, 3) AND ({IOU} > 0.12 OR {OVERLAP} > 0.35 OR {DIST} < 0.08)), false) AS box_backs,
    coalesce(bool_or(d.class_id = 0 AND d.conf >= 0.25 AND ({IOU} > 0.12 OR {OVERLAP} > 0.45 OR {DIST} < 0.045)), false) AS strong,
    coalesce(max(CASE WHEN d.class_id = 2 THEN {OVERLAP} END), 0) AS text_ov
  FROM own c LEFT JOIN detections d ON c.image_id = d.image_id GROUP BY ALL)"""
BACKED = """(c.source <> 'paddleocr_channel_recheck' OR (length(c.value) >= 2
    AND (a.text_backs OR (b.box_backs AND c.ocr_conf >= 0.55))))"""


@query("recheck_supported", f"""{BOXED} SELECT c.image_id, c.candidate_index, {BACKED} AS recheck_supported
  FROM own c JOIN agree a USING (image_id, candidate_index) JOIN boxed b USING (image_id, candidate_index)""")
def recheck_supported(spark, folder):
    out = ev.recheck_supported(fx.candidates(spark, folder), fx.detections(spark, folder))
    return out.select(*KEY, "recheck_supported")


@query("class_support", f""", near AS (SELECT c.image_id, c.candidate_index, bool_or({IOU} > 0.12 OR {OVERLAP} > 0.42 OR {DIST} < 0.045) AS s
    FROM candidates c JOIN detections d ON c.image_id = d.image_id AND d.class_id = 0 AND d.conf >= 0.25 GROUP BY ALL)
  SELECT c.image_id, c.candidate_index, coalesce(s, false) AS supported FROM candidates c LEFT JOIN near USING (image_id, candidate_index)""")
def class_support(spark, folder):
    out = ev.class_support(fx.candidates(spark, folder), fx.detections(spark, folder), ev.CHANNEL)
    return out.select(*KEY, "supported")


HALLUCINATION = """(c.value <> '' AND NOT b.strong AND c.ocr_conf < 0.80
    AND greatest(1.0, c.x2 - c.x1) / greatest(1, length(c.value)) / greatest(1.0, c.y2 - c.y1) >= 1.45
    AND (a.alpha_only_near OR b.text_ov >= 0.45))"""


@query("drop_text_hallucinations", f"""{BOXED} SELECT c.image_id, c.candidate_index, c.text
  FROM own c JOIN agree a USING (image_id, candidate_index) JOIN boxed b USING (image_id, candidate_index)
  WHERE NOT {HALLUCINATION}""")
def drop_text_hallucinations(spark, folder):
    out = ev.drop_text_hallucinations(fx.candidates(spark, folder), fx.detections(spark, folder))
    return out.select(*KEY, "text")


TOKEN = "list_contains(regexp_extract_all(' ' || regexp_replace(c.text, '[^A-Za-z0-9]', '  ', 'g') || ' ', ' ([0-9]{1,5}) ', 1), c.value)"
WEAK = f"(c.alpha AND NOT c.plain AND NOT {TOKEN})"
TRUSTED = "(c.plain AND length(c.value) BETWEEN 2 AND 5)"
ALIGN = f"""{BOXED}, bonus AS (
  SELECT c.image_id, c.candidate_index, d.detection_index, d.class_id, d.x1 AS bx1, d.y1 AS by1, d.x2 AS bx2, d.y2 AS by2,
    {IOU} AS iou, {DIST} AS dist,
    ({IOU} * CASE WHEN d.class_id = 0 THEN 0.55 ELSE 0.35 END
      + greatest(0.0::DOUBLE, CASE WHEN d.class_id = 0 THEN 0.25 ELSE 0.32 END - {DIST}))
      * CASE WHEN d.class_id = 3 AND {WEAK} THEN 0.25 ELSE 1.0 END AS bonus
  FROM own c JOIN detections d ON c.image_id = d.image_id AND d.class_id IN (0, 3)),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, candidate_index ORDER BY bonus DESC, detection_index) AS rn
    FROM bonus WHERE bonus > 0) WHERE rn = 1),
 worst AS (SELECT c.image_id, c.candidate_index, max((0.20 + 0.45 * {IOU}) * CASE WHEN NOT {TRUSTED} THEN 1.0
      WHEN d.class_id = 1 THEN 0.35 ELSE 0.50 END) AS penalty
  FROM own c JOIN detections d ON c.image_id = d.image_id AND d.class_id IN (1, 2) WHERE {IOU} > 0.10 GROUP BY ALL),
 aligned AS (SELECT c.image_id, c.candidate_index, coalesce(best.bonus, 0) AS bonus, coalesce(penalty, 0) AS penalty,
    best.detection_index AS aligned_detection, best.class_id AS aligned_class, coalesce(best.iou > 0.15 OR best.dist < 0.06, false) AS snapped,
    bx1, by1, bx2, by2
  FROM own c LEFT JOIN best USING (image_id, candidate_index) LEFT JOIN worst USING (image_id, candidate_index))"""


@query("best_alignment", f"""{ALIGN} SELECT c.image_id, c.candidate_index, {q6('bonus')} AS bonus, {q6('penalty')} AS penalty,
  aligned_detection, snapped, CASE WHEN snapped THEN bx1 ELSE c.x1 END AS snap_x1, CASE WHEN snapped THEN by1 ELSE c.y1 END AS snap_y1,
  CASE WHEN snapped THEN bx2 ELSE c.x2 END AS snap_x2, CASE WHEN snapped THEN by2 ELSE c.y2 END AS snap_y2
  FROM own c JOIN aligned USING (image_id, candidate_index)""")
def best_alignment(spark, folder):
    out = ev.best_alignment(fx.candidates(spark, folder), fx.detections(spark, folder))
    return rounded(out.select(*KEY, "bonus", "penalty", "aligned_detection", "snapped",
                              "snap_x1", "snap_y1", "snap_x2", "snap_y2"))


POSITION = """least(CASE WHEN (c.x1 + c.x2) / 2 < 1280 * 0.18 THEN 0.35 ELSE 0 END
  + CASE WHEN (c.y1 + c.y2) / 2 > 720 * 0.62 THEN 0.30 ELSE 0 END
  + CASE WHEN c.x1 < 1280 * 0.08 AND (c.y1 + c.y2) / 2 > 720 * 0.70 THEN 0.25 ELSE 0 END, 0.8)"""
QUALITY = f"""(CASE WHEN c.plain THEN 0.12 ELSE 0 END
  + CASE WHEN regexp_matches(c.text, '(?i)\\b(news|sports?|season|episode|crime|india|bangla|telugu|tamil|sony|star|zee|cnn|cnbc|tv)\\b') THEN -0.55 ELSE 0 END
  + CASE WHEN NOT c.alpha THEN 0 ELSE -0.65 + CASE WHEN NOT {TOKEN} THEN -0.25 WHEN c.source = 'refined_numeric_substring' THEN -0.10 ELSE 0 END END)"""
SCORED = f"""{ALIGN}, scored AS (
  SELECT c.image_id, c.candidate_index, c.text, c.source, c.value AS digits, c.ocr_conf, c.x1, c.y1, c.x2, c.y2, aligned_detection, aligned_class, snapped,
    CAST(0.35 + 0.45 * greatest(0, least(c.ocr_conf, 1)) + {POSITION} + CASE WHEN length(c.value) IN (2, 3) THEN 0.20 ELSE 0 END
    - CASE WHEN contains(c.text, ':') OR contains(lower(c.text), 'pm') OR contains(lower(c.text), 'am') THEN 0.55 ELSE 0 END
    - CASE WHEN c.source = 'refined_numeric_substring' THEN 0.10 ELSE 0 END + CASE WHEN c.recheck THEN 0.08 ELSE 0 END
    + {QUALITY} + {ADJUST} + bonus - penalty AS DOUBLE) AS rule_score
  FROM own c JOIN agree a USING (image_id, candidate_index) JOIN boxed b USING (image_id, candidate_index)
    JOIN aligned USING (image_id, candidate_index)
  WHERE length(c.value) BETWEEN 1 AND 5 AND NOT (c.ocr_conf < 0.35 AND c.recheck AND a.alpha_only_near) AND {BACKED})"""


def scored(spark, folder):
    """Rule score rounded as the ranking rounds it, so that equal scores tie."""
    out = rules.rule_score(fx.candidates(spark, folder), fx.detections(spark, folder))
    return out.withColumn("rule_score", r6("rule_score"))


@query("rule_score", f"{SCORED} SELECT image_id, candidate_index, digits, {q6('rule_score')} AS rule_score, aligned_detection FROM scored")
def rule_score(spark, folder):
    return scored(spark, folder).select(*KEY, "digits", "rule_score", "aligned_detection")


RANKED = f"""{SCORED}, ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {q6('rule_score')} DESC, candidate_index) AS rank
  FROM scored) WHERE rank <= 20)"""


@query("rank_candidates", f"{RANKED} SELECT image_id, candidate_index, CAST(rank AS INT) AS rank FROM ranked")
def rank_candidates(spark, folder):
    return rules.rank_candidates(scored(spark, folder)).select(*KEY, "rank")


# One score per digit count (a coarse confidence) makes ties common, as promotion only acts on ties.
PROMOTED = f"""{SCORED}, coarse AS (SELECT *, round(ocr_conf, 1) AS fusion_score FROM scored),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY fusion_score DESC, candidate_index) AS rank FROM coarse),
 tied AS (SELECT c.*, b.x1 AS qx1, b.y1 AS qy1, b.x2 AS qx2, b.y2 AS qy2 FROM ranked c JOIN ranked b ON c.image_id = b.image_id AND b.rank = 1
   WHERE length(b.digits) < 3 AND length(c.digits) = 3 AND c.rank > 1 AND c.fusion_score >= b.fusion_score),
 won AS (SELECT c.image_id, min(c.rank) AS promoted FROM tied c
   JOIN (SELECT image_id, x1, y1, x2, y2 FROM ranked WHERE rank = 1) d ON c.image_id = d.image_id
   WHERE ({q6('c.rule_score')} >= 0.25 AND ({OVERLAP} > 0.55 OR {DIST} < 0.045 OR c.aligned_detection IS NOT NULL))
      OR (c.source = 'paddleocr_channel_recheck' AND c.aligned_detection IS NOT NULL AND c.ocr_conf >= 0.55) GROUP BY ALL)
 SELECT r.image_id, r.candidate_index, coalesce(r.rank = w.promoted, false) AS promoted,
   CAST(CASE WHEN r.rank = w.promoted THEN 1 WHEN r.rank < w.promoted THEN r.rank + 1 ELSE r.rank END AS INT) AS rank
 FROM ranked r LEFT JOIN won w USING (image_id)"""


@query("promote_three_digit", PROMOTED)
def promote_three_digit(spark, folder):
    coarse = scored(spark, folder).withColumn("fusion_score", F.round("ocr_conf", 1))
    ranked = rules.rank_candidates(coarse, "fusion_score", k=1_000_000)
    return rules.promote_three_digit(ranked).select(*KEY, "promoted", "rank")


@query("require_channel_evidence", """SELECT f.image_id, count(d.image_id) > 0 AS has_channel_evidence,
  CASE WHEN count(d.image_id) > 0 THEN '' ELSE 'no_channel_evidence' END AS reject_reason
  FROM frames f LEFT JOIN detections d ON f.image_id = d.image_id AND d.class_id IN (0, 3) AND d.conf >= 0.25 GROUP BY f.image_id""")
def require_channel_evidence(spark, folder):
    out = ev.require_channel_evidence(fx.ground_truth(spark, folder).select("image_id"), fx.detections(spark, folder))
    return out.select("image_id", "has_channel_evidence", "reject_reason")


@query("one_digit_boxes", f""", small AS (SELECT *, greatest(1.0, x2 - x1) AS w, greatest(1.0, y2 - y1) AS hh FROM detections)
 SELECT c.image_id, c.detection_index FROM small c WHERE class_id = 0 AND conf >= 0.5 AND w / hh <= 2.2 AND w * hh / (1280 * 720) <= 0.015
  AND NOT EXISTS (SELECT 1 FROM candidates d WHERE d.image_id = c.image_id AND length({sql_digits('d.text')}) >= 2 AND {OVERLAP} > 0.45)""")
def one_digit_boxes(spark, folder):
    # The boxes of these tables are wider than a single digit, hence the wider aspect.
    out = ev.one_digit_boxes(fx.detections(spark, folder), fx.candidates(spark, folder), max_aspect=2.2)
    return out.select("image_id", "detection_index")


EDGE = "CAST((c.image_id % 100) AS DOUBLE) / 200"
GATE = f"""{OWN}, hist AS (SELECT *, ocr_conf AS ev, CAST(candidate_index % 12 AS DOUBLE) AS std, {EDGE} AS edge,
    image_id % 4 AS comps, 0.1 + CAST(image_id % 25 AS DOUBLE) / 10 AS asp FROM own c WHERE source = 'slot_proposal_recheck'),
 flags AS (SELECT c.image_id, c.candidate_index,
   coalesce(bool_or({SAME} AND d.value = c.value AND NOT d.alpha), false) AS exact,
   coalesce(bool_or({SAME} AND NOT (d.value = c.value AND NOT d.alpha) AND d.alpha AND d.value = ''), false) AS alpha
   FROM hist c LEFT JOIN own d ON c.image_id = d.image_id AND d.source <> 'slot_proposal_recheck' GROUP BY ALL),
 boxes AS (SELECT c.image_id, c.candidate_index,
   coalesce(bool_or(d.class_id = 0 AND ({IOU} > 0.12 OR {OVERLAP} > 0.42 OR {DIST} < 0.045)), false) AS channel,
   coalesce(bool_or(d.class_id = 2 AND ({IOU} > 0.12 OR {OVERLAP} > 0.42 OR {DIST} < 0.045)), false) AS txt
   FROM hist c LEFT JOIN detections d ON c.image_id = d.image_id AND d.conf >= 0.25 GROUP BY ALL),
 all_flags AS (SELECT h.*, exact, alpha AS alpha_near, channel, txt, exact OR channel AS supported, std < 6 AS flat,
   edge < 0.003 OR edge > 0.48 AS odd_edges,
   ev < CASE WHEN length(value) = 1 THEN 0.45 ELSE 0.35 END AS weak,
   length(value) = 1 AND (comps NOT IN (1, 2) OR NOT (asp BETWEEN 0.18 AND 2.20)) AS odd_shape
   FROM (SELECT * EXCLUDE (alpha) FROM hist) h JOIN flags USING (image_id, candidate_index) JOIN boxes USING (image_id, candidate_index))
 SELECT image_id, candidate_index, CASE WHEN value = '' THEN 'missing_bbox_or_digits'
   WHEN supported AND NOT (flat AND odd_edges) THEN 'accepted_supported'
   WHEN (alpha_near OR txt) AND NOT supported AND (weak OR flat OR odd_edges OR odd_shape) THEN 'text_or_class2_conflict_without_channel_support'
   WHEN odd_shape AND NOT supported THEN 'implausible_one_digit_geometry'
   WHEN flat AND odd_edges THEN 'blank_or_low_content_crop' ELSE 'accepted' END AS gate_reason FROM all_flags"""


@query("evidence_gate", GATE)
def evidence_gate(spark, folder):
    """Readings of one source stand in for readings of a remembered region; their visual measures come from the ids."""
    cands = fx.candidates(spark, folder)
    image = F.col("image_id")
    history = (
        cands.where("source = 'slot_proposal_recheck'")
        .withColumn("visible_text_evidence_score", F.col("ocr_conf"))
        .withColumn("crop_std", (F.col("candidate_index") % 12).cast("double"))
        .withColumn("edge_density", (image % 100).cast("double") / 200)
        .withColumn("digit_like_component_count", image % 4)
        .withColumn("crop_aspect_per_digit", F.lit(0.1) + (image % 25).cast("double") / 10)
    )
    out = ev.evidence_gate(history, cands.where("source <> 'slot_proposal_recheck'"), fx.detections(spark, folder))
    return out.select(*KEY, "gate_reason")
