"""Queries over ordered frames: tracks, slots, fields, consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from framefusion.operators import consensus as co
from framefusion.operators import frames as fr
from framefusion.operators import generate as gen
from framefusion.operators import measures
from framefusion.operators import rules
from framefusion.operators import slots as sl
from framefusion.operators import tracking as tr
from framefusion.operators.recheck import Recheck
from framefusion.plans import fixtures as fx
from framefusion.plans.registry import q6, query, r6, rounded, sql_class, sql_best_digit, sql_digits, sql_strip
from framefusion.plans.relations import KEY
from framefusion.plans.selection import LABELLED, selected
from framefusion.session import store_step


def _frames(spark, folder):
    return fx.frames(spark, folder).select("image_id", "sequence_id", "frame_index", "image_width", "image_height")


def readings(spark, folder):
    return sl.slot_readings(fx.candidates(spark, folder), _frames(spark, folder))


def slotted(spark, folder):
    """Slot ids by screen column, as given ids for the measures of slots."""
    return readings(spark, folder).where("has_digit AND conf >= 0.3").withColumn("slot", F.floor((F.col("x1") - 64) / 300).cast("int"))


READ = f""", rd AS (SELECT f.sequence_id, f.frame_index, c.image_id, c.candidate_index, c.text, {sql_class('c.text')} AS kind, {sql_strip(sql_best_digit('c.text'))} AS value,
   {sql_digits('c.text')} <> '' AS has_digit, coalesce(nullif(c.ocr_conf, 0), 0.5) AS conf, (c.x1 + c.x2) / 2 / 1280 AS cx, (c.y1 + c.y2) / 2 / 720 AS cy, (c.y2 - c.y1) / 720 AS h, c.x1, c.y1, c.x2, c.y2
   FROM candidates c JOIN frames f USING (image_id)),
 sl AS (SELECT *, CAST(floor((x1 - 64) / 300) AS INT) AS slot FROM rd WHERE has_digit AND conf >= 0.3),
 ch AS (SELECT * FROM rd WHERE kind = 'channelnum' AND value <> '' AND conf >= 0.3)"""


@query("observations", f"""SELECT sequence_id, frame_index, o.image_id, obs_order FROM (SELECT image_id, CAST(detection_index AS BIGINT) AS obs_order FROM detections WHERE class_id IN (0, 3)
  UNION ALL SELECT image_id, 1099511627776 + candidate_index FROM candidates WHERE length({sql_digits('text')}) BETWEEN 1 AND 4 AND NOT regexp_matches(text, '(?i)\\b[0-9]{{1,2}}\\s*:\\s*[0-9]{{2}}\\b|am|pm')
  UNION ALL SELECT image_id, -1 FROM frames) o JOIN frames USING (image_id)""")
def observations(spark, folder):
    out = tr.observations(_frames(spark, folder), fx.detections(spark, folder), fx.candidates(spark, folder))
    return out.select("sequence_id", "frame_index", "image_id", "obs_order")


def _observations(spark, folder):
    return tr.observations(_frames(spark, folder), fx.detections(spark, folder), fx.candidates(spark, folder))


@query("track_regions")
def track_regions(spark, folder):
    return tr.track_regions(_observations(spark, folder))


@query("slot_state")
def slot_state(spark, folder):
    return tr.slot_state(_observations(spark, folder))


@query("nearest_track")
def nearest_track(spark, folder):
    tracks = tr.track_regions(_observations(spark, folder))
    return tr.nearest_track(fx.candidates(spark, folder), tracks).select(*KEY, "track_fit.track", "track_fit.fit")


@query("annotate_history")
def annotate_history(spark, folder):
    tracks = tr.track_regions(_observations(spark, folder))
    return tr.annotate_history(fx.candidates(spark, folder), tracks)


@query("near_stable_only")
def near_stable_only(spark, folder):
    tracks = tr.track_regions(_observations(spark, folder))
    return tr.near_stable_only(tr.annotate_history(fx.candidates(spark, folder), tracks), 0.2)


@query("run_sequences")
def run_sequences(spark, folder):
    def choose(candidates, detections):
        # Only what the choice needs travels with a reading.
        scored = rules.rule_score(candidates, detections, suppress_hallucinations=True).select("image_id", "candidate_index", "digits", "rule_score")
        return rules.select_best(scored, "rule_score")

    return tr.run_sequences(_frames(spark, folder), fx.detections(spark, folder), fx.candidates(spark, folder), choose, "auto", "roi_prior")


class InWindow:
    """A stand-in for a recogniser: the digits of the frame's own readings whose corner lies in the window."""

    def predict_many(self, crops):
        return [[("".join(c for c in r["text"] if "0" <= c <= "9"), r["ocr_conf"]) for r in row["read"]
                 if row["x1"] <= r["x1"] <= row["x2"] and row["y1"] <= r["y1"] <= row["y2"]] for row in crops]


def whole_row(row):
    return row if row["read"] else None


def _walked(spark, folder):
    """Every frame walked with its locks read again, its readings at hand as pixels would be."""
    read = fx.candidates(spark, folder).groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("candidate_index", "text", "x1", "y1", "ocr_conf"))).alias("read"))
    frames = _frames(spark, folder).join(read, "image_id", "left")
    obs = tr.observations(frames, fx.detections(spark, folder), fx.candidates(spark, folder))
    return tr.walk_frames(obs, recheck=Recheck(InWindow, whole_row, carry=("read",), min_conf=0.5))


@query("sequence_rechecks")
def sequence_rechecks(spark, folder):
    """What is read where the locks are, inside the walk that moves them."""
    return tr.rechecked(_walked(spark, folder), "roi_prior_recheck").drop("image_width", "image_height")


@query("history_recheck")
def history_recheck(spark, folder):
    """Windows of every locked box read by a stand-in recogniser: the readings of the frame inside the window."""
    # The locks give the windows and are joined to what is read in them; stored, the walk runs once.
    states = store_step(tr.slot_state(_observations(spark, folder)).where("before_state = 'LOCKED' AND before_x1 IS NOT NULL").select(
        "image_id", *[f"before_{n}" for n in ("x1", "y1", "x2", "y2", "score", "age")]))
    box = [F.col(f"before_{n}").alias(n) for n in ("x1", "y1", "x2", "y2")]
    locks = states.select("image_id", F.lit(fx.WIDTH).alias("image_width"), F.lit(fx.HEIGHT).alias("image_height"), *box)
    windows = gen.history_windows(locks, ["image_id"])
    reads = fx.candidates(spark, folder).select("image_id", F.regexp_replace("text", "[^0-9]", "").alias("text"), "ocr_conf",
                                                F.col("x1").alias("rx"), F.col("y1").alias("ry")).where("text <> ''")
    hits = windows.join(reads, "image_id").where("rx BETWEEN x1 AND x2 AND ry BETWEEN y1 AND y2").withColumnRenamed("score", "proposal_score")
    held = states.select("image_id", *[F.col(f"before_{n}").alias(f"lock_{n}") for n in ("x1", "y1", "x2", "y2")],
                         F.col("before_score").alias("history_score"), F.col("before_age").alias("lock_age"))
    return tr.history_recheck(hits, held)


@query("with_priors", """SELECT image_id, CAST(class_id AS INT) AS class_id, source, count(*) AS n FROM (SELECT image_id, class_id, 'detector' AS source FROM detections
   UNION ALL SELECT image_id, 3, 'history_roi_prior' FROM frames WHERE image_id % 3 = 0) GROUP BY ALL""")
def with_priors(spark, folder):
    locks = _frames(spark, folder).where("image_id % 3 = 0").select(
        "image_id", *[F.lit(v).alias(k) for k, v in (("x1", 60.0), ("y1", 560.0), ("x2", 120.0), ("y2", 590.0))], F.lit(0.7).alias("history_score"))
    return fr.with_priors(fx.detections(spark, folder), locks).groupBy("image_id", "class_id", "source").agg(F.count(F.lit(1)).alias("n"))


@query("cluster_slots")
def cluster_slots(spark, folder):
    return sl.cluster_slots(readings(spark, folder)).select("sequence_id", "frame_index", *KEY, "slot")


@query("cluster_slots_by_size")
def cluster_slots_by_size(spark, folder):
    return sl.cluster_slots(readings(spark, folder), by_size=True).select("sequence_id", "frame_index", *KEY, "slot")


METRICS = f"""{READ}, nf AS (SELECT sequence_id, count(*) AS n_frames FROM frames GROUP BY 1),
 m AS (SELECT sequence_id, slot, count(DISTINCT frame_index) AS present, avg(CAST(kind = 'channelnum' AS DOUBLE)) AS chan_ratio, avg(CAST(kind = 'text' AS DOUBLE)) AS text_ratio,
   avg(CAST(kind IN ('time', 'date') AS DOUBLE)) AS time_ratio, count(DISTINCT CASE WHEN kind = 'channelnum' AND value <> '' THEN value END) AS "distinct",
   median(x1) AS a1, median(y1) AS a2, median(x2) AS a3, median(y2) AS a4, stddev_pop(cx) + stddev_pop(cy) AS pos_std, stddev_pop(h) / avg(h) AS h_cv,
   min(frame_index * 1000 + candidate_index) AS ff FROM sl GROUP BY ALL),
 sc AS (SELECT *, greatest(1.0, a3 - a1) / greatest(1.0, a4 - a2) AS aspect, greatest(1.0, a3 - a1) * greatest(1.0, a4 - a2) / (1280 * 720) AS area, greatest(1.0, a4 - a2) AS hp,
   (a1 + a3) / 2 / 1280 AS mcx, (a2 + a4) / 2 / 720 AS mcy FROM m JOIN nf USING (sequence_id)),
 met AS (SELECT *, round_even(1000 * (chan_ratio * (present / n_frames) * CASE WHEN "distinct" >= 2 THEN 1.0::DOUBLE + "distinct" * 0.15::DOUBLE ELSE 0.1::DOUBLE END * CASE WHEN time_ratio > 0.4 OR text_ratio > 0.5 THEN 0 ELSE 1 END
   * CASE WHEN aspect BETWEEN 0.25 AND 6 THEN 1 ELSE 0.15 END * CASE WHEN area > 0.06 THEN 0.15 ELSE 1 END * CASE WHEN pos_std > 0.03 THEN 0.5 ELSE 1 END * CASE WHEN h_cv > 0.35 THEN 0.6 ELSE 1 END), 0) / 1000 AS score FROM sc)"""


def _sizes(spark, folder):
    return fx.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("sequence_id")).agg(F.count(F.lit(1)).alias("n_frames"))


@query("slot_metrics", f"""{METRICS} SELECT sequence_id, slot, present, "distinct", {', '.join(f'{q6(c)} AS {c}' for c in ('chan_ratio', 'text_ratio', 'time_ratio', 'pos_std', 'h_cv', 'aspect', 'area', 'score'))} FROM met""")
def slot_metrics(spark, folder):
    out = sl.slot_metrics(slotted(spark, folder), _sizes(spark, folder))
    return rounded(out.select("sequence_id", "slot", "present", "distinct", "chan_ratio", "text_ratio", "time_ratio", "pos_std", "h_cv", "aspect", "area", "score"))


@query("label_slots", f"""{READ} SELECT sequence_id, slot, CASE WHEN bool_or(kind IN ('time', 'date')) THEN 'time' WHEN avg(CAST(kind = 'text' AS DOUBLE)) > 0.5 THEN 'text'
   WHEN count(DISTINCT CASE WHEN kind = 'channelnum' AND value <> '' THEN value END) >= 2 THEN 'channel' WHEN count(DISTINCT CASE WHEN kind = 'channelnum' AND value <> '' THEN value END) = 1 THEN 'constant' ELSE 'other' END AS label,
   {q6('median(x1)')} AS x1, {q6('median(y2)')} AS y2 FROM sl GROUP BY ALL""")
def label_slots(spark, folder):
    return rounded(sl.label_slots(slotted(spark, folder)).select("sequence_id", "slot", "label", "x1", "y2"))


@query("list_penalty", f"""{METRICS}, pen AS (SELECT a.*, EXISTS (SELECT 1 FROM met b WHERE a.sequence_id = b.sequence_id AND a.slot <> b.slot AND abs(a.mcx - b.mcx) < 0.03
    AND abs(a.hp - b.hp) / greatest(1.0, a.hp) < 0.3 AND abs(a.mcy - b.mcy) > 0.02 AND abs(a.mcy - b.mcy) < 0.18) AS vertical_neighbor FROM met a)
 SELECT sequence_id, slot, vertical_neighbor, {q6('CASE WHEN vertical_neighbor THEN round_even(1000 * (score * 0.6::DOUBLE), 0) / 1000 ELSE score END')} AS score FROM pen""")
def list_penalty(spark, folder):
    scored = sl.slot_metrics(slotted(spark, folder), _sizes(spark, folder))
    return rounded(sl.list_penalty(scored).select("sequence_id", "slot", "vertical_neighbor", "score"))


DUAL = f"""{METRICS}, sv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id, slot, frame_index ORDER BY conf DESC, candidate_index) AS rn FROM sl WHERE kind = 'channelnum' AND value <> '') WHERE rn = 1),
 pr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY round(score, 9) DESC, ff) AS rk FROM met) WHERE rk = 1 AND score > 0),
 com AS (SELECT o.sequence_id, o.slot, count(*) AS common, CAST(sum(CAST(o.value = p.value AS INT)) AS BIGINT) AS equal FROM sv o JOIN pr ON o.sequence_id = pr.sequence_id AND o.slot <> pr.slot
   JOIN sv p ON p.sequence_id = pr.sequence_id AND p.slot = pr.slot AND p.frame_index = o.frame_index GROUP BY ALL)"""


@query("dual_slots", f"""{DUAL} SELECT com.* FROM com JOIN met USING (sequence_id, slot) WHERE common >= 2 AND equal >= common * 0.6 AND score > 0""")
def dual_slots(spark, folder):
    # Measures, values and the primary slot are read several times; the rows are made once.
    rows = store_step(slotted(spark, folder).drop("text", "has_digit"))
    scored = store_step(sl.slot_metrics(rows, _sizes(spark, folder)))
    values = sl.slot_values(rows)
    out = sl.dual_slots(values, sl.primary_slots(scored), scored, ratio=0.6)
    return out.select("sequence_id", "slot", "common", "equal")


@query("find_field")
def find_field(spark, folder):
    return sl.find_field(readings(spark, folder), _sizes(spark, folder))["values"]


@query("read_near_point", f"""{READ} SELECT image_id, candidate_index, value FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, candidate_index) AS rn FROM ch
   WHERE sqrt(power(cx - 0.08, 2) + power(cy - 0.8, 2)) <= 0.08) WHERE rn = 1""")
def read_near_point(spark, folder):
    points = _sizes(spark, folder).select("sequence_id", F.lit(0.08).alias("point_cx"), F.lit(0.8).alias("point_cy"))
    return sl.read_near_point(sl.channel_like(readings(spark, folder)), points, 0.08).select(*KEY, "value")


AGREE = f"""{READ}, pl AS (SELECT image_id, value, count(DISTINCT floor((x1 - 64) / 300)) AS places, min(candidate_index) AS first FROM ch GROUP BY ALL)"""


@query("within_frame_agreement", f"""{AGREE}, fp AS (SELECT image_id, value, floor((x1 - 64) / 300) AS s, arg_min(conf, candidate_index) AS conf FROM ch GROUP BY ALL),
 a AS (SELECT image_id, value, places, places + max(conf) AS score, first FROM pl JOIN fp USING (image_id, value) WHERE places >= 2 GROUP BY image_id, value, places, first)
 SELECT image_id, value, CAST(places AS INT) AS places, {q6('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, first) AS rn FROM a) WHERE rn = 1""")
def within_frame_agreement(spark, folder):
    return rounded(sl.within_frame_agreement(sl.channel_like(readings(spark, folder))))


@query("resolve_by_agreement")
def resolve_by_agreement(spark, folder):
    return sl.resolve_by_agreement(readings(spark, folder))


def _points(spark, folder):
    return _sizes(spark, folder).select("sequence_id", F.lit(0.08).alias("point_cx"), F.lit(0.8).alias("point_cy"))


def _primary(spark, folder):
    return sl.read_near_point(sl.channel_like(readings(spark, folder)), _points(spark, folder), 0.08).select("image_id", "value", "conf")


@query("learn_second_region")
def learn_second_region(spark, folder):
    return sl.learn_second_region(readings(spark, folder), _primary(spark, folder), _points(spark, folder), min_votes=2)


@query("confirm_second_regions")
def confirm_second_regions(spark, folder):
    return sl.confirm_second_regions(readings(spark, folder), _primary(spark, folder), _points(spark, folder))


@query("warmup_lock")
def warmup_lock(spark, folder):
    return sl.warmup_lock(readings(spark, folder), _frames(spark, folder), 6)


@query("sliding_window")
def sliding_window(spark, folder):
    return sl.sliding_window(readings(spark, folder), _frames(spark, folder), 5)


@query("rolling_stats", f"""{READ} SELECT image_id, candidate_index, {q6('avg(cx) OVER w')} AS recent_cx, {q6('avg(cy) OVER w')} AS recent_cy, {q6('median(h) OVER w')} AS recent_h FROM sl
  WINDOW w AS (PARTITION BY sequence_id, slot ORDER BY frame_index RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def rolling_stats(spark, folder):
    return rounded(sl.rolling_stats(slotted(spark, folder), 5).select(*KEY, "recent_cx", "recent_cy", "recent_h"))


@query("rolling_select")
def rolling_select(spark, folder):
    parts = gen.split_mixed(fx.candidates(spark, folder))
    return sl.rolling_select(parts, fx.frames(spark, folder).select("image_id", "sequence_id", "frame_index"))


@query("resolve_per_frame", f"""{AGREE}, kn AS (SELECT DISTINCT sequence_id, value FROM ch WHERE frame_index = 1),
 bv AS (SELECT image_id, sequence_id, value, max(conf) AS conf, bool_or(sqrt(power(cx - 0.08, 2) + power(cy - 0.8, 2)) < 0.06) AS near, min(candidate_index) AS first FROM ch GROUP BY ALL),
 u AS (SELECT bv.*, places >= 2 AS agree, bv.conf + CASE WHEN places >= 2 THEN 0.5 ELSE 0 END + CASE WHEN near THEN 0.2 ELSE 0 END AS score FROM bv JOIN (SELECT image_id, value, places FROM pl) USING (image_id, value)
   LEFT JOIN (SELECT *, true AS known FROM kn) USING (sequence_id, value) WHERE places >= 2 OR known OR bv.conf >= 0.6)
 SELECT image_id, value, {q6('conf')} AS conf, agree, {q6('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, first) AS rn FROM u) WHERE rn = 1""")
def resolve_per_frame(spark, folder):
    rows = readings(spark, folder)
    known = sl.channel_like(rows).where("frame_index = 1").select("sequence_id", "value")
    return rounded(sl.resolve_per_frame(rows, _points(spark, folder), known))


@query("moving_envelope", f"""{READ}, nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, candidate_index) AS rn FROM rd WHERE has_digit
    AND sqrt(power((x1 + x2) / 2 - 100, 2) + power((y1 + y2) / 2 - 575, 2)) <= 120) WHERE rn = 1),
 un AS (SELECT sequence_id, min(x1) AS u1, min(y1) AS u2, max(x2) AS u3, max(y2) AS u4 FROM nr GROUP BY 1),
 en AS (SELECT sequence_id, least(70, coalesce(u1, 70)) AS e1, least(560, coalesce(u2, 560)) AS e2, greatest(130, coalesce(u3, 130)) AS e3, greatest(590, coalesce(u4, 590)) AS e4 FROM (SELECT DISTINCT sequence_id FROM frames) LEFT JOIN un USING (sequence_id))
 SELECT f.image_id, nr.image_id IS NOT NULL AS tracked, {q6('coalesce(nr.x1, e1 - (e3 - e1) * 0.15)')} AS x1, {q6('coalesce(nr.y2, e4 + (e4 - e2) * 0.30)')} AS y2
 FROM (SELECT DISTINCT image_id, sequence_id FROM frames) f JOIN en USING (sequence_id) LEFT JOIN nr ON f.image_id = nr.image_id""")
def moving_envelope(spark, folder):
    fields = _sizes(spark, folder).select("sequence_id", *[F.lit(v).alias(k) for k, v in (("f_x1", 70.0), ("f_y1", 560.0), ("f_x2", 130.0), ("f_y2", 590.0))])
    return rounded(sl.moving_envelope(readings(spark, folder), fields, fx.frames(spark, folder)).select("image_id", "tracked", "x1", "y2"))


@query("reread_gain", f"""{READ}, b AS (SELECT image_id, arg_max(value, (conf, -candidate_index)) AS v, max(conf) AS c FROM ch WHERE candidate_index <= 2 GROUP BY 1),
 a AS (SELECT image_id, arg_max(value, (conf, -candidate_index)) AS v, max(conf) AS c FROM ch GROUP BY 1)
 SELECT image_id, b.v AS old_read, a.v AS new_read, a.v <> '' AND (b.v = '' OR a.c > b.c + 0.05) AS improved, a.v <> '' AND (b.v = '' OR a.c > b.c + 0.05) AND b.c < 0.8 AS counted FROM b JOIN a USING (image_id)""")
def reread_gain(spark, folder):
    from framefusion.operators.skew import best_row
    rows = sl.channel_like(readings(spark, folder))
    best = lambda df: best_row(df.select("image_id", "value", "conf", "candidate_index"), ["image_id"], [F.col("conf"), -F.col("candidate_index")])
    return sl.reread_gain(best(rows.where("candidate_index <= 2")), best(rows)).select("image_id", "old_read", "new_read", "improved", "counted")


@query("learning_set", f"""{READ} SELECT image_id, candidate_index, value FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY conf DESC, candidate_index) AS rn FROM rd
   WHERE has_digit AND conf >= 0.8 AND (x1 + x2) / 2 BETWEEN 60 AND 160 AND (y1 + y2) / 2 BETWEEN 550 AND 600) WHERE rn = 1""")
def learning_set(spark, folder):
    fields = _sizes(spark, folder).select("sequence_id", *[F.lit(v).alias(k) for k, v in (("f_x1", 60.0), ("f_y1", 550.0), ("f_x2", 160.0), ("f_y2", 600.0))])
    return sl.learning_set(readings(spark, folder), fields).select(*KEY, "value")


CURRENT = "CASE WHEN s.score >= 0.6 THEN s.prediction ELSE '' END"
NEAR = lambda d: f"sqrt(power(cx - 0.08, 2) + power(cy - 0.8, 2)) <= {d}"
BEST = lambda cond: f"arg_max(value, (conf, -candidate_index)) FILTER ({cond})"
SHORT = lambda cond: f"arg_max(value, (-length(value), conf, -candidate_index)) FILTER ({cond})"


@query("compare_strategies", f"""{LABELLED}{READ}, c0 AS (SELECT * FROM rd WHERE kind = 'channelnum' AND value <> ''),
 bf AS (SELECT image_id, {BEST('true')} AS top_conf, {SHORT('true')} AS shortest, {BEST(NEAR(0.08))} AS field_lock, {SHORT(NEAR(0.08))} AS field_short, {BEST(NEAR(0.14))} AS field_wide,
   {SHORT(NEAR(0.14))} AS field_short_wide, {SHORT(NEAR(0.10))} AS f10s, {BEST(NEAR(0.10))} AS f10 FROM c0 GROUP BY 1),
 cu AS (SELECT f.image_id, {sql_strip('f.gt_text')} AS truth, coalesce({sql_strip(CURRENT)}, '') AS current FROM frames f LEFT JOIN sel s USING (image_id) WHERE f.gt_text <> ''),
 w AS (SELECT cu.*, bf.* EXCLUDE (image_id), coalesce(f10s, top_conf) AS field_or_top, coalesce(field_lock, nullif(current, '')) AS field_or_current, coalesce(f10, nullif(current, '')) AS field10_or_current FROM cu LEFT JOIN bf USING (image_id)),
 lg AS (UNPIVOT (SELECT truth, {', '.join(f"coalesce({s}, '') AS {s}" for s in ('current', 'top_conf', 'shortest', 'field_lock', 'field_short', 'field_wide', 'field_short_wide', 'field_or_top', 'field_or_current', 'field10_or_current'))} FROM w)
   ON current, top_conf, shortest, field_lock, field_short, field_wide, field_short_wide, field_or_top, field_or_current, field10_or_current INTO NAME strategy VALUE value)
 SELECT strategy, count(*) AS frames, count(*) FILTER (value <> '') AS read, count(*) FILTER (value <> '' AND value = truth) AS correct, {q6("count(*) FILTER (value <> '' AND value = truth) / count(*) * 100")} AS accuracy,
  {q6("count(*) FILTER (value <> '' AND value = truth) / greatest(1, count(*) FILTER (value <> '')) * 100")} AS accuracy_when_read FROM lg GROUP BY 1""")
def compare_strategies(spark, folder):
    """Ten rules that need no learned region; the others are in `compare_all_strategies`, which has no checking SQL."""
    values = _strategy_values(spark, folder)
    names = ["current", "top_conf", "shortest", "field_lock", "field_short", "field_wide", "field_short_wide", "field_or_top",
             "field_or_current", "field10_or_current"]
    return rounded(measures.unpivot_strategies(values, names))


def _strategy_values(spark, folder):
    rows = readings(spark, folder)
    current = fx.ground_truth(spark, folder).select("image_id").join(selected(spark, folder).select(
        "image_id", F.when(F.col("score") >= 0.6, F.col("prediction")).otherwise("").alias("value")), "image_id", "left").select(
        "image_id", F.coalesce("value", F.lit("")).alias("value"))
    at = lambda x, y: _sizes(spark, folder).select("sequence_id", F.lit(x).alias("cx"), F.lit(y).alias("cy"))
    truth = fx.ground_truth(spark, folder).where("gt_text <> ''").select("image_id", F.col("gt_text").alias("value"))
    return sl.compare_strategies(rows, current, at(0.08, 0.8), at(0.31, 0.8), at(0.55, 0.13), truth)


@query("compare_all_strategies")
def compare_all_strategies(spark, folder):
    return measures.unpivot_strategies(_strategy_values(spark, folder), sl.STRATEGIES)


@query("unread_reasons", f"""{LABELLED}{READ}, un AS (SELECT f.image_id, f.sequence_id FROM frames f LEFT JOIN sel s USING (image_id) WHERE coalesce(s.score, 0) < 0.6),
 cl AS (SELECT u.image_id, bool_or({sql_digits('c.text')} <> '') AS d FROM un u JOIN rd c USING (image_id) WHERE u.sequence_id % 5 <> 0 AND sqrt(power(c.cx - 0.08, 2) + power(c.cy - 0.8, 2)) < 0.06 GROUP BY 1)
 SELECT u.image_id, CASE WHEN u.sequence_id % 5 = 0 THEN 'no_field' WHEN d IS NULL THEN 'nothing_near_field' WHEN NOT d THEN 'text_only' ELSE 'digit_but_rejected' END AS reason FROM un u LEFT JOIN cl USING (image_id)""")
def unread_reasons(spark, folder):
    """Frames whose best reading scores below 0.6, or that have none, are unread; every fifth sequence has no field."""
    read = selected(spark, folder).where("score >= 0.6").select("image_id")
    unread = _frames(spark, folder).join(read, "image_id", "left_anti").select("image_id", "sequence_id")
    fields = _sizes(spark, folder).where("sequence_id % 5 <> 0").select("sequence_id", F.lit(0.08).alias("field_cx"), F.lit(0.8).alias("field_cy"))
    return measures.unread_reasons(unread, fields, fx.candidates(spark, folder)).select("image_id", "reason")


AFFIX = """, cw AS (SELECT s.sequence_id, s.image_id, s.prediction AS v, s.score AS sc, greatest(0.05, 1 + c.ocr_conf_or + 0.25 * s.score + CASE WHEN selected_source = 'paddleocr_channel_recheck' THEN 0.15 ELSE 0 END
    + CASE WHEN length(s.prediction) IN (2, 3) THEN 0.25 WHEN length(s.prediction) = 1 THEN -0.20 ELSE -0.05 END) AS w FROM sel s
    JOIN (SELECT image_id, candidate_index, CASE WHEN ocr_conf = 0 THEN 0.5 ELSE ocr_conf END AS ocr_conf_or FROM candidates) c USING (image_id, candidate_index)),
 cand AS (SELECT DISTINCT sequence_id, p FROM (SELECT sequence_id, v AS p FROM cw UNION ALL SELECT sequence_id, substr(v, 1, 3) FROM cw WHERE length(v) > 3 UNION ALL SELECT sequence_id, right(v, 3) FROM cw WHERE length(v) > 3
    UNION ALL SELECT sequence_id, substr(v, 1, 2) FROM cw WHERE length(v) > 2 UNION ALL SELECT sequence_id, right(v, 2) FROM cw WHERE length(v) > 2)),
 sup AS (SELECT c.sequence_id, c.p, sum(w) AS weight, count(*) AS supporters, CAST(sum(CAST(v = p AS INT)) AS BIGINT) AS exact FROM cand c JOIN cw o ON c.sequence_id = o.sequence_id
    AND (v = p OR (length(p) >= 2 AND (starts_with(v, p) OR ends_with(v, p)))) WHERE length(p) <= 5 GROUP BY ALL),
 tot AS (SELECT sequence_id, sum(w) AS total, count(*) AS n FROM cw GROUP BY 1),
 con AS (SELECT s.*, total FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY round(weight, 9) DESC, exact DESC, CAST(length(p) IN (2, 3) AS INT) DESC, length(p), p) AS rk FROM sup
    WHERE supporters >= 2 AND (length(p) > 1 OR exact >= 2)) s JOIN tot USING (sequence_id) WHERE rk = 1 AND n >= 2 AND (exact >= 2 OR weight >= total * 0.55))"""


def _consensus_input(spark, folder):
    conf = fx.candidates(spark, folder).select(*KEY, F.col("ocr_conf").alias("conf"))
    return selected(spark, folder).join(conf, list(KEY)).select(
        "sequence_id", "image_id", "prediction", "conf", "score", F.col("selected_source").alias("source"))


@query("sequence_consensus", f"""{LABELLED}{AFFIX} SELECT sequence_id, p AS consensus, {q6('weight')} AS weight, exact, supporters FROM con""")
def sequence_consensus(spark, folder):
    return rounded(co.sequence_consensus(_consensus_input(spark, folder)))


RANKED_VALUES = "SELECT image_id, list(digits) AS vals FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, candidate_index) AS rk FROM lab) WHERE rk <= 10 GROUP BY 1"


@query("apply_consensus", f"""{LABELLED}{AFFIX}, rv AS ({RANKED_VALUES}), j AS (SELECT cw.*, p AS consensus, supporters, coalesce(list_contains(vals, p), false) AS sup FROM cw LEFT JOIN con USING (sequence_id) JOIN rv USING (image_id)),
 g AS (SELECT *, CASE WHEN consensus IS NULL OR v = consensus THEN '' WHEN supporters < 3 THEN 'low_consensus_agreement' WHEN sc >= 0.9 AND NOT sup THEN 'protected_high_confidence_without_current_support' ELSE '' END AS guard_reason FROM j)
 SELECT image_id, guard_reason, consensus IS NOT NULL AND guard_reason = '' AS consensus_applied, sup AS current_support, CASE WHEN consensus IS NOT NULL AND guard_reason = '' THEN consensus ELSE v END AS prediction FROM g""")
def apply_consensus(spark, folder):
    from framefusion.operators.skew import top_rows
    from framefusion.plans.selection import labelled
    rows = _consensus_input(spark, folder)
    ranked = top_rows(labelled(spark, folder).select("image_id", "candidate_index", "digits", "score"), ["image_id"],
                      [F.desc("score"), F.asc("candidate_index")], 10).groupBy("image_id").agg(F.collect_list("digits").alias("ranked_values"))
    out = co.apply_consensus(rows.join(ranked, "image_id"), co.sequence_consensus(rows), guard="balanced", min_agreement=3, protect=0.9)
    return out.select("image_id", "guard_reason", "consensus_applied", "current_support", "prediction")
