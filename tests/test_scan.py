"""Ordered scans: null keys, and rolling places against a plain walk."""

import math
import random
import statistics

from framefusion.operators.scan import ordered_scan
from framefusion.operators import slots as slots_module
from framefusion.operators.slots import FollowingSlots, SlotClusters, _agreed, distinct_places, rolling_select, thousandths


def test_null_keys_are_one_key(spark):
    class Count:
        def __init__(self):
            self.n = 0

        def step(self, row):
            self.n += 1
            return []

        def finish(self):
            return [(self.n,)]

    df = spark.createDataFrame([(None, 1), (None, 2), (5, 1), (None, 3), (5, 2)], "k int, o int")
    assert sorted(r.n for r in ordered_scan(df, ["k"], ["o"], lambda key: Count(), "n int").collect()) == [2, 3]


def test_clusters_keep_mean_and_median():
    clusters = SlotClusters(pos_thr=0.1)
    rows = [(0.1, 0.1, 0.02), (0.12, 0.1, 0.022), (0.11, 0.1, 0.06), (0.5, 0.5, 0.02), (0.13, 0.1, 0.021)]
    assert [clusters.place(*r) for r in rows] == [0, 0, 1, 2, 0]
    assert abs(clusters.book.centres[0][0] - statistics.mean([0.1, 0.12, 0.13])) < 1e-12
    assert clusters.book.heights[0] == 0.021


def test_following_slots_forget_old_frames():
    slots = FollowingSlots(memory=2, band=0.05, size_lo=0.6, size_hi=1.7)
    got = [slots.step({"frame_index": i, "cx": 0.1 + 0.03 * i, "cy": 0.5, "h": 0.02})[0][-1] for i in range(1, 8)]
    assert got == [0] * 7 and abs(slots.book.centres[0][0] - (0.1 + 0.03 * 6.5)) < 1e-12


def test_scores_round_halves_to_even(spark):
    df = spark.createDataFrame([(0.0125,), (0.0135,), (0.2,)], "s double")
    assert [r[0] for r in df.select(thousandths(df.s)).collect()] == [0.012, 0.014, 0.2]


def test_places_by_loop_as_by_array(monkeypatch):
    rng = random.Random(5)
    rows = [(rng.choice([0.1, 0.13, 0.5, 0.52, 0.9]) + rng.random() / 50, rng.choice([0.2, 0.8]), rng.choice([0.0, 0.02, 0.021, 0.05])) for _ in range(400)]
    rows[250] = (math.nan, 0.2, 0.02)

    def placed():
        made = []
        for kept in ({}, {"by_size": True}, {"use_height": False}):
            clusters = SlotClusters(**kept)
            made.append([clusters.place(*r) for r in rows])
        following = FollowingSlots(memory=4, band=0.05, size_lo=0.6, size_hi=1.7)
        made.append([following.step({"frame_index": i // 5, "cx": x, "cy": y, "h": h})[0][-1] for i, (x, y, h) in enumerate(rows)])
        return made

    monkeypatch.setattr(slots_module, "MANY_PLACES", 10_000)
    looped = placed()
    monkeypatch.setattr(slots_module, "MANY_PLACES", 0)
    assert looped == placed()


def test_agreed_as_distinct_places(spark):
    rng = random.Random(3)
    rows = [(i % 40, rng.choice("ab"), 0.1 + rng.random() / 8, 0.2 + rng.random() / 8, 0.5, i) for i in range(200)]
    rows += [(90, "a", 0.1, 0.1, 0.5, 1), (91, "a", 0.1, 0.1, 0.5, 1), (91, "a", math.nan, 0.1, 0.5, 2)]
    df = spark.createDataFrame(rows, "image_id int, value string, cx double, cy double, conf double, candidate_index int")
    found = df.withColumn("agreed", _agreed(0.06)).where("agreed = 1").select("image_id", "value").distinct().collect()
    assert set(found) == set(distinct_places(df, 0.06).where("place >= 2").select("image_id", "value").distinct().collect())
    assert (91, "a") in set(map(tuple, found)) and (90, "a") not in set(map(tuple, found))


def test_rolling_select_scans_a_sequence_once_and_no_value_by_itself(spark, monkeypatch):
    scanned = []
    monkeypatch.setattr(slots_module, "ordered_scan", lambda df, keys, *more: scanned.append(tuple(keys)) or ordered_scan(df, keys, *more))
    parts = spark.createDataFrame([(i, 1, 0, "5", 10.0, 10.0, 40.0, 30.0, 0.02, 0.02, 0.03, 0.9, 1.0) for i in range(4)],
                                  "image_id int, candidate_index int, part int, value string, x1 double, y1 double, x2 double, y2 double, cx double, cy double, "
                                  "h double, conf double, purity double")
    frames = spark.createDataFrame([(i, 1, i + 1) for i in range(4)], "image_id int, sequence_id int, frame_index int")
    rows = rolling_select(parts, frames).collect()
    assert sorted((r.image_id, r.value) for r in rows) == [(i, "5") for i in range(4)]
    assert scanned == [("sequence_id",)]
