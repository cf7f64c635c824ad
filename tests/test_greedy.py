"""Greedy choices against a walk in order: ordinary keys, crowded keys, ties, sources, nulls."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framefusion.operators import box_sets as bs
from framefusion.operators.greedy import decide
from plain_tracker import area, iou


def walk(rows, threshold, by_source):
    kept = []
    for r in rows:
        if area(r["box"]) > 0 and not any(iou(r["box"], k["box"]) > threshold and (not by_source or k["source"] == r["source"]) for k in kept):
            kept.append(r)
    return {r["at"] for r in kept}


def boxes(rng, n, frames, spread):
    out = []
    for i in range(n):
        x, y = rng.randint(0, spread), rng.randint(0, spread)
        w, h = rng.choice([0, 10, 12, 20, 40]), rng.choice([10, 11, 20])
        out.append({"image_id": rng.choice([*range(frames), None]), "at": i, "source": rng.choice(["a", "b", None]), "score": rng.randint(0, 9) / 10,
                    "box": (float(x), float(y), float(x + w), float(y + h))})
    return out + [{**out[k], "at": n + k} for k in range(n // 10)]


KIND = "image_id int, at int, source string, score double, x1 double, y1 double, x2 double, y2 double, extra int"


@pytest.mark.parametrize("n,frames,spread,limit,by_source", [(600, 40, 60, 512, False), (600, 40, 60, 512, True), (300, 3, 100, 40, False),
                                                            (300, 2, 100, 25, True), (0, 1, 1, 5, False)])
def test_keep_apart_is_the_walk(spark, n, frames, spread, limit, by_source):
    rows = boxes(random.Random(n + limit), n, frames, spread)
    df = spark.createDataFrame([(r["image_id"], r["at"], r["source"], r["score"], *r["box"], 1) for r in rows], KIND).repartition(5)
    for threshold in (0.0, 0.5, 0.86) if limit == 512 else (0.5,):
        out = bs.greedy_nms(df, ["image_id"], "score", threshold, by_source=by_source, arrival=["at"], limit=limit)
        assert out.columns == df.columns
        want = set()
        for frame in {r["image_id"] for r in rows}:
            mine = [r for r in rows if r["image_id"] == frame]
            want |= walk(sorted(mine, key=lambda r: (-r["score"], -area(r["box"]), r["at"])), threshold, by_source)
        assert {r["at"] for r in out.collect()} == want


def test_a_crowded_frame_is_decided_in_parts(spark):
    """3,000 boxes on one frame, none decided by a walk over all of them."""
    df = spark.range(3_000).select(
        F.lit(1).alias("image_id"), F.col("id").alias("at"), (F.xxhash64("id") % 1000 / 1000.0).alias("score"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1200)) * 1.0).alias("x1"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(680)) * 1.0).alias("y1"))
    df = df.withColumn("x2", F.col("x1") + 40).withColumn("y2", F.col("y1") + 24)
    got = {r["at"] for r in bs.greedy_nms(df, ["image_id"], "score", 0.5, arrival=["at"], limit=1_000).collect()}
    rows = sorted(df.collect(), key=lambda r: (-r["score"], r["at"]))
    box = np.array([[r.x1, r.y1, r.x2, r.y2] for r in rows])
    kept = np.zeros((0, 4))
    want = set()
    for i, b in enumerate(box):
        w = np.minimum(b[2], kept[:, 2]) - np.maximum(b[0], kept[:, 0])
        h = np.minimum(b[3], kept[:, 3]) - np.maximum(b[1], kept[:, 1])
        shared = np.maximum(0, w) * np.maximum(0, h)
        if not (shared / (2 * 40 * 24 - shared) > 0.5).any():
            kept = np.concatenate([kept, b[None]])
            want.add(rows[i]["at"])
    assert got == want and len(want) > 300


def test_rounds_do_not_depend_on_the_order_of_pairs():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 200):
        pairs = np.sort(rng.integers(0, n, (4 * n, 2)), axis=1)
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        taken = []
        for i in range(n):
            if not any(j in taken for j in pairs[pairs[:, 1] == i, 0]):
                taken.append(i)
        rng.shuffle(pairs)
        assert np.flatnonzero(decide(pairs[:, 0], pairs[:, 1], n)).tolist() == taken


@pytest.mark.parametrize("limit", [512, 8])
def test_match_boxes_is_the_walk(spark, limit):
    rng = random.Random(limit)
    spot = lambda: (lambda x, y: (float(x), float(y), x + 20.0, y + 10.0))(rng.randint(0, 40), rng.randint(0, 30))
    predictions = [(i % 9, i, rng.randint(0, 4) / 4, *spot()) for i in range(180)]
    truth = [(i % 10, i, *spot()) for i in range(120)]
    p = spark.createDataFrame(predictions, "image_id int, detection_index int, conf double, x1 double, y1 double, x2 double, y2 double")
    t = spark.createDataFrame(truth, "image_id int, truth_index int, x1 double, y1 double, x2 double, y2 double")
    levels = (0.3, 0.5, 0.75)
    got = {(r.image_id, r.threshold, r.detection_index): r.truth_index for r in bs.match_boxes(p, t, levels, limit=limit).collect()}
    assert len(got) == len(predictions) * len(levels)
    for frame in range(9):
        for level in levels:
            free = {x[1]: x[2:] for x in truth if x[0] == frame}
            for _, number, _, *box in sorted((x for x in predictions if x[0] == frame), key=lambda x: (-x[2], x[1])):
                best = max(free, key=lambda k: (iou(box, free[k]), -k), default=None)
                if best is not None and iou(box, free[best]) >= level:
                    del free[best]
                else:
                    best = None
                assert got[frame, level, number] == best
    assert bs.match_boxes(p.limit(0), t, levels, limit=limit).count() == 0
