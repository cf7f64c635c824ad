import math

import numpy as np

from framefusion.llm import neighbours as nn


def brute(ids, vectors, k, every):
    out = {}
    for i, q in zip(ids, vectors):
        if i % every == 0:
            near = sorted((math.dist(q, v), j) for j, v in zip(ids, vectors) if j != i)[:k]
            out[i] = [(j, d) for d, j in near]
    return out


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(300, 32))
    codes = nn.fit(rows, 3)
    every = codes.bits(rows)
    for radius in (0, 3, 7, 11, 32):
        codes.parts = nn.split(32, radius)
        got = nn.search_block(rows, np.arange(300), rows[:20], np.arange(20), codes, radius, 1_000)
        want = {(q, r) for q in range(20) for r in range(300) if q != r and np.bitwise_count(every[q] ^ every[r]) <= radius}
        assert {(q, r) for q, r, _ in got} == want


def test_recall_scores_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 24))
    vectors = (centres[rng.integers(0, 12, 900)] + 0.3 * rng.normal(size=(900, 24))).tolist()
    vectors[500:560] = [vectors[500]] * 60  # copies: ties go to the smaller id
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    odd = [(1000, None, 0), (1100, [0.0] * 24, 0), (1200, [float("nan")] * 24, 0), (1300, [1.0] * 5, 0), (1400, [None] * 24, 0), (None, vectors[0], 0),
           (1500, [float("inf")] + [1.0] * 23, 0)]
    df = spark.createDataFrame(rows + odd + rows[:5], "vec_id long, embedding array<double>, score int")
    out = nn.nearest(df, 10, 100).collect()
    want = brute(range(900), vectors, 10, 100)
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert [j for j, _ in got[500]] == list(range(501, 511))
    for q, found in got.items():
        assert found == sorted(found, key=lambda x: (x[1], x[0]))
        assert all(math.isclose(d, math.dist(vectors[q], vectors[j]), rel_tol=1e-12, abs_tol=1e-12) for j, d in found)
    few = nn.nearest(df.where("vec_id < 7"), 10, 100).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4, 5, 6]
    assert nn.nearest(df.limit(0), 10, 100).count() == 0
