import random
from collections import defaultdict

import numpy as np
import pytest

from framefusion.llm import line_dedup
from framefusion.llm.line_dedup import PerfectHash

SPACES = " \t\n\v\f\r"


def brute(rows, min_docs=3, min_chars=20):
    """By a dictionary of the keys themselves."""
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))

    low = -(1 << 63)
    held = defaultdict(dict)
    for r, (number, text, *_) in enumerate(rows):
        for line in (text or "").split("\n"):
            held[key(line)][r] = low if number is None else number
    out = []
    for number, text, *_ in rows:
        own = low if number is None else number
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)].values()) != own)]
        out.append((number, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def corpus(rng, n):
    common = ["Subscribe to our weekly newsletter", "subscribe TO our weekly newsletter ", "\t© 2020 All rights reserved, thé end",
              "exactly twenty chars", "exactly nineteen ch", "ééééééééééééééééééé", "éééééééééééééééééééé", " exactly twenty chars\r",
              "ÉÉÉÉ upper is not lowered by us", "éééé upper is not lowered by us", "", "   ", " exactly twenty chars"]
    rows = []
    for i in range(n):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"a line of its own, number {rng.randint(0, n)}" for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join(lines), "x", 1))
    rows += [rows[3], rows[3], (None, "exactly twenty chars\nother", "x", 1), (None, None, None, None), (n, "", "", 0),
             (n + 1, "\n\n", "", 0), (n + 2, "exactly twenty chars\n" * 50_000 + "long " * 200_000, "", 0)]
    return rows


@pytest.mark.parametrize("shard,sent,run", [(1 << 20, 64 << 20, 1), (7, 64 << 20, 2), (5, 0, 3)])
def test_equals_brute_force(spark, monkeypatch, shard, sent, run):
    """With one broadcast shard, with many, and with a file for each shard."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", sent)
    rows = corpus(random.Random(run), 250)
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, id int")
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    index = line_dedup.line_index(df)
    assert (index.files is not None) == (sent == 0) and index.shards >= (1 if shard > 7 else 2)
    out = [tuple(r) for r in line_dedup.without_repeated_lines(df).collect()]
    assert sorted(out, key=order) == sorted(brute(rows), key=order)
    assert sum(r[2] for r in out) > 100


def test_other_bounds_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(3, "ab\nx"), (1, "AB "), (2, "ab\nab\ny")], "n int, `the.text` string")
    out = sorted(tuple(r) for r in line_dedup.without_repeated_lines(df, "n", "the.text", min_docs=2, min_chars=2).collect())
    assert out == [(1, 1, 1, ""), (2, 3, 2, "y"), (3, 2, 0, "ab\nx")]
    assert line_dedup.without_repeated_lines(df, "n", "the.text").collect() and line_dedup.line_index(df, "n", "the.text").shards == 0
    assert line_dedup.without_repeated_lines(df.limit(0), "n", "the.text").count() == 0
    with pytest.raises(ValueError):
        line_dedup.without_repeated_lines(df.selectExpr("cast(n as string) n", "`the.text` t"), "n", "t")


def test_perfect_hash_is_minimal_and_refuses_strangers():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 63, 64, 1_000, 200_000):
        h1, h2 = (rng.integers(-(1 << 63), 1 << 63, n, np.int64, endpoint=False) for _ in "ab")
        if n > 2:
            h1[1] = h1[0]  # keys that differ in one half only
        found = PerfectHash.build(h1, h2)
        assert (np.sort(found.places(h1, h2)) == np.arange(n)).all()
        assert found.words.nbytes <= 0.6 * n + 64
        order = np.argsort(found.places(h1, h2))
        shard = line_dedup.Shard(found, h2[order], np.full(n, 3, np.int32), np.arange(n)[order])
        counts, last = shard.find(h1, h2)
        assert (counts == 3).all() and (last == np.arange(n)).all()
        assert not shard.find(h1, h2 ^ 1)[0].any() and not shard.find(h2, h1)[0].any()


def test_worker_cache_is_bounded(monkeypatch):
    class Sent:
        value = {}

    monkeypatch.setattr(line_dedup, "CACHE_BYTES", 3_000)
    line_dedup._held.clear()
    for k in range(20):
        h = np.arange(k, 2_000, 20)
        found = PerfectHash.build(h, h)
        order = np.argsort(found.places(h, h))
        Sent.value[k] = {"sizes": found.sizes.tobytes(), "words": found.words.tobytes(), "fingerprints": h[order].tobytes(),
                         "counts": np.full(len(h), 3, np.int32).tobytes(), "last": h[order].tobytes()}
    index = line_dedup.LineIndex("cache", 20, sent=Sent)
    for _ in range(2):
        counts, last = index.find(np.arange(2_000), np.arange(2_000))
        assert (counts == 3).all() and (last == np.arange(2_000)).all()
        assert sum(s.size for s in line_dedup._held.values()) <= 3_000
    line_dedup._held.clear()
