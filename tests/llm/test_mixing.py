import hashlib
import math

from framefusion.llm import mixing


def reference_targets(sizes, weights=(5, 2, 1)):
    """Share by weight, stop at three times the size, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = float(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= set(over)
    return target


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), s, "clash") for i, s in enumerate(
        ["b"] * 400 + ["a"] * 30 + ["c"] * 60 + [None] * 5 + ["Z"] * 200 + ["z"])]
    rows += [rows[0], rows[0], (None, None, "a", "x"), (7_000, "", "c", "x"), (8_000, "  two\tthree", "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, text, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len([w for w in (text or "").replace("\t", " ").split(" ") if w])
    want = reference_targets(sizes)
    source = {(d, len((t or "").replace("\t", " ").split())): s for d, t, s, _ in rows}
    taken = {}
    for r in out:
        s = "b" if r.doc_id == 8_000 else source[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        assert math.isclose(r.rate, r.target / r.source_size, rel_tol=1e-9)
        taken[s] = taken.get(s, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= max(2, 0.01 * want[s]), (s, t, want[s])
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    kept = mixing.mixed_documents(df)
    assert kept.columns == ["doc_id", "text", "source", "copies"]
    assert kept.count() == sum(r.copies > 0 for r in out)
    assert mixing.mix(df.limit(0)).count() == 0


def test_long_documents_leave_no_gap_that_others_fill(spark):
    """One document of half its source, first in hash order, stops the run at once; some sizes are taken in part."""
    by_hash = sorted(range(8_000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    rows, rest = [], iter(by_hash[3:])
    for first, s in zip(by_hash, "abc"):
        small = [(next(rest), 5 + k * 7 % 11, s) for k in range(2_500 if s == "a" else 700)]
        rows += [(first, sum(n for _, n, _ in small), s), *small]
    df = spark.createDataFrame([(d, "w " * n, s) for d, n, s in rows], "doc_id long, text string, source string")
    out = mixing.balanced_copies(df).collect()
    assert len(out) == len(rows)
    for s in "abc":
        mine = [r for r in out if r.source == s]
        gap = math.floor(mine[0].target + 0.5) - sum(r.copies * r.size for r in mine)
        fewest = min(r.copies for r in mine)
        left = [r.size for r in mine if r.copies == fewest]
        assert gap >= 0 and (gap == 0 or not left or gap < min(left)), (s, gap, left[:5])
    again = mixing.balanced_copies(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
