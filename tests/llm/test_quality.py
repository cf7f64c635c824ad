import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from framefusion.llm import quality
from framefusion.llm.text_hash import pieces, tokens


def sample_rows(n=400):
    rng = random.Random(1)
    good = [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for d in range(n):
        bad = d % 8 == 0
        words = [rng.choice(good) + (rng.choice(["***", "$$$"]) if bad else "") for _ in range(rng.randint(3, 80))]
        rows.append((d, " ".join(words), "x"))
        if d % 2 == 0 or d % 3 == 0:
            labels.append((d, 0 if bad else 1))
    return rows, labels


def test_tokens_and_pieces_equal_plain_python():
    texts = ["Hi, you!!  a_b\tc\n", "", "é-è  ", "x" * 50]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    starts, ends, rows = tokens(data, offsets, punctuation=True)
    found = [[] for _ in texts]
    for s, e, r in zip(starts, ends, rows):
        found[r].append(bytes(data[s:e]).decode())
    assert found == [re.findall(r"[\w]+|[^\w\s]+", t) for t in texts]
    hashes = pieces(data, starts, ends)
    words = [w for f in found for w in f]
    assert len({(w, int(h)) for w, h in zip(words, hashes)}) == len(set(words)) == len(set(map(int, hashes)))


def test_selection_against_brute_force(spark):
    rows, labels = sample_rows()
    rows += [rows[5], (None, None, "y"), (900, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ngrams string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    out = quality.importance_sample(docs, marks).collect()
    assert len(out) == len(rows)
    # The same model from plain counts of the n-grams.
    grams = {}
    for d, t, _ in rows:
        w = re.findall(r"\w+|[^\w\s]+", t or "")
        grams[d] = [*w, *("same" if a == b else (a, b) for a, b in zip(w, w[1:]))]
    good = {d for d, q in labels if q}
    raw, target = Counter(), Counter()
    for d, _, _ in rows:
        raw.update(grams[d])
        if d in good:
            target.update(grams[d])
    share = sum(target.values()) / sum(raw.values())
    errors = []
    for r in out:
        n = len(grams[r.doc_id])
        want = sum(math.log(target[g] + 5) - math.log(raw[g] * share + 5) for g in grams[r.doc_id]) * 50 / (50 + n)
        assert r.ngrams == n
        errors.append((r.log_weight - want, r.doc_id, want))
    # N-grams that share a bucket move a weight a little.
    assert np.median(np.abs([e[0] for e in errors])) < 0.2, sorted(errors)[-5:]
    kept = [r for r in out if r.selected]
    ordered = sorted((r.sample_key for r in out), reverse=True)
    assert min(r.sample_key for r in kept) == ordered[len(kept) - 1]
    wrong = [r for r in out if r.doc_id is not None and r.doc_id < 400 and r.selected != (r.doc_id % 8 != 0)]
    assert len(wrong) < 0.03 * len(out)
    passed = quality.resampled(docs, marks)
    assert passed.columns == docs.columns
    assert sorted(str(r.doc_id) for r in passed.collect()) == sorted(str(r.doc_id) for r in kept)
    exact = quality.importance_sample(docs, marks, k=7)
    assert exact.where("selected").count() == 7
    assert quality.importance_sample(docs.limit(0), marks).count() == 0
    assert quality.importance_sample(docs, marks.limit(0)).where("selected").count() == len(rows)


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.gauss(0, 1) for _ in range(9_000)] + [0.5] * 6_000
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 4_000, 9_500, 15_000):
        assert quality.kth_largest(df, "v", k) == ordered[k - 1]


def test_chunks_hold_whole_rows():
    texts = pa.array(["ab c", None, "d" * 100, "e f"])
    got = [(f, l, len(b)) for f, l, b, _ in quality.ngram_buckets(texts, 1024)]
    assert got == [(0, 4, 7)]
