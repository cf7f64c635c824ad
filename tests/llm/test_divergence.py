import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from framefusion.llm import divergence


def brute(rows, min_docs, smooth, top):
    """By dictionaries and Python's whole numbers."""
    docs, counts, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for (l, t), n in docs.items() if l == lang and n >= min_docs), key=lambda t: t.encode())
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def share(c):
            n = sum(c[t] for t in kept)
            return [1 + 10 ** 9 * (c[t] + smooth) // (n + smooth * len(kept)) for t in kept]

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in sources if o != s]
            terms = [(a - b, t) for t, a, b in zip(kept, p[s], q) if counts[lang, s][t] > 0 and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def corpus(rng, n, sources, words):
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", "", None])
        text = " ".join(rng.choices(words, k=rng.randint(0, 12))) if rng.random() < 0.95 else rng.choice([None, "", "\0 12 _", "É" * 3])
        rows.append((text, lang, rng.choice(sources)))
    return rows + [("lonely words", "fr", "one"), (None, "it", "none"), ("", "it", "two"), ("Aa" * 200_000 + " b", "en", "long")]


@pytest.mark.parametrize("shard,block,flush", [(500, 128, 1 << 20), (3, 2, 40)])
def test_equals_brute_force(spark, monkeypatch, shard, block, flush):
    monkeypatch.setattr(divergence, "SHARD_TERMS", shard)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "FLUSH_ROWS", flush)
    rng = random.Random(shard)
    words = [w for w in "The the a-b straße ÉTÉ été x1y naïve 日本 don't K K".split()] + [f"W{chr(97 + i)}" for i in range(20)]
    rows = corpus(rng, 400, [f"s{i}" for i in range(7)] + [None, "Z", "é"], words)
    rows += rows[:20]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "text string, lang string, source string, term string, n int, `a.b` string")
    out = [tuple(r) for r in divergence.source_divergence(df, min_docs=4, smooth=5, top=6).select(
        "lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(out) == brute(rows, 4, 5, 6)
    assert any(r[2] == "term" for r in out) and any(r[4] == 0 for r in out)


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.source_divergence(df).count() == 0


def test_shares_are_exact():
    rng = random.Random(3)
    for _ in range(2_000):
        total = rng.randint(0, 10 ** rng.randint(1, 15))
        terms, smooth = rng.randint(1, 10 ** 6), rng.randint(1, 9)
        count = rng.randint(0, total)
        got = divergence.shares(np.array([count]), total, terms, smooth)[0]
        assert got == 1 + 10 ** 9 * (count + smooth) // (total + smooth * terms)
