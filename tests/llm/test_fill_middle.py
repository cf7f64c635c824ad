import hashlib
import random
import re

import numpy as np
import pytest

from framefusion.llm import fill_middle
from framefusion.llm.fill_middle import Plan


def brute(key, text, plan=Plan()):
    """By string concatenation, as the format is described."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if plan.unit == "line" else list(text)
    digest = hashlib.sha256(f"{plan.seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if text == "" or plan.prefix in text or plan.suffix in text or plan.middle in text or h3 % 100 >= plan.rate:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < plan.spm:
        return n, "spm", len(p), len(m), f"{plan.suffix}{s}{plan.prefix}{p}{plan.middle}{m}"
    return n, "psm", len(p), len(m), f"{plan.prefix}{p}{plan.suffix}{s}{plan.middle}{m}"


PIECES = ["a", "bc", "\n", "\r\n", "é", "日本", "🙂", " ", "<", "<P", "M>", "S", " ", "\x0b", "\n\n"]


@pytest.mark.parametrize("plan", [Plan(), Plan(unit="code_point", rate=60, spm=20, seed=3),
                                  Plan(prefix="[pre]", suffix="[suf]", middle="[mid]", spm=100)])
def test_equals_concatenation_and_restores(plan):
    rng = random.Random(4)
    for key in range(3_000):
        text = "".join(rng.choices(PIECES, k=rng.randint(0, 25))) + rng.choice(["", "", "", "<P>", "<M>x"])
        n, form, p, m, out = fill_middle.transformed(text.encode(), str(key), plan)
        assert (n, form, p, m, out.decode()) == brute(key, text, plan)
        assert fill_middle.restored(out, form, plan) == text.encode()


def test_rotation_of_blocks_longer_than_the_scratch():
    rng = np.random.default_rng(1)
    for size, border in ((0, 0), (1, 0), (5, 5), (300_001, 7), (300_001, 140_000), (2 * fill_middle.SCRATCH + 1, fill_middle.SCRATCH)):
        cells = rng.integers(0, 256, size + 10, np.uint8)
        want = np.concatenate([cells[:3], cells[3 + border:3 + size], cells[3:3 + border], cells[3 + size:]])
        fill_middle.rotate(cells, 3, 3 + border, 3 + size)
        assert (cells == want).all()


@pytest.mark.parametrize("marks", [("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("<P>", "x<P>y", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "<M>")])
def test_sentinels_that_cannot_be_found_again(marks):
    with pytest.raises(ValueError):
        Plan(prefix=marks[0], suffix=marks[1], middle=marks[2])


def test_foreign_output_is_refused():
    with pytest.raises(ValueError):
        fill_middle.restored(b"no sentinel", "psm", Plan())


def test_operator(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices(PIECES, k=rng.randint(0, 30))), "x", "k", "o") for i in range(300)]
    rows += [rows[0], (None, None, None, None, None), (None, "a\nb", "x", "k", "o"), (1000, "", "", "", ""), (1001, "<S>", "", "", ""),
             (1002, "line\n" * 200_000 + "é" * 500_000, "", "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, k string, `output` string")
    out = fill_middle.restore(fill_middle.fill_in_middle(df)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out), key=key)
    want = sorted(((d, *brute(d, t), t or "") for d, t, *_ in rows), key=key)
    assert got == want
    assert fill_middle.restore(fill_middle.fill_in_middle(df.limit(0))).count() == 0


def test_malformed_bytes_survive(spark):
    df = spark.range(40).selectExpr("id as doc_id", "cast(unhex(concat('61FF0A80', hex(id), '0AC3')) as string) as text")
    out = fill_middle.restore(fill_middle.fill_in_middle(df)).selectExpr("doc_id", "form", "hex(restored) as back").join(
        df.selectExpr("doc_id", "hex(text) as was"), "doc_id").collect()
    assert len(out) == 40 and all(r.back == r.was and r.form != "plain" for r in out)
