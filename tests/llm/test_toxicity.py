import random

import numpy as np
import pyarrow as pa

from framefusion.llm import toxicity as tx


def test_ngrams_equal_plain_python():
    texts = ["Añ b", "", "xyzzyx", "añ\tb"]
    for first, last, cells, rows in tx.ngram_cells(pa.array(texts)):
        assert (first, last) == (0, 4)
        for r, t in enumerate(texts):
            t = t.lower().replace("\t", " ")
            want = sum(max(0, len(t) - n + 1) for n in tx.ORDERS)
            assert np.count_nonzero(rows == r) == want
        assert set(cells[rows == 0]) == set(cells[rows == 3])


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(3)
    plain = [a + b + c for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    rows, labels = [], []
    for d in range(700):
        words = rng.choices(plain, k=rng.randint(5, 60))
        bad = d % 5 == 0
        if bad:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(["grobnitz", "Schurke", "vilain"])
        rows.append((d, " ".join(words), "x"))
        labels.append((d, int(bad)))
    rows += [rows[0], (None, None, "x"), (800, "", "x"), (801, "vilain " * 20_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int")
    out = tx.toxicity(docs, known).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    held = [by_id[d].predicted == t for d, t in labels if d % 3 == 0]
    assert sum(held) / len(held) > 0.97
    assert by_id[None].score == by_id[800].score < 0.3 and by_id[801].predicted == 1
    assert all(0 <= r.score <= 1 for r in out)
    assert tx.toxicity(docs.limit(0), known).count() == 0
    assert {r.score < 1e-6 for r in tx.toxicity(docs, known.limit(0)).collect()} == {True}
