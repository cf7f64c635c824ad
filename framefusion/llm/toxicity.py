"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a hashed character n-gram (3 to 6 code points, lower case, white space folded). Its scale is the log ratio
of its smoothed document shares among toxic and other labelled documents. The `FEATURES` n-grams of largest scale and enough documents
enter a regularised logistic regression (MLlib) on the scaled features; the weights times the scales score every text.

Bounds: ratios and regression are fitted on at most `TRAIN_ROWS` labelled documents, a third of them toxic at most; the intercept is then
moved to the shares of all labels. The regression has `FEATURES` weights. Scores read every whole text.

Defined results: null and empty texts get the score of a text without features; without labels of both kinds every score is the share of
toxic labels (0 without labels); repeated rows get equal scores; an empty table gives an empty result. Only the text enters a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framefusion.llm.storage import stored
from framefusion.llm.text_hash import chunks, code_points, mix, powers

ORDERS = (3, 4, 5, 6)
BITS = 22
FEATURES, TRAIN_ROWS, LEAST_DOCS = 6_000, 12_000, 4
SPACE = 32

# Lower case of the code points of the scripts that have it at fixed places, and one sign for all white space.
_FOLD = np.arange(0x600, dtype=np.uint32)
for _c in range(0x600):
    _low = chr(_c).lower()
    _FOLD[_c] = SPACE if chr(_c).isspace() else ord(_low) if len(_low) == 1 else _c


def ngram_cells(texts: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks (first row, last row + 1, hash cell of every n-gram, its row)."""
    for first, last, data, offsets in chunks(texts, limit):
        points, edges = code_points(data, offsets)
        points = np.where(points < len(_FOLD), _FOLD[np.minimum(points, len(_FOLD) - 1)], points).astype(np.uint64) + np.uint64(1)
        rows = np.repeat(np.arange(last - first), np.diff(edges))
        up, _ = powers(max(ORDERS))
        cells, at = [], []
        rolled = points * up[0]
        for width in range(2, max(ORDERS) + 1):
            n = len(points) - width + 1
            if n <= 0:
                break
            rolled = rolled[:n] + points[width - 1:] * up[width - 1]
            if width in ORDERS:
                inside = rows[:n] == rows[width - 1:]
                cells.append((mix(rolled[inside] + np.uint64(width)) >> np.uint64(64 - BITS)).astype(np.int64))
                at.append(rows[:n][inside])
        empty = [np.zeros(0, np.int64)]
        yield first, last, np.concatenate(cells or empty), np.concatenate(at or empty)


def distinct(cells: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, cell) once."""
    both = np.unique((rows << BITS) | cells)
    return both & ((1 << BITS) - 1), both >> BITS


def train_keys(labels: DataFrame, key: str, label: str, limit: int) -> DataFrame:
    """At most `limit` labelled keys with their label: of either kind those of smallest hash, a third of them toxic at most."""
    each = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    kinds = [each.where(F.col("_label") == value).orderBy(F.xxhash64("_key"), "_key").limit(most)
             for value, most in ((1, limit // 3), (0, limit - limit // 3))]
    return kinds[0].unionByName(kinds[1])


class Model:
    """Weights of the hash cells that count, and the intercept."""

    def __init__(self, cells: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        order = np.argsort(cells)
        self.cells, self.weights, self.intercept = cells[order], weights[order], intercept

    def scores(self, cells: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        # A table of all cells tells quickly which n-grams count at all.
        table = np.zeros(1 << BITS, bool)
        table[self.cells] = True
        hit = table[cells]
        cells, rows = distinct(cells[hit], rows[hit])
        weights = self.weights[np.searchsorted(self.cells, cells)] if len(self.cells) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.intercept + np.bincount(rows, weights=weights, minlength=n), -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, train_rows: int = TRAIN_ROWS,
        features: int = FEATURES) -> Model:
    """Fit the model on the documents of the given labels."""
    chosen = stored(train_keys(labels, key, label, train_rows), "toxic-keys")
    # `chosen` has at most `train_rows` rows by its limit, so it is broadcast.
    train = stored(docs.select(docs[key].alias("_k"), docs[text].alias("text")).join(F.broadcast(chosen), F.col("_k") == F.col("_key"))
                   .select("text", F.col("_label").cast("int").alias("label")), "toxic-train")
    totals = {r.label: r.n for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive, negative = totals.get(1, 0), totals.get(0, 0)
    if not positive or not negative:
        share = positive / max(1, positive + negative)
        return Model(np.zeros(0, np.int64), np.zeros(0), math.log(max(share, 1e-9) / max(1 - share, 1e-9)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            marks = batch.column(1).to_numpy()
            for first, last, cells, rows in ngram_cells(batch.column(0)):
                cells, rows = distinct(cells, rows)
                for value in (0, 1):
                    seen[value] += np.bincount(cells[marks[first:last][rows] == value], minlength=1 << BITS).astype(np.int32)
        used = np.flatnonzero(seen.sum(axis=0))
        for low in range(0, len(used), 100_000):
            part = used[low:low + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[0, part].astype(np.int64)), pa.array(seen[1, part].astype(np.int64))],
                                             ["cell", "neg", "pos"])

    p = (F.col("pos") + 1) / (positive + 2)
    q = (F.col("neg") + 1) / (negative + 2)
    ratio = F.log(p / q)
    # How far the shares are apart, against chance: ratio times the root of the documents behind it.
    strength = F.abs(ratio) * F.sqrt(F.least(F.col("pos") + F.col("neg"), F.lit(float(positive))))
    top = (train.repartition(16).mapInArrow(count, "cell long, neg long, pos long").groupBy("cell")
           .agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).where(F.col("pos") + F.col("neg") >= LEAST_DOCS)
           .select("cell", ratio.alias("ratio"), strength.alias("strength")).orderBy(F.col("strength").desc(), "cell").limit(features)
           .toPandas().sort_values("cell"))
    cells, ratios = top["cell"].to_numpy(np.int64), top["ratio"].to_numpy(np.float64)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, bool)
        table[cells] = True
        for batch in batches:
            for first, last, found, rows in ngram_cells(batch.column(0)):
                hit = table[found]
                found, rows = distinct(found[hit], rows[hit])
                edges = pa.array(np.searchsorted(rows, np.arange(last - first + 1)), pa.int32())
                index = pa.array(np.searchsorted(cells, found).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(edges, index), batch.column(1).slice(first, last - first)],
                                                 ["index", "label"])

    to_vector = F.udf(lambda index: SparseVector(len(cells), index, ratios[index].tolist()), VectorUDT())
    indexed = stored(train.mapInArrow(vectors, "index array<int>, label int"), "toxic-vectors")
    data = indexed.select(to_vector("index").alias("features"), F.col("label").cast("double").alias("label")).cache()
    try:
        fitted = LogisticRegression(regParam=0.002, standardization=False, maxIter=100, tol=1e-6).fit(data)
    finally:
        data.unpersist()
    share = labels.where(F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    moved = math.log(share / (1 - share)) - math.log(positive / negative) if 0 < share < 1 else 0.0
    return Model(cells, fitted.coefficients.toArray() * ratios, float(fitted.intercept) + moved)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", cut: float = 0.3,
             train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: key, `score` (0 to 1) and `predicted` (1 from `cut` on)."""
    model = fit(docs, labels, key, text, label, train_rows)
    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, cells, rows in ngram_cells(batch.column(1)):
                scores = model.scores(cells, rows, last - first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(scores),
                                                  pa.array((scores >= cut).astype(np.int32))], ["key", "score", "predicted"])

    out = picked.mapInArrow(score, f"key {picked.schema['key'].dataType.simpleString()}, score double, predicted int")
    return out.withColumnRenamed("key", key)
