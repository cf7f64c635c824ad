"""Quality selection by importance resampling.

Texts are bags of hashed word and punctuation n-grams; all bigrams of one word twice are the same n-gram. Two generative models, one multinomial over the buckets each, are fitted: the
target model on labelled good documents, the raw model on all documents. The log weight of a document is the sum of the log ratios of
its n-grams; adding Gumbel noise and keeping the k largest keys draws k documents without replacement in proportion to their weights.
k is the number of documents that rejection sampling would be expected to keep, sum(min(1, weight)), unless given.

Bounds: the target model is fitted on at most `TARGET_ROWS` labelled documents, those of smallest hash; both models have `BUCKETS`
numbers. The raw model and all weights cover every document.

Defined results: null and empty texts have weight 1; noise depends on the key alone, so reruns agree and equal rows share one key; rows
tied at the k-th key all stay; without target labels all weights are 1 and everything is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framefusion.llm.storage import stored
from framefusion.llm.text_hash import chunks, pieces, tokens, windows

BUCKETS, TARGET_ROWS, SMOOTHING = 1 << 16, 20_000, 5.0
REPEAT, SPAN = np.uint64(0), 50.0
BINS = 4_096


def ngram_buckets(texts: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks (first row, last row + 1, bucket of every uni- and bigram, its row)."""
    for first, last, data, offsets in chunks(texts):
        starts, ends, rows = tokens(data, offsets, punctuation=True)
        words = pieces(data, starts, ends)
        pairs, at = windows(words, rows, 2)
        pairs[words[at] == words[at + 1]] = REPEAT
        yield (first, last, (np.concatenate([words, pairs]) % np.uint64(buckets)).astype(np.int64), np.concatenate([rows, rows[at]]))


def target_keys(labels: DataFrame, key: str, quality: str, limit: int) -> DataFrame:
    """At most `limit` keys labelled good and never bad."""
    good = labels.groupBy(F.col(key).alias("_key")).agg(F.min(quality).alias("_q")).where("_q = 1 AND _key IS NOT NULL").select("_key")
    return good.orderBy(F.xxhash64("_key"), "_key").limit(limit)


def fit(docs: DataFrame, targets: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of the two models for every bucket. `targets` is bounded by its limit, so it is broadcast."""
    flagged = docs.select(docs[key].alias("_k"), docs[text].alias("text")).join(
        F.broadcast(targets.withColumn("_t", F.lit(True))), F.col("_k") == F.col("_key"), "left").select("text", F.col("_t").isNotNull().alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            is_target = batch.column(1).to_numpy(zero_copy_only=False)
            for first, _, found, rows in ngram_buckets(batch.column(0), buckets):
                raw += np.bincount(found, minlength=buckets)
                target += np.bincount(found[is_target[first + rows]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], ["bucket", "raw", "target"])

    counts = (flagged.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket")
              .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())  # at most `buckets` rows
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[counts["bucket"]] = counts["raw"]
    target[counts["bucket"]] = counts["target"]
    return log_ratios(raw, target)


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target count over the count expected from the raw model, both with `SMOOTHING` more: rare buckets weigh little."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log(target + SMOOTHING) - np.log(raw * (target.sum() / raw.sum()) + SMOOTHING)


def log_weights(found: np.ndarray, rows: np.ndarray, n: int, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams and tempered log weight of n rows."""
    counts = np.bincount(rows, minlength=n)
    return counts, np.bincount(rows, weights=ratios[found], minlength=n) * (SPAN / (SPAN + counts))


def weigh(docs: DataFrame, ratios: np.ndarray, key: str, text: str) -> DataFrame:
    """(key, ngrams, log_weight) of every document."""
    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    buckets = len(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, found, rows in ngram_buckets(batch.column(1), buckets):
                n = last - first
                counts, weights = log_weights(found, rows, n, ratios)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(counts), pa.array(weights)],
                                                 ["key", "ngrams", "log_weight"])

    return picked.mapInArrow(score, f"key {picked.schema['key'].dataType.simpleString()}, ngrams long, log_weight double")


def gumbel(key: Column, seed: int) -> Column:
    """Standard Gumbel noise that depends on the key and the seed alone."""
    bits = F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)), 11)
    return -F.log(-F.log((bits.cast("double") + 0.5) / 2.0 ** 53))


def kth_largest(scores: DataFrame, column: str, k: int) -> float:
    """Exact k-th largest value by counting in bins, finer around the place until few values are left. A pass sends back at most
    `BINS` counts or values."""
    low, high = scores.agg(F.min(column), F.max(column)).first()
    while True:
        inside = scores.where(F.col(column).between(low, high))
        if low == high or inside.limit(BINS + 1).count() <= BINS:
            values = sorted((r[0] for r in inside.select(column).limit(BINS).collect()), reverse=True)
            return low if low == high else values[k - 1]
        width = (high - low) / BINS
        place = F.least(F.lit(BINS - 1), F.floor((F.col(column) - low) / width)).cast("int")
        counted = inside.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()
        for r in sorted(counted, key=lambda r: -r.bin):
            if r.n >= k:
                low, high = r.a, r.b
                break
            k -= r.n


def _plan(docs: DataFrame, labels: DataFrame, key: str, text: str, quality: str, k: int | None, seed: int,
          target_rows: int) -> tuple[np.ndarray, DataFrame, float]:
    """The fitted ratios, the scores of all documents, and the smallest sample key that is kept."""
    ratios = fit(docs, target_keys(labels, key, quality, target_rows), key, text)
    scores = stored(weigh(docs, ratios, key, text).withColumn("sample_key", F.col("log_weight") + gumbel(F.col("key"), seed)), "quality")
    total, expected = scores.agg(F.count(F.lit(1)), F.sum(F.exp(F.least(F.lit(0.0), F.col("log_weight"))))).first()
    if k is None:
        good = labels.groupBy(key).agg(F.min(quality).alias("q")).agg(F.avg(F.col("q").cast("double"))).first()[0]
        k = round(max(expected or 0.0, total * (1.0 if good is None else good)))
    if k >= total:
        return ratios, scores, float("-inf")
    return ratios, scores, kth_largest(scores, "sample_key", k) if k > 0 else float("inf")


def importance_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality",
                      k: int | None = None, seed: int = 17, target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row per document: key, `ngrams`, `log_weight`, `sample_key` and whether it is `selected`."""
    _, scores, least = _plan(docs, labels, key, text, quality, k, seed, target_rows)
    return scores.select(F.col("key").alias(key), "ngrams", "log_weight", "sample_key", (F.col("sample_key") >= least).alias("selected"))


def resampled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality",
              k: int | None = None, seed: int = 17, target_rows: int = TARGET_ROWS) -> DataFrame:
    """The selected documents with their columns. The decision is made again on each row from the fitted model and the threshold,
    so no join moves the texts."""
    ratios, _, least = _plan(docs, labels, key, text, quality, k, seed, target_rows)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    at = docs.columns.index(text)

    def weight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, found, rows in ngram_buckets(batch.column(at), len(ratios)):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(log_weights(found, rows, last - first, ratios)[1])],
                                                 [*part.schema.names, "_log_weight"])

    weighed = docs.mapInArrow(weight, f"{columns}, _log_weight double")
    return weighed.where(F.col("_log_weight") + gumbel(F.col(key), seed) >= least).drop("_log_weight")
