"""Nearest neighbours by multi-index hashing over learned binary codes.

Codes: principal directions of a sample, turned by iterative quantisation so that signs lose little; one bit per direction, 64 at most. A
code is split into substrings, each with its own bucket index. Two codes within Hamming radius r = a * m + b agree within a bits in one of
the first b + 1 of m substrings or within a - 1 bits in one of the others; probing those buckets therefore finds every code within r. Found
codes within r are ranked by exact distance in double precision. The radius is the one that holds `HELD` of the true neighbours in the
sample; neighbours in all rows are nearer than in a sample, so it is on the safe side. Queries that find fewer than k rows are asked again
with a radius that reaches every code.

Rows are dealt into blocks by hash; every block of queries meets every block of rows once, and a block sends back its k best per query.
Equal vectors or one crowded bucket therefore never gather in one task.

Bounds: the fit sees at most `SAMPLE` rows, those of smallest hash; all rows are indexed.

Defined results: rows with a null id, and vectors that are null, empty, zero, of another length than most, or hold null or non-finite
numbers take no part; ties go to the smaller id; repeated ids count once, at their nearest; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framefusion.llm.storage import stored

SAMPLE, SAMPLE_QUERIES, HELD = 20_000, 400, 0.97
MOST_BITS, MOST_PROBES, ROTATIONS = 64, 1_024, 25
ROW_BLOCK, QUERY_BLOCK = 2_048, 1_024


@dataclass
class Codes:
    """A fitted code: how vectors become bits, how bits are split, and how far to look."""

    mean: np.ndarray
    turn: np.ndarray
    radius: int
    parts: list[tuple[int, int]]

    def bits(self, vectors: np.ndarray) -> np.ndarray:
        signs = (vectors - self.mean) @ self.turn > 0
        return (signs.astype(np.uint64) << np.arange(signs.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def substring(self, codes: np.ndarray, part: int) -> np.ndarray:
        low, high = self.parts[part]
        return ((codes >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)


def part_radius(radius: int, parts: int, part: int) -> int:
    """How many bits may differ in this substring; -1 if it needs no probe."""
    a, b = divmod(radius, parts)
    return a if part <= b else a - 1


def split(bits: int, radius: int, most_probes: int = MOST_PROBES) -> list[tuple[int, int]]:
    """The longest substrings that need at most `most_probes` probes a query."""
    for width in range(min(16, bits), 0, -1):
        parts = -(-bits // width)
        edges = [bits * i // parts for i in range(parts + 1)]
        widths = np.diff(edges)
        probes = sum(comb(int(w), d) for i, w in enumerate(widths) for d in range(part_radius(radius, parts, i) + 1))
        if probes <= most_probes:
            break
    return list(zip(edges[:-1], edges[1:]))


def fit(sample: np.ndarray, k: int) -> Codes:
    """Fit the code on sample rows."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    bits = min(MOST_BITS, sample.shape[1])
    _, _, directions = np.linalg.svd(centred.T @ centred)
    plane = centred @ directions[:bits].T
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(bits, bits)))[0]
    for _ in range(ROTATIONS):
        u, _, v = np.linalg.svd(plane.T @ np.sign(plane @ turn))
        turn = u @ v
    codes = Codes(mean, directions[:bits].T @ turn, bits, [(0, bits)])
    if len(sample) > 4 * k:
        every = codes.bits(sample)
        far = []
        for i in range(min(SAMPLE_QUERIES, len(sample))):
            distance = ((sample - sample[i]) ** 2).sum(axis=1)
            distance[i] = np.inf
            near = np.argpartition(distance, k)[:k]
            far.append(np.bitwise_count(every[near] ^ every[i]))
        codes.radius = int(np.quantile(np.concatenate(far), HELD, method="higher"))
    codes.parts = split(bits, codes.radius)
    return codes


def masks(width: int, radius: int) -> np.ndarray:
    """All substrings of this width with at most `radius` bits set."""
    every = np.arange(1 << width, dtype=np.int64)
    return every[np.bitwise_count(every) <= radius]


def search_block(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, codes: Codes, radius: int,
                 k: int) -> list[tuple[int, int, float]]:
    """The k nearest rows within the radius for every query: (query id, row id, distance)."""
    row_codes, query_codes = codes.bits(rows), codes.bits(queries)
    indexes = []
    for part, (low, high) in enumerate(codes.parts):
        reach = part_radius(radius, len(codes.parts), part)
        if reach < 0:
            continue
        sub = codes.substring(row_codes, part)
        order = np.argsort(sub, kind="stable")
        begins = np.searchsorted(sub[order], np.arange((1 << (high - low)) + 1))
        indexes.append((codes.substring(query_codes, part), masks(high - low, min(reach, high - low)), order, begins))
    out = []
    for q in range(len(queries)):
        found = np.zeros(len(rows), bool)
        for subs, near, order, begins in indexes:
            buckets = subs[q] ^ near
            starts, sizes = begins[buckets], begins[buckets + 1] - begins[buckets]
            ends = np.cumsum(sizes)
            found[order[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)]] = True
        at = np.flatnonzero(found)
        at = at[(np.bitwise_count(row_codes[at] ^ query_codes[q]) <= radius) & (ids[at] != query_ids[q])]
        distance = np.sqrt(((rows[at] - queries[q]) ** 2).sum(axis=1))
        if len(at) > k:
            # Keep everything not farther than the k-th, so that ties are settled by id below.
            close = distance <= np.partition(distance, k - 1)[k - 1]
            at, distance = at[close], distance[close]
        best = np.lexsort((ids[at], distance))[:k]
        out += [(int(query_ids[q]), int(ids[at[i]]), float(distance[i])) for i in best]
    return out


def valid(vector: Column) -> Column:
    return (vector.isNotNull() & (F.size(vector) > 0)
            & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0))


def _blocks(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int, codes: Codes, radius: int, k: int) -> DataFrame:
    row_blocks, query_blocks = max(1, -(-n_rows // ROW_BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))

    def dealt(df: DataFrame, own: int, other: int, mine: str, theirs: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(own)).cast("int").alias(mine)
        return df.select("id", "vector", block, F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(theirs))

    left = dealt(queries, query_blocks, row_blocks, "qb", "rb")
    right = dealt(rows, row_blocks, query_blocks, "rb", "qb")

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(r):
            found = search_block(np.array(r["vector"].tolist(), np.float64), r["id"].to_numpy(), np.array(q["vector"].tolist(), np.float64),
                                 q["id"].to_numpy(), codes, radius, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    return (left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb"))
            .applyInPandas(meet, "query_id long, vec_id long, score double"))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every row whose id is divisible by `every`: its k nearest other rows as (query_id, rank, vec_id, score)."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & valid(F.col("vector")))
    spark = vectors.sparkSession
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max(F.struct("n", "d"))).first()[0]
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stored(rows.where(F.size("vector") == lengths.d), "ann-rows")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()["vector"]  # at most SAMPLE rows
    codes = fit(np.array(sample.tolist(), np.float64), k)
    queries = rows.where(F.col("id") % every == 0).dropDuplicates(["id"])
    n_queries = queries.count()
    found = stored(_blocks(queries, rows, n_queries, lengths.n, codes, codes.radius, k), "ann-found")
    full = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= k)
    short = stored(queries.join(full, queries["id"] == full["query_id"], "left_anti"), "ann-short")
    n_short = short.count()
    if n_short:
        bits = codes.parts[-1][1]
        found = found.unionByName(_blocks(short, rows, n_short, lengths.n, codes, bits, k))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
