"""Helpers that keep hot keys from landing in one task.

A key (frame, sequence, source) may hold a large share of all rows. Aggregates are safe, since Spark combines them
before the shuffle; joins are safe, since adaptive execution splits skewed partitions. Windows and collected arrays
are not, so they are used for keys of checked size only and hot keys take the routes below.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 50_000
"""Rows of one key above which a window over that key is split."""


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    return (
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit).select(*keys)
    )


_SEEN: dict[tuple, bool] = {}


def find_hot(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """The hot keys as a DataFrame, or None when there are none.

    One counting job over the key columns decides; only its yes or no reaches the driver. The answer is kept per plan,
    so a table used several times in one query is counted once. It steers the route taken, never the result.
    """
    hot = hot_keys(df, keys, limit)
    token = (df.sparkSession.sparkContext.applicationId, hot.semanticHash())
    if token not in _SEEN:
        _SEEN[token] = not hot.isEmpty()
    return hot if _SEEN[token] else None


def few_values(df: DataFrame, columns: Sequence[str], limit: int, copies: int = 8) -> bool:
    """Whether the rows share few values of these columns: about `limit` at most, each held by `copies` rows or more on average. One counting
    job decides, kept per plan as in `find_hot`; it steers the route taken, never the result."""
    counts = df.agg(F.approx_count_distinct(F.struct(*columns)).alias("d"), F.count(F.lit(1)).alias("n"))
    token = (df.sparkSession.sparkContext.applicationId, counts.semanticHash())
    if token not in _SEEN:
        found = counts.first()
        _SEEN[token] = 0 < found["d"] <= min(limit, found["n"] // copies)
    return _SEEN[token]


def split_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys). Spark broadcasts `hot` only when its measured size allows."""
    keys = list(keys)
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str,
                bucket: Sequence[Column], limit: int = HOT_ROWS) -> DataFrame:
    """`row_number` per key. For hot keys `bucket`, which must rise with `order`, cuts the key into pieces: each piece
    is numbered on its own and shifted by the number of rows in the pieces before it."""
    keys = list(keys)
    numbered = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int")
    found = find_hot(df, keys, limit)
    if found is None:
        return df.withColumn(out, numbered)
    cold, hot = split_hot(df, found, keys)
    cold = cold.withColumn(out, numbered)
    hot = hot.withColumn("_piece", F.struct(*[b.alias(f"b{i}") for i, b in enumerate(bucket)]))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hot.groupBy(*keys, "_piece").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order)
    hot = (
        hot.join(offsets, keys + ["_piece"])
        .withColumn(out, (F.row_number().over(inside) + F.col("_offset")).cast("int"))
        .drop("_piece", "_offset")
    )
    return cold.unionByName(hot)


def best_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], **more: Column) -> DataFrame:
    """The row with the greatest `order` per key, as an aggregate (no window, no sort). `order` must be total; extra
    aggregates over the key may be asked for in `more`."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    row = F.max_by(F.struct(*[F.col(c) for c in rest]), ranked)
    picked = df.groupBy(*keys).agg(row.alias("_row"), *[v.alias(k) for k, v in more.items()])
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest], *more)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First `k` rows per key. Spark cuts each map partition to `k` rows per key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Add aggregates of each row's group: aggregate first, then join, so that a hot group is never buffered."""
    keys = list(keys)
    table = df.groupBy(*keys).agg(*[v.alias(k) for k, v in stats.items()])
    return df.join(table, keys, "left")


def running_total(df: DataFrame, order: Sequence[Column], bucket: Sequence[Column], **sums: Column) -> DataFrame:
    """Cumulative sums over one global order in two levels: per bucket in parallel, plus the totals of the buckets
    before. Only one row per bucket meets in a single task."""
    tagged = df.withColumn("_piece", F.struct(*[b.alias(f"b{i}") for i, b in enumerate(bucket)]))
    totals = tagged.groupBy("_piece").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    for k in sums:
        totals = totals.withColumn(f"_o_{k}", F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)))
    inside = Window.partitionBy("_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = tagged.join(totals.select("_piece", *[f"_o_{k}" for k in sums]), "_piece")
    for k, v in sums.items():
        out = out.withColumn(k, F.sum(v).over(inside) + F.col(f"_o_{k}"))
    return out.drop("_piece", *[f"_o_{k}" for k in sums])
