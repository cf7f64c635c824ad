"""Greedy choices in rounds: what beats all its undecided rivals is taken, what it rules out goes, and the rest plays again.

The result is that of a walk in order, without the walk: a choice waits for its rivals only, not for everything before it. Keys of
ordinary size are decided many at a time inside a task, on arrays. A crowded key is decided by joins: boxes meet by screen tile, and a
round takes every box that is the first in all tiles it touches, so a tile sends one box a round and no pairs of undecided boxes are formed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framefusion.functions import boxes as bx
from framefusion.operators.skew import find_hot, split_hot
from framefusion.session import cut_lineage
from framefusion.streaming.tracker import firsts, overlaps

BOX = ("x1", "y1", "x2", "y2")
CROWD = 512
"""Rows of one key above which it is decided by joins."""


def _columns(df: DataFrame) -> list[str]:
    return [f"`{c}`" for c in df.columns]


def decide(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """Which of `n` choices are taken, where `first[i]` rules out `second[i]` if it is itself taken; a choice never rules out one
    before it, so the rounds end."""
    open_, taken = np.ones(n, bool), np.zeros(n, bool)
    while len(first):
        rivals = np.zeros(n, bool)
        rivals[second] = True
        won = open_ & ~rivals
        taken |= won
        open_ &= ~won
        lost = second[won[first]]
        open_[lost] = False
        alive = open_[first] & open_[second]
        first, second = first[alive], second[alive]
    return taken | open_


def _groups(table: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """Numbers of the runs of equal keys."""
    changed = np.zeros(table.num_rows, bool)
    for key in keys:
        column = table[key]
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        changed[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(changed)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables that hold all rows of their keys, from batches sorted by key."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*rest, batch])
        if not table.num_rows:
            continue
        cut = int(firsts(_groups(table, keys))[-1])
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut).combine_chunks().to_batches()
    if rest:
        yield pa.Table.from_batches(rest)


def _apart(table: pa.Table, keys: Sequence[str], threshold: float, by_source: bool) -> np.ndarray:
    """The boxes of sorted rows that stay. Rows at distance 1, 2, … are compared for all keys at once."""
    group = _groups(table, [*keys])
    box = np.stack([table[c].to_numpy() for c in BOX], axis=1)
    source = table["source"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() if by_source else np.zeros(len(group))
    pairs = []
    for step in range(1, int(np.bincount(group).max())):
        i = np.flatnonzero((group[:-step] == group[step:]) & (source[:-step] == source[step:]))
        i = i[overlaps(box[i], box[i + step]) > threshold]
        pairs.append(np.stack([i, i + step]))
    first, second = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
    return decide(first, second, len(group))


def _small(rows: DataFrame, keys: Sequence[str], order: Sequence[str], threshold: float, by_source: bool) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            yield from table.filter(pa.array(_apart(table, keys, threshold, by_source))).combine_chunks().to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, rows.schema)


def keep_apart_in_turn(boxes: DataFrame, keys: Sequence[str], order: Sequence[str], later: Column, thresholds: tuple[float, float]) -> DataFrame:
    """`keep_apart` of the boxes that are not `later` by the first threshold, then of those kept and the later ones by the second, in one pass
    over keys of ordinary size."""
    rows = boxes.where(bx.area(bx.cols()) > 0).withColumn("_later", later)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            keep = table["_later"].to_numpy().copy()
            early = np.flatnonzero(~keep)
            if len(early):
                keep[early] = _apart(table.take(pa.array(early)), keys, thresholds[0], False)
            table = table.filter(pa.array(keep))
            if table.num_rows:
                yield from table.filter(pa.array(_apart(table, keys, thresholds[1], False))).combine_chunks().to_batches()

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, rows.schema).drop("_later")


def _crowded(rows: DataFrame, keys: Sequence[str], order: Sequence[str], threshold: float, by_source: bool, limit: int) -> DataFrame:
    """Rounds of joins until every key is of ordinary size; what is open then has no rival among the boxes taken."""
    columns, keys = _columns(rows), [*keys, *(["_source"] if by_source else [])]
    rows = rows.withColumn("_source", F.coalesce("source", F.lit("\0"))) if by_source else rows
    span = rows.groupBy(*keys).agg(F.greatest(F.lit(1.0), 2 * F.avg(F.col("x2") - F.col("x1"))).alias("_tw"),
                                   F.greatest(F.lit(1.0), 2 * F.avg(F.col("y2") - F.col("y1"))).alias("_th"))
    open_ = cut_lineage(rows.withColumn("_id", F.expr("uuid()")).join(span, keys).withColumn("_o", F.struct(*order, "_id")))
    taken = []
    while True:
        crowds = open_.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys)
        if crowds.isEmpty():
            break
        crowd = open_.join(crowds, keys, "left_semi")
        side = lambda low, high, size: F.explode(F.sequence(F.floor(F.col(low) / F.col(size)), F.floor(F.col(high) / F.col(size))))
        tiles = crowd.select(*keys, *BOX, "_id", "_o", "_th", side("x1", "x2", "_tw").alias("_tx")).select(
            *keys, *BOX, "_id", "_o", "_tx", side("y1", "y2", "_th").alias("_ty"))
        spot = [*keys, "_tx", "_ty"]
        best = tiles.groupBy(*spot).agg(F.min(F.struct("_o", "_id", *BOX)).alias("_best"))
        met = tiles.join(best, spot).select(
            "_id", F.col("_best._id").alias("_by"),
            (bx.iou(bx.cols(), bx.Box(*[F.col(f"_best.{c}") for c in BOX])) > threshold).alias("_near"))
        won = met.groupBy("_id").agg(F.bool_and(F.col("_id") == F.col("_by")).alias("_won")).where("_won").select("_id", "_won")
        lost = met.where("_near AND _id <> _by").join(won.select(F.col("_id").alias("_by")), "_by", "left_semi").select("_id").distinct()
        played = cut_lineage(open_.join(won, "_id", "left").join(lost.withColumn("_lost", F.lit(True)), "_id", "left"))
        taken.append(played.where("_won").drop("_won", "_lost"))
        open_ = played.where("_won IS NULL AND _lost IS NULL").drop("_won", "_lost")
    rest = _small(open_.select(*_columns(rows)), keys, order, threshold, by_source)
    return reduce(DataFrame.unionByName, [t.select(*columns) for t in taken], rest.select(*columns))


def keep_apart(boxes: DataFrame, keys: Sequence[str], order: Sequence[Column], threshold: float, by_source: bool = False,
               limit: int | None = CROWD) -> DataFrame:
    """The boxes of a key that a walk in `order` keeps, dropping each that overlaps a kept one by more than `threshold` (with
    `by_source`, one of its own source); boxes without area go. `limit` None says that no key can be crowded, and spares the count."""
    names = [f"_o{i}" for i in range(len(order))]
    rows = boxes.where(bx.area(bx.cols()) > 0).select("*", *[o.alias(n) for o, n in zip(order, names)])
    hot = find_hot(rows, keys, limit) if limit is not None else None
    if hot is None:
        return _small(rows, keys, names, threshold, by_source).select(*_columns(boxes))
    cold, crowd = split_hot(rows, hot, keys)
    cold = _small(cold.select(*_columns(rows)), keys, names, threshold, by_source)
    return cold.unionByName(_crowded(crowd.select(*_columns(rows)), keys, names, threshold, by_source, limit)).select(*_columns(boxes))


def take_pairs(pairs: DataFrame, keys: Sequence[str], left: str, right: str, order: Sequence[Column], hot: DataFrame | None) -> DataFrame:
    """One-to-one choice among the pairs of a key: in `order`, a pair is taken when neither of its sides is. Returns keys, left, right.

    The pairs of an ordinary key are sorted into an array and folded; those of the keys in `hot` are decided in rounds: a pair that is the
    first of both its sides is taken, and all others of these sides go."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(left).alias("l"), F.col(right).alias("r"))
    rows = pairs.select(*keys, rank.alias("_o"))
    kinds = dict(rows.select("_o.l", "_o.r").dtypes)
    side = f"array<struct<l:{kinds['l']},r:{kinds['r']}>>"

    def fold(acc: Column, p: Column) -> Column:
        used = F.exists(acc, lambda t: (t["l"] == p["l"]) | (t["r"] == p["r"]))
        return F.when(used, acc).otherwise(F.concat(acc, F.array(F.struct(p["l"].alias("l"), p["r"].alias("r")))))

    cold = rows if hot is None else rows.join(hot, [c for c in hot.columns], "left_anti").select(*_columns(rows))
    out = cold.groupBy(*keys).agg(F.array_sort(F.collect_list("_o")).alias("_p")).select(
        *keys, F.explode(F.aggregate("_p", F.array().cast(side), fold)).alias("_t")).select(
        *keys, F.col("_t.l").alias(left), F.col("_t.r").alias(right))
    if hot is None:
        return out
    open_ = rows.join(hot, [c for c in hot.columns], "left_semi").select(*keys, "_o", "_o.l", "_o.r")
    taken = []
    while True:
        open_ = cut_lineage(open_)
        if open_.isEmpty():
            break
        by = {s: open_.groupBy(*keys, s).agg(F.min("_o").alias(f"_{s}")) for s in "lr"}
        met = open_.join(by["l"], [*keys, "l"]).join(by["r"], [*keys, "r"])
        won = met.where((F.col("_o") == F.col("_l")) & (F.col("_o") == F.col("_r"))).select(*keys, "l", "r")
        taken.append(won.select(*keys, F.col("l").alias(left), F.col("r").alias(right)))
        open_ = open_.join(won.select(*keys, "l"), [*keys, "l"], "left_anti").join(
            won.select(*keys, "r"), [*keys, "r"], "left_anti").select(*open_.columns)
    return reduce(DataFrame.unionByName, taken, out)
