"""One spatial join for all box relations.

`relate` answers, for each left row, questions about the right rows of the same frame: the greatest overlap, whether a
close text agrees, which box fits best. A question is a `Fold` over pairs. The same folds run in one of two ways:

* frames with up to `limit` right rows (all frames of a real screen): the right rows become one small array per frame,
  joined once by frame; the folds are higher-order functions over it. No pair is ever emitted and nothing is grouped.
  Where the caller gives its folds as a `Block` too, the arrays of many rows are folded together.
* hot frames: equal rows on both sides are collapsed first, with a count; what remains meets by frame and screen tile,
  so only boxes near each other pair up, and the folds become aggregates. A `nearest` fold has no radius; it keeps the
  extent of the points in each tile and opens only the tiles that can hold the nearest point.

Both ways are exact and give the same rows; the frame sizes are counted by an aggregate, never collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any, Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framefusion.functions import boxes as bx
from framefusion.functions import text as tx
from framefusion.operators.blocks import Block
from framefusion.operators.skew import find_hot, split_hot

Size = tuple[int | str, int | str]
Get = Callable[[str], Column]
Derive = Callable[[Get, Get], dict[str, Column]]

ARRAY_LIMIT = 256
"""Right rows of one frame up to which they travel as an array."""
TILES = 16
"""Tiles per axis for the nearest-point search."""


@dataclass(frozen=True)
class Fold:
    """`how`: max, min, any, count, or best (greatest struct). `value` and `where` read the derived pair fields;
    `others` leaves the row itself out."""

    how: str
    value: Callable[[Get], Column] | None = None
    where: Callable[[Get], Column] | None = None
    default: Any = None
    others: bool = False


@dataclass(frozen=True)
class PerFrame:
    """Count, or greatest value, over all right rows of the frame, near or not; reads right columns."""

    how: str
    value: Callable[[Get], Column] | None = None
    where: Callable[[Get], Column] | None = None
    default: Any = None


@dataclass(frozen=True)
class Nearest:
    """Least normalised centre distance to the right rows with `column == equals`."""

    column: str | None = None
    equals: Any = None
    default: float = 9.0


@dataclass(frozen=True)
class NotSelf:
    """How to know a row among the right rows: by `id`, and only where `member` says the left row is one of them."""

    id: str
    member: Callable[[Get], Column]


def _with_default(value: Column, default: Any) -> Column:
    return value if default is None else F.coalesce(value, F.lit(default))


def _size(get: Get, frame_size: Size) -> tuple[Column, Column]:
    w, h = (get(s) if isinstance(s, str) else F.lit(s) for s in frame_size)
    return w, h


def _array_fold(pairs: Column, fold: Fold) -> Column:
    if getattr(fold, "others", False):
        pairs = F.filter(pairs, lambda p: ~p["_self"])
    if fold.where is not None:
        pairs = F.filter(pairs, lambda p: fold.where(lambda n: p[n]))
    if fold.how == "any":
        return F.coalesce(F.exists(pairs, lambda p: fold.value(lambda n: p[n])) if fold.value
                          else F.size(pairs) > 0, F.lit(False))
    if fold.how == "count":
        return F.greatest(F.lit(0), F.coalesce(F.size(pairs), F.lit(0))).cast("long")
    values = F.transform(pairs, lambda p: fold.value(lambda n: p[n]))
    folded = F.array_min(values) if fold.how == "min" else F.array_max(values)
    return _with_default(folded, fold.default)


def _pair_fold(fold: Fold | PerFrame) -> Column:
    get: Get = F.col
    where = fold.where(get) if fold.where is not None else F.lit(True)
    copies = F.lit(1) if isinstance(fold, PerFrame) else F.col("_copies")
    if getattr(fold, "others", False):
        copies = F.col("_others")
        where = where & (copies > 0)
    if fold.how == "any":
        return F.max(where & (fold.value(get) if fold.value else F.lit(True)))
    if fold.how == "count":
        return F.sum(F.when(where, copies).otherwise(0))
    value = F.when(where, fold.value(get))
    return F.min(value) if fold.how == "min" else F.max(value)


def _nearest_array(pairs: Column, fold: Nearest) -> Column:
    if fold.column is not None:
        pairs = F.filter(pairs, lambda p: p[fold.column] == fold.equals)
    return F.coalesce(F.array_min(F.transform(pairs, lambda p: p["_distance"])), F.lit(fold.default))


def _all_equal(pairs: Sequence[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in pairs])


@dataclass(frozen=True)
class OwnRows:
    """Left rows that also stand on the right: those with `where`, under the right column names."""

    where: Column
    columns: dict[str, Column]


def relate(left: DataFrame, right: DataFrame | None, *, on: str, derive: Derive, folds: dict[str, Fold | Nearest | PerFrame],
           left_cols: Sequence[str], right_cols: Sequence[str], reach: float,
           frame_size: Size = ("image_width", "image_height"), not_self: NotSelf | None = None,
           collapse: dict[str, Callable[[str], Column]] | None = None, own_rows: OwnRows | None = None,
           limit: int = ARRAY_LIMIT, block: Block | None = None) -> DataFrame:
    """Left rows with one column per fold.

    `left_cols`/`right_cols` name the columns `derive` may read (boxes in x1..y2). Pairs that matter must overlap or
    have centres within `reach` (in frame units). `frame_size` holds two numbers or the names of two columns found on
    both sides. `collapse` names right columns that may be aggregated when equal boxes of a hot frame are merged. `block` holds
    the same folds for many pairs at once; the columns it reads are carried along.
    """
    left_cols, right_cols = list(left_cols), list(right_cols)
    carried = right_cols + ([not_self.id] if not_self and not_self.id not in right_cols else [])
    carried += [c for c in (block.their if block else ()) if c not in carried]
    everything = _all_right(left, right, on, carried, frame_size, own_rows)
    hot = find_hot(everything, [on], limit)
    args = (on, derive, folds, carried, frame_size, not_self, own_rows, block)
    if hot is None:
        return _relate_arrays(left, right, *args)
    cold_left, hot_left = split_hot(left, hot, [on])
    cold_right = split_hot(right, hot, [on])[0] if right is not None else None
    hot_right = everything.join(hot, [on], "left_semi")
    cold = _relate_arrays(cold_left, cold_right, *args)
    hot_out = _relate_tiles(hot_left, hot_right, on, derive, folds, left_cols, right_cols, reach, frame_size, not_self,
                            collapse or {})
    return cold.unionByName(hot_out.select(*cold.columns))


def _all_right(left, right, on, carried, frame_size, own_rows) -> DataFrame:
    sizes = [s for s in frame_size if isinstance(s, str)]
    names = list(dict.fromkeys([on, *carried, *sizes]))
    if own_rows is None:
        return right.select(*names)
    mine = left.where(own_rows.where).select(
        on, *[own_rows.columns.get(n, F.col(n)).alias(n) for n in names if n != on])
    return mine if right is None else mine.unionByName(right.select(*names))


def _relate_arrays(left, right, on, derive, folds, carried, frame_size, not_self, own_rows, block):
    rows, parts, odd = left, [], []
    # What holds for a whole frame is counted with its array.
    frame = {k: f for k, f in folds.items() if isinstance(f, PerFrame) and own_rows is None}
    if own_rows is not None:
        # The rows of a frame are together already, so its own part of the array needs no join.
        mine = F.when(own_rows.where, F.struct(*[own_rows.columns.get(c, F.col(c)).alias(c) for c in carried]))
        rows = rows.withColumn("_mine", F.collect_list(mine).over(Window.partitionBy(on)))
        parts.append(F.col("_mine"))
        if block is not None:
            rows = rows.withColumn("_odd_mine", F.max(own_rows.where & block.odd(F.col)).over(Window.partitionBy(on)))
            odd.append(F.col("_odd_mine"))
    if right is not None:
        strange = [F.max(block.odd(F.col)).alias("_odd_theirs")] if block is not None else []
        near = right.groupBy(on).agg(F.collect_list(F.struct(*carried)).alias("_theirs"), *strange,
                                     *[_pair_fold(f).alias(f"_of_{k}") for k, f in frame.items()])
        odd += [F.col("_odd_theirs") for _ in strange]
        rows = rows.join(near, on, "left")
        kind = near.schema["_theirs"].dataType.simpleString()
        parts.append(F.coalesce("_theirs", F.array().cast(kind)) if own_rows is not None else F.col("_theirs"))
    rows = rows.withColumn("_near", F.concat(*parts) if len(parts) > 1 else parts[0])
    own: Get = F.col
    wants_nearest = any(isinstance(f, Nearest) for f in folds.values())

    def pair(r: Column) -> Column:
        fields = derive(own, lambda n: r[n])
        if wants_nearest:
            fields = {**fields, "_distance": bx.center_distance(
                bx.cols(), bx.field(lambda n: r[n]), *_size(own, frame_size))}
        if not_self is not None:
            same = F.coalesce(r[not_self.id] == F.col(not_self.id), F.lit(False))
            fields = {**fields, "_self": not_self.member(own) & same}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def column(fold: Fold | Nearest | PerFrame, pairs: Column, near: Column) -> Column:
        if isinstance(fold, Nearest):
            return _nearest_array(pairs, fold)
        return _array_fold(near if isinstance(fold, PerFrame) else pairs, fold)

    def counted(name: str) -> Column:
        fold = frame[name]
        default = False if fold.how == "any" else 0 if fold.how == "count" else fold.default
        return _with_default(F.col(f"_of_{name}"), default)

    if block is None:
        rows = rows.withColumn("_pairs", F.transform("_near", pair))
        columns = {k: counted(k) if k in frame else column(f, F.col("_pairs"), F.col("_near")) for k, f in folds.items()}
        return rows.select(*left.columns, *[v.alias(k) for k, v in columns.items()])
    odd.append(block.odd(F.col))
    rows = rows.withColumn("_odd", reduce(lambda a, b: a | b, [F.coalesce(o, F.lit(False)) for o in odd]))
    rows = rows.withColumn("_folded", block.column(F.col("_near")))
    get: Get = lambda n: F.col("_folded")[n]
    near = F.col("_near")
    numbers = block.finish(get, near) if block.finish else {k: get(k) for k in block.kinds}
    # One expression for the few odd rows, so that the code of the others stays small enough to be compiled.
    exact = tx.bind(F.transform(F.coalesce(near, F.array().cast(_kind(rows, "_near"))), pair), lambda pairs: F.struct(
        *[column(f, pairs, pairs).alias(k) for k, f in folds.items() if k in numbers]))
    rows = rows.withColumn("_exact", F.when(F.col("_odd"), exact))
    return rows.select(*left.columns, *[
        (counted(k) if k in frame else F.when(F.col("_odd"), F.col("_exact")[k]).otherwise(numbers[k])).alias(k) for k in folds])


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _tile_range(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))


def _relate_tiles(left, right, on, derive, folds, left_cols, right_cols, reach, frame_size, not_self, collapse):
    keys = [on] + [c for c in left_cols if c != on]
    sizes = [s for s in frame_size if isinstance(s, str)]
    group = [c for c in dict.fromkeys(right_cols + sizes) if c not in collapse]
    own = left.select(*dict.fromkeys(keys + sizes)).distinct()
    others = right.groupBy(on, *group).agg(
        F.count(F.lit(1)).alias("_copies"), *[how(c).alias(c) for c, how in collapse.items()])
    l_side = own.select(*[F.col(k).alias(f"l_{k}") for k in own.columns])
    r_side = others.select(*[F.col(c).alias(c if c == "_copies" else f"r_{c}") for c in others.columns])
    l_get: Get = lambda n: F.col(f"l_{n}")
    r_get: Get = lambda n: F.col(f"r_{n}")
    tile = max(reach, 1.0 / 32)
    l_side = _on_tiles(l_side, "l", bx.field(l_get), *_size(l_get, frame_size), reach, tile)
    r_side = _on_tiles(r_side, "r", bx.field(r_get), *_size(r_get, frame_size), 0.0, tile)
    # A pair sharing several tiles is kept on the tile of the corner where the two ranges begin to overlap.
    owner = (
        (F.col("l_tx") == F.greatest(F.col("l_fx"), F.col("r_fx")))
        & (F.col("l_ty") == F.greatest(F.col("l_fy"), F.col("r_fy")))
    )
    same_tile = (F.col("l_tx") == F.col("r_tx")) & (F.col("l_ty") == F.col("r_ty"))
    pairs = l_side.join(r_side, (F.col(f"l_{on}") == F.col(f"r_{on}")) & same_tile & owner)
    if not_self is not None:
        same = _all_equal([(l_get(c), r_get(c)) for c in group if c in keys])
        self_copy = F.when(same & not_self.member(l_get), 1).otherwise(0)
        pairs = pairs.withColumn("_others", F.col("_copies") - self_copy)
    else:
        pairs = pairs.withColumn("_others", F.col("_copies"))
    fields = derive(l_get, r_get)
    pairs = pairs.select(*[l_get(k) for k in keys], "_copies", "_others", *[v.alias(k) for k, v in fields.items()])
    plain = {k: f for k, f in folds.items() if isinstance(f, Fold)}
    rows = left
    if plain:
        grouped = pairs.groupBy(*[f"l_{k}" for k in keys]).agg(
            *[_pair_fold(f).alias(k) for k, f in plain.items()])
        match = _all_equal([(left[k], grouped[f"l_{k}"]) for k in keys])
        rows = left.join(grouped, match, "left").select(left["*"], *plain)
    per_frame = {k: f for k, f in folds.items() if isinstance(f, PerFrame)}
    if per_frame:
        totals = right.groupBy(on).agg(*[_pair_fold(f).alias(k) for k, f in per_frame.items()])
        rows = rows.join(totals, on, "left")
    for name, fold in {**plain, **per_frame}.items():
        default = False if fold.how == "any" else 0 if fold.how == "count" else fold.default
        rows = rows.withColumn(name, _with_default(F.col(name), default))
    nearest = {k: f for k, f in folds.items() if isinstance(f, Nearest)}
    return _nearest_tiles(rows, own, right, on, nearest, frame_size) if nearest else rows


def _on_tiles(side, tag, box, w, h, reach, size):
    x_low, x_high = box.x1 / w - reach, box.x2 / w + reach
    y_low, y_high = box.y1 / h - reach, box.y2 / h + reach
    return (
        side.withColumn(f"{tag}_fx", F.floor(x_low / size).cast("int"))
        .withColumn(f"{tag}_fy", F.floor(y_low / size).cast("int"))
        .withColumn(f"{tag}_tx", F.explode(_tile_range(x_low, x_high, size)))
        .withColumn(f"{tag}_ty", F.explode(_tile_range(y_low, y_high, size)))
    )


def _nearest_tiles(left, own, right, on, folds, frame_size):
    """Nearest centres of hot frames, for all kinds of right rows at once."""
    w, h = _size(F.col, frame_size)
    kinds = {f.column for f in folds.values()}
    if len(kinds) != 1:
        raise ValueError("nearest folds must share their column")
    kind = F.col(kinds.pop()) if None not in kinds else F.lit(0)
    wanted = sorted({f.equals for f in folds.values()}) if None not in {f.column for f in folds.values()} else [0]
    cx, cy = bx.center_x(bx.cols()) / w, bx.center_y(bx.cols()) / h
    tile = lambda v: F.greatest(F.lit(0), F.least(F.lit(TILES - 1), F.floor(v * TILES).cast("int")))
    points = right.where(kind.isin(*wanted)).select(on, kind.alias("kind"), cx.alias("px"), cy.alias("py")).distinct()
    points = points.withColumn("tile", tile(F.col("px")) * TILES + tile(F.col("py")))
    extents = points.groupBy(on, "kind", "tile").agg(
        F.min("px").alias("ax"), F.max("px").alias("bx"), F.min("py").alias("ay"), F.max("py").alias("by"))
    # At most TILES * TILES extents per frame and kind, whatever the number of points.
    maps = extents.groupBy(on, "kind").agg(F.collect_list(F.struct("tile", "ax", "bx", "ay", "by")).alias("_tiles"))
    spots = own.select(on, cx.alias("qx"), cy.alias("qy")).distinct().join(maps, on)
    zero = F.lit(0.0)

    def closest(t: Column) -> Column:
        dx = F.greatest(zero, t["ax"] - F.col("qx"), F.col("qx") - t["bx"])
        dy = F.greatest(zero, t["ay"] - F.col("qy"), F.col("qy") - t["by"])
        return dx * dx + dy * dy

    def farthest(t: Column) -> Column:
        dx = F.greatest(F.abs(F.col("qx") - t["ax"]), F.abs(F.col("qx") - t["bx"]))
        dy = F.greatest(F.abs(F.col("qy") - t["ay"]), F.abs(F.col("qy") - t["by"]))
        return dx * dx + dy * dy

    bounded = spots.withColumn("_bound", F.array_min(F.transform("_tiles", farthest)))
    open_tiles = F.filter("_tiles", lambda t: closest(t) <= F.col("_bound") + 1e-12)
    opened = bounded.select(on, "qx", "qy", "kind", F.explode(F.transform(open_tiles, lambda t: t["tile"])).alias("tile"))
    away = bx.point_distance(F.col("qx"), F.col("qy"), F.col("px"), F.col("py"))
    found = opened.join(points, [on, "kind", "tile"]).groupBy(on, "qx", "qy").agg(
        *[F.min(F.when(F.col("kind") == (f.equals if f.column else 0), away)).alias(f"_{k}") for k, f in folds.items()])
    rows = left.withColumn("qx", cx).withColumn("qy", cy).join(found, [on, "qx", "qy"], "left")
    exact = [F.coalesce(F.col(f"_{k}"), F.lit(f.default)).alias(k) for k, f in folds.items()]
    return rows.select(*left.columns, *exact)
