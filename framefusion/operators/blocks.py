"""Pairs of many rows weighed at once.

An ordinary frame's right rows travel as an array beside each left row (see `relate`). Here the arrays of a batch of left rows are laid end to
end, so that a fold is a few numpy steps over all pairs of the batch in place of an expression interpreted pair by pair. Nulls are NaN: the
minima and maxima below skip them and comparisons with them are false, as in Spark. Rows for which numbers and Spark would differ (see
`unlike_numbers`) are left to the expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRS = 1 << 18
"""Pairs weighed together, unless one row has more."""
LARGEST = 1e60
"""Coordinates beyond this could overflow in an area."""


class Pairs:
    """`own` and `their` give one number per pair, `greatest`, `least`, `any` and `best` one per left row."""

    def __init__(self, own: Mapping[str, np.ndarray], their: Mapping[str, np.ndarray], counts: np.ndarray):
        self._own, self._their, self.rows = own, their, len(counts)
        self.row = np.repeat(np.arange(len(counts)), counts)
        self.full = np.flatnonzero(counts)
        self.first = np.cumsum(counts) - counts
        self._geometry: dict[str, np.ndarray] | None = None

    def own(self, name: str) -> np.ndarray:
        return self._own[name][self.row]

    def their(self, name: str) -> np.ndarray:
        return self._their[name]

    def _reduce(self, how, values: np.ndarray) -> np.ndarray:
        return how.reduceat(values, self.first[self.full]) if len(self.full) else values[:0]

    def _extreme(self, how, none: float, values, where, default) -> np.ndarray:
        out = np.full(self.rows, default, dtype="float64")
        found = self._reduce(how, np.where(where & (values == values), values, none))
        hit = found != none
        out[self.full[hit]] = found[hit]
        return out

    def greatest(self, values: np.ndarray, where: np.ndarray, default: float) -> np.ndarray:
        return self._extreme(np.maximum, -np.inf, values, where, default)

    def least(self, values: np.ndarray, where: np.ndarray, default: float) -> np.ndarray:
        return self._extreme(np.minimum, np.inf, values, where, default)

    def any(self, where: np.ndarray) -> np.ndarray:
        out = np.zeros(self.rows, dtype=bool)
        out[self.full] = self._reduce(np.logical_or, where)
        return out

    def best(self, where: np.ndarray, keys: Sequence[np.ndarray]) -> np.ndarray:
        """Index of the pair with the greatest keys per row, a null the least; -1 where no pair takes part."""
        left = np.flatnonzero(where)
        for key in keys:
            row = self.row[left]
            if len(left) < 2 or (row[1:] != row[:-1]).all():
                break
            value = np.where(key[left] == key[left], key[left], -np.inf)
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            top = np.repeat(np.maximum.reduceat(value, starts), np.diff(np.append(starts, len(left))))
            left = left[value == top]
        out = np.full(self.rows, -1, dtype="int64")
        out[self.row[left][::-1]] = left[::-1]
        return out

    def geometry(self) -> dict[str, np.ndarray]:
        """`iou`, `overlap` and `distance` of the boxes, step by step as in `functions.boxes`."""
        if self._geometry is None:
            a = {n: self.own(n) for n in ("x1", "y1", "x2", "y2")}
            b = {n: self.their(n) for n in ("x1", "y1", "x2", "y2")}
            area_a, area_b = (np.fmax(0.0, k["x2"] - k["x1"]) * np.fmax(0.0, k["y2"] - k["y1"]) for k in (a, b))
            inter = (np.fmax(0.0, np.fmin(a["x2"], b["x2"]) - np.fmax(a["x1"], b["x1"]))
                     * np.fmax(0.0, np.fmin(a["y2"], b["y2"]) - np.fmax(a["y1"], b["y1"])))
            union, small = area_a + area_b - inter, np.fmin(area_a, area_b)
            dx = ((a["x1"] + a["x2"]) / 2.0 - (b["x1"] + b["x2"]) / 2.0) / self.own("image_width")
            dy = ((a["y1"] + a["y2"]) / 2.0 - (b["y1"] + b["y2"]) / 2.0) / self.own("image_height")
            share = lambda whole: np.divide(inter, whole, out=np.zeros_like(inter), where=whole > 0)
            self._geometry = {"iou": share(union), "overlap": share(small), "distance": np.sqrt(dx * dx + dy * dy)}
        return self._geometry


@dataclass(frozen=True)
class Block:
    """Folds as numpy steps. `own` and `their` name the numbers and flags read on each side, `exact` those of them that are whole numbers
    without nulls; `odd` reads either side and tells which rows to leave to the expressions. `folds` gives the columns named in `kinds`;
    `finish` turns them and the right rows into the folds."""

    own: Sequence[str]
    their: Sequence[str]
    kinds: Mapping[str, str]
    folds: Callable[[Pairs], dict[str, np.ndarray]]
    odd: Callable[[Callable[[str], Column]], Column]
    finish: Callable[[Callable[[str], Column], Column], dict[str, Column]] | None = None
    exact: Sequence[str] = field(default_factory=tuple)

    def column(self, near: Column) -> Column:
        """All folds of a row as one struct. Declared not deterministic so that filters above do not repeat it."""
        run = F.arrow_udf(_runner(self.own, self.their, self.kinds, self.folds, self.exact),
                          ", ".join(f"{k}: {v}" for k, v in self.kinds.items()))
        return run.asNondeterministic()(*[F.col(n) for n in self.own], *[near[n] for n in self.their])


def unlike_numbers(get: Callable[[str], Column], *names: str) -> Column:
    """Whether a number is NaN, infinite or so large that NaN could come of it."""
    odd = F.lit(False)
    for name in names:
        odd = odd | F.coalesce(~(F.abs(get(name)) <= LARGEST), F.lit(False))
    return odd


def _numbers(values: pa.Array, exact: bool) -> np.ndarray:
    if pa.types.is_boolean(values.type):
        return pc.fill_null(values, False).to_numpy(zero_copy_only=False)
    if exact:
        return pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
    return pc.cast(values, pa.float64(), safe=False).to_numpy(zero_copy_only=False)


def _runner(own, their, kinds, folds, exact):
    types = {"double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64()}
    own, their, kinds, exact = list(own), list(their), dict(kinds), set(exact)

    def run(*columns: pa.Array) -> pa.Array:
        mine = {n: _numbers(c, n in exact) for n, c in zip(own, columns)}
        lists = columns[len(own):]
        counts = pc.fill_null(pc.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False).astype("int64")
        theirs = {n: _numbers(c.flatten(), n in exact) for n, c in zip(their, lists)}
        ends = np.cumsum(counts)
        parts, at = [], 0
        while at < len(counts) or not parts:
            start = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + PAIRS, "right")))
            stop = int(ends[min(to, len(counts)) - 1]) if len(counts) else 0
            with np.errstate(all="ignore"):
                parts.append(folds(Pairs({n: v[at:to] for n, v in mine.items()}, {n: v[start:stop] for n, v in theirs.items()}, counts[at:to])))
            at = to
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate([p[k] for p in parts]), type=types[v], from_pandas=True) for k, v in kinds.items()], list(kinds))

    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return run
