"""Measures of many slots at once, on arrays sorted by slot, frame and reading."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class SlotBlock:
    """`table`: the rows of whole slots; `begin`: where each slot begins. Nulls take no part, as in an aggregate."""

    def __init__(self, table: pa.Table, begin: np.ndarray):
        self.table, self.begin, self.n = table, begin, table.num_rows
        self.size = np.diff(np.append(begin, self.n))
        self.owner = np.repeat(np.arange(len(begin)), self.size)

    def _numbers(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """The values of a column that are not null, and their slots."""
        column = self.table[name].combine_chunks()
        if not column.null_count:
            return column.to_numpy(zero_copy_only=False), self.owner
        known = ~column.is_null().to_numpy(zero_copy_only=False)
        return column.drop_null().to_numpy(zero_copy_only=False), self.owner[known]

    def _count(self, owner: np.ndarray) -> np.ndarray:
        return np.bincount(owner, minlength=len(self.begin))

    def _distinct(self, name: str) -> np.ndarray:
        """Distinct values of each slot, nulls left out."""
        column = self.table[name].combine_chunks().dictionary_encode()
        known = ~column.is_null().to_numpy(zero_copy_only=False)
        codes = column.indices.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = np.unique(self.owner[known] * np.int64(max(1, len(column.dictionary))) + codes)
        return self._count(pairs // max(1, len(column.dictionary)))

    def _share(self, name: str) -> np.ndarray:
        known = self.table["_known"].to_numpy()
        hits = np.bincount(self.owner, self.table[name].to_numpy().astype(np.float64), len(self.begin))
        return _over(hits, np.bincount(self.owner, known.astype(np.float64), len(self.begin)))

    def _mean(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Mean and spread."""
        values, owner = self._numbers(name)
        count = self._count(owner)
        mean = _over(np.bincount(owner, values, len(count)), count)
        away = values - mean[owner]
        return mean, np.sqrt(_over(np.bincount(owner, away * away, len(count)), count))

    def _median(self, name: str) -> np.ndarray:
        """The middle value, or the middle of the two; NaN counts as the greatest value."""
        values, owner = self._numbers(name)
        values = values[np.lexsort((values, owner))]
        count = self._count(owner)
        ends = np.cumsum(count)
        low, high = ends - count + np.maximum(0, count - 1) // 2, ends - count + count // 2
        some = count > 0
        a, b = values[low[some]], values[high[some]]
        out = np.full(len(count), np.nan)
        out[some] = np.where(a == b, a, a * 0.5 + b * 0.5)
        return pa.array(out, mask=~some)

    def greatest(self, name: str) -> pa.Array:
        values, owner = self._numbers(name)
        count = self._count(owner)
        some, out = count > 0, np.zeros(len(count), values.dtype)
        if some.any():
            out[some] = np.maximum.reduceat(values, (np.cumsum(count) - count)[some])
        return pa.array(out, mask=~some)

    def stats(self) -> dict[str, pa.Array]:
        (_, dx), (_, dy), (mean, spread) = (self._mean(n) for n in ("cx", "cy", "h"))
        with np.errstate(all="ignore"):
            ratio = spread / mean
        # Without a height, or with a mean of zero, the spread of heights is zero.
        flat = np.where((mean == 0) | (self._count(self._numbers("h")[1]) == 0), 0.0, ratio)
        placed = (self._count(self._numbers("cx")[1]) > 0) & (self._count(self._numbers("cy")[1]) > 0)
        known = np.bincount(self.owner, self.table["_known"].to_numpy().astype(np.float64), len(self.begin)) > 0
        shares = {n: pa.array(self._share(c), mask=~known) for n, c in (("chan_ratio", "_channel"), ("text_ratio", "_text"), ("time_ratio", "_time"))}
        return {"present": pa.array(self._distinct("frame_index"), pa.int64()), "distinct": pa.array(self._distinct("_value"), pa.int64()), **shares,
                **{f"m_{n}": self._median(n) for n in ("x1", "y1", "x2", "y2")}, "pos_std": pa.array(dx + dy, mask=~placed), "h_cv": pa.array(flat)}


def _over(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.divide(total, count, out=np.zeros(len(total)), where=count > 0)
