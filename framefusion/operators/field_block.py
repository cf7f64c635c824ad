"""The field of many keys at once, on arrays: slots, their scores, the primary slot, its duals and the value of every frame. The same as
`slots.find_field`, for keys whose rows a task can hold."""

from __future__ import annotations

from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from framefusion.operators.slot_block import SlotBlock

READ = ("frame_index", "candidate_index", "conf", "cx", "cy", "h", "x1", "y1", "x2", "y2", "image_width", "image_height")


def columns() -> list[Column]:
    """What a block reads, out of readings."""
    is_ = lambda *some: F.coalesce(F.col("kind").isin(*some), F.lit(False))
    value = F.when(is_("channelnum") & (F.col("value") != ""), F.col("value"))
    return [F.col("kind").isNotNull().alias("_known"), is_("channelnum").alias("_channel"), is_("text").alias("_text"),
            is_("time", "date").alias("_time"), value.alias("_value"), *[F.col(n) for n in READ]]


def _numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Places in sorted arrays where a new key begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class FieldBlock:
    """`table`: the columns of `columns()`, rows of whole keys in order of frame and reading; `begin`: where each key begins; `n_frames`: the
    frames of each key; `rule`: makes the choice of places of a key."""

    def __init__(self, table: pa.Table, begin: np.ndarray, n_frames: np.ndarray, rule: Callable[[], Callable[..., int]]):
        ends = np.append(begin[1:], table.num_rows)
        owner = np.repeat(np.arange(len(begin)), ends - begin)
        slot = self._slots(table, begin, ends, rule)
        # Slots one after the other, each in order of frame and reading.
        self.row = np.lexsort((slot, owner))
        rows = table.take(pa.array(self.row)).combine_chunks()
        owner, slot = owner[self.row], slot[self.row]
        start = firsts(owner, slot)
        self.frame, self.first_reading = _numbers(rows["frame_index"]), _numbers(rows["candidate_index"])
        self.key, self.slot = owner[start], slot[start]
        self.at = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(slot))))
        self._measure(SlotBlock(rows, start), n_frames[self.key])
        self._penalise()
        self.primary = self._primary(start, len(begin))
        self._values(rows)

    @staticmethod
    def _slots(table: pa.Table, begin: np.ndarray, ends: np.ndarray, rule: Callable[[], Callable[..., int]]) -> np.ndarray:
        data = [_numbers(table[c]).tolist() for c in ("cx", "cy", "h")]
        numbers: list[int] = []
        for a, b in zip(begin.tolist(), ends.tolist()):
            numbers.extend(map(rule(), *[d[a:b] for d in data]))
        return np.array(numbers, np.int64)

    def _measure(self, block: SlotBlock, n_frames: np.ndarray) -> None:
        """The score of `slots.slot_metrics`. NaN is greater than any number; a null fails every test."""
        stats = block.stats()
        null = {k: _numbers(v.is_null()) for k, v in stats.items()}
        s = {k: _numbers(v) for k, v in stats.items()}
        width, height = (block.greatest(n) for n in ("image_width", "image_height"))
        no_screen = _numbers(width.is_null()) | _numbers(height.is_null())
        width, height = _numbers(width).astype(np.float64), _numbers(height).astype(np.float64)
        over = lambda v, limit, unknown: ~(v <= limit) & ~unknown
        when = lambda test, factor: np.where(test, factor, 1.0)
        with np.errstate(all="ignore"):
            w = np.where(null["m_x1"] | null["m_x2"], 1.0, np.maximum(1.0, s["m_x2"] - s["m_x1"]))
            h = np.where(null["m_y1"] | null["m_y2"], 1.0, np.maximum(1.0, s["m_y2"] - s["m_y1"]))
            aspect, area = w / h, w * h / (width * height)
            other = over(s["time_ratio"], 0.4, null["time_ratio"]) | over(s["text_ratio"], 0.5, null["text_ratio"])
            score = (s["chan_ratio"] * (s["present"] / np.maximum(1, n_frames)) * np.where(s["distinct"] >= 2, 1.0 + s["distinct"] * 0.15, 0.1)
                     * when(other, 0.0) * when(~((aspect >= 0.25) & (aspect <= 6.0)), 0.15) * when(over(area, 0.06, no_screen), 0.15)
                     * when(over(s["pos_std"], 0.03, null["pos_std"]), 0.5) * when(over(s["h_cv"], 0.35, null["h_cv"]), 0.6))
            self.score = np.rint(1000 * score) / 1000
            self.cx, self.cy = (s["m_x1"] + s["m_x2"]) / 2 / width, (s["m_y1"] + s["m_y2"]) / 2 / height
        self.height = h

    def _penalise(self) -> None:
        """The step of `slots.list_penalty`: every slot meets those after it in its key."""
        n, listed = len(self.key), np.zeros(len(self.key), bool)
        at = np.arange(n)
        apart = 0
        while True:
            apart += 1
            at = at[at + apart < n]
            at = at[self.key[at] == self.key[at + apart]]
            if not len(at):
                break
            to = at + apart
            with np.errstate(all="ignore"):
                dx, dy, dh = np.abs(self.cx[at] - self.cx[to]), np.abs(self.cy[at] - self.cy[to]), np.abs(self.height[at] - self.height[to])
                near = (dx < 0.03) & (dy > 0.02) & (dy < 0.18)
                for one in (at, to):
                    listed[one[near & (dh / np.maximum(1.0, self.height[one]) < 0.3)]] = True
        self.score = np.where(listed, np.rint(1000 * (self.score * 0.6)) / 1000, self.score)

    def _primary(self, start: np.ndarray, n_keys: int) -> np.ndarray:
        """The best slot of every key with a positive score, the first seen of equals; -1 where there is none."""
        order = np.lexsort((self.first_reading[start], self.frame[start], -self.score, self.key))
        order = order[self.score[order] > 0]
        best = order[firsts(self.key[order])]
        out = np.full(n_keys, -1)
        out[self.key[best]] = best
        return out

    def _values(self, rows: pa.Table) -> None:
        """The value of every frame of a key: the primary's, else the most confident dual's."""
        value = rows["_value"].combine_chunks().dictionary_encode()
        read = np.flatnonzero(~_numbers(value.is_null()))
        code = _numbers(value.indices.take(pa.array(read))).astype(np.int64)
        at, frame, conf = self.at[read], self.frame[read], _numbers(rows["conf"])[read]
        order = np.lexsort((self.first_reading[read], -conf, ~np.isnan(conf), frame, at))
        order = order[firsts(at[order], frame[order])]
        read, code, at, frame, conf = read[order], code[order], at[order], frame[order], conf[order]
        key = self.key[at]
        lead = self.primary[key] == at
        # Frames of a key as one number, for the primary's value in the same frame.
        _, spot = np.unique(np.stack([key, frame]), axis=1, return_inverse=True)
        spot = spot.reshape(-1)
        own = np.full(spot.max(initial=-1) + 1, -1)
        own[spot[lead]] = code[lead]
        common = ~lead & (own[spot] >= 0)
        n = np.bincount(at[common], minlength=len(self.key))
        equal = np.bincount(at[common], own[spot[common]] == code[common], len(self.key))
        dual = (n >= 2) & (equal >= n) & (self.score > 0)
        keep = np.flatnonzero(lead | dual[at])
        order = keep[np.lexsort((self.slot[at[keep]], -conf[keep], ~np.isnan(conf[keep]), ~lead[keep], spot[keep]))]
        order = order[firsts(spot[order])]
        self.chosen, self.chosen_key, self.chosen_lead = self.row[read[order]], key[order], lead[order]

    def values(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of the table, their keys, whether the primary slot was read)."""
        return self.chosen, self.chosen_key, self.chosen_lead


def _records(columns: dict[str, pa.Array | pa.ChunkedArray]) -> pa.RecordBatch:
    arrays = [v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def window_values(table: pa.Table, begin: np.ndarray, n: int, rule: Callable[[], Callable[..., int]], out: Sequence[str]) -> pa.RecordBatch:
    """The value of the last frame of every window of `n` frames: rows of whole windows, `window` is the number of the last frame. A window
    without readings in that frame gives nothing and is left out."""
    frame, window = _numbers(table["frame_index"]), _numbers(table["window"])
    ends = np.append(begin[1:], table.num_rows)
    use = np.flatnonzero(frame[ends - 1] == window[begin])
    size = (ends - begin)[use]
    start = np.cumsum(size) - size
    rows = np.repeat(begin[use] - start, size) + np.arange(size.sum())
    own = window[begin[use]]
    at, key, lead = FieldBlock(table.take(pa.array(rows)).combine_chunks(), start, np.minimum(own, n), rule).values()
    last = frame[rows[at]] == own[key]
    found = table.take(pa.array(rows[at[last]]))
    origin = pa.array(np.where(lead[last], "primary", "dual"), pa.string())
    return _records({**{c: found[c] for c in out}, "origin": origin})


def locked_values(table: pa.Table, begin: np.ndarray, warmup: int, pos_thr: float, rule: Callable[[], Callable[..., int]]) -> pa.RecordBatch:
    """The rows of `slots.warmup_lock` for whole sequences: what the primary slot of the first frames reads (of all frames, where that finds
    none), as rank 1, and the most confident channel value near its place in every frame, as rank 0."""
    ends = np.append(begin[1:], table.num_rows)
    owner = np.repeat(np.arange(len(begin)), ends - begin)
    frame, placed = _numbers(table["frame_index"]), _numbers(table["_placed"])
    frames = {early: _numbers(table[c])[begin] for early, c in ((True, "_early"), (False, "_frames"))}
    point, known, open_ = np.full((len(begin), 2), np.nan), [], np.ones(len(begin), bool)
    for early in (True, False):
        rows = np.flatnonzero(placed & open_[owner] & ((frame <= warmup) if early else True))
        if not len(rows):
            continue
        start = firsts(owner[rows])
        keys = owner[rows[start]]
        block = FieldBlock(table.take(pa.array(rows)).combine_chunks(), start, frames[early][keys], rule)
        found = block.primary >= 0
        point[keys[found]] = np.stack([block.cx, block.cy], axis=1)[block.primary[found]]
        at, _, lead = block.values()
        known.append(rows[at[lead]])
        open_[keys[found]] = False
    value = table["_value"].combine_chunks()
    read = ~_numbers(value.is_null())
    with np.errstate(all="ignore"):
        dx, dy = _numbers(table["cx"]) - point[owner, 0], _numbers(table["cy"]) - point[owner, 1]
        near = np.flatnonzero(read & (np.sqrt(dx * dx + dy * dy) <= pos_thr))
    image = _numbers(table["image_id"].combine_chunks().dictionary_encode().indices.fill_null(-1))
    conf = _numbers(table["conf"])
    order = near[np.lexsort((_numbers(table["candidate_index"])[near], -conf[near], ~np.isnan(conf[near]), image[near]))]
    near = order[firsts(image[order])]
    known = np.concatenate(known) if known else np.zeros(0, np.int64)
    found = table.take(pa.array(np.concatenate([known, near])))
    rank = pa.array(np.repeat([1, 0], [len(known), len(near)]), pa.int32())
    return _records({"image_id": found["image_id"], "value": found["_value"], "conf": found["conf"], "rank": rank})
