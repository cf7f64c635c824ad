"""Structured Streaming forms of the sequence operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framefusion.streaming.tracker import LOCK, STATE_TYPES, TRACK, SequenceState, TrackerSettings, seen_array, state_row

OBSERVATION = "struct<box:array<double>,conf:double,class_id:int,detector:boolean>"
_KINDS = {"i8": "bigint", "b1": "boolean", "f8": "double"}


def use_typed_state(spark: SparkSession) -> None:
    """Choose the state store that typed state and timers need; before the first stream of a session starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fresh_frames(frames: DataFrame, event_time: str, delay: str = "10 minutes") -> DataFrame:
    """Drop repeated deliveries of a frame within the watermark."""
    return frames.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["sequence_id", "frame_index"])


def _types(kind: np.dtype, without: tuple[str, ...] = ()) -> str:
    """The columns of a row of state: boxes are arrays."""
    fields = [(name, kind[name]) for name in kind.names if name not in without]
    return ", ".join(f"{name} {'array<double>' if t.shape else _KINDS[t.str[1:]]}" for name, t in fields)


def _plain(row: np.void, names: list[str]) -> tuple:
    return tuple(row[name].tolist() for name in names)


class FrameOrder(StatefulProcessor):
    """Advances each sequence frame by frame, whatever the order of arrival.

    Typed state of a sequence: `place` (the frame that is next, the lock), `tracks` (a list), `waiting` (a map from frame number to what
    the frame shows, for frames that came before one still missing). Timers of event time: once the watermark is `patience_ms` past the
    newest frame seen, missing frames are given up and the walk goes on with those that wait; once it is `idle_ms` past it, the sequence
    is over and its state goes.
    """

    TRACK_NAMES = [name for name in TRACK.names if name != "owner"]

    def __init__(self, settings: TrackerSettings, event_time: str, patience_ms: int, idle_ms: int, columns: list[str]):
        self.settings, self.event_time, self.patience, self.idle, self.columns = settings, event_time, patience_ms, idle_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", f"next int, newest bigint, {_types(LOCK)}")
        self.tracks = handle.getListState("tracks", _types(TRACK, ("owner",)))
        self.waiting = handle.getMapState("waiting", "frame_index int", f"width int, height int, observations array<{OBSERVATION}>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.place.get() if self.place.exists() else None
        expected, newest = (held[0], held[1]) if held else (1, 0)
        for batch in rows:
            for r in batch.itertuples(index=False):
                newest = max(newest, int(getattr(r, self.event_time).timestamp() * 1000))
                number = int(r.frame_index)
                if number >= expected:
                    seen = [([float(v) for v in o["box"]], float(o["conf"]), int(o["class_id"]), bool(o["detector"]))
                            for o in (r.observations if r.observations is not None else [])]
                    self.waiting.updateValue((number,), (int(r.image_width), int(r.image_height), seen))
        yield from self._go_on(key, held, expected, newest)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.place.exists():
            return
        held = self.place.get()
        watermark = timerValues.getCurrentWatermarkInMs()
        if watermark >= held[1] + self.patience:
            while self.waiting.exists() and (numbers := sorted(k[0] for k in self.waiting.keys())):
                yield from self._go_on(key, held, numbers[0], held[1])
                held = self.place.get()
        if watermark >= held[1] + self.idle:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.place.clear()
            self.tracks.clear()
            self.waiting.clear()

    def _go_on(self, key: tuple, held: tuple | None, expected: int, newest: int) -> Iterator[pd.DataFrame]:
        """Advance from frame `expected` on as far as frames follow each other; keep the rest."""
        lock = np.zeros(1, LOCK)
        tracks = np.zeros(0, TRACK)
        if held:
            for name, value in zip(LOCK.names, held[2:]):
                lock[name] = value
            rows = list(self.tracks.get()) if self.tracks.exists() else []
            tracks = np.zeros(len(rows), TRACK)
            for name, column in zip(self.TRACK_NAMES, zip(*rows)):
                tracks[name] = list(column)
        state, out = SequenceState(self.settings, lock, tracks), []
        while self.waiting.containsKey((expected,)):
            width, height, seen = self.waiting.getValue((expected,))
            self.waiting.removeKey((expected,))
            state.advance(expected, width, height, seen_array(*[list(c) for c in zip(*seen)] or [[]] * 4))
            out.append((key[0], expected, *state_row(state.all.locks[0])))
            expected += 1
        self.tracks.put([_plain(t, self.TRACK_NAMES) for t in state.all.tracks]) if len(state.all.tracks) else self.tracks.clear()
        self.place.update((expected, newest, *_plain(state.all.locks[0], list(LOCK.names))))
        for timer in {newest + self.patience, newest + self.idle}:
            self.handle.registerTimer(timer)
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def track_stream(frames: DataFrame, event_time: str, settings: TrackerSettings = TrackerSettings(), key_type: str = "bigint",
                 delay: str = "10 minutes", patience_ms: int = 60_000, idle_ms: int = 3_600_000) -> DataFrame:
    """Lock state per frame over a stream of frames (sequence_id, frame_index, image_width, image_height, observations, an event time).

    Frames of a sequence may come in any order and split over micro-batches: a frame waits until all before it came, or until the
    watermark (`delay` behind the newest event) is `patience_ms` past the newest frame of the sequence. A repeated frame and one that comes after
    its place was given up are dropped. State goes when the watermark is `idle_ms` past the newest frame. Needs `use_typed_state`.
    """
    columns = ["sequence_id", "frame_index", *[c.split()[0] for c in STATE_TYPES.split(", ")]]
    marked = frames.withWatermark(event_time, delay)
    return marked.groupBy("sequence_id").transformWithStateInPandas(
        FrameOrder(settings, event_time, patience_ms, idle_ms, columns),
        f"sequence_id {key_type}, frame_index int, {STATE_TYPES}", "append", "EventTime")


def warmup_stream(frames: DataFrame, warmup: int, pos_thr: float = 0.04, key_type: str = "bigint") -> DataFrame:
    """Streaming warm-up lock: the region is the mean place of channel-like readings of the busiest cluster in the first
    `warmup` frames; later frames are read at that place in constant time. Frames carry `readings`
    (cx, cy, h, conf, value) and come in order per sequence."""
    from framefusion.operators.slots import WarmupReader

    def run(key: tuple, batches: Iterator[pd.DataFrame], store: GroupState) -> Iterator[pd.DataFrame]:
        reader = WarmupReader.load(store.get[0]) if store.exists else WarmupReader(warmup, pos_thr)
        out = []
        for batch in batches:
            for r in batch.sort_values("frame_index").itertuples(index=False):
                readings = [(float(x["cx"]), float(x["cy"]), float(x["h"]), float(x["conf"]), str(x["value"]))
                            for x in (r.readings if r.readings is not None else [])]
                out += [(key[0], *row) for row in reader.frame(int(r.frame_index), readings)]
        store.update((reader.dump(),))
        if out:
            yield pd.DataFrame(out, columns=["sequence_id", "frame_index", "value", "conf"])

    return frames.groupBy("sequence_id").applyInPandasWithState(
        run, f"sequence_id {key_type}, frame_index int, value string, conf double", "reader string", "append",
        GroupStateTimeout.NoTimeout)


def frames_with_observations(observations: DataFrame) -> DataFrame:
    """One row per frame with its observations in order, from rows of (sequence_id, frame_index, obs_order, …)."""
    item = F.struct("obs_order", F.array("x1", "y1", "x2", "y2").alias("box"), F.col("conf").alias("conf"), F.col("class_id").alias("class_id"),
                    F.col("detector").alias("detector"))
    real = F.when(F.col("obs_order") >= 0, item)
    return observations.groupBy("sequence_id", "frame_index").agg(
        F.max("image_width").alias("image_width"), F.max("image_height").alias("image_height"),
        F.transform(F.array_sort(F.collect_list(real)), lambda o: F.struct(o["box"].alias("box"), o["conf"].alias("conf"),
                                                                           o["class_id"].alias("class_id"), o["detector"].alias("detector"))).alias("observations"))
