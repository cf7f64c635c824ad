"""The tracking stream: frames late, repeated, missing and out of order, against the batch walk; and what becomes of its state."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from framefusion.operators import tracking as tr
from framefusion.plans import fixtures as fx
from framefusion.streaming.processors import frames_with_observations, fresh_frames, track_stream, use_typed_state

KIND = ("sequence_id bigint, frame_index int, image_width int, image_height int, "
        "observations array<struct<box:array<double>,conf:double,class_id:int,detector:boolean>>, at timestamp")
BOX = [([20.0, 40.0, 64.0, 62.0], 0.9, 0, True)]


@pytest.fixture(autouse=True)
def typed(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    use_typed_state(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def deliver(spark, batches, build, name, checkpoint=None):
    """Each batch is one micro-batch; the rows that came out, and the query's last number of rows of state."""
    work = tempfile.mkdtemp(prefix="spark-")
    source = os.path.join(work, "in")
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", os.path.join(work, "cp")).start()
    try:
        query.processAllAvailable()
        state = query.lastProgress["stateOperators"][0]
    finally:
        query.stop()
    return spark.table(name).collect(), state


def frame(sequence, index, second, seen=BOX, kind=KIND):
    return (sequence, index, 200, 100, seen, second)


def batch(spark, rows):
    return spark.createDataFrame([(*r[:5], float(r[5])) for r in rows], KIND.replace("at timestamp", "at double")).withColumn(
        "at", F.timestamp_seconds("at"))


def test_batch_equals_stream_in_any_order(spark, folder):
    frames = fx.frames(spark, folder).select("image_id", "sequence_id", "frame_index", "image_width", "image_height")
    obs = tr.observations(frames, fx.detections(spark, folder), fx.candidates(spark, folder))
    names = ["sequence_id", "frame_index", "state", "lock_x1", "lock_age", "reason"]
    want = tr.slot_state(obs).select(*names).collect()
    rows = frames_with_observations(obs).withColumn("at", F.timestamp_seconds(1000 + F.col("frame_index")))
    # Later frames are delivered before earlier ones, and some frames twice.
    parts = [rows.where(F.col("frame_index") % 3 == p) for p in (2, 0, 1)] + [rows.where(F.col("frame_index") % 2 == 0)]
    got, state = deliver(spark, parts, lambda s: track_stream(s, "at"), "any_order")
    assert sorted(str([r[n] for n in names]) for r in got) == sorted(str([r[n] for n in names]) for r in want)


def test_missing_late_and_repeated_frames(spark):
    """Frame 3 never comes in time: the walk goes on after the watermark is past the patience, and a late frame 3 changes nothing."""
    batches = [
        batch(spark, [frame(1, 1, 100), frame(1, 2, 101), frame(1, 4, 103), frame(1, 2, 101)]),
        batch(spark, [frame(1, 5, 104), frame(2, 1, 150)]),
        batch(spark, [frame(2, 2, 300)]),
        batch(spark, [frame(1, 3, 299), frame(1, 6, 301)]),
        batch(spark, [frame(2, 3, 302)]),
    ]
    got, _ = deliver(spark, batches, lambda s: track_stream(s, "at", delay="1 second", patience_ms=10_000, idle_ms=10_000_000), "missing")
    assert [r.frame_index for r in sorted(got, key=lambda r: r.frame_index) if r.sequence_id == 1] == [1, 2, 4, 5, 6]
    kind = "image_id long, sequence_id long, frame_index int, image_width int, image_height int"
    frames = spark.createDataFrame([(i, 1, i, 200, 100) for i in (1, 2, 4, 5, 6)], kind)
    boxes = spark.createDataFrame([(i, 0, 0, *BOX[0][0], 0.9) for i in (1, 2, 4, 5, 6)],
                                  "image_id long, detection_index int, class_id int, x1 double, y1 double, x2 double, y2 double, conf double")
    none = spark.createDataFrame([], "image_id long, candidate_index int, text string, x1 double, y1 double, x2 double, y2 double, ocr_conf double")
    want = tr.slot_state(tr.observations(frames, boxes, none)).collect()
    names = ["frame_index", "state", "lock_x1", "lock_age", "history_score", "reason"]
    assert sorted([r[n] for n in names] for r in want) == sorted([r[n] for n in names] for r in got if r.sequence_id == 1)


def test_state_goes_after_idle_time(spark):
    batches = [
        batch(spark, [frame(k, i, 100 + i) for k in range(20) for i in (1, 2)]),
        batch(spark, [frame(99, 1, 5_000)]),
        batch(spark, [frame(99, 2, 5_001)]),
        batch(spark, [frame(3, 1, 5_002)]),
    ]
    got, state = deliver(spark, batches, lambda s: track_stream(s, "at", delay="1 second", patience_ms=1_000, idle_ms=100_000), "idle")
    # Sequence 3 begins anew; nothing is left of the other nineteen.
    assert sorted((r.frame_index, r.lock_age) for r in got if r.sequence_id == 3) == [(1, 0), (1, 0), (2, 0)]
    kept, _ = deliver(spark, batches, lambda s: track_stream(s, "at", delay="1 second", patience_ms=1_000, idle_ms=10_000_000), "kept")
    assert len([r for r in kept if r.sequence_id == 3]) == 2
    assert state["numRowsRemoved"] + state["numRowsTotal"] >= 0 and state["numRowsTotal"] < 20


def test_fresh_frames_drops_repeats_within_the_watermark(spark):
    rows = [(1, 1, 10.0), (1, 1, 11.0), (1, 2, 12.0), (2, 1, 10.0)]
    first = spark.createDataFrame(rows, "sequence_id long, frame_index int, at double").withColumn("at", F.timestamp_seconds("at"))
    again = first.where("frame_index = 1")
    got, _ = deliver(spark, [first, again], lambda s: fresh_frames(s, "at", "1 hour"), "fresh")
    assert sorted((r.sequence_id, r.frame_index) for r in got) == [(1, 1), (1, 2), (2, 1)]
