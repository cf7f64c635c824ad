"""What the steps of sequence queries leave on disk."""

from framefusion.operators import generate as gen
from framefusion.operators import groups as gr
from framefusion.operators import tracking as tr
from framefusion.plans import fixtures as fx
from framefusion.plans import grouping, load


def test_run_sequences_stores_little(spark, folder, monkeypatch):
    """Two stored tables and no checkpoint: the walk without the lock after the frame, and the readings with their history."""
    def refuse(*_):
        raise AssertionError("rows are checkpointed")

    kept, store = [], tr.store_step
    monkeypatch.setattr(tr, "store_step", lambda df: kept.append(df) or store(df))
    monkeypatch.setattr(type(spark.range(0)), "checkpoint", refuse)
    out = load()["run_sequences"](spark, folder)
    assert len(kept) == 2 and "tracks" in kept[0].columns and "history_score" in kept[1].columns
    assert not {"state", "lock_x1"} & set(kept[0].columns) and {"before_state", "before_x1"} <= set(kept[0].columns)
    # The choice of a reading carries its number, digits and score, not its place, source or history.
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "snap_x1" not in plan.split("max_by(")[1].split(" AS _row")[0]
    assert out.count() == out.select("image_id").distinct().count() > 0
    names = set(out.columns)
    assert {"candidate_index", "digits", "rule_score", "lockable", "reject_reason"} <= names and "history_track" not in names


def test_search_regions_are_chosen_in_one_pass(spark, folder, monkeypatch):
    """The regions of two choices one after the other, for ordinary and for crowded frames."""
    def regions():
        frames, boxes, read = fx.frames(spark, folder), fx.detections(spark, folder), fx.candidates(spark, folder)
        return gen.search_regions(frames, boxes, read, slot_bands=True)

    once = regions()
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == plan.count("MapInArrow") == 1
    rows = sorted(map(tuple, once.collect()))
    monkeypatch.setattr(gen, "CROWD", 3)
    some = sorted(map(tuple, regions().collect()))
    monkeypatch.setattr(gen, "CROWD", 0)
    assert rows == some == sorted(map(tuple, regions().collect())) and rows
    assert once.columns == ["image_id", "image_width", "image_height", "stage", "arrival", "x1", "y1", "x2", "y2"]


def test_order_by_value_group_makes_its_rows_once(spark, folder, monkeypatch):
    """Groups and members read the stored feature rows."""
    kept, store = [], grouping.store_step
    monkeypatch.setattr(grouping, "store_step", lambda df: kept.append(df) or store(df))
    out = grouping.order_by_value_group(spark, folder)
    assert len(kept) == 1 and "lineitem" not in " ".join(out.inputFiles())
    rows = grouping.feature_rows(spark, folder)
    groups = grouping.scored_groups(spark, folder)
    want = gr.order_by_value_group(rows.select(*grouping.KEY, "candidate_digits", "base_score"), groups).select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
