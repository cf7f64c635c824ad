"""Slots measured as blocks of arrays against the same measures as aggregates."""

import random

from framefusion.operators import slots as sl

KIND = ("sequence_id int, slot int, frame_index int, candidate_index int, kind string, value string, x1 double, y1 double, x2 double, y2 double, "
        "cx double, cy double, h double, image_width int, image_height int")


def rows_of(seed, sequences):
    pick = random.Random(seed)
    kinds = ("channelnum", "text", "time", "date", "othernum", None)
    maybe = lambda v: None if pick.random() < 0.1 else v
    for _ in range(600):
        x, y = pick.randrange(40), pick.randrange(40)
        yield (maybe(pick.randrange(sequences)), pick.randrange(3), maybe(pick.randrange(6)), pick.randrange(4), pick.choice(kinds),
               pick.choice(("", "7", "12", None)), float(x), maybe(float(y)), x + 9.0, y + 5.5, maybe(x / 100), y / 100,
               pick.choice((0.0, 0.25, None)), 100, pick.choice((100, 120)))


def plain(rows):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else repr(v) if v is None else str(v) for v in r) for r in rows)


def test_blocks_equal_aggregates(spark):
    for seed, sequences in ((1, 4), (2, 150)):
        rows = spark.createDataFrame(list(rows_of(seed, sequences)), KIND).repartition(3)
        group = ["sequence_id", "slot"]
        blocks = sl._slot_stats(rows, group)
        names = [c for c in blocks.columns if c != "first_seen"] + ["first_seen.candidate_index"]
        assert plain(blocks.select(*names).collect()) == plain(sl._crowded_slot_stats(rows, group).select(*names).collect())


def test_crowded_slots_take_the_other_route_with_the_same_rows(spark):
    rows = spark.createDataFrame(list(rows_of(3, 5)), KIND)
    frames = spark.createDataFrame([(i, 6) for i in range(5)], "sequence_id int, n_frames int")
    some = sl.slot_metrics(rows, frames).drop("first_seen")
    assert plain(some.collect()) == plain(sl.slot_metrics(rows, frames, limit=45).drop("first_seen").select(*some.columns).collect())


def test_dual_slots_classify_the_readings_once(spark, folder):
    from framefusion.plans.temporal import dual_slots
    plan = dual_slots(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "percentile" not in plan
