"""Reading again inside the walk: frames are looked up once, and carried columns travel once per frame."""

import numpy as np

from framefusion.operators import tracking as tr
from framefusion.operators.recheck import Recheck
from framefusion.streaming.tracker import LOCK, LOCKED, STATES


class Sevens:
    def predict_many(self, crops):
        return [[("7", 0.9)] for _ in crops]


def test_a_frame_is_looked_up_once_for_all_its_windows():
    locks = np.zeros(3, LOCK)
    locks["state"], locks["held"] = STATES.index(LOCKED), [True, False, True]
    locks["box"], locks["score"] = [20.0, 40.0, 64.0, 62.0], 0.8
    asked = []

    def frames(owners):
        asked.append(owners.tolist())
        return [{"image_id": 100 + int(i)} for i in owners]

    crops = []
    recheck = Recheck(Sevens, lambda row: crops.append(row) or row, min_conf=0.5)
    made = recheck.read(Sevens(), locks, np.full((3, 2), [200, 100]), frames)
    assert asked == [[0, 2]]
    assert {c["image_id"] for c in crops} == {100, 102} and len(crops) > 2 and len(made) == len(crops)
    assert [r[0] for r in made] == sorted(r[0] for r in made)
    first = made[0]
    assert first[2:7] == ("7", 20.0, 40.0, 64.0, 62.0) and first[10:12] == (1.0, 0.0)


def test_carried_columns_stand_on_the_marker_alone(spark):
    frames = spark.createDataFrame([(1, 9, 1, 200, 100, "pixels")],
                                   "image_id int, sequence_id int, frame_index int, image_width int, image_height int, carried string")
    seen = spark.createDataFrame([(1, i, 1.0, 1.0, 9.0, 9.0, 0.9, 0) for i in range(4)],
                                 "image_id int, detection_index int, x1 double, y1 double, x2 double, y2 double, conf double, class_id int")
    read = spark.createDataFrame([(1, 1, "5", 1.0, 1.0, 9.0, 9.0, 0.9)],
                                 "image_id int, candidate_index int, text string, x1 double, y1 double, x2 double, y2 double, ocr_conf double")
    rows = tr.observations(frames, seen, read).orderBy("obs_order").collect()
    assert len(rows) == 6 and {(r.sequence_id, r.frame_index, r.image_width) for r in rows} == {(9, 1, 200)}
    assert [r.carried for r in rows] == ["pixels"] + [None] * 5


def test_history_recheck_stores_its_locks(spark, folder):
    from framefusion.plans.temporal import history_recheck
    plan = history_recheck(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "before_x1" in plan and "before_state" not in plan
