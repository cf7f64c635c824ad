"""The route for hot keys gives the same rows as the ordinary one; a frame holding a third of all rows still finishes."""

from pyspark.sql import functions as F

from framefusion.operators import evidence as ev
from framefusion.operators import features as ft
from framefusion.operators import groups as gr
from framefusion.operators import learn
from framefusion.operators import rules
from framefusion.operators import slots as sl
from framefusion.plans import fixtures as fx
from framefusion.plans.registry import rounded


def rows(df, *names):
    df = rounded(df.select(*names)) if names else rounded(df)
    return sorted(map(str, df.collect()))


def test_ranks(spark, folder):
    assert rows(fx.candidates(spark, folder)) == rows(fx.candidates(spark, folder, limit=3))
    assert rows(fx.frames(spark, folder)) == rows(fx.frames(spark, folder, limit=4))


def test_detection_features_by_tiles(spark, folder):
    c, d = fx.candidates(spark, folder), fx.detections(spark, folder)
    assert rows(ev.detection_features(c, d)) == rows(ev.detection_features(c, d, limit=2))


def test_rule_score_by_tiles(spark, folder):
    c, d = fx.candidates(spark, folder), fx.detections(spark, folder)
    names = ["image_id", "candidate_index", "rule_score", "aligned_detection", "snap_x1"]
    assert rows(rules.rule_score(c, d), *names) == rows(rules.rule_score(c, d, limit=3), *names)


def test_pool_by_pieces(spark, folder):
    c = fx.candidates(spark, folder)
    assert rows(ft.pool_features(c)) == rows(ft.pool_features(c, limit=3))


def test_groups_by_cells(spark, folder):
    from framefusion.plans.grouping import NUMBERS, feature_rows
    r = feature_rows(spark, folder)
    names = [*gr.KEYS, "source", "representative_index", *NUMBERS]
    assert rows(gr.value_groups(r, "base_score"), *names) == rows(gr.value_groups(r, "base_score", limit=1), *names)


def test_list_penalty_by_tiles(spark, folder):
    from framefusion.plans.temporal import _sizes, slotted
    scored = sl.slot_metrics(slotted(spark, folder), _sizes(spark, folder))
    names = ["sequence_id", "slot", "score", "vertical_neighbor"]
    assert rows(sl.list_penalty(scored), *names) == rows(sl.list_penalty(scored, limit=2), *names)


def test_one_frame_with_a_third_of_all_rows(spark, folder):
    hot = lambda df: df.withColumn("image_id", F.when(F.col("image_id") % 3 == 0, F.lit(1)).otherwise(F.col("image_id")))
    c = hot(fx.candidates(spark, folder)).withColumn("candidate_index", F.row_number().over(
        __import__("pyspark").sql.Window.partitionBy("image_id").orderBy("x1", "y1", "x2", "y2", "text", "source", "ocr_conf")))
    d = hot(fx.detections(spark, folder)).withColumn("detection_index", F.row_number().over(
        __import__("pyspark").sql.Window.partitionBy("image_id").orderBy("class_id", "conf", "x1", "y1", "x2", "y2")))
    out = rules.rule_score(c, d)
    assert out.where("image_id = 1").count() > 1000
    features = ev.detection_features(c, d).where("image_id = 1")
    total = d.where("image_id = 1 AND class_id = 0").count()
    assert features.agg(F.min("yolo_ch0_count"), F.max("yolo_ch0_count")).collect()[0] == (float(total), float(total))


def test_order_statistics_match_a_sort(spark, folder):
    df = fx.candidates(spark, folder)
    values = sorted(r[0] for r in df.select("ocr_conf").collect())
    n = len(values)
    spots = [0, 7, n // 3, n // 2, n - 1]
    assert learn.order_statistics(df, "ocr_conf", lambda m: spots) == [values[i] for i in spots]
