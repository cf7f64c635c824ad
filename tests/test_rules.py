"""Hand cases: grouping, gate, policies, evidence, hallucination, metrics, text rules."""

import pytest
from pyspark.sql import functions as F

from framefusion.functions.linear import linear_score
from framefusion.functions import text as tx
from framefusion.functions.linear import LinearModel
from framefusion.operators import box_sets as bs
from framefusion.operators import evidence as ev
from framefusion.operators import frames as fr
from framefusion.operators import groups as gr
from framefusion.operators import learn

CANDIDATE = ("image_id string, candidate_index int, text string, source string, x1 double, y1 double, x2 double, y2 double, ocr_conf double, "
             "image_width int, image_height int")
DETECTION = "image_id string, detection_index int, class_id int, x1 double, y1 double, x2 double, y2 double, conf double, image_width int, image_height int"


def group_rows(spark, items):
    """(text, source, score, box) of one 100 x 100 frame."""
    data = [("train", "f", "p", i, t, t, s, float(sc), *map(float, b), (b[0] + b[2]) / 200.0, (b[1] + b[3]) / 200.0,
             (b[2] - b[0]) * (b[3] - b[1]) / 1e4, ch, ch, near, 0.95) for i, (t, s, sc, b, ch, near) in enumerate(items, 1)]
    return spark.createDataFrame(data, "split string, image_id string, provider string, candidate_index int, candidate_digits string, text string, "
                                 "source string, base_score double, x1 double, y1 double, x2 double, y2 double, bbox_cx_norm double, bbox_cy_norm double, "
                                 "bbox_area_norm double, yolo_ch0_max_conf double, yolo_ch0_max_iou double, near_yolo_channel_evidence double, ocr_conf double")


def basic(spark):
    return group_rows(spark, [("041", "original_ocr", 2, (10, 10, 30, 30), 0.0, 0.0), ("041", "paddleocr_channel_recheck", 1, (11, 10, 31, 30), 0.0, 0.0),
                              ("41", "original_ocr", 3, (70, 70, 90, 90), 0.0, 0.0)])


def test_leading_zero_is_kept(spark):
    got = {r["candidate_digits"]: r for r in gr.value_groups(basic(spark), "base_score").collect()}
    assert set(got) == {"041", "41"}
    assert got["041"]["group_candidate_count"] == 2 and got["041"]["group_source_count"] == 2
    assert got["041"]["group_spatial_cluster_count"] == 2


def identity(name):
    return LinearModel([name], [0.0], [1.0], [1.0], 0.0)


def test_gate_margin_and_policies(spark):
    groups = gr.value_groups(group_rows(spark, [("041", "original_ocr", 2, (10, 10, 30, 30), 0.0, 0.0), ("99", "original_ocr", 1, (70, 70, 90, 90), 0.0, 0.0)]), "base_score")
    universe = spark.createDataFrame([("f",), ("empty",)], "image_id string")
    models = identity("group_base_score_max"), identity("top1_softmax_probability")
    out = {r["image_id"]: r for r in gr.value_group_gate(groups, universe, *models, 0.5).collect()}
    assert out["f"]["top1_top2_margin"] == 1.0 and out["f"]["top1_softmax_probability"] > 0.5
    assert out["f"]["final_prediction"] == "041" and out["f"]["output_confidence_status"] == "high"
    assert out["empty"]["reject_reason"] == "no_runtime_eligible_candidates"
    strict = gr.value_group_gate(groups, universe, *models, 2.0).where("image_id = 'f'").collect()[0]
    assert strict["final_prediction"] == "" and strict["reject_reason"] == "relative_confidence_gate"
    for policy in ("known_present", "positive_first"):
        r = gr.value_group_gate(groups, universe, *models, 2.0, policy).where("image_id = 'f'").collect()[0]
        assert r["final_prediction"] == "041" and r["output_confidence_status"] == "low" and r["gate_bypassed"]
    with pytest.raises(ValueError):
        gr.value_group_gate(groups, universe, *models, 2.0, "other")


def test_multi_position_rescue(spark):
    rows = group_rows(spark, [("041", "original_ocr", 3, (5, 10, 20, 20), 0.95, 1.0), ("041", "original_ocr", 2.5, (75, 10, 90, 20), 0.0, 0.0),
                              ("99", "original_ocr", 1, (40, 70, 50, 80), 0.0, 0.0)])
    universe = spark.createDataFrame([("f",)], "image_id string")
    out = gr.value_group_gate(gr.value_groups(rows, "base_score"), universe, identity("group_base_score_max"), identity("top1_softmax_probability"), 2.0, rescue=True)
    r = out.collect()[0]
    assert r["rescue_passed"] and r["final_prediction"] == "041"


def test_hallucination_needs_no_channel_box(spark):
    c = spark.createDataFrame([("f", 1, "20", "x", 10.0, 10.0, 150.0, 45.0, 0.61, 400, 200), ("f", 2, "NEWS", "original", 12.0, 10.0, 148.0, 45.0, 0.9, 400, 200)], CANDIDATE)
    text = [("f", 1, 2, 10.0, 10.0, 150.0, 45.0, 0.9, 400, 200)]
    d = spark.createDataFrame(text, DETECTION)
    assert "20" not in [r["text"] for r in ev.drop_text_hallucinations(c, d).collect()]
    d = spark.createDataFrame(text + [("f", 2, 0, 12.0, 10.0, 150.0, 45.0, 0.9, 400, 200)], DETECTION)
    assert "20" in [r["text"] for r in ev.drop_text_hallucinations(c, d).collect()]


def test_evidence_gate_reasons(spark):
    history = spark.createDataFrame([
        ("a", 1, "7", "h", 20.0, 40.0, 30.0, 60.0, 0.9, 200, 100, 0.9, 20.0, 0.1, 1, 0.5),
        ("b", 1, "7", "h", 20.0, 40.0, 120.0, 60.0, 0.9, 200, 100, 0.1, 3.0, 0.001, 5, 5.0)],
        CANDIDATE + ", visible_text_evidence_score double, crop_std double, edge_density double, digit_like_component_count int, crop_aspect_per_digit double")
    current = spark.createDataFrame([("b", 2, "NEWS", "o", 20.0, 40.0, 120.0, 60.0, 0.9, 200, 100)], CANDIDATE)
    d = spark.createDataFrame([("a", 1, 0, 20.0, 40.0, 30.0, 60.0, 0.9, 200, 100), ("b", 1, 2, 20.0, 40.0, 120.0, 60.0, 0.9, 200, 100)], DETECTION)
    got = {r["image_id"]: r["gate_reason"] for r in ev.evidence_gate(history, current, d).collect()}
    assert got == {"a": "accepted_supported", "b": "text_or_class2_conflict_without_channel_support"}


def test_detection_metrics_on_an_exact_box(spark):
    p = spark.createDataFrame([("a", 1, 0.0, 0.0, 10.0, 10.0, 0.9)], "image_id string, detection_index int, x1 double, y1 double, x2 double, y2 double, conf double")
    t = spark.createDataFrame([("a", 1, 0.0, 0.0, 10.0, 10.0)], "image_id string, truth_index int, x1 double, y1 double, x2 double, y2 double")
    r = bs.detection_metrics(p, t, spark.createDataFrame([("a",)], "image_id string")).collect()[0]
    assert (r["tp"], r["fp"], r["fn"], round(r["ap50"], 9), round(r["map50_95"], 9)) == (1, 0, 0, 1.0, 1.0)


def test_text_rules(spark):
    cases = [("041", "041", "41", "channelnum"), ("000", "000", "0", "channelnum"), ("CH 12", "12", "12", "channelnum"), ("12:30", "1230", "1230", "time"),
             ("3/12", "312", "312", "date"), ("News", "", "", "text"), ("a1b22c", "122", "122", "othernum")]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string").select("t", tx.digits(F.col("t")), tx.numeric_equiv(F.col("t")), tx.classify(F.col("t")))
    assert [tuple(r) for r in df.collect()] == cases
    pairs = [("705", "70", "len_short"), ("705", "7051", "len_long"), ("705", "765", "sub1"), ("705", "168", "subN"), ("705", "", "unread"), ("705", "705", "correct")]
    df = spark.createDataFrame(pairs, "a string, b string, w string").select("w", tx.misread_bucket(F.col("a"), F.col("b")))
    assert all(r[0] == r[1] for r in df.collect())
    assert tx.ema_settings(5) == {"alpha": 0.3333, "warmup": 5, "min_seen": 3}


def test_leakage_raises_in_forbidden_roles_only(spark):
    df = spark.createDataFrame([("train", "data/acme/x"), ("final_test", "data/acme/y"), ("train", "data/no_acme/z")], "role string, path string")
    got = [r["verdict"] for r in fr.leakage_scan(df, "acme", "path").collect()]
    assert got == ["violation", "warning", "clean"]
    with pytest.raises(ValueError):
        fr.assert_no_leakage(fr.leakage_scan(df, "acme", "path"))


def test_pairwise_model_ranks_the_positive_first(spark):
    rows = spark.createDataFrame([(i, j, int(j == 1), float(3 - j) + 0.01 * i, 0.5, 2.0) for i in range(40) for j in range(1, 4)],
                                 "image_id int, candidate_index int, label_train int, a double, ocr_conf double, candidate_digit_len double")
    assert learn.train_pairwise(rows, ["a"], 0.01).weights[0] > 0
    assert learn.train_pointwise(rows, ["a"], 0.01).weights[0] > 0


def test_rows_are_made_twice_for_any_number_of_providers(spark):
    """Once for all fits and once for the scores."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i, p, float(i % 4), i % 2) for i, p in enumerate("abc" * 8)],
                                 "image_id int, provider string, a double, label_train int")
    scored = learn.provider_oof(rows.mapInArrow(count, rows.schema), ["a"], 0.01).collect()
    assert made.value == 2 * 24 and all(r.oof_score is not None for r in scored)
    alone = learn.train_pointwise(rows.where("provider <> 'b'"), ["a"], 0.01)
    expected = {r.image_id: r.s for r in rows.select("image_id", linear_score(rows, alone).alias("s")).collect()}
    assert all(abs(r.oof_score - expected[r.image_id]) < 1e-6 for r in scored if r.provider == "b")
