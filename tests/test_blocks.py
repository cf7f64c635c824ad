"""Folds over blocks of pairs give the rows of the expressions, also for odd rows; both are evaluated once per row."""

import random

import pytest
from pyspark.sql import functions as F

from framefusion.operators import blocks
from framefusion.operators import evidence as ev
from framefusion.operators import rules
from framefusion.plans import fixtures as fx
from framefusion.plans.registry import r6, rounded

READING = ("image_id long, candidate_index int, text string, source string, x1 double, y1 double, x2 double, y2 double, ocr_conf double, "
           "image_width int, image_height int")
BOX = "image_id long, detection_index int, class_id int, x1 double, y1 double, x2 double, y2 double, conf double, image_width int, image_height int"


def odd_tables(spark):
    rng = random.Random(5)
    number = lambda: rng.choice([None, float("nan"), float("inf"), 1e200]) if rng.random() < 0.02 else float(rng.randint(0, 8) * 10)
    box = lambda: [number(), number(), *[v and v + 25.0 for v in (number(), number())]]
    texts = ["12", "123", "0123", "1234", "CH 12", "News", "12:30", "", None, "1" * 17, "1" * 18, "1" * 19, "2" + "1" * 18, "12 34"]
    sources = ["original_ocr", "paddleocr_channel_recheck", "digit_sequence_trim", "", None]
    left = [(i % 60, i // 60, rng.choice(texts), rng.choice(sources), *box(), rng.choice([None, 0.3, 0.7]), 100, 100) for i in range(480)]
    right = [(i % 50, rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1, 2, 3, 7]), *box(), rng.choice([None, 0.2, 0.9]), 100, 100) for i in range(300)]
    return spark.createDataFrame(left, READING), spark.createDataFrame(right, BOX)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("pairs", [7, 1 << 18])
def test_numbers_equal_expressions(spark, monkeypatch, pairs):
    monkeypatch.setattr(blocks, "PAIRS", pairs)
    cands, boxes = odd_tables(spark)
    names = [f for f in ev.AGREEMENT + ev.DETECTOR]
    ask = lambda: (rows(ev.rule_evidence(cands, boxes).select("image_id", "candidate_index", *names)),
                   rows(ev.rule_evidence(cands, None, ev.AGREEMENT).select("image_id", "candidate_index", *ev.AGREEMENT)),
                   rows(ev.detection_features(cands, boxes)))
    by_blocks = ask()
    monkeypatch.setattr(ev, "_rule_block", lambda names: None)
    monkeypatch.setattr(ev, "_detection_block", lambda: None)
    assert by_blocks == ask()


def test_pairs_are_folded_in_blocks_and_once(spark, folder, capsys):
    cands, boxes = fx.candidates(spark, folder), fx.detections(spark, folder)
    for df in (rules.rule_score(cands, boxes, suppress_hallucinations=True), ev.detection_features(cands, boxes)):
        df.explain()
        assert capsys.readouterr().out.count("ArrowEvalPython [") == 1


def test_rounding_is_that_of_decimals(spark):
    values = [(v,) for v in (0.1234565, -0.1234565, 1e-7, -1e-7, 2.5, 123456.7890125, 1e12 + 0.125, 3e15, float("nan"), float("inf"), None, -0.0)]
    rng = random.Random(1)
    df = spark.createDataFrame(values + [(rng.uniform(-10, 10) ** 5,) for _ in range(5_000)], "v double")
    plain = df.select((F.round(F.col("v") + F.lit(1.234567e-9), 6) + F.lit(0.0)).alias("v"))
    assert rows(df.select(r6("v").alias("v"))) == rows(plain)
    many = [f"v{i}" for i in range(9)]
    assert rows(rounded(df.select(*[F.col("v").alias(n) for n in many]))) == rows(plain.select(*[F.col("v").alias(n) for n in many]))
