"""Training rows, order statistics, threshold sweeps and linear models fitted with MLlib."""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framefusion.functions import text as tx
from framefusion.functions.linear import LinearModel, linear_score
from framefusion.operators.measures import evaluation_columns, ratio
from framefusion.operators.skew import running_total, top_rows
from framefusion.session import store_step

INF = float("inf")
# Fixed value: columns that describe a row and never become features.
METADATA_COLUMNS = (
    "split", "provider", "image_id", "image_path", "candidate_id", "candidate_index", "candidate_text",
    "candidate_digits", "numeric_candidate", "source", "raw_source", "bbox", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2",
    "gt_channel_number", "numeric_gt", "label_exact", "label_numeric_equiv", "label_train",
)
FORBIDDEN_FEATURES = ("image_id", "filename", "folder_name", "provider", "sequence_name", "gt_channel_number",
                      "numeric_gt", "label_exact", "label_numeric_equiv", "label_train")


def order_statistics(df: DataFrame, column: str, positions: Callable[[int], Sequence[int]], pieces: int = 256) -> list[float]:
    """Exact values at 0-based ranks, without sorting everything in one place.

    Equal values are counted first. Approximate quantiles cut the rest into even pieces; counts before each piece give
    the rank of every value, and only the values at the asked ranks (a bounded number) reach the driver.
    """
    values = df.groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v IS NOT NULL")
    head = df.where(F.col(column).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.approx_percentile(F.col(column).cast("double"), [i / pieces for i in range(1, pieces)], 10_000).alias("cuts"),
    ).collect()[0]
    if not head["n"]:
        return []
    wanted = [int(p) for p in positions(head["n"])]
    cuts = [-INF, *sorted(set(head["cuts"])), INF]
    piece = Bucketizer(splits=cuts, inputCol="v", outputCol="piece", handleInvalid="keep")
    ranked = running_total(piece.transform(values), [F.col("v")], [F.col("piece")], upto=F.col("n"))
    targets = F.array(*[F.lit(p).cast("long") for p in sorted(set(wanted))])
    hits = F.filter(targets, lambda t: (t < F.col("upto")) & (t >= F.col("upto") - F.col("n")))
    found = ranked.select("v", F.explode(hits).alias("rank")).collect()
    at = {r["rank"]: r["v"] for r in found}
    return [at[p] for p in wanted]


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Exact quantiles with linear interpolation between neighbours."""
    spots: list[tuple[int, int, float]] = []

    def positions(n: int) -> list[int]:
        for q in shares:
            at = (n - 1) * q
            low = int(at)
            spots.append((low, min(low + 1, n - 1), at - low))
        return [p for low, high, _ in spots for p in (low, high)]

    values = order_statistics(df, column, positions)
    return [values[2 * i] + (values[2 * i + 1] - values[2 * i]) * f for i, (_, _, f) in enumerate(spots)] if values else []


def threshold_grid(df: DataFrame, column: str, steps: int) -> list[float]:
    """Distinct quantiles of the finite scores, with both infinities."""
    finite = df.where((F.abs(column) != INF) & ~F.isnan(column))
    values = quantiles(finite, column, [i / (steps - 1) for i in range(steps)] if steps > 1 else [0.0])
    if not values:
        return [0.0]
    if values[0] == values[-1]:
        return [-INF, values[0], INF]
    return sorted({-INF, INF, *values})


def sweep_thresholds(selected: DataFrame, grid: Sequence[float]) -> DataFrame:
    """All evaluation fields at every threshold, from one pass: each row falls into the interval below its score, and
    the counts of the intervals (one row per threshold) are added up from the top."""
    grid = sorted(grid)
    score = tx.safe_float(F.col("score"))
    lits = F.array(*[F.lit(float(t)) for t in grid])
    rows = selected.withColumn("_level", F.size(F.filter(lits, lambda t: t <= score)))
    valid, exists = F.col("split") != "no_ui_val", F.col("correct_candidate_exists") == 1
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    counts = rows.groupBy("_level").agg(
        one(valid).alias("v"), F.sum(F.when(valid, F.col("selected_exact")).otherwise(0)).cast("long").alias("ex"),
        F.sum(F.when(valid, F.col("selected_numeric_equiv")).otherwise(0)).cast("long").alias("nu"),
        one(valid & exists).alias("o"), one(valid & exists & (F.col("selected_exact") == 0)).alias("ns"),
        one(~valid).alias("u"))
    spark = selected.sparkSession
    levels = spark.createDataFrame([(i, float(t)) for i, t in enumerate(grid, 1)], "_level int, threshold double")
    # One row per threshold from here on.
    table = counts.join(levels, "_level", "full").na.fill(0, ["v", "ex", "nu", "o", "ns", "u"])
    every = Window.partitionBy()
    above = Window.orderBy(F.desc("_level")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = F.col
    total = lambda name: F.sum(name).over(every)
    passed = lambda name: F.sum(name).over(above)
    table = table.select(
        "threshold", total("v").alias("valid_gt_count"), passed("v").alias("output_count"),
        passed("ex").alias("final_exact_correct_count"), passed("nu").alias("final_numeric_equiv_correct_count"),
        total("o").alias("oracle_hit_count"), passed("ns").alias("correct_candidate_exists_but_not_selected_count"),
        (total("o") - passed("o")).alias("correct_candidate_exists_but_thresholded_or_rejected_count"),
        total("u").alias("no_ui_image_count"), passed("u").alias("no_ui_fp")).where("threshold IS NOT NULL")
    return table.select(
        "*", ratio(c("output_count"), c("valid_gt_count")).alias("coverage"),
        ratio(c("final_exact_correct_count"), c("valid_gt_count")).alias("final_exact_accuracy"),
        ratio(c("final_numeric_equiv_correct_count"), c("valid_gt_count")).alias("final_numeric_equiv_accuracy"),
        ratio(c("final_exact_correct_count"), c("output_count")).alias("output_precision"),
        (c("output_count") - c("final_exact_correct_count")).alias("wrong_output_count"),
        (c("valid_gt_count") - c("output_count")).alias("no_output_count"),
        ratio(c("oracle_hit_count"), c("valid_gt_count")).alias("candidate_oracle_exact_accuracy"),
        (c("valid_gt_count") - c("oracle_hit_count")).alias("no_correct_candidate_count"),
        ratio(c("final_exact_correct_count"), c("oracle_hit_count")).alias("selector_accuracy_given_correct_candidate_exists"),
        ratio(c("no_ui_fp"), c("no_ui_image_count")).alias("no_ui_fp_rate"))


def best_threshold(sweep: DataFrame, max_no_ui_fp_rate: float | None = None) -> DataFrame:
    """The best row of a sweep; with a false-positive limit, thresholds that keep it come first."""
    c = F.col
    key = [c("final_exact_accuracy"), -c("no_ui_fp_rate"), c("output_precision"), c("coverage")]
    if max_no_ui_fp_rate is not None:
        key = [(c("no_ui_fp_rate") <= max_no_ui_fp_rate).cast("int"), c("final_exact_accuracy"),
               -c("wrong_output_count"), c("output_precision"), c("coverage"), -c("no_ui_fp_rate")]
    ranked = F.struct(*[k.alias(f"k{i}") for i, k in enumerate([*key, -c("threshold")])])
    return sweep.agg(F.max_by(F.struct(*sweep.columns), ranked).alias("r")).select("r.*")


def choose_model(results: DataFrame) -> DataFrame:
    """Best model over one metric row per model."""
    c = F.col
    key = F.struct(c("final_exact_accuracy"), c("output_precision"), c("coverage"), c("provider_worst_accuracy"),
                   (-c("no_ui_fp_rate")).alias("fp"))
    return results.agg(F.max_by(F.struct(*results.columns), key).alias("r")).select("r.*")


def standardize_fit(df: DataFrame, features: Sequence[str]) -> tuple[list[float], list[float]]:
    """Mean and population standard deviation per feature; a constant feature gets 1."""
    row = standardize_table(df, features).collect()[0]
    return [row[f"mean_{f}"] for f in features], [row[f"std_{f}"] for f in features]


def standardize_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    value = {f: tx.safe_float(F.col(f)) for f in features}
    spread = lambda f: F.stddev_pop(value[f])
    return df.agg(*[F.avg(value[f]).alias(f"mean_{f}") for f in features], *[
        F.when(spread(f) < 1e-8, 1.0).otherwise(spread(f)).alias(f"std_{f}") for f in features])


def frame_balanced_weights(rows: DataFrame, key: str = "image_id", label: str = "label_train") -> DataFrame:
    """Half of a frame's weight to its positives, half to its negatives; scaled to mean one over all rows."""
    counts = rows.groupBy(key).agg(F.sum(label).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    positive = F.col(label) == 1
    negatives = F.col("_n") - F.col("_pos")
    raw = (
        F.when((F.col("_pos") > 0) & (negatives > 0) & positive, F.lit(0.5) / F.col("_pos"))
        .when((F.col("_pos") > 0) & (negatives > 0), F.lit(0.5) / negatives).otherwise(F.lit(1.0) / F.col("_n")))
    # Each frame sums to one, so the mean weight is frames / rows: one row, broadcast.
    mean = counts.agg((F.count(F.lit(1)) / F.sum("_n")).alias("_mean"))
    weighted = rows.join(counts, key).withColumn("_raw", raw)
    return weighted.join(F.broadcast(mean)).withColumn(
        "weight", F.col("_raw") / F.greatest(F.lit(1e-8), F.col("_mean"))).drop("_pos", "_n", "_raw", "_mean")


def hard_negatives(rows: DataFrame, k: int = 24, label: str = "label_train") -> DataFrame:
    """Per frame the `k` hardest negatives: confident first, then close to three digits."""
    order = [F.desc("ocr_conf"), F.abs(F.col("candidate_digit_len") - 3), F.asc("candidate_index")]
    return top_rows(rows.where(F.col(label) == 0), ["image_id"], order, k, "hardness")


def pair_differences(rows: DataFrame, features: Sequence[str], mean: Sequence[float], std: Sequence[float], k: int = 24,
                     label: str = "label_train") -> DataFrame:
    """Standardised feature differences of each positive and the hardest negatives of its frame."""
    scaled = [(tx.safe_float(F.col(f)) - m) / s for f, m, s in zip(features, mean, std)]
    vector = F.array(*scaled)
    positive = rows.where(F.col(label) == 1).select("image_id", F.col("candidate_index").alias("positive_index"), vector.alias("p"))
    negative = hard_negatives(rows, k, label).select("image_id", F.col("candidate_index").alias("negative_index"), vector.alias("q"))
    return positive.join(negative, "image_id").select(
        "image_id", "positive_index", "negative_index", F.zip_with("p", "q", lambda a, b: a - b).alias("difference"))


def _fit(df: DataFrame, l2: float, intercept: bool, weight: str | None = None):
    lr = LogisticRegression(featuresCol="features", labelCol="label", regParam=l2, elasticNetParam=0.0,
                            standardization=False, fitIntercept=intercept, maxIter=500, tol=1e-7)
    if weight:
        lr.setWeightCol(weight)
    return lr.fit(df)


def train_pointwise(rows: DataFrame, features: Sequence[str], l2: float, label: str = "label_train",
                    model_type: str = "pointwise_logistic") -> LinearModel:
    """Weighted logistic regression with an L2 term on standardised features; frames weigh the same."""
    mean, std = standardize_fit(rows, features)
    weighted = frame_balanced_weights(rows, label=label)
    scaled = F.array(*[(tx.safe_float(F.col(f)) - m) / s for f, m, s in zip(features, mean, std)])
    fitted = _fit(weighted.select(array_to_vector(scaled).alias("features"), F.col(label).cast("double").alias("label"),
                                  "weight"), l2, True, "weight")
    return LinearModel(list(features), mean, std, [float(x) for x in fitted.coefficients], float(fitted.intercept), model_type)


def train_pairwise(rows: DataFrame, features: Sequence[str], l2: float, k: int = 24, label: str = "label_train",
                   model_type: str = "pairwise_linear") -> LinearModel:
    """Logistic regression without bias on positive-minus-negative differences, mirrored to have two classes."""
    mean, std = standardize_fit(rows, features)
    pairs = pair_differences(rows, features, mean, std, k, label).select("difference")
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("difference").alias("d"), F.lit(1.0).alias("label")),
        F.struct(F.transform("difference", lambda x: -x).alias("d"), F.lit(0.0).alias("label")))).alias("s"))
    fitted = _fit(both.select(array_to_vector("s.d").alias("features"), F.col("s.label").alias("label")), l2, False)
    return LinearModel(list(features), mean, std, [float(x) for x in fitted.coefficients], 0.0, model_type)


def provider_oof(rows: DataFrame, features: Sequence[str], l2: float, providers: Sequence[str] | None = None,
                 label: str = "label_train") -> DataFrame:
    """Each provider's rows scored by a model trained on the others. The provider list is short; one fit each, and
    all scores are one expression, so the rows are read once for scoring. What the fits read is made once and stored."""
    known = store_step(rows.select(*dict.fromkeys(["image_id", "provider", label, *features])))
    if providers is None:
        providers = sorted(r[0] for r in known.select("provider").where("provider IS NOT NULL").distinct().collect())
    score: Column = F.lit(None).cast("double")
    for provider in providers:
        model = train_pointwise(known.where(F.col("provider") != provider), features, l2, label)
        score = F.when(F.col("provider") == provider, linear_score(rows, model)).otherwise(score)
    return rows.withColumn("oof_score", score)


def infer_features(rows: DataFrame) -> list[str]:
    """Columns outside the metadata list whose values all read as numbers: one aggregate over the whole table."""
    kinds = dict(rows.dtypes)
    names = [c for c in rows.columns if c not in METADATA_COLUMNS]
    numeric = [c for c in names if kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    strings = [c for c in names if kinds[c] == "string"]
    if strings:
        checks = rows.select(*strings).agg(*[
            F.count_if(F.col(c).try_cast("double").isNull()).alias(c) for c in strings]).collect()[0]
        numeric += [c for c in strings if checks[c] == 0]
    return [c for c in names if c in numeric]


def feature_schema(rows: DataFrame) -> dict:
    names = infer_features(rows)
    return {
        "feature_names": names, "feature_count": len(names), "excluded_metadata_columns": list(METADATA_COLUMNS),
        "source_feature_mapping": {n: f"source_detail_{n}" for n in tx.SOURCE_DETAILS},
        "missing_feature_default": 0.0, "forbidden_as_model_features": list(FORBIDDEN_FEATURES),
        "suspicious": [n for n in names if any(t in n.lower() for t in ("image_id", "image_path", "provider", "gt"))],
    }


def training_rows(features: DataFrame, truth: DataFrame) -> DataFrame:
    """Feature rows with labels; frames without truth are kept for the no-UI split only."""
    t = truth.select("image_id", "split", "provider", F.coalesce("gt_text", F.lit("")).alias("gt_channel_number"))
    rows = features.withColumn("candidate_digits", tx.digits(F.col("text"))).where("candidate_digits <> ''").join(t, "image_id")
    rows = rows.where((F.col("split") == "no_ui_val") | (F.col("gt_channel_number") != ""))
    want = tx.digits(F.col("gt_channel_number"))
    known = want != ""
    got = tx.strip_zeros(F.col("candidate_digits"))
    return (
        rows.withColumn("numeric_candidate", got).withColumn("numeric_gt", tx.strip_zeros(want))
        .withColumn("label_exact", (known & (F.col("candidate_digits") == want)).cast("int"))
        .withColumn("label_numeric_equiv", (known & (got == tx.strip_zeros(want))).cast("int"))
        .withColumn("label_train", F.col("label_exact"))
    )


def training_summary(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """Per split: frames, skipped frames, rows, frames with a correct reading and their share."""
    hit = rows.groupBy("image_id").agg(F.max("label_exact").alias("hit"), F.count(F.lit(1)).alias("n"))
    f = frames.join(hit, "image_id", "left")
    used = (F.col("split") == "no_ui_val") | (F.coalesce("gt_text", F.lit("")) != "")
    images = F.sum(used.cast("long"))
    hits = F.sum(F.when(F.col("split") != "no_ui_val", F.coalesce("hit", F.lit(0))).otherwise(0)).cast("long")
    return f.groupBy("split").agg(
        images.alias("image_count"), F.sum((~used).cast("long")).alias("skipped_no_gt"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), hits.alias("oracle_hit_count"),
        F.when((F.first("split") != "no_ui_val") & (images > 0), hits / images).alias("oracle_accuracy"))
