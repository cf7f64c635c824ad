"""Column layout of the base tables. Extra input columns are kept in `meta`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = ("x1", "y1", "x2", "y2")

FRAMES = T.StructType([
    T.StructField("image_id", T.StringType(), False),
    T.StructField("path", T.StringType()),
    T.StructField("image_width", T.IntegerType()),
    T.StructField("image_height", T.IntegerType()),
    T.StructField("folder", T.StringType()),
    T.StructField("stem", T.StringType()),
])

CANDIDATES = T.StructType([
    T.StructField("image_id", T.StringType(), False),
    T.StructField("candidate_index", T.IntegerType()),
    T.StructField("candidate_id", T.StringType()),
    T.StructField("text", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in BOX],
    T.StructField("ocr_conf", T.DoubleType()),
    T.StructField("detection_conf", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("raw_source", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("parent_text", T.StringType()),
    T.StructField("image_width", T.IntegerType()),
    T.StructField("image_height", T.IntegerType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
])

DETECTIONS = T.StructType([
    T.StructField("image_id", T.StringType(), False),
    T.StructField("detection_index", T.IntegerType()),
    T.StructField("class_id", T.IntegerType()),
    *[T.StructField(c, T.DoubleType()) for c in BOX],
    T.StructField("conf", T.DoubleType()),
])

SEQUENCES = T.StructType([
    T.StructField("sequence_id", T.StringType()),
    T.StructField("group_key", T.StringType()),
    T.StructField("frame_index", T.IntegerType()),
    T.StructField("image_id", T.StringType()),
])

GROUND_TRUTH = T.StructType([
    T.StructField("image_id", T.StringType()),
    T.StructField("value", T.StringType()),
])

GT_BOXES = T.StructType([
    T.StructField("image_id", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in BOX],
])

MODEL = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project `df` onto `schema`: missing columns become null, extra ones go to `meta` when it has one."""
    known = {f.name for f in schema.fields}
    extra = [c for c in df.columns if c not in known]
    columns = []
    for field in schema.fields:
        if field.name == "meta" and "meta" not in df.columns:
            if extra:
                pairs = [x for c in extra for x in (F.lit(c), F.col(c).cast("string"))]
                value = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
            else:
                value = F.lit(None)
        elif field.name in df.columns:
            value = F.col(field.name)
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def require(df: DataFrame, schema: T.StructType, *names: str) -> DataFrame:
    """Fail at plan time when a needed column is missing or has another type."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in schema.fields}
    for name in names or tuple(want):
        if name not in have:
            raise ValueError(f"missing column {name}")
        if have[name] != want[name]:
            raise ValueError(f"column {name} is {have[name].simpleString()}, expected {want[name].simpleString()}")
    return df
