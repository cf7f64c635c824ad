"""Queries over a numeric pixel view of the lineitem table."""

from __future__ import annotations

from pyspark.sql import functions as F

from framefusion.operators import infer
from framefusion.operators import pixels as px
from framefusion.plans import fixtures as fx
from framefusion.plans.registry import q6, query, rounded

PIXELS = """WITH pixels AS (SELECT l_linestatus AS key, l_linenumber AS frame, CAST(l_partkey % 32 AS INT) AS x, CAST(l_suppkey % 32 AS INT) AS y, CAST(l_orderkey % 256 AS INT) AS grey,
   CAST(l_orderkey % 256 AS INT) AS r, CAST(l_partkey % 128 AS INT) AS g, CAST(l_suppkey % 64 AS INT) AS b FROM lineitem)"""
KEYS = ["key"]


def pixels(spark, folder):
    c = F.col
    return fx.table(spark, folder, "lineitem").select(
        c("l_linestatus").alias("key"), c("l_linenumber").alias("frame"), (c("l_partkey") % 32).cast("int").alias("x"),
        (c("l_suppkey") % 32).cast("int").alias("y"), (c("l_orderkey") % 256).cast("int").alias("grey"), (c("l_orderkey") % 256).cast("int").alias("r"),
        (c("l_partkey") % 128).cast("int").alias("g"), (c("l_suppkey") % 64).cast("int").alias("b"))


def _composite(how: str, sql: str):
    @query(f"temporal_composite_{how}", f"{PIXELS} SELECT key, x, y, {sql} FROM pixels GROUP BY ALL HAVING count(DISTINCT frame) >= 2", fixture=False)
    def run(spark, folder):
        return rounded(px.temporal_composite(pixels(spark, folder), KEYS, how).select("key", "x", "y", "r", "g", "b"))


_composite("min", "min(r) AS r, min(g) AS g, min(b) AS b")
_composite("median", ", ".join(f"{q6(f'median({c})')} AS {c}" for c in "rgb"))
_composite("mean", ", ".join(f"{q6(f'avg({c})')} AS {c}" for c in "rgb"))


@query("static_mask", f"""{PIXELS} SELECT key, x, y, greatest(max(r) - min(r), max(g) - min(g), max(b) - min(b)) AS change, {q6('(stddev_pop(r) + stddev_pop(g) + stddev_pop(b)) / 3')} AS std,
  greatest(max(r) - min(r), max(g) - min(g), max(b) - min(b)) < 30 AS static FROM pixels GROUP BY key, x, y""", fixture=False)
def static_mask(spark, folder):
    return rounded(px.static_mask(pixels(spark, folder), KEYS, 30))


@query("persistence_share", f"{PIXELS} SELECT key, x, y, {q6('avg(CAST(grey > 127 AS DOUBLE))')} AS share FROM pixels GROUP BY key, x, y", fixture=False)
def persistence_share(spark, folder):
    return rounded(px.persistence_share(pixels(spark, folder), KEYS, F.col("grey") > 127))


@query("font_colour", f"""{PIXELS}, q AS (SELECT key, frame, CAST(r // 96 * 96 + 48 AS INT) AS r, CAST(g // 96 * 96 + 48 AS INT) AS g, CAST(b // 96 * 96 + 48 AS INT) AS b FROM pixels),
 s AS (SELECT *, n / sum(n) OVER (PARTITION BY key, frame) AS share FROM (SELECT key, frame, r, g, b, count(*) AS n FROM q GROUP BY ALL)),
 p AS (SELECT key, r, g, b, count(*) AS frames, sum(share) AS weight FROM s WHERE share >= 0.1 GROUP BY ALL)
 SELECT key, r, g, b, frames FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY frames DESC, round(weight, 9) DESC, r, g, b) AS rk FROM p) WHERE rk = 1""", fixture=False)
def font_colour(spark, folder):
    return px.font_colour(pixels(spark, folder), KEYS, step=96).select("key", "r", "g", "b", "frames")


@query("static_colour", f"""{PIXELS}, st AS (SELECT key, x, y FROM pixels GROUP BY ALL HAVING greatest(max(g) - min(g), max(b) - min(b)) < 120), m AS (SELECT key, x, y, avg(g) AS g, avg(b) AS b FROM pixels SEMI JOIN st USING (key, x, y) GROUP BY ALL),
 c AS (SELECT key, CAST(floor(g / 20) * 20 + 10 AS INT) AS g, CAST(floor(b / 20) * 20 + 10 AS INT) AS b, count(*) AS n FROM m GROUP BY ALL)
 SELECT key, g, b, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, g, b) AS rk, sum(n) OVER (PARTITION BY key) AS t FROM c) WHERE rk = 1 AND t >= 8""", fixture=False)
def static_colour(spark, folder):
    return px.static_colour(pixels(spark, folder), KEYS, 120, channels=("g", "b")).select("key", "g", "b", "n")


@query("otsu_split", f"""{PIXELS}, h AS (SELECT x, grey AS bin, count(*) AS n FROM pixels GROUP BY ALL), c AS (SELECT *, sum(n) OVER w AS wb, sum(n * bin) OVER w AS sb, sum(n) OVER (PARTITION BY x) AS wt, sum(n * bin) OVER (PARTITION BY x) AS st FROM h
   WINDOW w AS (PARTITION BY x ORDER BY bin ROWS UNBOUNDED PRECEDING)), v AS (SELECT *, CASE WHEN wt > wb THEN wb * (wt - wb) * power(sb / wb - (st - sb) / (wt - wb), 2) END AS var FROM c)
 SELECT x, bin AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY coalesce(round(var, 3), -1) DESC, bin) AS rk FROM v) WHERE rk = 1""", fixture=False)
def otsu_split(spark, folder):
    return px.otsu_split(pixels(spark, folder), ["x"])


@query("otsu_colours")
def otsu_colours(spark, folder):
    return px.otsu_colours(pixels(spark, folder), KEYS)


@query("colour_mask", f"""{PIXELS} SELECT key, frame, x, y, r, g, b, count(*) AS n FROM pixels WHERE sqrt(power(r - 200, 2) + power(g - 100, 2) + power(b - 50, 2)) < sqrt(power(r - 20, 2) + power(g - 30, 2) + power(b - 10, 2)) GROUP BY ALL""", fixture=False)
def colour_mask(spark, folder):
    rows = pixels(spark, folder)
    colours = rows.select("key").distinct().select("key", *[F.lit(v).alias(k) for k, v in (
        ("font_r", 200), ("font_g", 100), ("font_b", 50), ("back_r", 20), ("back_g", 30), ("back_b", 10))])
    return px.colour_mask(rows, colours, KEYS).groupBy("key", "frame", "x", "y", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


class _Echo:
    """A stand-in recogniser that reads a region's own text."""

    def predict_many(self, crops):
        return [[(text, conf)] for text, conf in crops]


@query("score_regions", "SELECT image_id, candidate_index, regexp_replace(text, '[^0-9]', '', 'g') AS text FROM candidates WHERE regexp_matches(text, '[0-9]') AND ocr_conf >= 0.5")
def score_regions(spark, folder):
    regions = fx.candidates(spark, folder)
    digits = lambda row: ("".join(c for c in row["text"] if c.isdigit()), row["ocr_conf"])
    return infer.score_regions(regions, _Echo, digits, ["image_id", "candidate_index"], 0.5).select("image_id", "candidate_index", "text")
