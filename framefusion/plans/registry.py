"""Named queries over the given tables, each with a checking query where SQL can say the same."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framefusion.plans.fixtures import FIXTURE_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, fixture: bool = True) -> Callable[[Query], Query]:
    """Register a query. `sql` follows the fixture views: either a SELECT or further views starting with a comma."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = f"{FIXTURE_SQL}\n{sql.strip()}" if fixture else sql.strip()
        return fn

    return register


def r6(value: Column | str) -> Column:
    """Round for comparison. The small shift moves decimals that end in 5 off the rounding edge, where the last bit of
    the two engines would decide."""
    c = (F.col(value) if isinstance(value, str) else value) + F.lit(1.234567e-9)
    # A whole number of millionths divided once is the double next to that decimal, as `round` finds it by way of its digits.
    return F.when(F.abs(c) < 1e9, F.rint(c * 1e6) / 1e6).otherwise(F.round(c, 6)) + F.lit(0.0)


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    """Round every double column except the keys."""
    names = [c for c, kind in df.dtypes if kind == "double" and c not in keys]
    if len(names) <= 6:
        return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])
    # Many columns are rounded as one array: spelled out one by one, their code grows too large to be compiled.
    rows = df.withColumn("_rounded", F.transform(F.array(*names), r6))
    return rows.select(*[F.get("_rounded", F.lit(names.index(c))).alias(c) if c in names else F.col(c) for c in df.columns])


# Fragments of the checking SQL.

def q6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE) + 1.234567e-9::DOUBLE, 6) + CAST(0 AS DOUBLE))"


def sql_area(a: str) -> str:
    return f"(greatest(0.0::DOUBLE, {a}.x2 - {a}.x1) * greatest(0.0::DOUBLE, {a}.y2 - {a}.y1))"


def sql_inter(a: str, b: str) -> str:
    return (f"(greatest(0.0::DOUBLE, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
            f" * greatest(0.0::DOUBLE, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))")


def sql_iou(a: str, b: str) -> str:
    union = f"({sql_area(a)} + {sql_area(b)} - {sql_inter(a, b)})"
    return f"(CASE WHEN {union} > 0 THEN {sql_inter(a, b)} / {union} ELSE 0.0::DOUBLE END)"


def sql_overlap(a: str, b: str) -> str:
    small = f"least({sql_area(a)}, {sql_area(b)})"
    return f"(CASE WHEN {small} > 0 THEN {sql_inter(a, b)} / {small} ELSE 0.0::DOUBLE END)"


def sql_distance(a: str, b: str) -> str:
    dx = f"((({a}.x1 + {a}.x2) / 2 - ({b}.x1 + {b}.x2) / 2) / 1280)"
    dy = f"((({a}.y1 + {a}.y2) / 2 - ({b}.y1 + {b}.y2) / 2) / 720)"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def sql_digits(t: str) -> str:
    return f"regexp_replace({t}, '[^0-9]', '', 'g')"


def sql_strip(v: str) -> str:
    return f"(CASE WHEN regexp_matches({v}, '^0+[0-9]') THEN regexp_replace({v}, '^0+', CASE WHEN regexp_matches({v}, '^0+$') THEN '0' ELSE '' END) ELSE {v} END)"


def sql_runs(t: str) -> str:
    return f"list_filter(regexp_extract_all({t}, '[0-9]+'), lambda r: length(r) <= 5)"


def sql_best_digit(t: str) -> str:
    runs = sql_runs(t)
    longest = f"list_max(list_transform({runs}, lambda r: length(r)))"
    return f"coalesce(list_filter({runs}, lambda r: length(r) = {longest})[1], '')"


def sql_class(t: str) -> str:
    digits = sql_digits(t)
    rest = f"trim(regexp_replace({t}, '[0-9]', '', 'g'))"
    return f"""(CASE WHEN regexp_matches({t}, '[0-9]{{1,2}}\\s*:\\s*[0-9]{{2}}') THEN 'time'
      WHEN regexp_matches({t}, '[0-9]{{1,4}}\\s*[/.\\-]\\s*[0-9]{{1,2}}') THEN 'date'
      WHEN {digits} = '' THEN 'text'
      WHEN length({digits}) = length(regexp_replace({t}, '\\s', '', 'g')) AND length({digits}) <= 5 THEN 'channelnum'
      WHEN len({sql_runs(t)}) = 1 AND ({rest} = '' OR (regexp_matches(regexp_replace({rest}, '[.#]', '', 'g'), '^[A-Za-z]+$') AND length({rest}) <= 8)) THEN 'channelnum'
      ELSE 'othernum' END)"""
