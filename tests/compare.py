"""Run registered queries next to their checking SQL and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(v):
    if v is None:
        return ""
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{cell(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return f"{type(v).__name__}:{v}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted("|".join(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, folder):
    df = fn(spark, folder)
    t = time.time()
    names, mine = rows_of(df.columns, df.collect())
    compare.spent = time.time() - t
    cur = con.execute(sql)
    theirs_cols = [d[0] for d in cur.description]
    names2, theirs = rows_of(theirs_cols, cur.fetchall())
    if names != names2:
        return f"columns {names} != {names2}"
    a, b = Counter(mine), Counter(theirs)
    left, right = sorted((a - b).elements()), sorted((b - a).elements())
    if left or right:
        return f"{len(left)} of {len(mine)} rows differ in {str(names)[:200]}\n   spark {str(left[:2])[:900]}\n   check {str(right[:2])[:900]}"
    return None if mine else "EMPTY"


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from framefusion.session import build_session
    from framefusion.plans import ORACLES, QUERIES, load
    load()
    folder = f"/root/testdata/{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                         "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in QUERIES:
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        t = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, QUERIES[name], ORACLES[name], folder)
                note = f"ok (run {compare.spent:.1f}s)"
            else:
                n = QUERIES[name](spark, folder).count()
                problem, note = (None if n else "EMPTY"), f"rows only: {n}"
        except Exception as e:
            problem, note = f"{type(e).__name__}: {str(e)[:700]}", ""
        bad += problem is not None
        print(f"{'FAIL' if problem else 'pass'} {name} {time.time() - t:.1f}s {problem or note}", flush=True)
    print("failures:", bad)
