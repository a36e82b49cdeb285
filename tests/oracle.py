"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    return v


def key(row):
    return tuple((x is None, str(type(x).__name__ in ("int", "float") and "n" or "s"), str(x)) for x in row)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, queries, oracles):
    """Return (rows, problem or None, seconds)."""
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(normal(r[c]) for c in cols) for r in df.collect()]
    secs = time.time() - t0
    if name not in oracles:
        return len(got), None, secs
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return len(got), f"columns {cols} != {sorted(names)}", secs
    at = [names.index(c) for c in cols]
    want = [tuple(normal(r[i]) for i in at) for r in cur.fetchall()]
    if len(got) != len(want):
        return len(got), f"rows {len(got)} != {len(want)}", secs
    got.sort(key=key)
    want.sort(key=key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return len(got), f"{len(bad)} differ, first spark={bad[0][0]} sql={bad[0][1]} cols={cols}", secs
    return len(got), None, secs


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from conftest import make_session

    import __spark_entry__ as entry

    sf = f"/root/testdata/{sys.argv[1]}"
    pick = sys.argv[2:]
    qs, orc = entry.queries(), entry.oracle_sql()
    spark = make_session()
    con = duck(sf)
    fails = 0
    for name in qs:
        if pick and not any(p in name for p in pick):
            continue
        try:
            n, problem, secs = compare(spark, con, sf, name, qs, orc)
        except Exception as exc:  # report and go on to the next query
            n, problem, secs = -1, f"{type(exc).__name__}: {str(exc)[:1500]}", 0
        tag = "FAIL" if problem else ("ok  " if name in orc else "rows")
        fails += bool(problem)
        print(f"{tag} {name:28s} rows={n:7d} {secs:6.2f}s {problem or ''}", flush=True)
    print("failures:", fails)
