"""Compare registered queries with their oracle SQL (also a small CLI)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return f"{0.0 if f == 0 else f:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message, spark seconds, duckdb seconds)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(v) for v in r) for r in df.select(*cols).collect())
    t1 = time.time()
    if sql is None:
        return False, f"{len(got)} rows, no oracle", t1 - t0, 0.0
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    t2 = time.time()
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}", t1 - t0, t2 - t1
    order = [names.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    if got == want:
        return True, f"{len(got)} rows", t1 - t0, t2 - t1
    a, b = set(got) - set(want), set(want) - set(got)
    return False, f"rows {len(got)} vs {len(want)}; spark-only {sorted(a)[:3]} duckdb-only {sorted(b)[:3]}", t1 - t0, t2 - t1


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as e
    from conftest import make_session

    sf = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, con = make_session(), connect(sf)
    sqls = e.oracle_sql()
    bad = 0
    for name, fn in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, msg, a, b = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as exc:  # report and go on
            ok, msg, a, b = False, "ERROR " + str(exc)[:700], 0, 0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {a:6.2f}s duck {b:5.2f}s  {msg}", flush=True)
    print("failures:", bad)
