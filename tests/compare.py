"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import decimal
import math
import sys
import time


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return 0.0 if value == 0 else float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return names, sorted(out, key=repr)


def connect(sf_dir):
    import duckdb

    from scorelake.plans.catalogue import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, SQL has {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"\n   spark {dict(zip(got[0], a))}\n   sql   {dict(zip(want[0], b))}"
    if not want[1]:
        return "no rows"
    return None


def main(sf_dir, *only):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from scorelake.session import local_session

    spark = local_session(8, 8)
    con = connect(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:500]}"
        mark = "ok " if problem is None else "BAD"
        bad += problem is not None
        note = "" if name in oracles else " (rows only)"
        print(f"{mark} {time.time() - t:6.2f}s {name}{note} {problem or ''}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
