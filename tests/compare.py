"""Run registered queries next to their SQL in DuckDB and compare row sets.

    python -m tests.compare [--sf 0.01] [key ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return v


def rows_of(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, key, fn, sql, sf_dir):
    """Empty string when both agree, else the first differences."""
    df = fn(spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    kinds = lambda rows: [sorted({type(r[i]).__name__ for r in rows} - {"NoneType"}) for i in range(len(got_names))]
    if got and want and kinds(got) != kinds(want):
        return f"types {dict(zip(got_names, kinds(got)))} != {kinds(want)}"
    if got != want:
        g, w = set(got), set(want)
        return (f"rows {len(got)} vs {len(want)}; only spark {sorted(g - w, key=repr)[:3]}; "
                f"only sql {sorted(w - g, key=repr)[:3]}")
    return "" if got else "both empty"


def main() -> None:
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from tidewatch.session import build_session
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                                "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{a.sf}"
    con, q, sql = connect(sf_dir), e.queries(), e.oracle_sql()
    bad = 0
    for key in a.keys or q:
        t = time.time()
        try:
            msg = compare(spark, con, key, q[key], sql.get(key), sf_dir)
        except Exception as ex:  # report and go on
            msg = f"{type(ex).__name__}: {str(ex)[:700]}"
        bad += bool(msg)
        print(f"{'FAIL' if msg else 'ok  '} {key:24s} {time.time() - t:6.2f}s {'' if key in sql else '(rows only) '}{msg[:1200]}",
              flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
