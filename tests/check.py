"""Compare registered queries with their SQL in DuckDB: python tests/check.py [-s SF_DIR] [names...]"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def compare(spark, sf, name, fn, sql):
    df = fn(spark, sf)
    got_cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows-only {len(got)}"
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want_cols, want = canonical(cols, cur.fetchall())
    if got_cols != want_cols:
        return f"FAIL columns {got_cols} != {want_cols}"
    if got != want:
        only_got = [r for r in got if r not in set(want)][:3]
        only_want = [r for r in want if r not in set(got)][:3]
        return f"FAIL rows {len(got)} != {len(want)}\n   spark: {only_got}\n   duckdb: {only_want}"
    return f"ok {len(got)}" + (" EMPTY" if not got else "")


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from motioncat.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("-s", default="/root/testdata/sf0.001")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session()
    sqls, bad = oracle_sql(), []
    for name, fn in queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        t = time.time()
        try:
            verdict = compare(spark, args.s, name, fn, sqls.get(name))
        except Exception as exc:  # report and go on
            verdict = f"FAIL {type(exc).__name__}: {str(exc)[:1200]}"
        if verdict.startswith("FAIL"):
            bad.append(name)
        print(f"{name:32s} {time.time() - t:6.2f}s {verdict}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
