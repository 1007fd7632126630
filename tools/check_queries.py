"""Run the queries beside their SQL and compare the rows.

Usage: python tools/check_queries.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from worksignal.catalog import ORACLES, QUERIES
from worksignal.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return f"{float(value):.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if type(value).__name__ == "Decimal":
        return f"{float(value):.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(**{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{args.sf}/{name}.parquet'")
    bad = 0
    for name in args.names or list(QUERIES):
        try:
            start = time.time()
            df = QUERIES[name](spark, args.sf)
            got = [tuple(r) for r in df.collect()]
            spent = time.time() - start
            if name not in ORACLES:
                print(f"rows {name}: {len(got)} rows {spent:.1f}s")
                continue
            start = time.time()
            result = con.execute(ORACLES[name])
            columns = [d[0] for d in result.description]
            want = result.fetchall()
            sql_spent = time.time() - start
            if sorted(columns) != sorted(df.columns):
                bad += 1
                print(f"BAD  {name}: columns {sorted(df.columns)} vs {sorted(columns)}")
                continue
            a, b = rows_of(df.columns, got), rows_of(columns, want)
            if a == b:
                print(f"ok   {name}: {len(a)} rows, spark {spent:.1f}s, sql {sql_spent:.1f}s")
            else:
                bad += 1
                sa, sb = set(a), set(b)
                print(f"BAD  {name}: {len(a)} vs {len(b)} rows, sorted by column: {sorted(columns)}")
                print("   spark only:", [str(x)[:700] for x in sorted(sa - sb)[:2]])
                print("   sql only:  ", [str(x)[:700] for x in sorted(sb - sa)[:2]])
        except Exception as error:
            bad += 1
            print(f"FAIL {name}: {type(error).__name__}: {str(error)[:900]}")
        sys.stdout.flush()
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
