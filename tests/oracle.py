"""Compares every query with its SQL counterpart, value by value.

    python tests/oracle.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def database(sf: str):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def difference(df, con, sql: str) -> str | None:
    """None if the query result and the SQL result are equal, else what differs."""
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {sorted(set(got[0]) ^ set(want[0]))}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}"
    wrong = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if wrong:
        bad = [n for n, a, b in zip(got[0], *wrong[0]) if a != b]
        return f"{len(wrong)} rows differ, first in {bad}: {[x for x in zip(*wrong[0]) if x[0] != x[1]]}"
    kinds = [
        (n, type(a), type(b))
        for n, *pair in zip(got[0], *[[next((v for v in col if v is not None), None) for col in zip(*r[1])] for r in (got, want)])
        for a, b in [pair]
        if type(a) is not type(b)
    ]
    return f"types {kinds}" if kinds else None


def main(sf: str, only: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = database(sf), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = query(spark, sf)
            found = difference(df, con, oracles[name]) if name in oracles else f"no SQL, {df.count()} rows"
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:600]}"
        failed += found is not None and not found.startswith("no SQL")
        print(f"{name:28s} {time.time() - start:6.1f}s  {found or 'equal'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
