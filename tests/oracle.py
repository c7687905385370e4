"""Compare registered queries with their SQL in DuckDB: python tests/oracle.py [--sf DIR] [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def plain(x):
    if x is None:
        return ""
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(plain(y) for y in x) + "]"
    if isinstance(x, bool):
        return str(x)
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, name: str, query, sql: str | None, sf: str = SF) -> str:
    df = query(spark, sf)
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only: {len(found[1])}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if found[0] != want[0]:
        return f"DIFFERENT columns {found[0]} / {want[0]}"
    if found[1] == want[1]:
        return f"same: {len(found[1])}"
    a, b = set(found[1]), set(want[1])
    return f"DIFFERENT {len(found[1])}, {len(want[1])} rows; only here {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"[:1500]


if __name__ == "__main__":
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args.pop(1) if args[:1] == ["--sf"] else SF
    args = args[1:] if args[:1] == ["--sf"] else args
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in args or queries:
        began = time.time()
        try:
            said = compare(spark, name, queries[name], oracle.get(name), sf)
        except Exception as e:
            said = f"FAILED {type(e).__name__}: {str(e)[:1800]}"
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
