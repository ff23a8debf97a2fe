"""Run registered queries in Spark and their SQL in DuckDB and compare every value."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}") + 0.0
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def compare(spark, con, folder, fn, sql):
    """(ok, message, spark rows)."""
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return True, f"rows only: {len(got)}", got
    cur = con.execute(sql)
    names, kinds = [c[0] for c in cur.description], [str(c[1]) for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} / {sorted(names)}", got
    odd = [f"{n}:{k}" for n, k in zip(names, kinds) if "HUGEINT" in k or "DECIMAL" in k]
    spark_types = dict(df.dtypes)
    for n, k in zip(names, kinds):
        s = spark_types[n]
        pair = (s, k)
        if pair not in {
            ("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("string", "VARCHAR"), ("boolean", "BOOLEAN"),
            ("timestamp_ntz", "TIMESTAMP"), ("date", "DATE"),
        }:
            odd.append(f"{n}:{s}/{k}")
    a, b = rows_of(df.columns, got), rows_of(names, want)
    note = f" types {odd}" if odd else ""
    if len(a) != len(b):
        return False, f"rows {len(a)} / {len(b)}{note}", got
    for x, y in zip(a, b):
        if x != y:
            return False, f"first difference {x} / {y}{note}", got
    return True, f"{len(a)} rows{note}", got


def main(folder: str, only: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = connect(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if only and not any(o in name for o in only):
            continue
        start = time.time()
        try:
            ok, text, _ = compare(spark, con, folder, fn, oracles.get(name))
        except Exception as exc:  # report and go on
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {text}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
