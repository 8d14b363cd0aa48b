"""Run registered queries against their SQL: ``python tests/check_oracle.py [folder] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), sorted(columns)


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def compare(spark, con, folder, name, fn, sql):
    started = time.time()
    df = fn(spark, folder)
    got, got_columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spark_time = time.time() - started
    if sql is None:
        return len(got), spark_time, None, "no sql"
    started = time.time()
    result = con.execute(sql)
    want, want_columns = rows_of([c[0] for c in result.description], result.fetchall())
    sql_time = time.time() - started
    if got_columns != want_columns:
        return len(got), spark_time, sql_time, f"COLUMNS {got_columns} {want_columns}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lacking = [r for r in want if r not in set(got)][:2]
        return len(got), spark_time, sql_time, f"DIFFERS {len(got)} {len(want)} extra={str(extra)[:600]} lacking={str(lacking)[:600]}"
    return len(got), spark_time, sql_time, "ok"


def main(folder="/root/testdata/sf0.01", *names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), []
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        try:
            n, took, sql_took, verdict = compare(spark, con, folder, name, queries[name], oracles.get(name))
        except Exception as error:  # noqa: BLE001
            n, took, sql_took, verdict = -1, 0.0, None, "ERROR " + str(error)[:900]
        if verdict not in ("ok", "no sql"):
            bad.append(name)
        print(f"{name:28s} rows={n:<8d} spark={took:6.2f}s sql={sql_took and round(sql_took, 2)} {verdict}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
