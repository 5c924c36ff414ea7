"""Run registered queries beside their DuckDB SQL and compare whole results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{value:.9g}"
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    """(seconds Spark, seconds DuckDB, rows, problem or None)."""
    start = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    spark_time = time.time() - start
    if sql is None:
        return spark_time, 0.0, len(got), None
    start = time.time()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    wanted = result.fetchall()
    duck_time = time.time() - start
    if sorted(names) != sorted(df.columns):
        return spark_time, duck_time, len(got), f"columns {df.columns} != {names}"
    if len(got) != len(wanted):
        return spark_time, duck_time, len(got), f"{len(got)} rows != {len(wanted)}"
    left, right = _rows(df.columns, got), _rows(names, wanted)
    if left != right:
        a, b = next((a, b) for a, b in zip(left, right) if a != b)
        return spark_time, duck_time, len(got), f"first difference\n  {str(a)[:700]}\n  {str(b)[:700]}"
    return spark_time, duck_time, len(got), None


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    database = connect(folder)
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        try:
            s, d, n, problem = compare(session, database, folder, query, sql.get(name))
            state = problem or ("same" if name in sql else "rows only")
        except Exception as error:  # report and go on with the next query
            s, d, n, state = 0, 0, 0, f"FAILED {type(error).__name__}: {str(error)[:900]}"
        print(f"{name:24} spark {s:6.2f}s duckdb {d:6.2f}s rows {n:8d} {state}", flush=True)
