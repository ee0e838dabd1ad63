"""Run queries on Spark and in DuckDB over the same tables and compare the rows.

    python tests/oracle.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dataloom.queries import all_queries, all_sql  # noqa: E402
from dataloom.queries.tables import NAMES  # noqa: E402


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("dataloom")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return repr(value)
    return value


def spark_rows(frame):
    order = sorted(frame.columns)
    data = frame.select(*[f"`{c}`" for c in order]).collect()
    return order, sorted((tuple(_plain(v) for v in r) for r in data), key=repr)


def duck_rows(con, sql: str):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = result.fetchall()
    return (
        [names[i] for i in order],
        sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr),
    )


def differences(left, right) -> str | None:
    if left[0] != right[0]:
        return f"columns {left[0]} against {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"{len(left[1])} rows against {len(right[1])}"
    wrong = [(a, b) for a, b in zip(left[1], right[1]) if repr(a) != repr(b)]
    if wrong:
        return f"{len(wrong)} of {len(left[1])} rows differ, first: {wrong[0][0]} / {wrong[0][1]}"
    return None


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(folder)
    queries, sql = all_queries(), all_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            got = spark_rows(queries[name](spark, folder))
            took = time.time() - start
            problem = differences(got, duck_rows(con, sql[name])) if name in sql else None
        except Exception as error:  # report and go on with the other queries
            took, problem, got = time.time() - start, f"{type(error).__name__}: {error}"[:1500], ((), ())
        bad += problem is not None
        kind = "" if name in sql else " (rows only)"
        print(f"{'BAD ' if problem else 'ok  '} {name:28s} {len(got[1]):7d} rows {took:6.2f}s{kind}"
              + (f"\n     {problem}" if problem else ""), flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
