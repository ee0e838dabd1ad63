"""Sources, sinks, projections, previews."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dataloom.functions.columns import columns_of
from dataloom.operators import pairs, preview
from dataloom.operators.profile import missing_only
from dataloom.operators.validate import duplicate_rows
from dataloom.plans.shared import scratch_path
from dataloom.queries.tables import (
    DIRTY_LINEITEM, DIRTY_ORDERS, PADDED_TEXT, PAIRS, Tables, duck, rounded, union_all,
)
from dataloom.sources import readers, writers

# Bytes of JSON text in a file: two ranges or more of Spark's usual size.
FILE_BYTES = 1 << 28


def in_files(rows: DataFrame, least: int = 1) -> DataFrame:
    """The rows dealt to the tasks that write a file each: ``least`` files while these hold
    FILE_BYTES each at most, and more when they would not."""
    size = rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return rows.repartition(max(least, -(-size // FILE_BYTES)))


def as_documents(df: DataFrame, opening: str, closing: str, path: str, ending: str = "\n") -> None:
    """Write files that each hold one JSON document around a list of one partition's rows."""
    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for batch in batches:
            lines = batch["line"].tolist()
            head = [opening + lines[0]] if first and lines else [f",{x}" for x in lines[:1]]
            first = first and not lines
            yield pd.DataFrame({"line": head + [f",{x}" for x in lines[1:]]})
        yield pd.DataFrame({"line": [opening + closing if first else closing]})

    lines = df.select(F.to_json(F.struct(*df.columns)).alias("line"))
    lines.mapInPandas(framed, "line string").write.text(path, lineSep=ending)


def csv_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    writers.write_csv(t.customer, path)
    return readers.read_csv(t.spark, path).select(
        F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_nationkey", "c_acctbal",
        "c_mktsegment",
    )


def csv_typed(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "csv")
    writers.write_csv(t.documents, path)
    return readers.read_csv(t.spark, path, t.documents.schema)


def json_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "json")
    as_documents(t.orders, "[", "]", path)
    return readers.read_json(t.spark, path, t.orders.schema)


def jsonl_roundtrip(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "jsonl")
    writers.write_jsonl(t.part, path)
    return readers.read_jsonl(t.spark, path).select(
        "p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("int").alias("p_size"),
        "p_retailprice",
    )


def json_nested(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "nested")
    as_documents(t.orders, '{"name": "orders", "about": {"tags": [1]}, "records": [', "]}", path)
    return readers.read_json_nested(t.spark, path, t.orders.schema)


_SPLITS = """
(SELECT *, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'validation'
  ELSE 'test' END AS split FROM {orders})
"""


def load_split(t: Tables) -> DataFrame:
    path = writers.publish(t.sql(_SPLITS), scratch_path(t.spark, "published"))
    return readers.load_split(t.spark, path, "train")


_POINTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

QUERIES = {
    "csv_roundtrip": (csv_roundtrip, "SELECT * FROM customer"),
    "csv_typed": (csv_typed, "SELECT * FROM documents"),
    "json_roundtrip": (json_roundtrip, "SELECT * FROM orders"),
    "jsonl_roundtrip": (jsonl_roundtrip, "SELECT * FROM part"),
    "json_nested": (
        json_nested, "SELECT * FROM orders",
    ),
    "load_split": (load_split, "SELECT * FROM orders WHERE o_orderstatus = 'F'"),
    "raw_records_json": (
        lambda t: preview.raw_records(t.customer, ["c_custkey"], 5, "json"),
        """SELECT row_number() OVER (ORDER BY c_custkey)::INT AS line,
          CAST(to_json(customer) AS VARCHAR) AS record
        FROM customer QUALIFY line <= 5""",
    ),
    "raw_records_csv": (
        lambda t: preview.raw_records(t.customer, ["c_custkey"], 5, "csv"),
        """SELECT row_number() OVER (ORDER BY c_custkey)::INT AS line,
          concat_ws(',', c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment) AS record
        FROM customer QUALIFY line <= 5""",
    ),
    "select_numeric": (
        lambda t: rounded(columns_of(t.lineitem, "numeric")),
        """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
          round(l_quantity, 6) + 0.0 AS l_quantity, round(l_extendedprice, 6) + 0.0 AS l_extendedprice,
          round(l_discount, 6) + 0.0 AS l_discount, round(l_tax, 6) + 0.0 AS l_tax FROM lineitem""",
    ),
    "select_non_numeric": (
        lambda t: columns_of(t.orders, "non_numeric"),
        "SELECT o_orderstatus, o_orderdate, o_orderpriority FROM orders",
    ),
    "select_datetime": (
        lambda t: columns_of(t.events, "datetime"), "SELECT ts FROM events",
    ),
    "pairs_project": (
        lambda t: pairs.to_pairs(t.labels, "doc_id", "quality"),
        "SELECT CAST(doc_id AS VARCHAR) AS input, CAST(quality AS VARCHAR) AS target FROM labels",
    ),
    "trim_columns": (
        lambda t: pairs.trim_columns(t.sql(PADDED_TEXT), ["c_name"]),
        f"SELECT c_custkey, trim(c_name) AS c_name, c_mktsegment FROM {duck(PADDED_TEXT)}",
    ),
    "pairs_nonblank": (
        lambda t: pairs.drop_blank_pairs(
            pairs.to_pairs(t.sql(PADDED_TEXT), "c_name", "c_mktsegment", keep=["c_custkey"])
        ),
        f"""SELECT c_custkey, c_name AS input, c_mktsegment AS target FROM {duck(PADDED_TEXT)}
        WHERE trim(c_name) <> '' AND trim(c_mktsegment) <> ''""",
    ),
    "preview_head": (
        lambda t: preview.head(t.orders, ["o_orderkey"], 10),
        "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
    ),
    "preview_tail": (
        lambda t: preview.tail(t.orders, ["o_orderkey"], 10),
        "SELECT * FROM orders ORDER BY o_orderkey DESC LIMIT 10",
    ),
    "preview_sample": (lambda t: preview.sample(t.orders, ["o_orderkey"], 10), None),
    "schema_table": (
        lambda t: preview.schema_table(t.lineitem),
        """SELECT (row_number() OVER () - 1)::INT AS position, column_name AS "column",
          CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
            WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS type
        FROM (DESCRIBE lineitem)""",
    ),
    "line_series": (
        lambda t: preview.sort_by(t.orders.select("o_orderdate", "o_totalprice"), "o_orderdate"),
        "SELECT o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate",
    ),
    "scatter_xy": (
        lambda t: preview.xy(t.lineitem, "l_quantity", "l_extendedprice", color="l_returnflag"),
        """SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS color FROM lineitem""",
    ),
    "scatter_3d": (
        lambda t: preview.xy(t.part, "p_size", "p_retailprice", "p_partkey", "p_type"),
        "SELECT p_size AS x, p_retailprice AS y, p_partkey AS z, p_type AS color FROM part",
    ),
    "scatter_matrix": (
        lambda t: rounded(preview.scatter_matrix(t.lineitem, _POINTS)),
        "SELECT " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _POINTS) + " FROM lineitem",
    ),
    "duplicate_rows": (
        lambda t: duplicate_rows(t.sql(DIRTY_ORDERS)),
        f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate
        FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey, o_custkey, o_orderstatus,
            o_totalprice, o_orderpriority, o_orderdate) AS copy FROM {duck(DIRTY_ORDERS)})
        WHERE copy > 1""",
    ),
    "missing_by_column": (
        lambda t: rounded(missing_only(t.sql(DIRTY_LINEITEM))),
        "SELECT * FROM (" + union_all([
            f"""SELECT '{c}' AS "column", CAST(count(*) - count({c}) AS BIGINT) AS missing,
              round((count(*) - count({c})) * 100.0 / count(*), 6) + 0.0 AS missing_pct
            FROM {duck(DIRTY_LINEITEM)}"""
            for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
                      "l_returnflag", "l_shipdate")
        ]) + ") WHERE missing > 0",
    ),
    "pairs_conversations": (
        lambda t: pairs.to_pairs(t.sql(PAIRS), "question", "answer", keep=["conv_id", "turn"]),
        f"SELECT conv_id, turn, question AS input, answer AS target FROM {duck(PAIRS)}",
    ),
}
