"""Column profiles."""

from __future__ import annotations

from dataloom.operators import profile
from dataloom.operators.pairs import to_pairs
from dataloom.queries.tables import (
    DIRTY_LINEITEM, DIRTY_ORDERS, PAIRS, duck, rounded, union_all,
)

ORDERS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
    "o_totalprice": "double", "o_orderpriority": "string", "o_orderdate": "timestamp_ntz",
}
LINES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
PARTS = {
    "p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
    "p_size": "int", "p_retailprice": "double",
}
DOCUMENTS = {
    "doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint",
}
CONVERSATIONS = {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}
NUMBERS = ("bigint", "int", "double")


def per_column(columns, table: str, template: str) -> str:
    return union_all([template.format(c=c, t=table) for c in columns])


def missing_sql(columns, table: str) -> str:
    return per_column(columns, table, """SELECT '{c}' AS "column",
      CAST(count(*) - count({c}) AS BIGINT) AS missing,
      round((count(*) - count({c})) * 100.0 / count(*), 6) + 0.0 AS missing_pct FROM {t}""")


def distinct_sql(columns, table: str) -> str:
    return per_column(
        columns, table,
        """SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_values FROM {t}""",
    )


def numeric_sql(columns, table: str) -> str:
    return per_column(columns, table, """SELECT '{c}' AS "column",
      round(min(CAST({c} AS DOUBLE)), 4) + 0.0 AS "min", round(max(CAST({c} AS DOUBLE)), 4) + 0.0 AS "max",
      round(avg(CAST({c} AS DOUBLE)), 4) + 0.0 AS "mean",
      round(median(CAST({c} AS DOUBLE)), 4) + 0.0 AS "median",
      round(stddev_samp(CAST({c} AS DOUBLE)), 4) + 0.0 AS "std" FROM {t}""")


def describe_sql(columns, table: str) -> str:
    return per_column(columns, table, """SELECT '{c}' AS "column", count({c}) AS "count",
      round(avg(CAST({c} AS DOUBLE)), 4) + 0.0 AS "mean",
      round(stddev_samp(CAST({c} AS DOUBLE)), 4) + 0.0 AS "std",
      round(min(CAST({c} AS DOUBLE)), 4) + 0.0 AS "min",
      round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) + 0.0 AS q25,
      round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) + 0.0 AS q50,
      round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) + 0.0 AS q75,
      round(max(CAST({c} AS DOUBLE)), 4) + 0.0 AS "max" FROM {t}""")


def numbers_of(columns: dict[str, str]) -> list[str]:
    return [c for c, kind in columns.items() if kind in NUMBERS]


def texts_of(columns: dict[str, str]) -> list[str]:
    return [c for c, kind in columns.items() if kind == "string"]


def duplicates_sql(table: str) -> str:
    return f"((SELECT count(*) FROM {table}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table})))"


def megabytes_sql(columns: dict[str, str], table: str) -> str:
    widths = {"bigint": "8", "int": "4", "double": "8", "timestamp_ntz": "8"}
    size = " + ".join(
        f"coalesce(strlen({c}), 0)" if kind == "string" else widths[kind]
        for c, kind in columns.items()
    )
    return f"(SELECT round(sum({size}) / 1048576.0, 6) + 0.0 FROM {table})"


def top_values_sql(columns, table: str) -> str:
    return per_column(columns, table, """SELECT '{c}' AS "column", value, n, rank FROM (
      SELECT {c} AS value, count(*) AS n,
        CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INT) AS rank
      FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5""")


def column_info_sql(columns: dict[str, str], table: str) -> str:
    types = union_all([
        f"""SELECT {i}::INT AS position, '{c}' AS "column", '{kind}' AS type"""
        for i, (c, kind) in enumerate(columns.items())
    ])
    return f"""
    WITH t AS (SELECT * FROM {table}), types AS ({types}),
    m AS ({missing_sql(columns, "t")}), d AS ({distinct_sql(columns, "t")}),
    s AS ({numeric_sql(numbers_of(columns), "t")}),
    v AS (SELECT "column", string_agg(value || ': ' || n, ', ' ORDER BY rank) AS top_values
      FROM ({top_values_sql(texts_of(columns), "t")}) GROUP BY "column")
    SELECT types.*, missing, missing_pct, unique_values, "min", "max", "mean", "median", "std",
      top_values, CASE WHEN type = 'string' THEN
        unique_values * 1.0 / (SELECT count(*) FROM t) < 0.1 END AS likely_categorical
    FROM types JOIN m USING ("column") JOIN d USING ("column") LEFT JOIN s USING ("column")
      LEFT JOIN v USING ("column")"""


def _counts_sql(table: str, column: str, k: int | None) -> str:
    limit = f"LIMIT {k}" if k else ""
    return f"""SELECT {column} AS value, count(*) AS n FROM {table} WHERE {column} IS NOT NULL
    GROUP BY {column} ORDER BY n DESC, value {limit}"""


def _info_sql(columns: dict[str, str], table: str) -> str:
    cells = " + ".join(f"(count(*) - count({c}))" for c in columns)
    return f"""WITH t AS (SELECT * FROM {table})
    SELECT count(*) AS "rows", CAST({len(columns)} AS BIGINT) AS columns,
      CAST({cells} AS BIGINT) AS missing_cells, {megabytes_sql(columns, "t")} AS estimated_mb,
      CAST({duplicates_sql("t")} AS BIGINT) AS duplicate_rows FROM t"""


_DIRTY = duck(DIRTY_ORDERS)

QUERIES = {
    "column_info": (
        lambda t: rounded(profile.column_info(t.sql(DIRTY_ORDERS)), 4, missing_pct=6),
        column_info_sql(ORDERS, _DIRTY),
    ),
    "column_info_lineitem": (
        lambda t: rounded(profile.column_info(t.lineitem), 4, missing_pct=6),
        column_info_sql(LINES, "lineitem"),
    ),
    "dataset_info": (
        lambda t: rounded(profile.dataset_info(t.sql(DIRTY_ORDERS))), _info_sql(ORDERS, _DIRTY),
    ),
    "dataset_info_documents": (
        lambda t: rounded(profile.dataset_info(t.documents)), _info_sql(DOCUMENTS, "documents"),
    ),
    "dataset_info_conversations": (
        lambda t: rounded(profile.dataset_info(t.conversations)),
        _info_sql(CONVERSATIONS, "conversations"),
    ),
    "embeddings_mb": (
        lambda t: rounded(profile.estimated_mb(t.embeddings)),
        """SELECT round(sum(12 + 4 * len(embedding)) / 1048576.0, 6) + 0.0 AS estimated_mb
        FROM embeddings""",
    ),
    "distinct_documents": (
        lambda t: profile.distinct_by_column(t.documents), distinct_sql(DOCUMENTS, "documents"),
    ),
    "distinct_pages": (
        lambda t: profile.distinct_by_column(t.pages),
        distinct_sql(["page_id", "url", "html"], "pages"),
    ),
    "missing_profile": (
        lambda t: rounded(profile.missing_by_column(t.sql(DIRTY_ORDERS))),
        missing_sql(ORDERS, _DIRTY),
    ),
    "missing_cells": (
        lambda t: profile.missing_cells(t.sql(DIRTY_ORDERS)),
        "SELECT CAST(" + " + ".join(f"(count(*) - count({c}))" for c in ORDERS)
        + f" AS BIGINT) AS missing_cells FROM {_DIRTY}",
    ),
    "duplicate_count": (
        lambda t: profile.duplicate_count(t.sql(DIRTY_LINEITEM)),
        f"SELECT CAST({duplicates_sql(duck(DIRTY_LINEITEM))} AS BIGINT) AS duplicate_rows",
    ),
    "estimated_mb": (
        lambda t: rounded(profile.estimated_mb(t.lineitem)),
        f"SELECT {megabytes_sql(LINES, 'lineitem')} AS estimated_mb",
    ),
    "type_histogram": (
        lambda t: profile.type_histogram(t.lineitem),
        """SELECT CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
            WHEN 'INTEGER' THEN 'int' ELSE lower(column_type) END AS type, count(*) AS columns
        FROM (DESCRIBE lineitem) GROUP BY 1""",
    ),
    "distinct_profile": (
        lambda t: profile.distinct_by_column(t.lineitem), distinct_sql(LINES, "lineitem"),
    ),
    "numeric_profile": (
        lambda t: rounded(profile.numeric_profile(t.sql(DIRTY_LINEITEM)), 4),
        numeric_sql(
            ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"], duck(DIRTY_LINEITEM)
        ),
    ),
    "describe": (
        lambda t: rounded(profile.describe(t.lineitem), 4),
        describe_sql(numbers_of(LINES), "lineitem"),
    ),
    "describe_dirty": (
        lambda t: rounded(profile.describe(t.sql(DIRTY_ORDERS)), 4),
        describe_sql(numbers_of(ORDERS), _DIRTY),
    ),
    "value_counts_top5": (
        lambda t: profile.value_counts(t.sql(DIRTY_ORDERS), "o_orderpriority", 5),
        _counts_sql(_DIRTY, "o_orderpriority", 5),
    ),
    "value_counts_top10": (
        lambda t: profile.value_counts(t.part, "p_brand", 10), _counts_sql("part", "p_brand", 10),
    ),
    "value_counts_top20": (
        lambda t: profile.value_counts(t.part, "p_name", 20), _counts_sql("part", "p_name", 20),
    ),
    "value_counts_all": (
        lambda t: profile.value_counts(t.lineitem, "l_partkey"),
        _counts_sql("lineitem", "l_partkey", None),
    ),
    "top_values": (
        lambda t: profile.top_values(t.part), top_values_sql(texts_of(PARTS), "part"),
    ),
    "likely_categorical": (
        lambda t: rounded(profile.likely_categorical(t.part)),
        per_column(texts_of(PARTS), "part", """SELECT '{c}' AS "column",
          count(DISTINCT {c}) AS unique_values,
          round(count(DISTINCT {c}) * 1.0 / count(*), 6) + 0.0 AS distinct_share,
          count(DISTINCT {c}) * 1.0 / count(*) < 0.1 AS likely_categorical FROM {t}"""),
    ),
    "detect_format": (
        lambda t: profile.detect_format(t.documents),
        """SELECT CASE WHEN ((avg(length(text)) > 100)::INT + (avg(length(lang)) > 100)::INT
          + (avg(length(source)) > 100)::INT) / 5.0 > 0.5 THEN 'text' ELSE 'mixed' END AS format
        FROM documents""",
    ),
    "detect_format_pages": (
        lambda t: profile.detect_format(t.pages),
        """SELECT CASE WHEN ((avg(length(html)) > 100)::INT + (avg(length(url)) > 100)::INT) / 3.0
          > 0.5 THEN 'text' ELSE 'mixed' END AS format FROM pages""",
    ),
    "pair_stats": (
        lambda t: rounded(profile.pair_stats(to_pairs(t.sql(PAIRS), "question", "answer"))),
        f"""SELECT count(*) AS examples,
          CAST(round_even(avg(length(question)), 1) AS DOUBLE) AS mean_input_length,
          count(*) < 5 AS small_dataset FROM {duck(PAIRS)}""",
    ),
}
