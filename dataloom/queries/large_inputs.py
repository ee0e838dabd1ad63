"""Inputs that one task should not hold: files of many ranges, texts that begin alike,
tables that grow, vocabularies beyond a broadcast, metrics of any shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dataloom.operators import catalog, pairs, profile, runs
from dataloom.plans.shared import scratch_path
from dataloom.queries.pairs_runs import VOCABULARY, encoded_sql, pairs_of
from dataloom.queries.preview_sources import as_documents, in_files
from dataloom.queries.tables import Tables, duck, text_list, union_all
from dataloom.sources import readers, writers

# Values with line breaks, quotes and delimiters.
NOTES = """
(SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'plain' WHEN 1 THEN 'of "' || o_orderpriority || '",' || chr(10) || chr(10) || 'open'
    WHEN 2 THEN '"' || chr(10) || ',' || o_orderstatus || '""' ELSE 'two' || chr(10) || 'lines' END AS note, o_custkey
FROM {orders})
"""


def _csv_multiline(t: Tables) -> DataFrame:
    """Files of many ranges; the types are inferred."""
    path = scratch_path(t.spark, "csv")
    writers.write_csv(in_files(t.sql(NOTES)), path)
    return readers.read_csv(t.spark, path).select(
        F.col("o_orderkey").cast("long").alias("o_orderkey"), "note", F.col("o_custkey").cast("long").alias("o_custkey")
    )


def _json_one_line(t: Tables) -> DataFrame:
    """Files of many ranges without a line end."""
    path = scratch_path(t.spark, "json")
    as_documents(in_files(t.documents), "[", "]", path, ending=" ")
    return readers.read_json(t.spark, path, t.documents.schema)


def _json_ranges(t: Tables) -> DataFrame:
    """Records with records inside; the types are inferred."""
    path = scratch_path(t.spark, "json")
    rows = t.orders.select(
        "o_orderkey", F.array(F.struct(F.lit("}]\"{").alias("sign"), F.col("o_custkey").alias("key")), F.struct(F.lit(None).cast("string").alias("sign"), F.lit(1).cast("long").alias("key"))).alias("parts"),
    )
    as_documents(in_files(rows, 2), "[", "]", path)
    return readers.read_json(t.spark, path).select(
        "o_orderkey", F.col("parts")[0]["sign"].alias("sign"), F.col("parts")[0]["key"].alias("o_custkey"), F.size("parts").cast("long").alias("n")
    )


# Pages, and texts of which many occur once and begin alike.
PAGES = """
(SELECT CASE WHEN page_id % 9 = 0 THEN '<html>' ELSE html END AS html, '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>' || url AS page, url
FROM {pages})
"""


def _top_sql() -> str:
    return union_all([
        f"""SELECT * FROM (SELECT '{c}' AS "column", {c} AS value, count(*) AS n,
          row_number() OVER (ORDER BY count(*) DESC, {c})::INT AS rank FROM {duck(PAGES)} GROUP BY {c} QUALIFY rank <= 5)"""
        for c in ("html", "page", "url")
    ])


def _profile_merged(t: Tables) -> DataFrame:
    """Three parts of the lines, each sketched when it comes; and whether the estimates are
    within their error: 3 % of the distinct values, 2 % of the rows for the median's rank."""
    lines = t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    book = catalog.Catalog(t.spark, scratch_path(t.spark, "catalog"))
    for part in range(3):
        book.append_profile(1, lines.filter(F.col("l_orderkey") % 3 == part))
    found = book.merged_profile(1)
    exact = profile.distinct_by_column(lines).withColumnRenamed("unique_values", "exact")
    numbers = ["l_orderkey", "l_quantity", "l_extendedprice"]
    # One row a column; medians are compared by their rank in the column.
    medians = {r["column"]: r["median"] for r in found.select("column", "median").collect()}
    ranks = lines.agg(*[F.struct(
        F.avg((F.col(c) < medians[c]).cast("double")).alias("below"), F.avg((F.col(c) <= medians[c]).cast("double")).alias("upto")
    ).alias(c) for c in numbers])
    placed = ranks.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), f"{c}.below", f"{c}.upto") for c in numbers])))
    near = (F.col("below") <= 0.52) & (F.col("upto") >= 0.48)
    return found.join(F.broadcast(exact), "column").join(F.broadcast(placed), "column", "left").select(
        "column", "rows", "missing", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        (F.abs(F.col("unique_values") - F.col("exact")) <= F.greatest(F.lit(1), F.col("exact") * 0.03)).alias("distinct_near"),
        F.when(F.col("below").isNotNull(), near).alias("median_near"),
    )


def _merged_sql() -> str:
    numbers = union_all([
        f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS missing, min({c})::DOUBLE AS "min",
          max({c})::DOUBLE AS "max", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, true AS distinct_near,
          true AS median_near FROM lineitem"""
        for c in ("l_orderkey", "l_quantity", "l_extendedprice")
    ])
    others = union_all([
        f"""SELECT '{c}' AS "column", count(*) AS "rows", count(*) - count({c}) AS missing, NULL, NULL, NULL, NULL, true, NULL FROM lineitem"""
        for c in ("l_returnflag", "l_shipdate")
    ])
    return f"{numbers} UNION ALL {others}"


def _encoded_large(t: Tables) -> DataFrame:
    """The vocabulary has more words than may be broadcast."""
    text = pairs_of(t)
    vocab = pairs.build_vocab(text, ["input", "target"], VOCABULARY)
    ready = pairs.add_prefix(text, "Comment to Code")
    rows = pairs.encode_pairs(ready, vocab, ["conv_id", "turn"], max_in=64, max_tgt=32, max_vocabulary=100)
    return rows.withColumns({c: text_list(c) for c in ("input_ids", "attention_mask", "labels")})


# Objects of several shapes, a metric of two types, a list.
METRICS = """
(SELECT user_id AS job_id, event_id, CASE event_id % 5
    WHEN 0 THEN '{{"loss": {{"train": ' || CAST(event_id % 100 AS STRING) || '.5}}, "k": "' || event_type || '"}}'
    WHEN 1 THEN 'no metrics' WHEN 2 THEN NULL
    ELSE '{{"k": ' || CAST(event_id % 7 AS STRING) || ', "steps": [1, ' || CAST(event_id AS STRING) || ']}}' END AS metrics
FROM {events})
"""

QUERIES = {
    "csv_multiline": (_csv_multiline, f"SELECT * FROM {duck(NOTES)}"),
    "json_one_line": (_json_one_line, "SELECT * FROM documents"),
    "json_ranges": (
        _json_ranges, """SELECT o_orderkey, '}]"{' AS sign, o_custkey, 2::BIGINT AS n FROM orders""",
    ),
    "top_values_pages": (lambda t: profile.top_values(t.sql(PAGES)), _top_sql()),
    "catalog_profile_merged": (_profile_merged, _merged_sql()),
    "encode_pairs_large_vocab": (_encoded_large, encoded_sql()),
    "metric_series_nested": (
        lambda t: runs.metric_columns(t.sql(METRICS)).withColumnRenamed("loss.train", "loss_train"),
        """SELECT user_id AS job_id, event_id,
          CASE event_id % 5 WHEN 0 THEN '"' || event_type || '"' WHEN 3 THEN CAST(event_id % 7 AS VARCHAR)
            WHEN 4 THEN CAST(event_id % 7 AS VARCHAR) END AS k,
          CASE WHEN event_id % 5 = 0 THEN (event_id % 100 + 0.5)::DOUBLE END AS loss_train,
          CASE WHEN event_id % 5 >= 3 THEN '[1,' || event_id || ']' END AS steps FROM events""",
    ),
}
