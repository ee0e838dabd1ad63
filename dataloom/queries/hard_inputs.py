"""Inputs with ties, long and nested values, clashing names, repeated and missing keys,
mixed dates and malformed rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from dataloom.functions.columns import require_columns
from dataloom.operators import charts, clean, features, pairs, preview, profile, versions
from dataloom.plans.shared import scratch_path
from dataloom.queries.preview_sources import as_documents
from dataloom.queries.tables import Tables, dealt_anew, duck, rounded, union_all
from dataloom.sources import readers

# Three texts of equal number that differ behind their hundredth character.
LONG_TIES = """
(SELECT doc_id, CASE WHEN doc_id % 8 <> 7 THEN repeat('Zeta ', 25) || CAST(doc_id % 4 AS STRING) END AS label
FROM {documents})
"""

MIXED_DATES = """
(SELECT o_orderkey, o_totalprice, CASE o_orderkey % 9
    WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
    WHEN 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T10:00:00.5'
    WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 1:30:00+01:00'
    WHEN 3 THEN date_format(o_orderdate, 'M/d/yyyy')
    WHEN 4 THEN date_format(o_orderdate, 'M.d.yyyy')
    WHEN 5 THEN date_format(o_orderdate, 'MMM d, yyyy')
    WHEN 6 THEN date_format(o_orderdate, 'd MMMM yyyy h:mm a')
    WHEN 7 THEN date_format(o_orderdate, 'yyyyMMdd')
    WHEN 8 THEN date_format(o_orderdate, CASE WHEN day(o_orderdate) > 12 THEN 'd/M/yyyy' ELSE 'yyyy/M/d' END)
  END AS moment FROM {orders})
"""

CLASHES = """
(SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'a' END AS flag, p_size AS flag_b FROM {part})
"""

# Lines of an order share their key; some orders are gone and some quantities changed.
LINES_V2 = """
(SELECT l_orderkey, CASE WHEN l_orderkey % 50 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_tax
FROM {lineitem} WHERE l_orderkey % 70 <> 1)
"""

MISSING_KEYS = """
(SELECT CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS customer, o_totalprice{change} AS price FROM {orders})
"""
_OLD_KEYS = MISSING_KEYS.replace("{change}", "")
_NEW_KEYS = MISSING_KEYS.replace("{change}", " + CASE WHEN o_orderkey % 25 = 1 THEN 1 ELSE 0 END")

_MANY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"]


def _nested(t: Tables, later: bool = False) -> DataFrame:
    """Arrays and structs that differ only in the place of their NULLs."""
    none, kind = F.lit(None).cast("int"), F.col("vec_id") % 3
    arrays = [F.array(none, F.lit(1)), F.array(F.lit(1), none), F.array(F.lit(1))]
    if later:
        arrays = [arrays[1], arrays[0], arrays[2]]
    struct = F.when(F.col("vec_id") % 2 == 0, F.struct(none.alias("a"), F.lit(1).alias("b"))).otherwise(
        F.struct(F.lit(1).alias("a"), none.alias("b"))
    )
    return t.embeddings.select(
        F.when(kind == 0, arrays[0]).when(kind == 1, arrays[1]).otherwise(arrays[2]).alias("items"), struct.alias("pair")
    )


def _csv_malformed(t: Tables) -> DataFrame:
    """Every tenth row has one field too many and is, on request, left out."""
    path = scratch_path(t.spark, "csv")
    wide = F.when(F.col("o_orderkey") % 10 == 0, F.lit("x,y")).otherwise(F.col("o_orderpriority"))
    rows = t.orders.select("o_orderkey", "o_custkey", wide.alias("o_orderpriority"))
    rows.write.option("header", True).option("quote", "").csv(path)
    return readers.read_csv(t.spark, path, "o_orderkey long, o_custkey long, o_orderpriority string", malformed="drop")


def _json_nested_inferred(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "nested")
    as_documents(t.part, '{"name": "parts", "records": [', "]}", path)
    return readers.read_json_nested(t.spark, path)


def _json_nested_typed(t: Tables) -> DataFrame:
    """The caller's types count, also where others would be inferred."""
    path = scratch_path(t.spark, "nested") + ".json"
    as_documents(t.part, '{"name": "parts", "records": [', "]}", path)
    return readers.read_dataset(t.spark, path, "p_partkey string, p_size string, p_name string")


def _sample_holds(t: Tables) -> DataFrame:
    """Size, distinctness, origin and repeatability of a sample."""
    key = ["l_orderkey", "l_linenumber"]
    lines = t.lineitem.groupBy(*key).agg(F.count("*").alias("copies"))
    one, again = preview.sample(lines, key, 100, 3), preview.sample(dealt_anew(lines, "l_linenumber", "l_orderkey"), key, 100, 3)
    return one.withColumn("own", F.lit(1)).join(again, key, "full").join(lines.select(*key, F.lit(1).alias("there")), key, "left").agg(
        F.count("*").alias("rows"), F.count("own").alias("sampled"), F.count("there").alias("found")
    )


def _hash_holds(t: Tables) -> DataFrame:
    """A fingerprint does not see row order and sees one edit."""
    moved = dealt_anew(t.lineitem, "l_partkey", "l_orderkey").sortWithinPartitions("l_tax")
    edited = t.lineitem.withColumn("l_tax", F.when(
        (F.col("l_orderkey") == t.lineitem.agg(F.max("l_orderkey")).first()[0]), F.col("l_tax") + 1
    ).otherwise(F.col("l_tax")))
    own, same, other = (
        versions.fingerprint(d).select("rows", F.col("content_hash").alias(n)) for d, n in ((t.lineitem, "a"), (moved, "b"), (edited, "c"))
    )
    return own.join(same, "rows").join(other, "rows").select(
        "rows", (F.col("a") == F.col("b")).alias("kept"), (F.col("a") != F.col("c")).alias("changed")
    )


def _split_holds(t: Tables) -> DataFrame:
    """Exact test size; the same split after the rows were dealt anew."""
    one = pairs.train_test_split(t.orders, "o_orderkey", 0.1, seed=1).select("o_orderkey", "split")
    again = pairs.train_test_split(dealt_anew(t.orders, "o_custkey", "o_orderkey"), "o_orderkey", 0.1, seed=1)
    both = one.join(again.select("o_orderkey", F.col("split").alias("other")), "o_orderkey")
    return both.groupBy("split").agg(F.count("*").alias("rows"), F.count_if(F.col("split") == F.col("other")).alias("same"))


def _products_sql() -> str:
    made = ", ".join(
        f"round(CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE), 6) + 0.0 AS {a}_{b}_product" for a, b in combinations(_MANY, 2)
    )
    return f"SELECT {', '.join(_MANY[:4])}, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _MANY[4:])}, {made} FROM lineitem"


QUERIES = {
    "impute_mode_long_ties": (
        lambda t: clean.impute_mode(t.sql(LONG_TIES)),
        f"""WITH t AS (SELECT * FROM {duck(LONG_TIES)})
        SELECT doc_id, coalesce(label, (SELECT label FROM t WHERE label IS NOT NULL GROUP BY label
          ORDER BY count(*) DESC, label LIMIT 1)) AS label FROM t""",
    ),
    "top_values_documents": (
        lambda t: profile.top_values(t.documents, ["text", "source"], 20),
        union_all([
            f"""SELECT '{c}' AS "column", {c} AS value, count(*) AS n,
              CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) AS INT) AS rank
            FROM documents GROUP BY {c} QUALIFY rank <= 20""" for c in ("text", "source")
        ]),
    ),
    "pair_products_named": (
        lambda t: rounded(features.pair_products(t.lineitem.select(*_MANY), _MANY)), _products_sql(),
    ),
    "one_hot_clash": (
        lambda t: features.one_hot_low_card(t.sql(CLASHES)),
        f"""SELECT p_partkey, flag, flag_b, flag = 'B' AS "flag_B_2", flag = 'a' AS flag_a FROM {duck(CLASHES)}""",
    ),
    "ts_text_mixed": (
        lambda t: rounded(charts.time_series(t.sql(MIXED_DATES), "moment", "o_totalprice", "day", "count")),
        """SELECT CAST(o_orderdate AS DATE) AS period, count(o_totalprice) AS value FROM orders GROUP BY 1""",
    ),
    "csv_malformed": (
        _csv_malformed, "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0",
    ),
    "json_nested_inferred": (
        _json_nested_inferred, "SELECT * REPLACE (CAST(p_size AS BIGINT) AS p_size) FROM part",
    ),
    "json_nested_typed": (
        _json_nested_typed, "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_name FROM part",
    ),
    "duplicate_count_nested": (
        lambda t: profile.duplicate_count(_nested(t)), "SELECT count(*) - 6 AS duplicate_rows FROM embeddings",
    ),
    "value_diff_nested": (
        lambda t: versions.value_diff(_nested(t), _nested(t, later=True)),
        """SELECT 'items' AS "column", false AS type_changed, (SELECT count(*) FILTER (vec_id % 3 = 0)
          <> count(*) FILTER (vec_id % 3 = 1) FROM embeddings) AS values_changed
        UNION ALL SELECT 'pair', false, false""",
    ),
    "pending_nested": (
        lambda t: versions.pending_changes(_nested(t), _nested(t, later=True)),
        "SELECT 0::BIGINT AS rows_diff, 0::BIGINT AS columns_diff, false AS unchanged",
    ),
    "row_diff_repeated_keys": (
        lambda t: versions.row_diff(t.lineitem.select("l_orderkey", "l_quantity", "l_tax"), t.sql(LINES_V2), ["l_orderkey"]),
        """SELECT DISTINCT l_orderkey, CASE WHEN l_orderkey % 70 = 1 THEN 'removed' ELSE 'changed' END AS change,
          CASE WHEN l_orderkey % 70 <> 1 THEN 'l_quantity' END AS changed_columns
        FROM lineitem WHERE l_orderkey % 70 = 1 OR l_orderkey % 50 = 0""",
    ),
    "row_diff_null_keys": (
        lambda t: versions.row_diff(t.sql(_OLD_KEYS), t.sql(_NEW_KEYS), ["customer"]),
        f"""SELECT CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS customer, 'changed' AS change, 'price' AS changed_columns
        FROM orders GROUP BY 1 HAVING bool_or(o_orderkey % 25 = 1)""",
    ),
    "require_columns": (
        lambda t: require_columns(t.orders, ["o_orderkey", "o_totalprice"]), "SELECT * FROM orders",
    ),
    "sample_holds": (
        _sample_holds, """SELECT least(100, n) AS "rows", least(100, n) AS sampled, least(100, n) AS found
        FROM (SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS n FROM lineitem)""",
    ),
    "content_hash_holds": (
        _hash_holds, """SELECT count(*) AS "rows", true AS kept, true AS changed FROM lineitem""",
    ),
    "split_holds": (
        _split_holds,
        """SELECT split, "rows", "rows" AS same FROM (
          SELECT 'test' AS split, CAST(ceil(count(*) * 0.1) AS BIGINT) AS "rows" FROM orders
          UNION ALL SELECT 'train', count(*) - CAST(ceil(count(*) * 0.1) AS BIGINT) FROM orders)""",
    ),
}
