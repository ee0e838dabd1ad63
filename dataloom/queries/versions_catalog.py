"""Versions and catalog, over histories derived from the given tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from dataloom.operators import catalog, versions
from dataloom.plans import states
from dataloom.plans.shared import scratch_path
from dataloom.queries.profiling import (
    ORDERS, distinct_sql, missing_sql, numbers_of, numeric_sql,
)
from dataloom.queries.tables import DIRTY_ORDERS, ORDERS_V2, Tables, dealt_anew, duck, rounded, union_all

# Each customer is a dataset and each order one of its versions.
MANIFEST = """
(SELECT o_custkey AS dataset_id, 'v' || o_orderkey AS version_id,
  CAST(NULL AS STRING) AS parent_version_id, o_orderpriority AS description,
  o_orderdate AS created_at,
  '{{"rows": ' || CAST(o_orderkey * 10 AS STRING) || ', "columns": 6}}' AS metadata,
  'data/' || o_orderkey AS file_path
FROM {orders})
"""

# Chains of eight versions; those with status F were removed.
CHAINS = """
(SELECT CAST(floor(o_orderkey / 8) AS BIGINT) AS dataset_id, 'v' || o_orderkey AS version_id,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE 'v' || (o_orderkey - 1) END AS parent_version_id,
  o_orderstatus AS description, o_orderdate AS created_at, CAST(NULL AS STRING) AS metadata,
  'data/' || o_orderkey AS file_path
FROM {orders})
"""

# Each part is a dataset and each of its order lines one column profile.
DATASETS = "(SELECT p_partkey AS id, p_name AS name, p_type AS source FROM {part})"
COLUMNS = """
(SELECT l_orderkey AS id, l_partkey AS dataset_id, l_returnflag || l_linenumber AS name,
  l_linestatus AS data_type, l_suppkey AS unique_values FROM {lineitem})
"""

# Each order is a new state of its customer's dataset; one market segment was removed.
STATES = """
(SELECT o_custkey AS id, o_orderdate AS updated_at, o_orderkey AS seq, o_orderstatus AS format,
  o_orderpriority AS description FROM {orders})
"""
REMOVED = "(SELECT c_custkey AS id FROM {customer} WHERE c_mktsegment = 'MACHINERY')"

HUB = """
(SELECT source || '/' || doc_id AS id,
  CASE WHEN n_chars % 2 = 0 THEN '' ELSE 'Text of ' || n_chars || ' characters' END AS description,
  CASE WHEN n_chars % 3 = 0 THEN NULL ELSE source END AS author, lang, n_chars AS downloads
FROM {documents})
"""

_DIRTY = duck(DIRTY_ORDERS)


def _snapshot(t: Tables) -> DataFrame:
    store = versions.VersionStore(t.spark, scratch_path(t.spark, "store"))
    version = store.create(1, t.orders, "first", now=dt.datetime(2024, 1, 1))
    return store.load(1, version)


def _restored(t: Tables) -> DataFrame:
    store = versions.VersionStore(t.spark, scratch_path(t.spark, "store"))
    first = store.create(1, t.orders, "first", now=dt.datetime(2024, 1, 1))
    store.create(1, t.sql(ORDERS_V2), "second", now=dt.datetime(2024, 1, 2))
    return store.load(1, store.restore(1, first, now=dt.datetime(2024, 1, 3)))


def _stored_profile(t: Tables) -> DataFrame:
    book = catalog.Catalog(t.spark, scratch_path(t.spark, "catalog"))
    dataset = book.store_profile(t.sql(DIRTY_ORDERS), "orders")
    return rounded(book.columns(dataset), 4, missing_percentage=6)


def _profile_sql() -> str:
    types = union_all([
        f"SELECT {i + 1}::INT AS id, '{c}' AS name, '{kind}' AS data_type"
        for i, (c, kind) in enumerate(ORDERS.items())
    ])
    return f"""WITH t AS (SELECT * FROM {_DIRTY}), c AS ({types}),
    m AS ({missing_sql(ORDERS, "t")}), d AS ({distinct_sql(ORDERS, "t")}),
    s AS ({numeric_sql(numbers_of(ORDERS), "t")})
    SELECT c.id, 1::INT AS dataset_id, c.name, data_type, missing AS missing_values,
      missing_pct AS missing_percentage, unique_values, "min" AS min_value, "max" AS max_value,
      "mean" AS mean_value, "median" AS median_value, "std" AS std_value
    FROM c JOIN m ON m."column" = c.name JOIN d ON d."column" = c.name
      LEFT JOIN s ON s."column" = c.name"""


_SAME = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
_V2 = duck(ORDERS_V2)


def _positional_sql() -> str:
    def placed(table: str) -> str:
        return f"SELECT *, row_number() OVER (ORDER BY o_orderkey) AS position FROM {table}"

    counts = union_all([
        f"""SELECT '{c}' AS "column", false AS type_changed, count(*) FILTER (
          a.position IS NULL OR b.position IS NULL OR a.{c} IS DISTINCT FROM b.{c}) AS differing_rows
        FROM a FULL JOIN b ON a.position = b.position""" for c in _SAME
    ])
    return f"""WITH a AS ({placed("orders")}), b AS ({placed(_V2)})
    {counts} UNION ALL SELECT 'o_custkey', true, NULL::BIGINT"""


def _multiset_sql() -> str:
    each = union_all([
        f"""SELECT '{c}' AS "column", false AS type_changed,
          (SELECT count(*) FROM ((SELECT {c} FROM orders EXCEPT ALL SELECT {c} FROM {_V2})
            UNION ALL (SELECT {c} FROM {_V2} EXCEPT ALL SELECT {c} FROM orders))) > 0
            AS values_changed""" for c in _SAME
    ])
    return f"{each} UNION ALL SELECT 'o_custkey', true, NULL::BOOLEAN"


def _row_diff_sql() -> str:
    values = [c for c in _SAME if c != "o_orderkey"]
    names = ", ".join(f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in values)
    return f"""SELECT * FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
      CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed'
        WHEN concat_ws(',', {names}) <> '' THEN 'changed' END AS change,
      CASE WHEN a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL
        THEN concat_ws(',', {names}) END AS changed_columns
    FROM orders a FULL JOIN {_V2} b ON a.o_orderkey = b.o_orderkey) WHERE change IS NOT NULL"""


def _keyless_sql() -> str:
    cols = "o_orderstatus, o_totalprice, o_orderdate"

    def more(left: str, right: str, change: str) -> str:
        return f"""SELECT {cols}, '{change}' AS change, count(*) AS copies
        FROM (SELECT {cols} FROM {left} EXCEPT ALL SELECT {cols} FROM {right}) GROUP BY ALL"""

    return more("orders", _V2, "removed") + " UNION ALL " + more(_V2, "orders", "added")


def _latest_sql(table: str, key: str, order: str) -> str:
    return f"""SELECT * FROM {table}
    QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1"""


_METRICS = """SELECT dataset_id, version_id[1:8] || '...' AS version, created_at AS date,
  CAST(json_extract(metadata, '$.rows') AS BIGINT) AS "rows",
  CAST(json_extract(metadata, '$.columns') AS BIGINT) AS columns, version_id, description
FROM """

QUERIES = {
    "content_hash": (lambda t: versions.fingerprint(t.lineitem), None),
    "version_snapshot": (_snapshot, "SELECT * FROM orders"),
    "version_restore": (_restored, "SELECT * FROM orders"),
    "version_history": (
        lambda t: versions.list_versions(t.sql(MANIFEST)), f"SELECT * FROM {duck(MANIFEST)}",
    ),
    "version_get": (
        lambda t: versions.get_version(t.sql(CHAINS), 2, "v17"),
        f"SELECT * FROM {duck(CHAINS)} WHERE dataset_id = 2 AND version_id = 'v17'",
    ),
    "version_latest": (
        lambda t: versions.latest_version(t.sql(MANIFEST)),
        _latest_sql(duck(MANIFEST), "dataset_id", "created_at DESC, version_id DESC"),
    ),
    "version_metrics": (
        lambda t: versions.version_metrics(t.sql(MANIFEST)), _METRICS + duck(MANIFEST),
    ),
    "version_delete_reparent": (
        lambda t: versions.live_versions(
            t.sql(CHAINS), t.sql(CHAINS).filter("description = 'F'")),
        f"""SELECT dataset_id, version_id, up AS parent_version_id, description, created_at,
          metadata, file_path FROM (
          SELECT *, last_value(CASE WHEN description <> 'F' THEN version_id END IGNORE NULLS) OVER (
            PARTITION BY dataset_id ORDER BY CAST(version_id[2:] AS BIGINT)
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up
          FROM {duck(CHAINS)}) WHERE description <> 'F'""",
    ),
    "schema_diff": (
        lambda t: versions.schema_diff(t.orders, t.sql(ORDERS_V2)),
        f"""SELECT c."column", change, from_type, to_type,
          (SELECT count(*) FROM {_V2}) - (SELECT count(*) FROM orders) AS rows_diff
        FROM (VALUES ('o_orderpriority', 'removed', 'string', NULL), ('o_year', 'added', NULL, 'int'),
          ('o_custkey', 'type_changed', 'bigint', 'string')) c("column", change, from_type, to_type)""",
    ),
    "value_diff_multiset": (
        lambda t: versions.value_diff(t.orders, t.sql(ORDERS_V2)), _multiset_sql(),
    ),
    "value_diff_positional": (
        lambda t: versions.value_diff_positional(t.orders, t.sql(ORDERS_V2), ["o_orderkey"]),
        _positional_sql(),
    ),
    "row_diff": (
        lambda t: versions.row_diff(t.orders, t.sql(ORDERS_V2), ["o_orderkey"]), _row_diff_sql(),
    ),
    "row_diff_keyless": (
        lambda t: rounded(versions.row_diff_keyless(
            t.orders.drop("o_orderkey", "o_custkey", "o_orderpriority"),
            t.sql(ORDERS_V2).drop("o_orderkey", "o_custkey"))),
        f"SELECT * REPLACE (round(o_totalprice, 6) + 0.0 AS o_totalprice) FROM ({_keyless_sql()})",
    ),
    "pending_changes": (
        lambda t: versions.pending_changes(t.orders, t.sql(ORDERS_V2)),
        f"""SELECT (SELECT count(*) FROM {_V2}) - (SELECT count(*) FROM orders) AS rows_diff,
          0::BIGINT AS columns_diff, false AS unchanged""",
    ),
    "pending_nothing": (
        lambda t: versions.pending_changes(
            t.lineitem, dealt_anew(t.lineitem, "l_partkey", "l_orderkey").sortWithinPartitions("l_tax")),
        "SELECT 0::BIGINT AS rows_diff, 0::BIGINT AS columns_diff, true AS unchanged",
    ),
    "catalog_profile": (_stored_profile, _profile_sql()),
    "catalog_lookup": (
        lambda t: catalog.with_columns_of(t.sql(DATASETS), t.sql(COLUMNS)),
        f"""SELECT d.id, d.name, d.source, c.name AS "column", c.data_type, c.unique_values
        FROM {duck(DATASETS)} d JOIN {duck(COLUMNS)} c ON c.dataset_id = d.id""",
    ),
    "catalog_by_id": (
        lambda t: catalog.by_id(t.sql(DATASETS), 42),
        f"SELECT * FROM {duck(DATASETS)} WHERE id = 42",
    ),
    "catalog_by_name": (
        lambda t: catalog.by_name(t.sql(DATASETS), "red widget"),
        f"SELECT * FROM {duck(DATASETS)} WHERE name = 'red widget' ORDER BY id LIMIT 1",
    ),
    "catalog_latest_state": (
        lambda t: states.without_removed(
            states.latest_state(t.sql(STATES), "id", ["updated_at", "seq"]),
            t.sql(REMOVED), {"id": "id"}),
        f"""SELECT * FROM ({_latest_sql(duck(STATES), "id", "updated_at DESC, seq DESC")})
        WHERE id NOT IN (SELECT id FROM {duck(REMOVED)})""",
    ),
    "catalog_cascade": (
        lambda t: states.without_removed(
            t.orders.select("o_orderkey", "o_custkey"), t.sql(REMOVED), {"o_custkey": "id"}),
        f"""SELECT o_orderkey, o_custkey FROM orders
        WHERE o_custkey NOT IN (SELECT id FROM {duck(REMOVED)})""",
    ),
    "catalog_search": (
        lambda t: catalog.search(
            t.sql(HUB).withColumn("tags", F.array("lang", F.element_at(F.split("id", "/"), 1))), "fr"
        ).withColumn("tags", F.concat_ws(",", "tags")),
        f"""SELECT id, split_part(id, '/', 2) AS name,
          coalesce(nullif(description, ''), 'No description available') AS description,
          coalesce(author, 'Unknown') AS author, lang || ',' || split_part(id, '/', 1) AS tags,
          downloads
        FROM {duck(HUB)} WHERE lang = 'fr' ORDER BY downloads DESC, id LIMIT 20""",
    ),
}
