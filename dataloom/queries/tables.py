"""The given tables, and inputs derived from them by the same SQL in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dataloom.functions.columns import fixed, quoted

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# A table with missing values (some columns above, some below a fifth), repeated rows
# and extreme prices.
DIRTY_ORDERS = """
(WITH base AS (
  SELECT o_orderkey, o_custkey,
    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL
         WHEN o_orderkey % 97 = 0 THEN o_totalprice * 20
         ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
    o_orderdate
  FROM {orders})
SELECT * FROM base UNION ALL SELECT * FROM base WHERE o_orderkey % 50 = 0)
"""

DIRTY_LINEITEM = """
(WITH base AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
    CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
    CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
    l_shipdate
  FROM {lineitem})
SELECT * FROM base UNION ALL SELECT * FROM base WHERE l_orderkey % 40 = 0)
"""

# Text columns that hold numbers, dates, and a mixture.
TYPED_TEXT = """
(SELECT o_orderkey,
  CAST(o_custkey AS STRING) AS num_text,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_text,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS STRING) ELSE 'n/a' END AS mixed_text
FROM {orders})
"""

# Two versions of a table: rows removed and changed, a type change, a column gone and
# one new.
ORDERS_V2 = """
(SELECT o_orderkey, CAST(o_custkey AS STRING) AS o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 25 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
  o_orderdate, CAST(year(o_orderdate) AS INT) AS o_year
FROM {orders} WHERE o_orderkey % 100 <> 0)
"""

PADDED_TEXT = """
(SELECT c_custkey,
  CASE WHEN c_custkey % 9 = 0 THEN '   ' ELSE '  ' || c_name || ' ' END AS c_name,
  c_mktsegment
FROM {customer})
"""

# A user's turn with the assistant's answer.
PAIRS = """
(SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer
FROM {conversations} u JOIN {conversations} a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant')
"""

# Status events and log lines of training runs.
JOB_EVENTS = """
(SELECT user_id AS job_id, ts, event_id,
  CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'running'
    WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'log' END AS status,
  props AS metrics, value
FROM {events})
"""


def duck(template: str) -> str:
    """The template over the plain table names."""
    return template.format(**{n: n for n in NAMES})


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, template: str) -> DataFrame:
        text = template.strip()
        used = {n: getattr(self, n) for n in NAMES if "{" + n + "}" in text}
        return self.spark.sql(f"SELECT * FROM {text}", **used)


def dealt_anew(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows in other tasks, as many as the session shuffles into; ``columns`` tell
    rows apart, so that no task gets many more than others."""
    return df.repartition(*columns)


# The benchmark turns the rounding off: it serves the comparison, not the operator.
ROUND = True


def rounded(df: DataFrame, digits: int = 6, **per_column: int | None) -> DataFrame:
    """Doubles rounded for comparison, as engines add up in different orders; a column
    given None stays as it is."""

    if not ROUND:
        return df

    def shown(field: T.StructField):
        places = per_column.get(field.name, digits)
        if places is None or not isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return quoted(field.name)
        return fixed(quoted(field.name), places).alias(field.name)

    return df.select(*[shown(f) for f in df.schema])


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def text_list(column: str):
    """An array of numbers as text, for comparison."""
    return F.concat_ws(" ", F.col(column).cast("array<string>"))
