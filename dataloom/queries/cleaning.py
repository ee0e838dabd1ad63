"""Cleaning, features, scaling."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from dataloom.operators import clean, features
from dataloom.operators.process import CLEANING, CUSTOM, TRANSFORMATION, process
from dataloom.queries.tables import DIRTY_LINEITEM, DIRTY_ORDERS, Tables, duck, rounded

_DIRTY = duck(DIRTY_ORDERS)
_LINES = duck(DIRTY_LINEITEM)
_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
_TEXTS = ["o_orderstatus", "o_orderpriority"]
_OTHER = ["o_orderdate"]


def _double(name: str) -> str:
    return f"CAST({name} AS DOUBLE)"


def _mode(name: str, table: str) -> str:
    return f"""(SELECT {name} FROM {table} WHERE {name} IS NOT NULL GROUP BY {name}
      ORDER BY count(*) DESC, {name} LIMIT 1)"""


def _few(name: str, table: str, limit: float) -> str:
    return f"(SELECT avg(CASE WHEN {name} IS NULL THEN 1.0 ELSE 0.0 END) FROM {table}) <= {limit}"


def _impute_sql(numbers, texts, other, table: str, digits: int | None = None) -> str:
    def shape(expr: str) -> str:
        return expr if digits is None else f"round({expr}, {digits}) + 0.0"

    filled = [
        shape(f"""coalesce({_double(c)}, CASE WHEN {_few(c, table, 0.2)}
          THEN (SELECT median({_double(c)}) FROM {table}) END)""") + f" AS {c}" for c in numbers
    ] + [
        f"""coalesce({c}, CASE WHEN {_few(c, table, 0.2)}
          THEN coalesce({_mode(c, table)}, 'Unknown') END) AS {c}""" for c in texts
    ]
    return f"SELECT {', '.join([*filled, *other])} FROM {table}"


def _clip_sql(numbers, other, table: str) -> str:
    bounds = ", ".join(
        f"""quantile_cont({_double(c)}, 0.25) AS a_{c}, quantile_cont({_double(c)}, 0.75) AS b_{c},
        avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS s_{c}""" for c in numbers
    )
    clipped = [
        f"""round(CASE WHEN s_{c} <= 0.1 AND {c} IS NOT NULL THEN
          greatest(least({_double(c)}, b_{c} + 1.5 * (b_{c} - a_{c})), a_{c} - 1.5 * (b_{c} - a_{c}))
          ELSE {_double(c)} END, 4) + 0.0 AS {c}""" for c in numbers
    ]
    return f"SELECT {', '.join([*clipped, *other])} FROM {table}, (SELECT {bounds} FROM {table})"


def _clean_sql(numbers, texts, other, table: str) -> str:
    return f"""WITH d AS (SELECT DISTINCT * FROM {table}),
    f AS ({_impute_sql(numbers, texts, other, "d")})
    {_clip_sql(numbers, [*texts, *other], "f")}"""


def _pair_columns(names, kinds=("product", "ratio")) -> list[str]:
    made = []
    for a, b in combinations(names[:5], 2):
        if "product" in kinds:
            made.append(f"{_double(a)} * {_double(b)} AS {a}_{b}_product")
        if "ratio" in kinds:
            made.append(
                f"{_double(a)} / nullif({_double(b)}, 0) AS {a}_{b}_ratio"
            )
    return made


_STATUS = ["F", "O", "P"]
_PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _indicators(name: str, values) -> list[str]:
    return [f"coalesce({name} = '{v}', false) AS \"{name}_{v}\"" for v in values]


def _row_aggregates(names) -> list[str]:
    values = "[" + ", ".join(_double(c) for c in names) + "]"
    return [
        f"round(coalesce(list_sum({values}), 0), 4) + 0.0 AS sum_numeric",
        f"round(list_avg({values}), 4) + 0.0 AS mean_numeric",
        f"round(list_stddev_samp({values}), 4) + 0.0 AS std_numeric",
    ]


def _dirty_columns() -> list[str]:
    return ["o_orderkey", "o_custkey", "round(o_totalprice, 4) + 0.0 AS o_totalprice",
            *_TEXTS, *_OTHER]


def _for_compare(df: DataFrame) -> DataFrame:
    """Rounded, except columns that are one operation on stored values: those are equal
    to the last bit."""
    digits: dict[str, int | None] = {}
    for c in df.columns:
        if c.endswith(("_product", "_ratio", "_normalized")):
            digits[c] = None
        elif c.endswith(("_scaled", "_log")):
            digits[c] = 6
    return rounded(df, 4, **digits)


def _scaled(names, table: str, kinds) -> tuple[list[str], str]:
    stats = ", ".join(
        f"""avg({_double(c)}) AS m_{c}, stddev_pop({_double(c)}) AS s_{c},
        min({_double(c)}) AS lo_{c}, max({_double(c)}) AS hi_{c}""" for c in names
    )
    made = []
    if "log" in kinds:
        made += [f"round(ln({c}), 6) + 0.0 AS {c}_log" for c in kinds["log"]]
    if "scaled" in kinds:
        made += [f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}_scaled" for c in names]
    if "normalized" in kinds:
        made += [
            f"({_double(c)} - lo_{c}) / (hi_{c} - lo_{c}) AS {c}_normalized" for c in names
        ]
    return made, f"{table}, (SELECT {stats} FROM {table})"


_LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax"]
_LINE_COLUMNS = [
    *_LINE_NUMBERS[:4],
    *[f"round({c}, 4) + 0.0 AS {c}" for c in _LINE_NUMBERS[4:]],
]


def _scale_query(kinds) -> str:
    made, source = _scaled(_LINE_NUMBERS, "lineitem", kinds)
    return f"""SELECT {', '.join([*_LINE_COLUMNS, "l_returnflag", "l_linestatus", "l_shipdate", *made])}
    FROM {source}"""


def _transform_sql() -> str:
    made, source = _scaled(_LINE_NUMBERS, "lineitem", {
        "log": ["l_linenumber", "l_quantity", "l_extendedprice"], "scaled": True, "normalized": True
    })
    flags = _indicators("l_returnflag", ["A", "N", "R"]) + _indicators("l_linestatus", ["F", "O"])
    return f"SELECT {', '.join([*_LINE_COLUMNS, 'l_shipdate', *made, *flags])} FROM {source}"


def _mart(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", "p_type", "p_size", "p_retailprice")


def _custom_step(df: DataFrame) -> DataFrame:
    return df.groupBy("c_mktsegment").agg(
        F.count("*").alias("customers"), F.max("c_acctbal").alias("best")
    )


_PART_MADE, _PART_FROM = _scaled(
    ["p_partkey", "p_size", "p_retailprice"], "part",
    {"log": ["p_size", "p_retailprice"], "scaled": True, "normalized": True},
)
_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

QUERIES = {
    "dedupe": (
        lambda t: rounded(clean.dedupe(t.sql(DIRTY_ORDERS)), 4),
        f"SELECT DISTINCT {', '.join(_dirty_columns())} FROM {_DIRTY}",
    ),
    "impute_median": (
        lambda t: rounded(clean.impute_median(t.sql(DIRTY_ORDERS)), 4),
        _impute_sql(_NUMBERS, [], [*_TEXTS, *_OTHER], _DIRTY, 4),
    ),
    "impute_mode": (
        lambda t: rounded(clean.impute_mode(t.sql(DIRTY_ORDERS)), 4),
        _impute_sql([], _TEXTS, ["o_orderkey", "o_custkey",
                                 "round(o_totalprice, 4) + 0.0 AS o_totalprice", *_OTHER], _DIRTY),
    ),
    "clip_iqr": (
        lambda t: rounded(clean.clip_iqr(t.sql(DIRTY_ORDERS)), 4),
        _clip_sql(_NUMBERS, [*_TEXTS, *_OTHER], _DIRTY),
    ),
    "clean": (
        lambda t: rounded(clean.clean(t.sql(DIRTY_ORDERS)), 4),
        _clean_sql(_NUMBERS, _TEXTS, _OTHER, _DIRTY),
    ),
    "clean_lineitem": (
        lambda t: rounded(clean.clean(t.sql(DIRTY_LINEITEM)), 4),
        _clean_sql(["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"],
                   ["l_returnflag"], ["l_shipdate"], _LINES),
    ),
    "engineer_pairs": (
        lambda t: _for_compare(features.pair_features(t.sql(DIRTY_ORDERS))
                               .drop("o_orderstatus", "o_orderpriority", "o_orderdate")),
        f"""SELECT o_orderkey, o_custkey, round(o_totalprice, 4) + 0.0 AS o_totalprice,
          {', '.join(_pair_columns(_NUMBERS))} FROM {_DIRTY}""",
    ),
    "pair_products": (
        lambda t: _for_compare(features.pair_products(t.part)),
        f"""SELECT p_partkey, p_name, p_brand, p_type, p_size,
          round(p_retailprice, 4) + 0.0 AS p_retailprice,
          {', '.join(_pair_columns(["p_partkey", "p_size", "p_retailprice"], ("product",)))} FROM part""",
    ),
    "pair_ratios": (
        lambda t: _for_compare(features.pair_ratios(t.part)),
        f"""SELECT p_partkey, p_name, p_brand, p_type, p_size,
          round(p_retailprice, 4) + 0.0 AS p_retailprice,
          {', '.join(_pair_columns(["p_partkey", "p_size", "p_retailprice"], ("ratio",)))} FROM part""",
    ),
    "one_hot_drop_first": (
        lambda t: rounded(features.one_hot_low_card(t.sql(DIRTY_ORDERS)), 4),
        f"""SELECT {', '.join(_dirty_columns()
            + _indicators("o_orderstatus", _STATUS[1:])
            + _indicators("o_orderpriority", _PRIORITY[1:]))} FROM {_DIRTY}""",
    ),
    "one_hot_all": (
        lambda t: rounded(features.one_hot_all(t.sql(DIRTY_ORDERS)), 4),
        f"""SELECT o_orderkey, o_custkey, round(o_totalprice, 4) + 0.0 AS o_totalprice, o_orderdate,
          {', '.join(_indicators("o_orderstatus", _STATUS)
                     + _indicators("o_orderpriority", _PRIORITY))} FROM {_DIRTY}""",
    ),
    "row_aggregates": (
        lambda t: rounded(features.row_aggregates(t.sql(DIRTY_LINEITEM)), 4),
        f"""SELECT l_orderkey, l_linenumber, round(l_quantity, 4) + 0.0 AS l_quantity,
          round(l_extendedprice, 4) + 0.0 AS l_extendedprice, l_returnflag, l_shipdate,
          {', '.join(_row_aggregates(["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]))}
        FROM {_LINES}""",
    ),
    "engineer": (
        lambda t: _for_compare(features.engineer(t.sql(DIRTY_ORDERS))),
        f"""SELECT {', '.join(_dirty_columns() + _pair_columns(_NUMBERS)
            + _indicators("o_orderstatus", _STATUS[1:])
            + _indicators("o_orderpriority", _PRIORITY[1:])
            + _row_aggregates(_NUMBERS))} FROM {_DIRTY}""",
    ),
    "scale_standard": (
        lambda t: _for_compare(features.scale_standard(t.lineitem)), _scale_query({"scaled": True}),
    ),
    "scale_minmax": (
        lambda t: _for_compare(features.scale_minmax(t.lineitem)), _scale_query({"normalized": True}),
    ),
    "log_positive": (
        lambda t: _for_compare(features.log_positive(t.lineitem)),
        _scale_query({"log": ["l_linenumber", "l_quantity", "l_extendedprice"]}),
    ),
    "transform": (
        lambda t: _for_compare(features.transform(t.lineitem)), _transform_sql(),
    ),
    "process_dispatch": (
        lambda t: _for_compare(process(_mart(t), TRANSFORMATION)),
        f"""SELECT p_partkey, p_size, round(p_retailprice, 4) + 0.0 AS p_retailprice,
          {', '.join(_PART_MADE + _indicators("p_type", _TYPES))} FROM {_PART_FROM}""",
    ),
    "process_cleaning": (
        lambda t: rounded(process(t.sql(DIRTY_ORDERS), CLEANING), 4),
        _clean_sql(_NUMBERS, _TEXTS, _OTHER, _DIRTY),
    ),
    "process_custom": (
        lambda t: rounded(process(t.customer, CUSTOM, _custom_step)),
        """SELECT c_mktsegment, count(*) AS customers, round(max(c_acctbal), 6) + 0.0 AS best
        FROM customer GROUP BY 1""",
    ),
    "process_expressions": (
        lambda t: process(t.customer, CUSTOM, ["c_custkey", "upper(c_mktsegment) AS segment"]),
        "SELECT c_custkey, upper(c_mktsegment) AS segment FROM customer",
    ),
}
