"""Quality, type suggestions, outliers."""

from __future__ import annotations

from dataloom.operators import validate
from dataloom.queries.profiling import LINES, ORDERS, duplicates_sql, missing_sql, per_column
from dataloom.queries.tables import (
    DIRTY_LINEITEM, DIRTY_ORDERS, TYPED_TEXT, duck, rounded,
)

_DIRTY = duck(DIRTY_ORDERS)

def _quality_sql(columns, table: str) -> str:
    cells = " + ".join(f"(count(*) - count({c}))" for c in columns)
    return f"""
    WITH t AS (SELECT * FROM {table}),
    a AS (SELECT count(*) AS n, {cells} AS lost, {duplicates_sql("t")} AS dup FROM t),
    p AS (SELECT *, lost * 100.0 / (n * {len(columns)}) AS mp, dup * 100.0 / n AS dp FROM a)
    SELECT n AS "rows", n * {len(columns)} AS cells, CAST(lost AS BIGINT) AS missing_cells,
      round(mp, 6) + 0.0 AS missing_pct, round(100 - mp, 6) + 0.0 AS completeness,
      CAST(dup AS BIGINT) AS duplicate_rows, round(dp, 6) + 0.0 AS duplicate_pct,
      round(greatest(0.0, least(100.0, 100 - (mp + dp))), 6) + 0.0 AS quality_score FROM p"""


def _bounds(table: str, column: str) -> str:
    return f"""(SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound
    FROM (SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {table}))"""


_LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag",
                 "l_shipdate"]
_NAMES = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate"
_ROUNDED = _NAMES.replace("o_totalprice", "round(o_totalprice, 6) + 0.0 AS o_totalprice")

QUERIES = {
    "quality_metrics": (
        lambda t: rounded(validate.quality_metrics(t.sql(DIRTY_ORDERS))),
        _quality_sql(ORDERS, _DIRTY),
    ),
    "quality_metrics_lineitem": (
        lambda t: rounded(validate.quality_metrics(t.lineitem)), _quality_sql(LINES, "lineitem"),
    ),
    "missing_status": (
        lambda t: rounded(validate.missing_status(t.sql(DIRTY_LINEITEM))),
        f"""SELECT "column", missing, percentage, CASE WHEN percentage < 5 THEN 'Good'
          WHEN percentage < 20 THEN 'Warning' ELSE 'Critical' END AS status
        FROM (SELECT "column", missing, CAST(round_even(missing_pct, 2) AS DOUBLE) AS percentage
          FROM ({missing_sql(_LINE_COLUMNS, duck(DIRTY_LINEITEM))}) WHERE missing > 0)""",
    ),
    "type_suggestions": (
        lambda t: validate.type_suggestions(t.sql(TYPED_TEXT)),
        f"""SELECT "column", 'string' AS current_type, suggested_type FROM (
          SELECT "column", CASE WHEN numbers > 0.8 THEN 'numeric' WHEN dates > 0.8 THEN 'datetime'
            END AS suggested_type FROM ("""
        + per_column(["num_text", "date_text", "mixed_text"], duck(TYPED_TEXT),
                     """SELECT '{c}' AS "column",
            avg(CASE WHEN TRY_CAST({c} AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS numbers,
            avg(CASE WHEN TRY_CAST({c} AS TIMESTAMP) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS dates
          FROM {t} WHERE {c} IS NOT NULL""")
        + ")) WHERE suggested_type IS NOT NULL",
    ),
    "completeness_check": (
        lambda t: validate.completeness_check(t.sql(DIRTY_ORDERS)),
        f"""SELECT "column", format('{{:.2f}}%', 100 - missing_pct) AS completeness,
          format('{{:.2f}}%', missing_pct) AS missing,
          'Consider imputing or removing this column' AS recommendation
        FROM ({missing_sql(ORDERS, _DIRTY)}) WHERE 1 - missing_pct / 100 < 0.8""",
    ),
    "outliers_iqr": (
        lambda t: rounded(validate.outliers_iqr(t.sql(DIRTY_ORDERS), "o_totalprice")),
        f"""SELECT {_ROUNDED}, round(lower_bound, 6) + 0.0 AS lower_bound,
          round(upper_bound, 6) + 0.0 AS upper_bound
        FROM {_DIRTY}, {_bounds(_DIRTY, "o_totalprice")}
        WHERE o_totalprice < lower_bound OR o_totalprice > upper_bound""",
    ),
    "outliers_zscore": (
        lambda t: rounded(validate.outliers_zscore(t.sql(DIRTY_ORDERS), "o_totalprice", 3.0)),
        f"""SELECT {_ROUNDED}, round((o_totalprice - m) / p, 6) + 0.0 AS z,
          round(m - 3 * s, 6) + 0.0 AS lower_bound, round(m + 3 * s, 6) + 0.0 AS upper_bound
        FROM {_DIRTY}, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS p,
          stddev_samp(o_totalprice) AS s FROM {_DIRTY})
        WHERE abs((o_totalprice - m) / p) > 3""",
    ),
    "outlier_report": (
        lambda t: rounded(validate.outlier_report(t.sql(DIRTY_ORDERS), "o_totalprice")),
        f"""SELECT count(*) FILTER (o_totalprice < lower_bound OR o_totalprice > upper_bound) AS outliers,
          round(count(*) FILTER (o_totalprice < lower_bound OR o_totalprice > upper_bound) * 100.0
            / count(*), 6) + 0.0 AS outlier_pct,
          round(max(lower_bound), 6) + 0.0 AS lower_bound,
          round(max(upper_bound), 6) + 0.0 AS upper_bound
        FROM {_DIRTY}, {_bounds(_DIRTY, "o_totalprice")}""",
    ),
    "outlier_report_events": (
        lambda t: rounded(validate.outlier_report(t.events, "value")),
        f"""SELECT count(*) FILTER (value < lower_bound OR value > upper_bound) AS outliers,
          round(count(*) FILTER (value < lower_bound OR value > upper_bound) * 100.0 / count(*), 6)
            + 0.0 AS outlier_pct,
          round(max(lower_bound), 6) + 0.0 AS lower_bound,
          round(max(upper_bound), 6) + 0.0 AS upper_bound
        FROM events, {_bounds("events", "value")}""",
    ),
    "outlier_flag": (
        lambda t: rounded(validate.flag_outliers(t.sql(DIRTY_ORDERS), "o_totalprice")),
        f"""SELECT {_ROUNDED},
          coalesce(o_totalprice < lower_bound OR o_totalprice > upper_bound, false) AS is_outlier
        FROM {_DIRTY}, {_bounds(_DIRTY, "o_totalprice")}""",
    ),
}
