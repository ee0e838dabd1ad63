"""Aggregates behind charts."""

from __future__ import annotations

from itertools import combinations

from dataloom.operators import charts
from dataloom.operators.validate import flag_outliers
from dataloom.plans.shared import stored
from dataloom.queries.profiling import LINES, numbers_of
from dataloom.queries.tables import DIRTY_LINEITEM, DIRTY_ORDERS, TYPED_TEXT, duck, rounded, union_all

_DIRTY = duck(DIRTY_ORDERS)

# Whole numbers: sums are exact in any order, so means compare without rounding.
CENTS = "(SELECT event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM {events})"


def _histogram_sql(table: str, column: str, bins: int, color: str | None = None) -> str:
    extra = ", color" if color else ""
    of = f", {color} AS color" if color else ""
    frame = f"(SELECT DISTINCT {color} AS color FROM {table} WHERE {column} IS NOT NULL), " if color else ""
    match = " AND c.color IS NOT DISTINCT FROM f.color" if color else ""
    return f"""
    WITH l AS (SELECT min({column}) AS lo, max({column}) AS hi, (max({column}) - min({column})) / {bins} AS w
      FROM {table}),
    c AS (SELECT least(floor(({column} - lo) / w), {bins - 1})::INT AS bin{of}, count(*) AS n
      FROM {table}, l WHERE {column} IS NOT NULL GROUP BY ALL),
    f AS (SELECT range::INT AS bin{extra} FROM {frame} range({bins}))
    SELECT f.bin, round(lo + f.bin * w, 6) + 0.0 AS bin_start,
      round(lo + (f.bin + 1) * w, 6) + 0.0 AS bin_end{", f.color" if color else ""},
      coalesce(n, 0) AS n
    FROM l, f LEFT JOIN c ON c.bin = f.bin{match}"""


def _density_sql(table: str, column: str, bins: int) -> str:
    return f"""SELECT *, round(n / ((SELECT count({column}) FROM {table})
      * (SELECT (max({column}) - min({column})) / {bins} FROM {table})), 8) + 0.0 AS density
    FROM ({_histogram_sql(table, column, bins)})"""


def _smoothed_sql(table: str, column: str, *keys: str) -> str:
    key = ", ".join(keys)
    return f"""
    WITH t AS (SELECT {key}, {column} AS x, row_number() OVER (ORDER BY {column} NULLS LAST, {key}) - 1
      AS position FROM {table}),
    w AS (SELECT CASE WHEN count(*) > 10 THEN count(*) // 10 ELSE count(*) END AS w FROM t),
    r AS (SELECT position, {key}, x, sum(x) OVER p AS s, count(x) OVER p AS c
      FROM t WINDOW p AS (ORDER BY position)),
    e AS (SELECT max(position) AS last, max(c) AS c, max_by(s, position) AS s FROM r)
    SELECT r.position, {', '.join(f'r.{k}' for k in keys)}, CAST(r.x AS DOUBLE) AS x,
      CAST(coalesce(u.s, e.s, 0) - coalesce(b.s, 0) AS DOUBLE)
        / nullif(coalesce(u.c, e.c) - coalesce(b.c, 0), 0) AS smoothed
    FROM r, w, e
    LEFT JOIN r u ON u.position = least(r.position + (w - 1) // 2, e.last)
    LEFT JOIN r b ON b.position = r.position - w // 2 - 1"""


def _box_sql(table: str, y: str, by: str | None) -> str:
    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    where = f"WHERE {by} IS NOT NULL AND {y} IS NOT NULL" if by else f"WHERE {y} IS NOT NULL"
    join = f"JOIN f USING ({by})" if by else "CROSS JOIN f"
    out = ", ".join(
        f"round({f}, 6) + 0.0 AS {f}"
        for f in ("q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low", "whisker_high")
    )
    return f"""
    WITH t AS (SELECT * FROM {table} {where}),
    q AS (SELECT {key} quantile_cont({y}, 0.25) AS q1, median({y}) AS median,
      quantile_cont({y}, 0.75) AS q3 FROM t {group}),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q),
    a AS (SELECT {key} count(*) AS n, max(q1) AS q1, max(median) AS median, max(q3) AS q3,
      max(lower_fence) AS lower_fence, max(upper_fence) AS upper_fence,
      min({y}) FILTER ({y} BETWEEN lower_fence AND upper_fence) AS whisker_low,
      max({y}) FILTER ({y} BETWEEN lower_fence AND upper_fence) AS whisker_high,
      count(*) FILTER ({y} NOT BETWEEN lower_fence AND upper_fence) AS outliers
      FROM t {join} {group})
    SELECT {key} n, {out}, outliers FROM a"""


def _kde_sql(table: str, y: str, by: str, bins: int | None = None) -> str:
    value = y if bins is None else (
        f"lo + (least(floor(({y} - lo) / ((hi - lo) / {bins})), {bins - 1}) + 0.5) * ((hi - lo) / {bins})"
    )
    return f"""
    WITH s AS (SELECT {by} AS g, count(*) AS n, min({y}) AS lo, max({y}) AS hi,
      1.06 * stddev_samp({y}) * pow(count(*), -0.2) AS h FROM {table} GROUP BY {by}),
    v AS (SELECT g, {value} AS v, count(*) AS c FROM {table} JOIN s ON g = {by} GROUP BY ALL),
    p AS (SELECT s.*, range::INT AS point, lo + range * ((hi - lo) / 63) AS x FROM s, range(64))
    SELECT p.g AS "group", point, round(max(x), 6) + 0.0 AS x,
      round(sum(c * exp(-0.5 * pow((x - v) / h, 2))) / max(n * h) / sqrt(2 * pi()), 9) + 0.0 AS density
    FROM p JOIN v ON v.g = p.g GROUP BY p.g, point"""


def _pairs_sql(table: str, names: list[str]) -> str:
    one = ", ".join(
        f"corr({a}, {b}) AS r{i}" for i, (a, b) in enumerate(combinations(names, 2))
    )
    rows = union_all([
        f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, r{i} AS r FROM one"
        for i, (a, b) in enumerate(combinations(names, 2))
    ])
    return f"""(WITH one AS (SELECT {one} FROM {table}) SELECT feature_1, feature_2,
      CASE WHEN isnan(r) THEN NULL ELSE round(r, 6) + 0.0 END AS correlation FROM ({rows}))"""


def _matrix_sql(table: str, names: list[str]) -> str:
    diagonal = union_all([
        f"SELECT '{c}', '{c}', CASE WHEN (SELECT stddev_pop({c}) FROM {table}) > 0 THEN 1.0::DOUBLE END"
        for c in names
    ])
    return f"""WITH p AS (SELECT * FROM {_pairs_sql(table, names)})
    SELECT feature_1, feature_2, correlation FROM p
    UNION ALL SELECT feature_2, feature_1, correlation FROM p UNION ALL {diagonal}"""


def _series_sql(table: str, bucket: str, value: str) -> str:
    return f"""SELECT {bucket} AS period, {value} AS value FROM {table}
    WHERE {bucket} IS NOT NULL GROUP BY 1 ORDER BY 1"""


def _trend_sql(series: str, axis: str) -> str:
    return f"""
    WITH s AS ({series}), x AS (SELECT *, {axis} AS x FROM s),
    l AS (SELECT regr_slope(value, x - m) AS slope, regr_intercept(value, x - m) AS mid,
      regr_r2(value, x - m) AS r2, max(m) AS m FROM x, (SELECT avg(x) AS m FROM x))
    SELECT period, round(value, 4) + 0.0 AS value, round(mid + slope * (x - m), 4) + 0.0 AS fitted,
      round(slope, 10) + 0.0 AS slope, round(mid - slope * m, 3) + 0.0 AS intercept,
      round(r2, 6) + 0.0 AS r2 FROM x, l"""


def _trend(df):
    return rounded(df, 4, slope=10, intercept=3, r2=6)


_NUMBERS = numbers_of(LINES)
_EVENT_SUMS = _series_sql("events", "CAST(ts AS DATE)", "sum(value)")

QUERIES = {
    "histogram": (
        lambda t: rounded(charts.histogram(t.lineitem, "l_extendedprice", 20)),
        _histogram_sql("lineitem", "l_extendedprice", 20),
    ),
    "histogram_by": (
        lambda t: rounded(charts.histogram(t.sql(DIRTY_ORDERS), "o_totalprice", 50, "o_orderpriority")),
        _histogram_sql(_DIRTY, "o_totalprice", 50, "o_orderpriority"),
    ),
    "histogram_text": (
        lambda t: charts.histogram(t.orders, "o_orderpriority", color="o_orderstatus"),
        """SELECT o_orderpriority AS value, o_orderstatus AS color, count(*) AS n FROM orders
        GROUP BY 1, 2""",
    ),
    "histogram_density": (
        lambda t: rounded(charts.density_histogram(t.events, "value", 40), density=8),
        _density_sql("events", "value", 40),
    ),
    "smoothed_sorted": (
        lambda t: charts.smoothed_sorted(t.sql(CENTS), "cents", ["event_id"]),
        _smoothed_sql(duck(CENTS), "cents", "event_id"),
    ),
    "smoothed_sorted_missing": (
        lambda t: charts.smoothed_sorted(
            t.sql(DIRTY_LINEITEM), "l_quantity", ["l_orderkey", "l_linenumber"]),
        _smoothed_sql(duck(DIRTY_LINEITEM), "l_quantity", "l_orderkey", "l_linenumber"),
    ),
    "box_summary": (
        lambda t: rounded(charts.box_summary(t.lineitem, "l_extendedprice", "l_returnflag")),
        _box_sql("lineitem", "l_extendedprice", "l_returnflag"),
    ),
    "box_summary_all": (
        lambda t: rounded(charts.box_summary(t.events, "value")),
        _box_sql("events", "value", None),
    ),
    "box_by_color": (
        lambda t: rounded(charts.box_summary(
            t.orders, "o_totalprice", "o_orderstatus", "o_orderpriority")),
        _box_sql("orders", "o_totalprice", "o_orderstatus, o_orderpriority")
        .replace("WHERE o_orderstatus, o_orderpriority IS NOT NULL AND", "WHERE"),
    ),
    "box_by_flag": (
        # The flag takes several passes to compute: written once, then read by the box's.
        lambda t: rounded(charts.box_summary(
            stored(flag_outliers(t.events.select("value"), "value")), "value", "is_outlier")),
        _box_sql("""(SELECT value, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
          AS is_outlier FROM events, (SELECT quantile_cont(value, 0.25) AS q1,
          quantile_cont(value, 0.75) AS q3 FROM events))""", "value", "is_outlier"),
    ),
    "kde_by_group": (
        lambda t: rounded(charts.violin(t.events, "value", "event_type"), 6, density=9),
        _kde_sql("events", "value", "event_type"),
    ),
    "kde_binned": (
        lambda t: rounded(charts.violin(t.lineitem, "l_extendedprice", "l_returnflag", bins=512),
                          6, density=9),
        _kde_sql("lineitem", "l_extendedprice", "l_returnflag", 512),
    ),
    "correlation_matrix": (
        lambda t: rounded(charts.correlation_matrix(t.lineitem)),
        _matrix_sql("lineitem", _NUMBERS),
    ),
    "correlation_missing": (
        lambda t: rounded(charts.correlation_pairs(t.sql(DIRTY_ORDERS))),
        f"SELECT * FROM {_pairs_sql(_DIRTY, ['o_orderkey', 'o_custkey', 'o_totalprice'])}",
    ),
    "top_correlations": (
        lambda t: rounded(charts.top_correlations(t.lineitem, 10)),
        f"""SELECT * FROM {_pairs_sql("lineitem", _NUMBERS)}
        ORDER BY abs(correlation) DESC NULLS LAST, feature_1, feature_2 LIMIT 10""",
    ),
    "group_describe": (
        lambda t: rounded(charts.group_describe(t.lineitem, "l_returnflag", "l_extendedprice"), 4),
        """SELECT l_returnflag, count(l_extendedprice) AS "count",
          round(avg(l_extendedprice), 4) + 0.0 AS "mean",
          round(stddev_samp(l_extendedprice), 4) + 0.0 AS "std",
          round(min(l_extendedprice), 4) + 0.0 AS "min", round(max(l_extendedprice), 4) + 0.0 AS "max",
          round(quantile_cont(l_extendedprice, 0.25), 4) + 0.0 AS q25,
          round(quantile_cont(l_extendedprice, 0.5), 4) + 0.0 AS q50,
          round(quantile_cont(l_extendedprice, 0.75), 4) + 0.0 AS q75
        FROM lineitem GROUP BY l_returnflag""",
    ),
    "group_describe_many": (
        lambda t: rounded(charts.group_describe(t.lineitem, "l_partkey", "l_quantity"), 4),
        """SELECT l_partkey, count(l_quantity) AS "count", round(avg(l_quantity), 4) + 0.0 AS "mean",
          round(stddev_samp(l_quantity), 4) + 0.0 AS "std", round(min(l_quantity), 4) + 0.0 AS "min",
          round(max(l_quantity), 4) + 0.0 AS "max",
          round(quantile_cont(l_quantity, 0.25), 4) + 0.0 AS q25,
          round(quantile_cont(l_quantity, 0.5), 4) + 0.0 AS q50,
          round(quantile_cont(l_quantity, 0.75), 4) + 0.0 AS q75
        FROM lineitem GROUP BY l_partkey""",
    ),
    "date_like_columns": (
        lambda t: charts.date_like_columns(t.sql(TYPED_TEXT), ["o_orderkey"]),
        union_all([
            f"""SELECT '{c}' AS "column", 'text' AS kind FROM (SELECT bool_and({c} LIKE '%/%' OR
            {c} LIKE '%-%') AS dated FROM (SELECT {c} FROM {duck(TYPED_TEXT)}
            WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT 5)) WHERE dated"""
            for c in ("num_text", "date_text", "mixed_text")
        ]),
    ),
    "ts_day": (
        lambda t: rounded(charts.time_series(t.events, "ts", "value", "day", "sum"), 2),
        _series_sql("events", "CAST(ts AS DATE)", "round(sum(value), 2) + 0.0"),
    ),
    "ts_week": (
        lambda t: rounded(charts.time_series(t.events, "ts", "value", "week", "mean")),
        _series_sql("events", "CAST(date_trunc('week', ts) AS TIMESTAMP)", "round(avg(value), 6) + 0.0"),
    ),
    "ts_month": (
        lambda t: rounded(charts.time_series(t.orders, "o_orderdate", "o_totalprice", "month"), 4),
        _series_sql("orders", "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)",
                    "round(avg(o_totalprice), 4) + 0.0"),
    ),
    "ts_quarter": (
        lambda t: rounded(charts.time_series(
            t.lineitem, "l_shipdate", "l_extendedprice", "quarter", "max"), 4),
        _series_sql("lineitem", "CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP)",
                    "round(max(l_extendedprice), 4) + 0.0"),
    ),
    "ts_year": (
        lambda t: charts.time_series(t.sql(DIRTY_ORDERS), "o_orderdate", "o_totalprice", "year", "count"),
        _series_sql(_DIRTY, "CAST(year(o_orderdate) AS INT)", "count(o_totalprice)"),
    ),
    "ts_min_integer": (
        lambda t: charts.time_series(t.orders, "o_orderdate", "o_custkey", "month", "min"),
        _series_sql("orders", "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP)", "min(o_custkey)"),
    ),
    "ts_text_dates": (
        lambda t: charts.time_series(t.sql(TYPED_TEXT), "date_text", "o_orderkey", "month", "count"),
        _series_sql(duck(TYPED_TEXT), "CAST(date_trunc('month', CAST(date_text AS DATE)) AS TIMESTAMP)",
                    "count(o_orderkey)"),
    ),
    "ts_trendline": (
        lambda t: _trend(charts.trendline(charts.time_series(t.events, "ts", "value", "day", "sum"))),
        _trend_sql(_EVENT_SUMS, "epoch(period)"),
    ),
    "ts_trendline_year": (
        lambda t: _trend(charts.trendline(
            charts.time_series(t.orders, "o_orderdate", "o_totalprice", "year", "mean"))),
        _trend_sql(_series_sql("orders", "CAST(year(o_orderdate) AS INT)", "avg(o_totalprice)"), "period"),
    ),
    "pie_counts": (
        lambda t: charts.pie(t.sql(DIRTY_ORDERS), "o_orderpriority"),
        f"""SELECT o_orderpriority AS category, count(*) AS size FROM {_DIRTY}
        WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY size DESC, category LIMIT 10""",
    ),
    "pie_sums": (
        lambda t: rounded(charts.pie(t.part, "p_brand", "p_retailprice", 10), 2),
        """SELECT p_brand AS category, round(sum(p_retailprice), 2) + 0.0 AS size FROM part
        GROUP BY 1 ORDER BY sum(p_retailprice) DESC, category LIMIT 10""",
    ),
    "pie_all": (
        lambda t: charts.pie(t.part, "p_type", top_n=0),
        "SELECT p_type AS category, count(*) AS size FROM part GROUP BY 1",
    ),
    "bar_totals": (
        lambda t: rounded(charts.bar_totals(
            t.sql(DIRTY_ORDERS), "o_orderpriority", "o_totalprice", "o_orderstatus"), 2),
        f"""SELECT o_orderpriority AS x, o_orderstatus AS color,
          round(coalesce(sum(o_totalprice), 0), 2) + 0.0 AS total FROM {_DIRTY} GROUP BY 1, 2""",
    ),
}
