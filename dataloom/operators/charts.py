"""The aggregates behind charts: distributions, correlation, categories, time series."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dataloom.functions.columns import (
    canonicalise, datetime_columns, epoch_micros, quoted, text_columns,
)
from dataloom.functions.parsing import parse_datetime
from dataloom.plans.long_form import first_texts, named, numeric_long, numeric_of
from dataloom.plans.one_row import as_struct, with_row
from dataloom.plans.positions import with_running
from dataloom.plans.quantiles import attach, group_quantiles

# Positions of a sorted table that one task brings together.
POSITIONS = 1 << 18


def _value(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, canonicalised: the scan reads nothing else."""
    return canonicalise(df.select(*[quoted(n) for n in dict.fromkeys(names)]))


def histogram(df: DataFrame, column: str, bins: int = 20, color: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max], empty ones included: bin, bin_start, bin_end,
    [color,] n. A text column gives one count per value instead."""
    if column in text_columns(df):
        keys = [quoted(column).alias("value")] + ([quoted(color).alias("color")] if color else [])
        return df.filter(quoted(column).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    if not 5 <= bins <= 100:
        raise ValueError("bins must be 5 to 100")
    rows = _value(df, column, *([color] if color else [])).filter(quoted(column).isNotNull())
    value = quoted(column).cast("double")
    limits = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("_stats.hi") - F.col("_stats.lo")) / bins
    place = F.coalesce(
        F.least(F.floor(F.try_divide(value - F.col("_stats.lo"), width)), F.lit(bins - 1)),
        F.lit(0),
    ).cast("int")
    keyed = with_row(rows, limits).select(
        place.alias("bin"), *([quoted(color).alias("color")] if color else [])
    )
    counts = keyed.groupBy(*keyed.columns).agg(F.count("*").alias("n"))
    # The frame of the chart comes from the counted bins: one map of at most 100 per color.
    filled = counts.groupBy(*(["color"] if color else [])).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_counts")
    )
    frame = with_row(filled, limits).filter("_stats.lo is not null").withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))
    )
    return frame.withColumn("n", F.try_element_at("_counts", F.col("bin"))).select(
        "bin",
        (F.col("_stats.lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("_stats.lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        *(["color"] if color else []),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def density_histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Histogram whose bars have total area one."""
    counts = histogram(df, column, bins)
    # At most 100 rows reach this window.
    rows = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("density", F.try_divide("n", rows * (F.col("bin_end") - F.col("bin_start"))))


def smoothed_sorted(df: DataFrame, column: str, key: list[str]) -> DataFrame:
    """Values in rising order with a centred moving mean over a tenth of the rows.

    The window is floor(rows / 10), or all rows when there are at most ten. Means come
    from running sums: row i needs the sum up to the last row of its window and the sum
    before the first, so each row sends its running sum to the two rows that need it
    and one grouping by position brings the three together, in tasks of POSITIONS each.
    """
    rows = canonicalise(
        df.select(*[quoted(k).alias(k) for k in key], quoted(column).cast("double").alias("x"))
    )
    order = [F.asc_nulls_last("x"), *[quoted(k) for k in key]]
    running, totals = with_running(rows, order, "x")
    n = F.col("_stats.n")
    window = F.when(n > 10, F.floor(n / 10)).otherwise(n)
    below, above = F.floor(window / 2), F.floor((window - 1) / 2)
    point, nothing = F.col("position"), F.lit(None)

    def part(target: Column, role: str) -> Column:
        own = role == "own"
        return F.struct(
            target.cast("long").alias("at"),
            *[(quoted(c) if own else nothing).alias(c) for c in [*key, "x"]],
            *[
                (F.col(c) if role == r else nothing).alias(f"{r}_{c}")
                for r in ("upto", "before") for c in ("run_sum", "run_count")
            ],
        )

    sent = with_row(running, totals).select("_stats", F.explode(F.array(
        part(point, "own"), part(point - above, "upto"), part(point + below + 1, "before"),
    )).alias("m")).filter((F.col("m.at") >= 0) & (F.col("m.at") < n))
    names = [*key, "x", *[f"{r}_{c}" for r in ("upto", "before") for c in ("run_sum", "run_count")]]
    # Dealt before it is grouped: what arrives together has few positions, where a
    # task's own share of the rows has one for nearly each.
    tasks = 1 + totals.first()["n"] // POSITIONS
    dealt = sent.select("m.*").repartition(tasks, "at")
    met = dealt.groupBy(F.col("at").alias("position")).agg(*[F.max(quoted(c)).alias(c) for c in names])
    met = with_row(met, totals)
    total = F.coalesce(F.col("upto_run_sum"), F.col("_stats.sum")) - F.coalesce(
        F.col("before_run_sum"), F.lit(0.0)
    )
    count = F.coalesce(F.col("upto_run_count"), F.col("_stats.seen")) - F.coalesce(
        F.col("before_run_count"), F.lit(0)
    )
    return met.select(
        "position", *[quoted(k) for k in key], "x", F.try_divide(total, count).alias("smoothed")
    )


def box_summary(
    df: DataFrame, y: str, by: str | None = None, color: str | None = None
) -> DataFrame:
    """Quartiles, fences, whiskers (extremes inside the fences) and outlier count, for
    the whole column or per group."""
    keys = [k for k in (by, color) if k]
    rows = _value(df, y, *keys).filter(quoted(y).isNotNull())
    whole = not keys
    if whole:
        # The whole column is the one group of the long form.
        rows, keys, y = numeric_long(rows, [y]), ["column"], "value"
    quartiles = group_quantiles(
        rows, keys, y, {"q1": 0.25, "median": 0.5, "q3": 0.75}, bounded=whole, size="n"
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fences = quartiles.withColumns({
        "lower_fence": F.col("q1") - reach, "upper_fence": F.col("q3") + reach
    })
    value = quoted(y).cast("double")
    inside = value.between(F.col("lower_fence"), F.col("upper_fence"))
    names = ("q1", "median", "q3", "lower_fence", "upper_fence")
    boxes = (
        attach(rows, fences, keys, "n", whole)
        .groupBy(*[quoted(k) for k in keys])
        .agg(
            F.count("*").alias("n"),
            *[F.max(c).alias(c) for c in names],
            F.min(F.when(inside, value)).alias("whisker_low"),
            F.max(F.when(inside, value)).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )
    return boxes.drop("column") if whole else boxes


def violin(df: DataFrame, y: str, by: str, grid: int = 64, bins: int | None = None) -> DataFrame:
    """Gaussian density per group on an even grid from minimum to maximum.

    Bandwidth 1.06 * s * n^(-1/5). Each batch of rows adds to one sum for each point of a
    group's grid; these are combined in the task before the shuffle. With ``bins`` the rows are first
    counted per bin and the bin centres meet the grid: one pass over the rows instead of
    ``grid`` kernel values per row.
    """
    rows = _value(df, y, by).select(quoted(by).alias("group"), quoted(y).cast("double").alias("v"))
    rows = rows.filter("group is not null and v is not null")
    stats = rows.groupBy("group").agg(
        F.count("*").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.stddev_samp("v").alias("s"),
    )
    if bins:
        width = (F.col("hi") - F.col("lo")) / bins
        place = F.coalesce(
            F.least(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(bins - 1)),
            F.lit(0),
        )
        centre = F.when(width > 0, F.col("lo") + (place + 0.5) * width).otherwise(F.col("v"))
        per_bin = [F.col(c) for c in ("rows", "lo", "hi", "s")]
        weighted = attach(rows, stats, ["group"], "rows").groupBy(
            "group", centre.alias("v"), *per_bin
        ).agg(F.count("*").alias("c"))
    else:
        weighted = attach(rows, stats, ["group"], "rows").withColumn("c", F.lit(1))
    bandwidth = F.lit(1.06) * F.col("s") * F.pow(F.col("rows"), F.lit(-0.2))
    placed = weighted.withColumn("h", bandwidth).filter("h > 0").select(
        "group", "v", F.col("c").cast("double").alias("c"), "lo", "hi", "h", F.col("rows").cast("long").alias("rows")
    )
    sums = _kernel_sums(placed, grid).groupBy("group", "point").agg(
        F.sum("m").alias("m"), *[F.max(c).alias(c) for c in ("rows", "lo", "hi", "h")]
    )
    step = (F.col("hi") - F.col("lo")) / (grid - 1)
    norm = F.col("rows") * F.col("h") * (2 * 3.141592653589793) ** 0.5
    return sums.select(
        "group", "point", (F.col("lo") + F.col("point") * step).alias("x"), (F.col("m") / norm).alias("density")
    )


# Rows whose kernel values are computed together.
_KERNEL_ROWS = 4096


def _kernel_sums(placed: DataFrame, grid: int) -> DataFrame:
    """(group, point, m, lo, hi, h, rows): for each point of a group's grid the kernel
    values of a batch's rows, added up by one matrix product."""
    points = np.arange(grid)
    schema = f"group {placed.schema['group'].dataType.simpleString()}, point int, m double, lo double, hi double, h double, rows long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            v, c, lo, hi, h, rows = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 7))
            found = []
            for start, end in zip(starts, [*starts[1:], len(order)]):
                one, total = order[start], np.zeros(grid)
                x = lo[one] + points * (hi[one] - lo[one]) / (grid - 1)
                for at in range(start, end, _KERNEL_ROWS):
                    own = order[at: min(at + _KERNEL_ROWS, end)]
                    total += np.exp(-0.5 * ((x[:, None] - v[own]) / h[one]) ** 2) @ c[own]
                found.append(total)
            if not found:
                continue
            firsts = np.repeat(order[starts], grid)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(firsts)), pa.array(np.tile(points, len(found)).astype(np.int32)),
                pa.array(np.concatenate(found)), *(pa.array(a[firsts]) for a in (lo, hi, h, rows)),
            ], ["group", "point", "m", "lo", "hi", "h", "rows"])

    return placed.mapInArrow(run, schema)


# A variance below this share of the mean square is rounding: the column is constant there.
_ROUNDING = 1e-13


def _pair_sums(doubles: DataFrame, pairs: list[tuple[int, int]], shifts: list[float]) -> DataFrame:
    """(pair, n, x, y, xx, yy, xy, odd): sums over the rows where both columns have a value,
    and the number of infinite ones among them.

    Each task multiplies matrices of its batches and sends one row per pair, so neither
    rows nor pairs of values are multiplied out.
    """
    k, base = len(shifts), np.array(shifts)
    left, right = (np.array([p[side] for p in pairs]) for side in (0, 1))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares, products, odd = (np.zeros((k, k)) for _ in range(5))
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            there = (~np.isnan(values)).astype(float)
            moved = np.where(np.isfinite(values), values - base, 0.0)
            odd += np.isinf(values).T.astype(float) @ there
            n += there.T @ there
            sums += moved.T @ there
            squares += (moved * moved).T @ there
            products += moved.T @ moved
        found = [n[left, right], sums[left, right], sums[right, left], squares[left, right], squares[right, left], products[left, right]]
        found.append(odd[left, right] + odd[right, left])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(pairs), dtype=np.int32)), *(pa.array(f) for f in found)], ["pair", *names]
        )

    names = ["n", "x", "y", "xx", "yy", "xy", "odd"]
    parts = doubles.mapInArrow(add_up, ", ".join(["pair int", *[f"{c} double" for c in names]]))
    return parts.groupBy("pair").agg(*[F.sum(c).alias(c) for c in names])


def _pairwise(df: DataFrame, names: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """(feature_1, feature_2, correlation) of the given pairs, each over the rows where
    both columns have a value; NULL where either is constant or infinite there.

    A first pass takes each column's smallest value, from which values are measured; one
    row of them goes to the tasks.
    """
    doubles = df.select(*[quoted(n).cast("double").alias(f"c{i}") for i, n in enumerate(names)])
    least = doubles.agg(*[F.min(F.when(F.abs(c) < float("inf"), F.col(c))).alias(c) for c in doubles.columns]).first()
    place = {n: i for i, n in enumerate(names)}
    sums = _pair_sums(doubles, [(place[a], place[b]) for a, b in pairs], [0.0 if v is None else v for v in least])

    def spread(squares: str, total: str) -> Column:
        variance = F.col(squares) - F.col(total) * F.try_divide(total, "n")
        return F.when(variance <= F.col(squares) * _ROUNDING, 0.0).otherwise(F.sqrt(variance))

    joint = F.col("xy") - F.col("x") * F.try_divide("y", "n")
    r = F.when(F.col("odd") == 0, F.try_divide(joint, spread("xx", "x") * spread("yy", "y")))
    # greatest and least skip NULL, so a constant column needs its own branch.
    clamped = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    labels = df.sparkSession.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(pairs)],
        "pair int, feature_1 string, feature_2 string",
    )
    # One row per pair of columns on both sides.
    return labels.join(F.broadcast(sums.select("pair", clamped.alias("correlation"))), "pair", "left").select(
        "feature_1", "feature_2", "correlation"
    )


def correlation_pairs(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of each two numeric columns, upper triangle."""
    df = canonicalise(df)
    names = numeric_of(df, columns)
    if len(names) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    return _pairwise(df, names, list(combinations(names, 2)))


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long form of the full matrix; the diagonal is 1, or NULL for a constant column."""
    df = canonicalise(df)
    names = numeric_of(df, columns)
    upper = _pairwise(df, names, list(combinations_with_replacement(names, 2)))
    same = F.col("feature_1") == F.col("feature_2")
    value = F.when(same & F.col("correlation").isNotNull(), 1.0).otherwise(F.col("correlation"))
    cells = F.array(
        F.struct("feature_1", "feature_2", value.alias("correlation")),
        F.struct(
            F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"),
            value.alias("correlation"),
        ),
    )
    return upper.select(F.inline(F.slice(cells, F.lit(1), F.when(same, 1).otherwise(2))))


def top_correlations(
    df: DataFrame, k: int | None = 10, columns: list[str] | None = None
) -> DataFrame:
    ordered = correlation_pairs(df, columns).orderBy(
        F.abs("correlation").desc_nulls_last(), "feature_1", "feature_2"
    )
    return ordered.limit(k) if k else ordered


def group_describe(df: DataFrame, by: str, y: str) -> DataFrame:
    """The eight usual statistics of ``y`` per category."""
    rows = _value(df, by, y).filter(quoted(by).isNotNull())
    value = quoted(y).cast("double")
    moments = rows.groupBy(quoted(by)).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
    )
    quartiles = group_quantiles(rows, [by], y, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quartiles, by, "left")


def date_like_columns(df: DataFrame, key: list[str], look_at: int = 5) -> DataFrame:
    """Datetime columns, and text columns whose first values all hold '/' or '-'."""
    session = df.sparkSession
    found = [
        session.createDataFrame([(c, "datetime")], "column string, kind string")
        for c in datetime_columns(df)
    ]
    texts = text_columns(df)
    if texts:
        dated = first_texts(df, texts, key, look_at).groupBy("column").agg(
            F.bool_and(F.col("text").rlike("[/-]")).alias("dated")
        )
        found.append(named(dated.filter("dated"), texts).select("column", F.lit("text").alias("kind")))
    if not found:
        return session.createDataFrame([], "column string, kind string")
    return reduce(DataFrame.unionAll, found)


_PERIODS = {"week": "week", "month": "month", "quarter": "quarter"}
_AGGREGATES = ("mean", "sum", "min", "max", "count")


def time_series(
    df: DataFrame, ts: str, y: str, period: str, agg: str = "mean", unread: str = "raise"
) -> DataFrame:
    """(period, value): ``y`` aggregated per day, week (from Monday), month, quarter or
    year. A text column is read as dates; rows without a date are left out. A text that is
    not a date stops the job, or, with ``unread="drop"``, is left out as well."""
    if unread not in ("raise", "drop"):
        raise ValueError(f"unread is 'raise' or 'drop', not {unread!r}")
    when = quoted(ts)
    if ts in text_columns(df):
        text, when = when, parse_datetime(when)
        if unread == "raise":
            stop = F.raise_error(F.concat(F.lit(f"not a date in {ts}: "), F.substring(text, 1, 100)))
            when = F.when(text.isNotNull() & when.isNull(), stop.cast("timestamp_ntz")).otherwise(when)
    when = when.cast("timestamp_ntz")
    if period == "day":
        bucket = F.to_date(when)
    elif period == "year":
        bucket = F.year(when)
    elif period in _PERIODS:
        bucket = F.date_trunc(_PERIODS[period], when).cast("timestamp_ntz")
    else:
        raise ValueError(f"unknown period {period!r}")
    if agg not in _AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r}; one of {_AGGREGATES}")
    value = F.col("v")
    result = {
        "mean": F.avg(value), "min": F.min(value), "max": F.max(value), "count": F.count(value),
        "sum": F.coalesce(F.sum(value), F.lit(0)),
    }[agg]
    rows = _value(df, ts, y).select(bucket.alias("period"), quoted(y).alias("v"))
    return rows.filter("period is not null").groupBy("period").agg(result.alias("value")).orderBy(
        "period"
    )


def trendline(series: DataFrame, x: str = "period", y: str = "value") -> DataFrame:
    """Least-squares line through a time series: each point with its fitted value.

    x is in seconds since 1970, or the number itself for years. Sums are taken around
    the mean of x, which keeps their precision.
    """
    kind = series.schema[x].dataType.simpleString()
    axis = quoted(x).cast("double")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        axis = epoch_micros(quoted(x).cast("timestamp_ntz")) / 1e6
    points = series.withColumn("_x", axis).withColumn("_y", quoted(y).cast("double"))
    centre = points.agg(F.avg("_x").alias("mx"))
    near = with_row(points, centre, "_centre").withColumn("_dx", F.col("_x") - F.col("_centre.mx"))
    line = near.agg(
        F.regr_slope("_y", "_dx").alias("slope"), F.regr_intercept("_y", "_dx").alias("middle"),
        F.regr_r2("_y", "_dx").alias("r2"),
    )
    slope = F.col("_line.slope")
    return with_row(near, line, "_line").select(
        quoted(x), quoted(y), (F.col("_line.middle") + slope * F.col("_dx")).alias("fitted"),
        slope.alias("slope"),
        (F.col("_line.middle") - slope * F.col("_centre.mx")).alias("intercept"),
        F.col("_line.r2").alias("r2"),
    )


def pie(df: DataFrame, category: str, value: str | None = None, top_n: int = 10) -> DataFrame:
    """Row count or sum of ``value`` per category, largest first; 0 keeps all."""
    rows = _value(df, category, *([value] if value else [])).filter(quoted(category).isNotNull())
    size = F.coalesce(F.sum(quoted(value)), F.lit(0)) if value else F.count("*")
    slices = rows.groupBy(quoted(category).alias("category")).agg(size.alias("size")).orderBy(
        F.desc("size"), F.asc("category")
    )
    return slices.limit(top_n) if top_n else slices


def bar_totals(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Height of each (stacked) bar: the sum of y per x and color."""
    rows = _value(df, x, y, *([color] if color else []))
    keys = [quoted(x).alias("x")] + ([quoted(color).alias("color")] if color else [])
    return rows.groupBy(*keys).agg(F.coalesce(F.sum(quoted(y)), F.lit(0)).alias("total"))
