"""Exact quantiles (linear interpolation) without one task holding all values.

Spark's ``percentile`` keeps every distinct value of a group in one hash map. Here a
sketch only proposes where to cut, and counting makes the answer exact:

1. one sketch per group gives a few edges around each wanted rank;
2. one pass counts values per bucket, the buckets being the ranges between the edges,
   each cut into equal widths in large groups. Counts, smallest and largest value of the
   buckets show in which of them a rank lies - whatever the sketch's error was;
3. only the values of those buckets are grouped by value, ordered, and counted through
   to the rank.

With accuracy A and W widths about 4 / (A * W) of a large group's values reach step 3,
as distinct values: with the defaults some two million of 10^12.

Each step carries what the next one needs, so no step depends on running an earlier one
twice with the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from dataloom.functions.columns import quoted
from dataloom.plans.shared import checkpoint

ACCURACY = 10_000
WIDTHS = 256
LARGE_GROUP = 100_000
BROADCAST_GROUPS, BROADCAST_BYTES = 100_000, 64 << 20
HEAVY_GROUPS = 10_000


def attach(
    rows: DataFrame, table: DataFrame, keys: list[str], size: str, bounded: bool = False
) -> DataFrame:
    """Join rows with a table of one row per group; ``size`` is its column of group sizes.

    ``bounded`` says the number of groups is fixed by the schema: the table is broadcast.
    Otherwise it is checkpointed and counted, and broadcast if rows and keys are few. If not, the groups
    that hold more than one row in HEAVY_GROUPS - there can be no more than that many -
    are broadcast, and only the other rows are shuffled, none of whose groups is large.
    """
    if bounded:
        return rows.join(F.broadcast(table), keys)
    table = checkpoint(table)
    length = reduce(Column.__add__, [F.coalesce(F.octet_length(quoted(k).cast("string")), F.lit(0)) for k in keys])
    of = table.agg(F.count("*"), F.sum(length), F.sum(size), F.max(length)).first()
    if of[0] <= BROADCAST_GROUPS and (of[1] or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), keys)
    if of[3] * HEAVY_GROUPS > BROADCAST_BYTES:
        # Keys too long to be sent even for the heavy groups: AQE splits those.
        return rows.join(table, keys)
    heavy = table.filter(F.col(size) * HEAVY_GROUPS > of[2])
    others = table.filter(F.col(size) * HEAVY_GROUPS <= of[2])
    names = F.broadcast(heavy.select(*[quoted(k) for k in keys]))
    shuffled = rows.join(names, keys, "left_anti").join(others, keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(shuffled)


def _bucket(value: Column, edges: Column, count: int, widths: Column) -> Column:
    """Number of the bucket of a value; it never falls when the value rises."""
    passed = reduce(
        Column.__add__, [(value >= F.get(edges, F.lit(i))).cast("int") for i in range(count)]
    )
    low, high = F.get(edges, passed - 1), F.get(edges, passed)
    within = F.floor(F.try_divide(value - low, high - low) * widths)
    # Outermost ranges have one open end and stay whole.
    return passed * widths + F.least(F.coalesce(within, F.lit(0)), widths - 1)


def group_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    bounded: bool = False,
    accuracy: int = ACCURACY,
    size: str | None = None,
    more: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per group: the keys, one exact quantile per entry of ``probs``, and, when
    ``size`` is given, the number of values under that name.

    ``more`` are aggregates of the value (``_v``) that the first pass takes as well.

    NULL keys and NULL values are left out.
    """
    by = [quoted(k) for k in keys]
    rows = df.select(*by, quoted(value).cast("double").alias("_v"))
    rows = rows.filter(reduce(Column.__and__, [c.isNotNull() for c in by], F.col("_v").isNotNull()))
    slack = 2.0 / accuracy
    edges = sorted({min(1.0, max(0.0, p + s)) for p in probs.values() for s in (-slack, slack)})

    sketch = rows.groupBy(*by).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_v", edges, accuracy).alias("_edges"),
        *[c.alias(n) for n, c in (more or {}).items()],
    )
    if more:
        # Used here and at the end: written, so that the pass is not made twice.
        sketch = checkpoint(sketch)
    widths = F.when(F.col("_n") > LARGE_GROUP, WIDTHS).otherwise(1).cast("long")
    at = _bucket(F.col("_v"), F.col("_edges"), len(edges), widths)
    buckets = (
        attach(rows, sketch, keys, "_n", bounded)
        .groupBy(*by, at.alias("_bucket"))
        .agg(F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    )
    # At most (edges + 1) * WIDTHS rows per group.
    group = Window.partitionBy(*by)
    placed = buckets.withColumns({
        "_n": F.sum("_c").over(group),
        "_after": F.sum("_c").over(group.orderBy("_bucket")),
    }).withColumn("_before", F.col("_after") - F.col("_c"))
    found = []
    for t, p in enumerate(probs.values()):
        rank = F.lit(p) * (F.col("_n") - 1)
        first, last = F.floor(rank), F.ceil(rank)
        has_first = (F.col("_before") <= first) & (first < F.col("_after"))
        has_last = (F.col("_before") <= last) & (last < F.col("_after"))
        found.append(F.struct(
            F.lit(t).alias("t"),
            F.min(F.when(has_first, F.col("_lo"))).alias("lo"),
            F.max(F.when(has_last, F.col("_hi"))).alias("hi"),
            F.min(F.when(has_first, F.col("_before"))).alias("base"),
            F.max(first).alias("first"), F.max(last).alias("last"),
            F.max(rank - first).alias("weight"),
        ).alias(f"_s{t}"))
    found = placed.groupBy(*by).agg(F.max("_n").alias("_n"), *found)

    near = [
        F.col("_v").between(F.col(f"_s{t}.lo"), F.col(f"_s{t}.hi")) for t in range(len(probs))
    ]
    candidates = (
        attach(rows, found, keys, "_n", bounded)
        .filter(reduce(Column.__or__, near))
        .select(*by, "_v", "_n", F.explode(F.array(*[f"_s{t}" for t in range(len(probs))])).alias("_s"))
        .filter(F.col("_v").between(F.col("_s.lo"), F.col("_s.hi")))
        .groupBy(*by, F.col("_s.t").alias("_t"), "_v")
        .agg(
            F.count("*").alias("_c"), F.max("_n").alias("_n"),
            *[F.max(f"_s.{f}").alias(f"_{f}") for f in ("base", "first", "last", "weight")],
        )
    )
    up_to = Window.partitionBy(*by, "_t").orderBy("_v")
    ranked = candidates.withColumn("_end", F.col("_base") + F.sum("_c").over(up_to))

    def at_rank(rank: str) -> Column:
        inside = (F.col(rank) < F.col("_end")) & (F.col(rank) >= F.col("_end") - F.col("_c"))
        return F.max(F.when(inside, F.col("_v")))

    picked = ranked.groupBy(*by, "_t").agg(
        at_rank("_first").alias("_a"), at_rank("_last").alias("_b"),
        F.max("_weight").alias("_w"), F.max("_n").alias("_n"),
    )
    quantile = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")
    answers = [
        F.max(F.when(F.col("_t") == t, quantile)).alias(name) for t, name in enumerate(probs)
    ]
    if size is not None:
        answers.append(F.max("_n").alias(size))
    answered = picked.groupBy(*by).agg(*answers)
    if not more:
        return answered
    aggregates = sketch.select(*by, *[quoted(n) for n in more])
    return answered.join(F.broadcast(aggregates) if bounded else aggregates, keys)


def column_quantiles(
    long: DataFrame, probs: dict[str, float], accuracy: int = ACCURACY, more: dict[str, Column] | None = None
) -> DataFrame:
    """Quantiles of a (column, value) table: one row per column."""
    return group_quantiles(long, ["column"], "value", probs, bounded=True, accuracy=accuracy, more=more)
