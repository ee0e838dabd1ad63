"""Shards along a Hilbert curve through several metadata dimensions.

Each dimension is quantised to as many cells of equal rank, the cells' coordinates are
turned into the place on the curve, rows are sorted by it, and the order is cut into
runs. Neighbours on the curve are neighbours in every dimension, so each run covers a
small box of all dimensions and a filter on any of them skips most files.

Sorting is by range over the whole cluster. Rows that share a place on the curve, as the
rows of a hot source do, are told apart by further columns, so they spread over many
tasks; no shard is ever one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dataloom.llm.common import by_place, place, text_or_empty
from dataloom.plans.positions import with_position
from dataloom.plans.shared import stored

# Bits of each dimension's coordinate.
DEPTH = 6


def _steps(dimensions: int, depth: int) -> Column:
    """(bit, dimension) pairs, the highest bit first."""
    return F.array(*[
        F.struct(F.lit(1 << b).alias("bit"), F.lit(i).alias("axis"))
        for b in range(depth - 1, 0, -1) for i in range(dimensions)
    ])


def _turned(axes: Column, step: Column) -> Column:
    """One turn of the cube: mirror the low bits of the first axis, or swap them with the
    step's axis."""
    low, first, own = step["bit"] - 1, axes[0], F.element_at(axes, step["axis"] + 1)
    swap = first.bitwiseXOR(own).bitwiseAND(low)
    return F.when(
        own.bitwiseAND(step["bit"]) != 0, F.transform(axes, lambda x, j: F.when(j == 0, x.bitwiseXOR(low)).otherwise(x))
    ).otherwise(
        F.transform(axes, lambda x, j: F.when((j == 0) | (j == step["axis"]), x.bitwiseXOR(swap)).otherwise(x))
    )


def with_curve(df: DataFrame, axes: str, name: str, dimensions: int, depth: int) -> DataFrame:
    """Adds the place on the Hilbert curve of ``dimensions`` coordinates of ``depth`` bits,
    given as the array column ``axes``. Each step is a column that the next one reads."""
    turned = F.aggregate(_steps(dimensions, depth), F.col(axes), _turned) if depth > 1 else F.col(axes)
    df = df.withColumn(f"{name}_turned", turned)
    # Gray code along the axes, then the correction that the last axis carries.
    gray, last = [], None
    for i in range(dimensions):
        own = F.get(f"{name}_turned", F.lit(i))
        last = own if last is None else last.bitwiseXOR(own)
        gray.append(last)
    df = df.withColumn(f"{name}_gray", F.array(*gray))
    flip = F.lit(0)
    for b in range(depth - 1, 0, -1):
        bit = F.element_at(f"{name}_gray", -1).bitwiseAND(F.lit(1 << b))
        flip = flip.bitwiseXOR(F.when(bit != 0, (1 << b) - 1).otherwise(0))
    df = df.withColumn(f"{name}_flip", flip)
    index = F.lit(0).cast("long")
    for b in range(depth):
        for i in range(dimensions):
            own = F.get(f"{name}_gray", F.lit(i)).bitwiseXOR(F.col(f"{name}_flip"))
            place = b * dimensions + dimensions - 1 - i
            index = index + F.shiftleft(F.shiftright(own, b).bitwiseAND(F.lit(1)).cast("long"), place)
    return df.withColumn(name, index).drop(f"{name}_turned", f"{name}_gray", f"{name}_flip")


def _coordinates(rows: DataFrame, dimension: str, depth: int) -> DataFrame:
    """Each value's cell: the rank of the distinct value, scaled to ``2 ** depth`` cells.

    The values themselves may be many, so they are ranked by a distributed sort; NULL
    comes first.
    """
    values = with_position(rows.select(F.col(dimension).alias("value")).distinct(), ["value"])
    n = values.count()
    return stored(values.select("value", F.floor(F.col("position") * (1 << depth) / F.lit(max(1, n))).cast("int").alias(f"cell_{dimension}")), "cells")


def shards(
    docs: DataFrame, dimensions: dict[str, str | Column], n_shards: int = 16, depth: int = DEPTH,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``id, size, crc, curve, shard, slot`` and the ``dimensions`` of every row of ``docs``.

    ``dimensions`` maps a name to a column or to an expression of ``text``. Shards are
    runs of the curve's order whose row counts differ by one at most; ``slot`` is the
    place in the shard. ``size`` is the text's UTF-8 bytes plus 1, ``crc`` its CRC-32;
    NULL text counts as empty, NULL metadata is a value of its own. Equal places on the
    curve are ordered by checksum, size and id; rows that repeat all of these are
    interchangeable. An empty table gives no rows.
    """
    placed = by_place(docs)
    text = text_or_empty(F.col(place(docs, text_col)))
    # The text is read once; what follows works on these few columns.
    rows = stored(placed.select(
        F.col(place(docs, id_col)).alias("id"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        *[(F.col(place(docs, d)) if isinstance(d, str) else d(text)).alias(f"d_{n}") for n, d in dimensions.items()],
    ), "metadata")
    names = [f"d_{n}" for n in dimensions]
    found = rows
    for name in names:
        cells = _coordinates(rows, name, depth)
        found = found.join(cells, found[name].eqNullSafe(cells["value"])).drop("value")
    placed_at = found.withColumn("axes", F.array(*[F.col(f"cell_{n}") for n in names])).drop(*[f"cell_{n}" for n in names])
    indexed = with_curve(placed_at, "axes", "curve", len(names), depth).drop("axes")
    total = rows.count()
    runs = with_position(indexed, ["curve", "crc", "size", "id"])
    shard = F.expr(f"cast((position * {n_shards}L) div {max(1, total)}L as int)")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return runs.withColumn("shard", shard).withColumn("slot", F.col("position") - first).drop("position").withColumnsRenamed(
        {f"d_{n}": n for n in dimensions}
    )


def manifest(sharded: DataFrame, dimensions: list[str]) -> DataFrame:
    """One row per shard: rows, bytes, and each dimension's smallest and largest value,
    by which a reader skips shards."""
    bounds = [f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("least", F.min), ("most", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"), *bounds)


def write_shards(docs: DataFrame, sharded: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write whole rows as Parquet, a folder for each shard, sorted along the curve.

    Ids must be unique. A shard's rows are dealt by range of their slots, so large shards
    become several files that each cover a short run of the curve.
    """
    placed = by_place(docs)
    key = place(docs, id_col)
    runs = sharded.select("id", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows = placed.join(runs, placed[key].eqNullSafe(runs["id"])).drop("id")
    ordered = rows.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
    ordered.drop("_slot").toDF(*docs.columns, "shard").write.partitionBy("shard").parquet(path)
