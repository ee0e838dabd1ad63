"""SimHash near-duplicates found through vantage-point trees.

Fingerprints live in the space of 64-bit words under the Hamming distance. A tree of
vantage points, grown from a bounded sample, cuts that space into shards: at each node a
fingerprint goes inside or outside the node's radius. A search ball that reaches across
a radius goes both ways (triangle inequality), all other branches are pruned. Every
fingerprint is stored in one shard and looked up in each shard its ball overlaps; inside
a shard a smaller tree prunes in the same way down to blocks that are compared bit by bit.
Equal fingerprints are one point, and a shard passes on only a spanning forest of the
links it finds, so a group of n copies costs n rows and not n * n.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from dataloom.llm.common import hash_share, picked, rows_of, text_or_empty
from dataloom.llm.components import components
from dataloom.plans.shared import stored

# Fixed values of the fingerprint.
SEED = 42
BITS = 64
# Shingles whose bits are counted at once.
_CHUNK = 65_536
# Points that a shard's tree no longer divides.
_LEAF = 192


def fingerprint(text: str, words: int = 3) -> int:
    """The SimHash of one text: lower-cased A-Z, words between white space, shingles with
    repeats hashed by XXH64; a bit is set if it is in more than half the hashes."""
    joined = b" ".join(pieces := text.encode("utf-8", "surrogatepass").lower().split())
    if not pieces:
        return 0
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    n = max(1, len(pieces) - words + 1)
    last = ends[min(words, len(pieces)) - 1:].tolist()
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        hashes = np.fromiter(
            (digest(joined[s:e], SEED) for s, e in zip(starts[at:to], last[at:to])), np.uint64, to - at
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _mark(text: Column) -> Column:
    return F.xxhash64(text)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, mark, print`` of every row: the 64 bits as a long, and a hash that tells apart
    the texts of a repeated id. NULL text counts as empty."""
    rows = picked(docs, id=id_col, text=text_col).select("id", text_or_empty().alias("text")).select(
        "id", _mark(F.col("text")).alias("mark"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["id", "mark", "print"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, mark long, print long")


def _far(points: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ point)


@dataclass
class Node:
    point: np.uint64
    radius: int
    inside: "Node | int"
    outside: "Node | int"


def grow(sample: np.ndarray, depth: int) -> tuple["Node | int", int]:
    """A vantage-point tree over ``sample`` and the number of its leaves (the shards)."""
    leaves = 0

    def at(points: np.ndarray, left: int) -> Node | int:
        nonlocal leaves
        if left and len(points) > 1:
            distance = _far(points, points[0])
            radius = int(np.median(distance))
            near = distance <= radius
            if not near.all():
                return Node(points[0], radius, at(points[near], left - 1), at(points[~near], left - 1))
        leaves += 1
        return leaves - 1

    return at(sample, depth), leaves


def route(tree: Node | int, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, index of point) of every shard that the ball of ``reach`` around a point overlaps."""
    shards, rows = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
    stack = [(tree, np.arange(len(points)))]
    while stack:
        node, index = stack.pop()
        if not len(index):
            continue
        if isinstance(node, int):
            shards.append(np.full(len(index), node, np.int32))
            rows.append(index)
            continue
        distance = _far(points[index], node.point).astype(np.int16)
        stack.append((node.inside, index[distance - reach <= node.radius]))
        stack.append((node.outside, index[distance + reach > node.radius]))
    return np.concatenate(shards), np.concatenate(rows)


def near_pairs(points: np.ndarray, asked: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of ``asked``, of ``points``) at most ``reach`` bits apart, by a local tree."""
    stack = [(np.arange(len(points)), np.arange(len(asked)))]
    while stack:
        here, there = stack.pop()
        if not len(here) or not len(there):
            continue
        if len(here) > _LEAF:
            pivot = points[here[len(here) // 2]]
            distance = _far(points[here], pivot).astype(np.int16)
            radius = int(np.median(distance))
            near = distance <= radius
            if near.all():  # more than half lie on the rim: cut just inside it
                radius -= 1
                near = distance <= radius
            if near.any() and not near.all():
                away = _far(asked[there], pivot).astype(np.int16)
                stack.append((here[near], there[away - reach <= radius]))
                stack.append((here[~near], there[away + reach > radius]))
                continue
        for at in range(0, len(there), 4096):
            some = there[at:at + 4096]
            for low in range(0, len(here), 1024):
                block = here[low:low + 1024]
                q, p = np.nonzero(np.bitwise_count(asked[some][:, None] ^ points[block][None, :]) <= reach)
                if len(q):
                    yield some[q], block[p]


def _forest(points: np.ndarray, asked: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``asked`` and ``points``."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    links = []
    for q, p in near_pairs(points, asked, reach):
        for a, b in zip(asked[q].view(np.int64).tolist(), points[p].view(np.int64).tolist()):
            if a != b and (x := top(a)) != (y := top(b)):
                above[max(x, y)] = min(x, y)
                links.append((a, b))
    return links


def links(
    prints: DataFrame, reach: int = 2, shard_points: int = 4096, max_depth: int = 12, sample_points: int = 65_536
) -> DataFrame:
    """``a, b``: links that connect all distinct ``print`` values at most ``reach`` bits apart.

    The tree has about one leaf for each ``shard_points`` values and at most
    ``2 ** max_depth``; it is grown from about ``sample_points`` values at most, chosen by
    hash. Both bound what reaches the driver and a broadcast, and decide only how the
    work is cut: every value is stored and searched whatever the tree.
    """
    n = prints.count()
    depth = max(0, min(max_depth, int(np.ceil(np.log2(max(1, n) / shard_points)))))
    tree: Node | int = 0
    if depth:
        chosen = prints.select("print").where(hash_share(F.col("print"), min(sample_points, 64 << depth), n)).toPandas()
        sample = np.random.default_rng(0).permutation(np.sort(chosen["print"].to_numpy(np.int64)))
        tree, _ = grow(sample.view(np.uint64), depth)
    shared = prints.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            home, row = route(shared.value, points, 0)
            at_home = np.empty(len(points), np.int32)
            at_home[row] = home
            shard, row = route(shared.value, points, reach)
            # Two values find each other from the one whose shard comes first.
            kept = shard >= at_home[row]
            shard, row = shard[kept], row[kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(points[row].view(np.int64)), pa.array(shard == at_home[row])],
                ["shard", "print", "home"],
            )

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        values = shard["print"].to_numpy(np.int64).view(np.uint64)
        found = _forest(values[shard["home"].to_numpy(bool)], values, reach)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return (
        prints.select("print").mapInArrow(deal, "shard int, print long, home boolean")
        .groupBy("shard").applyInPandas(search, "a long, b long")
    )


def _grouped(docs: DataFrame, words: int, reach: int, id_col: str, text_col: str) -> DataFrame:
    """``id, mark, print, root, component, group_size`` of every row of ``docs``."""
    rows = stored(fingerprints(docs, words, id_col, text_col), "prints")
    points = stored(rows.groupBy("print").agg(F.min("id").alias("id"), F.count("*").alias("n")), "points")
    tied = components(links(points, reach)).withColumnRenamed("node", "print")
    rooted = stored(
        points.join(tied, "print", "left").withColumn("root", F.coalesce("root", "print")), "rooted"
    )
    groups = rooted.groupBy("root").agg(F.min("id").alias("component"), F.sum("n").alias("group_size"))
    # One row for each distinct fingerprint; rows that share one are met by a skew join.
    named = stored(rooted.select("print", "root").join(groups, "root"), "named")
    return rows.join(named, "print")


def near_duplicates(
    docs: DataFrame, words: int = 3, reach: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, print, component, group_size`` of every row of ``docs``.

    Rows whose fingerprints differ in at most ``reach`` bits are linked; ``component`` is
    the smallest id that links lead to, the row's own included, and ``group_size`` the
    number of its rows. A text without words has fingerprint 0 and is linked like any
    other; NULL text counts as empty. A NULL id keeps its row and names a component only
    where every id in it is NULL. Repeated rows are rows of one component. An empty table
    gives no rows.
    """
    return _grouped(docs, words, reach, id_col, text_col).select("id", "print", "component", "group_size")


def drop_near_duplicates(
    docs: DataFrame, words: int = 3, reach: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``docs`` of every group, with all its columns: that of the smallest id,
    a NULL id last. Where rows repeat that id, one of them stays."""
    rows = _grouped(docs, words, reach, id_col, text_col)
    first = rows.groupBy("root", "id", "mark").agg(F.count("*").alias("n_rows")).groupBy("root").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark", "n_rows")).alias("first")
    )
    kept = stored(first.groupBy("first.id", "first.mark").agg(F.max("first.n_rows").alias("n_rows")), "kept")
    keys = {
        "id": F.col(f"c{docs.columns.index(id_col)}"),
        "mark": _mark(text_or_empty(F.col(f"c{docs.columns.index(text_col)}"))),
    }
    return rows_of(docs, keys, kept)
