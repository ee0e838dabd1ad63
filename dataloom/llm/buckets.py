"""Links between the members of buckets, without all pairs of a bucket.

One member of a bucket is its hub, picked by the bucket, so that a node of several buckets
meets several hubs. First every member is compared with its hub only: n rows for n members.
Verified links are joined to components. What may then still be missing is a link between
members of different components, so in one more round the members outside their hub's
component - the stragglers - are compared with one straggler and one member at home,
picked anew, and components are joined again: 2 n rows at most. Only the stragglers that
still remain are compared with all members of other components. Every pair of a bucket is in
the end compared or lies in one component already: no link between components is lost, a
bucket of n copies costs about n comparisons, and one of n near copies a few times n. Many
members of one bucket that allow a link by their sketches and yet have none are the
exception: their pairs are all compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from dataloom.llm.components import components
from dataloom.plans.shared import stored

# Turns in which stragglers are compared with picked members before those with all.
ROUNDS = 1


def _pick(node: Column, turn: int) -> Column:
    """One node of a bucket, another one by bucket and turn: the smallest after bits are
    turned over that both decide."""
    mask = F.xxhash64("bucket", F.lit(turn))
    return F.min(node.bitwiseXOR(mask))


def _unmasked(picked: Column, turn: int) -> Column:
    return picked.bitwiseXOR(F.xxhash64("bucket", F.lit(turn)))


def often(members: DataFrame) -> DataFrame:
    """``bucket, node`` without most of the buckets that have one member.

    A count over short hashes of the buckets, a few bytes a row, leaves those out before
    nodes are looked at.
    """
    hashed = members.withColumn("short", F.hash("bucket"))
    shorts = hashed.groupBy("short").agg(F.count("*").alias("n")).where("n > 1").select("short")
    return hashed.join(shorts, "short", "left_semi").select("bucket", "node")


def _shared(members: DataFrame) -> DataFrame:
    """``bucket, node, hub`` of the buckets with more than one node.

    Near copies share many buckets. Of buckets with the same members, which would give the
    same pairs, one stays; members are told by their number and 128 bits of hash.
    """
    some = stored(members.select("bucket", "node").distinct(), "often")
    hubs = some.groupBy("bucket").agg(
        F.min("node").alias("low"), F.max("node").alias("top"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), _pick(F.col("node"), 0).alias("hub"),
    ).where("low < top").withColumn("hub", _unmasked(F.col("hub"), 0))
    single = hubs.groupBy("low", "top", "n", "x", "y").agg(F.min_by("hub", "bucket").alias("hub"), F.min("bucket").alias("bucket"))
    return some.join(single.select("bucket", "hub"), "bucket").select("bucket", "node", "hub")


def _tagged(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``bucket, node, root, hub_root`` of all members but the hubs."""
    of_node = roots.select("node", F.col("root").alias("node_root"))
    of_hub = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    return shared.where("node <> hub").join(of_node, "node", "left").join(of_hub, "hub", "left").select(
        "bucket", "node", F.coalesce("node_root", "node").alias("root"), F.coalesce("hub_root", "hub").alias("hub_root")
    )


def _with_stragglers(tagged: DataFrame) -> DataFrame:
    """What lies in a bucket that has stragglers."""
    open_buckets = tagged.where("root <> hub_root").select("bucket").distinct()
    return tagged.join(open_buckets, "bucket", "left_semi")


def _picked_pairs(tagged: DataFrame, turn: int) -> DataFrame:
    """``a, b``, each once: stragglers with one straggler and with one member at home."""
    away, node = F.col("root") != F.col("hub_root"), F.col("node")
    picks = tagged.groupBy("bucket").agg(
        _pick(F.when(away, node), turn).alias("away"), _pick(F.when(~away, node), turn).alias("home")
    )
    others = F.explode(F.array(_unmasked(F.col("away"), turn), _unmasked(F.col("home"), turn))).alias("other")
    return tagged.where(away).select("bucket", "node").join(picks, "bucket").select("node", others).where(
        "other <> node"
    ).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def linked(
    members: DataFrame, near: Callable[[Column, Column], Column],
    prepared: Callable[[DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]],
) -> DataFrame:
    """``node, root`` of every node linked to another.

    ``members(bucket, node)``: rows may repeat; ``often`` makes them fewer where most
    buckets have one member. ``prepared`` gets the nodes that share a bucket with others, each once. It
    returns their stored ``node, sketch`` and a function that takes ``a, b`` pairs, each
    once, and gives those linked. ``near`` tells from two sketches whether a link is
    possible; it must not deny any, and only pairs that pass become rows.
    """
    shared = stored(_shared(members), "buckets")
    known, verified = prepared(stored(shared.select("node").distinct(), "nodes"))
    of_a, of_b = (known.select(F.col("node").alias(n), F.col("sketch").alias(f"{n}_sketch")) for n in "ab")

    def links(pairs: DataFrame) -> DataFrame:
        possible = pairs.join(of_b, "b").join(of_a, (pairs["a"] == of_a["a"]) & near(of_a["a_sketch"], F.col("b_sketch")))
        return stored(verified(possible.select(pairs["a"], pairs["b"])), "links")

    def joined(more: DataFrame) -> DataFrame:
        # What earlier links have joined is a star by now.
        return components(more.unionAll(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    roots = components(links(shared.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()))
    tagged = stored(_with_stragglers(_tagged(shared, roots)), "tagged")
    for turn in range(1, ROUNDS + 1):
        more = links(_picked_pairs(tagged, turn))
        if more.isEmpty():
            break
        roots = joined(more)
        tagged = stored(_with_stragglers(_tagged(shared, roots)), "tagged")
    tagged = tagged.join(known, "node")
    stray = tagged.where("root <> hub_root").select(
        F.col("bucket").alias("of"), F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("sketch").alias("a_sketch")
    )
    rest = stray.join(
        tagged, (F.col("of") == F.col("bucket")) & (F.col("a_root") != F.col("root"))
        & ((F.col("root") == F.col("hub_root")) | (F.col("a") < F.col("node"))) & near(F.col("a_sketch"), F.col("sketch")),
    ).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    late = stored(verified(rest), "links")
    return roots if late.isEmpty() else joined(late)
