"""SpotSigs: fingerprints from chains of content words behind common words.

Each common word (anchor) of a text that is followed by enough content words within reach
gives one signature: the anchor and the chain of those words. Stretches that no anchor
reaches give the plain chains of their words, so that the set grows with the text wherever
anchors are few. The set of a text's signatures is its fingerprint; the likeness of two
texts is the Jaccard similarity of their sets. Near-duplicates are found by cutting the sets into partitions by length, so
that sets whose lengths alone exclude the similarity never meet, and by looking up only
as many of a set's rarest signatures as a partner must share.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from dataloom.llm.buckets import linked, often
from dataloom.llm.common import picked, text_or_empty
from dataloom.plans.positions import with_position
from dataloom.plans.shared import stored

# Content words of a chain, and words behind the anchor among which they must stand.
CHAIN = 2
REACH = 8
SIMILARITY = 0.8

# Common words of four languages.
ANCHORS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "der die und den von zu das mit sich des für auf ist im nicht dem ein eine als "
    "la le et les en un du une que est pour qui dans par sur au pas avec "
    "de el y los se del las por con no su para es al lo"
).split()


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def spots_of(words: Column, chain: int = CHAIN, reach: int = REACH) -> Column:
    """Place and hash of each anchor with a chain, in the order of the text."""
    follows = F.transform(words, lambda w, i: F.when(
        w.isin(ANCHORS),
        F.struct(
            i.alias("at"), w.alias("anchor"),
            F.slice(F.filter(F.slice(words, i + 2, F.lit(reach)), lambda x: ~x.isin(ANCHORS)), 1, chain).alias("chain"),
        ),
    ))
    return F.transform(
        F.filter(follows, lambda s: F.size(s["chain"]) == chain),
        lambda s: F.struct(s["at"].alias("at"), F.hash(s["anchor"], s["chain"]).alias("sign")),
    )


def signatures(words: Column, spots: Column, chain: int = CHAIN, reach: int = REACH) -> Column:
    """The set of signatures, sorted: those of the spots, and where a word lies out of every
    spot's reach and begins a plain chain that meets no spot, that chain. So there is one
    at least for every ``reach + chain + 1`` words of any text, repeats aside. Fewer words
    than a chain give the sequence of them: no set is empty."""
    places = F.transform(spots, lambda s: s["at"])
    plain = F.flatten(F.zip_with(
        F.concat(F.array(F.lit(-reach - 1)), places), F.concat(places, F.array(F.size(words))),
        lambda a, b: F.when(b - a > reach + chain + 1, F.sequence(a + reach + 1, b - chain - 1)).otherwise(F.array().cast("array<int>")),
    ))
    found = F.concat(
        F.transform(spots, lambda s: s["sign"]), F.transform(plain, lambda i: F.hash(F.slice(words, i + 1, F.lit(chain + 1))))
    )
    return F.array_sort(F.array_distinct(F.when(F.size(words) > chain, found).otherwise(F.array(F.hash(words)))))


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the signature set of a text column. The words and spots stand in columns of
    their own, so that they are taken once."""
    words, spots = f"{name}_words", f"{name}_spots"
    taken = df.withColumn(words, words_of(F.col(text))).withColumn(spots, spots_of(F.col(words)))
    return taken.withColumn(name, signatures(F.col(words), F.col(spots))).drop(words, spots)


def likeness(left: Column, right: Column) -> Column:
    both = F.size(F.array_intersect(left, right))
    return both / (F.size(left) + F.size(right) - both)


def digest(signs: Column) -> Column:
    return F.sha2(F.array_join(signs.cast("array<string>"), " "), 256)


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside an edit of it: ``id, n_chars, edited, signs, edited_signs, next_signs``.

    The edit replaces the last third of a text's code points (rounded down) by as many
    from the beginning of the next text, in falling order of id, the first following the
    last. NULL text counts as empty; NULL ids come last; ties of ids are ordered by a hash
    of the text; rows that repeat id and text have one place in the order and the same
    result each. A lone document follows itself; an empty table gives no rows.
    """
    text = text_or_empty()
    rows = picked(docs, id=id_col, text=text_col).select("id", F.xxhash64(text).alias("mark"), text.alias("text"))
    # The order is made of ids only; texts are then shuffled once, and of each as much of
    # its beginning as its neighbour needs.
    order = rows.select("id", "mark", F.char_length("text").alias("n_chars")).distinct()
    ranked = stored(with_position(order, [F.col("id").desc_nulls_last(), F.col("mark")]), "order")
    n = ranked.count()
    before = ranked.select(
        ((F.col("position") + 1) % max(1, n)).alias("position"), F.col("id").alias("to"), F.col("mark").alias("to_mark"),
        F.floor(F.col("n_chars") / 3).cast("int").alias("need"),
    )
    steps = ranked.join(before, "position").select(F.col("id").alias("of"), F.col("mark").alias("of_mark"), "to", "to_mark", "need")
    following = rows.join(steps, rows["id"].eqNullSafe(steps["of"]) & (rows["mark"] == steps["of_mark"]))
    heads = with_signatures(following, "text", "next_signs").select(
        "to", "to_mark", F.expr("left(text, need)").alias("head"), "next_signs"
    ).dropDuplicates(["to", "to_mark"])
    paired = rows.join(heads, rows["id"].eqNullSafe(heads["to"]) & (rows["mark"] == heads["to_mark"]))
    n_chars = F.char_length("text")
    edited = paired.select(
        "id", "text", n_chars.cast("long").alias("n_chars"), "next_signs",
        F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int))"), "head").alias("edited"),
    )
    return with_signatures(with_signatures(edited, "text", "signs"), "edited", "edited_signs").drop("text")


def _length_class(size: Column, least: float) -> Column:
    """Number of the length partition: sets more than one partition apart are too unlike."""
    return F.floor(F.log(size.cast("double")) / -math.log(least) + 1e-9).cast("int")


def near_duplicates(
    docs: DataFrame, least: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id, class_id, class_size`` of every row: classes connected by a likeness of at
    least ``least``; ``class_id`` is the smallest id in it.

    Equal sets are one node. NULL text counts as empty, NULL ids keep their rows, an empty
    table gives no rows.
    """
    rows = stored(with_signatures(picked(docs, id=id_col, text=text_col).select("id", text_or_empty().alias("text")), "text", "signs").select("id", "signs"), "signs")
    keyed = rows.withColumn("key", digest(F.col("signs")))
    sets = stored(
        keyed.groupBy("key").agg(F.first("signs").alias("signs")).withColumn("node", F.monotonically_increasing_id()), "sets"
    )
    seen = sets.select("node", F.size("signs").alias("n"), F.explode("signs").alias("sign"))
    # A partner must share one of a set's (n - needed + 1) rarest signatures.
    rare = seen.join(seen.groupBy("sign").agg(F.count("*").alias("often")), "sign").groupBy("node", "n").agg(
        F.sort_array(F.collect_list(F.struct("often", "sign"))).alias("signs")
    )
    taken = rare.select("node", "n", F.explode(F.slice("signs", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))).alias("s"))
    part = _length_class(F.col("n"), least)
    # Sets meet in their own partition and in the next one.
    members = stored(taken.select(
        F.explode(F.array(part, part + 1)).alias("part"), F.col("s.sign").alias("sign"), "node"
    ).select(F.xxhash64("part", "sign").alias("bucket"), "node"), "spots")

    def near(left: Column, right: Column) -> Column:
        """Lengths prune before the sets are compared."""
        return F.least(left, right) >= F.greatest(left, right) * least - 1e-9

    def prepared(nodes: DataFrame):
        own = stored(sets.select("node", "signs").join(nodes, "node", "left_semi"), "sets")
        left, right = (own.select(F.col("node").alias(n), F.col("signs").alias(s)) for n, s in (("a", "left"), ("b", "right")))

        def verified(pairs: DataFrame) -> DataFrame:
            return pairs.join(left, "a").join(right, "b").where(likeness(F.col("left"), F.col("right")) >= least).select("a", "b")

        return own.select("node", F.size("signs").alias("sketch")), verified

    roots = linked(often(members), near, prepared)
    named = sets.select("key", "node").join(roots, "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    tagged = keyed.select("id", "key").join(named, "key")
    classes = tagged.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return tagged.join(classes, "root").select("id", "class_id", "class_size")
