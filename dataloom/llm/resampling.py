"""Importance resampling towards a target text collection.

Texts are bags of hashed word n-grams. A bucket's gain is the logarithm of its share in
the target over its share in the source; a document's weight is the sum of the gains of
its features; adding Gumbel noise to it and taking the highest scores draws without
replacement in proportion to the weights.

The counts rest on segments: separator newlines cut texts into lines, the features of
each distinct line are counted once and multiplied by the line's occurrences, and n-grams
that run across lines are added separately. A document's weight is likewise the sum of
the weights of its lines, each computed once, and of its cross-line n-grams.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from dataloom.llm.common import picked
from dataloom.plans.positions import with_position
from dataloom.plans.shared import stored

# What does not belong to a word, once A-Z are lower case.
NO_WORD = "\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F"
BUCKETS = 10_000
# A line with more than this share of all lines is broadcast: there are at most 1 / HOT.
HOT = 0.001


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(f"[^{NO_WORD}]+"), F.lit(0))


def lines_of(text: Column) -> Column:
    """The lines of a text that are not empty; none of a NULL."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line != "")
    return F.coalesce(lines, F.array().cast("array<string>"))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(gram.cast("binary")), F.lit(buckets)).cast("int")


def _starts(words: Column, n: int) -> Column:
    """Places (from 1) where runs of ``n`` words begin."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))


def line_features(words: Column, longest: int, buckets: int) -> Column:
    """Buckets of all runs of up to ``longest`` words of a line."""

    def runs(own: Column, n: int) -> Column:
        return F.transform(_starts(own, n), lambda i: F.array_join(F.slice(own, i, n), " "))

    def grams(own: Column) -> Column:
        every = F.concat(own, *[runs(own, n) for n in range(2, longest + 1)]) if longest > 1 else own
        return F.transform(every, lambda g: _bucket(g, buckets))

    # The inner variable holds the words, which are then taken from the text only once.
    return F.transform(F.array(words), grams)[0]


def cross_features(text: Column, longest: int, buckets: int) -> Column:
    """Buckets of the runs of words that begin in one line and end in another."""
    tagged = F.flatten(F.transform(
        lines_of(text), lambda line, i: F.transform(words_of(line), lambda w: F.named_struct(F.lit("word"), w, F.lit("line"), i))
    ))

    def runs(own: Column, n: int) -> Column:
        across = F.filter(_starts(own, n), lambda i: F.element_at(own, i)["line"] != F.element_at(own, i + n - 1)["line"])
        return F.transform(across, lambda i: F.array_join(F.transform(F.slice(own, i, n), lambda x: x["word"]), " "))

    def grams(own: Column) -> Column:
        return F.transform(F.concat(*[runs(own, n) for n in range(2, longest + 1)]), lambda g: _bucket(g, buckets))

    return F.transform(F.array(tagged), grams)[0]


def _distinct_lines(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``key, n, n_words, features`` of each distinct line of ``text``: its 128-bit digest,
    its occurrences and the buckets of its features."""
    lines = texts.select(F.explode(lines_of(F.col("text"))).alias("line")).groupBy("line").agg(F.count("*").alias("n"))
    words = lines.select("n", F.unhex(F.md5("line")).alias("key"), words_of(F.col("line")).alias("words"))
    return stored(words.select(
        "key", "n", F.size("words").alias("n_words"), line_features(F.col("words"), longest, buckets).alias("features")
    ), "lines")


def _counts(lines: DataFrame, texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``bucket, n`` over all texts: line counts times occurrences, plus cross-line runs."""
    counts = lines.select(F.explode("features").alias("bucket"), "n").groupBy("bucket").agg(F.sum("n").alias("n"))
    if longest == 1:
        return counts
    cross = texts.select(F.explode(cross_features(F.col("text"), longest, buckets)).alias("bucket"))
    return counts.unionByName(cross.groupBy("bucket").agg(F.count("*").alias("n"))).groupBy("bucket").agg(F.sum("n").alias("n"))


def _gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """``bucket, gain`` of all buckets; broadcast, as there are ``buckets`` rows."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(
        target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    ).unionByName(source.sparkSession.range(buckets).select(
        F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")
    ))
    counts = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    rows = counts.agg(
        F.sum("s").alias("all_s"), F.sum("t").alias("all_t"), F.collect_list(F.struct("bucket", "s", "t")).alias("counts")
    ).select("all_s", "all_t", F.inline("counts"))
    real = lambda c: F.col(c).cast("double")
    gain = F.floor(1000 * F.log(
        (real("t") + 1) * (real("all_s") + buckets) / ((real("s") + 1) * (real("all_t") + buckets))
    ))
    return F.broadcast(stored(rows.select("bucket", gain.alias("gain")), "gains"))


def weights(docs: DataFrame, target: DataFrame, longest: int, buckets: int) -> DataFrame:
    """``row, id, n_words, n_features, weight`` of each row of ``docs`` (``id, text``);
    ``target`` has ``text``."""
    lines = _distinct_lines(docs, longest, buckets)
    goal = _distinct_lines(target, longest, buckets)
    gains = _gains(_counts(lines, docs, longest, buckets), _counts(goal, target, longest, buckets), buckets)
    zero = F.lit(0).cast("long")
    valued = stored(lines.select(
        "key", "n", "n_words", F.size("features").alias("n_features"), F.explode_outer("features").alias("bucket")
    ).join(gains, "bucket", "left").groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("n", "n_words", "n_features")], F.coalesce(F.sum("gain"), zero).alias("weight")
    ), "line-weights")
    total = valued.agg(F.sum("n")).scalar()
    value = F.struct("n_words", "n_features", "weight")
    hot = F.broadcast(valued.where(F.col("n") > total * HOT).select(F.col("key").alias("hot_key"), value.alias("hot")))
    rest = valued.where(F.col("n") <= total * HOT).select(F.col("key").alias("rest_key"), value.alias("rest"))

    # Each row begins with an empty line, which carries what is no line's.
    cross = cross_features(F.col("text"), longest, buckets) if longest > 1 else F.lit(None).cast("array<int>")
    cut = docs.withColumn("row", F.monotonically_increasing_id()).select(
        "row", "id", cross.alias("cross"),
        F.posexplode(F.concat(F.array(F.lit("")), lines_of(F.col("text")))).alias("at", "line"),
    ).select(
        "row", "id", F.when(F.col("at") > 0, F.unhex(F.md5("line"))).alias("key"),
        F.when(F.col("at") == 0, F.col("cross")).alias("cross"),
    )
    found = cut.join(hot, F.col("key") == F.col("hot_key"), "left")
    # Rows that need no second look-up get keys of their own, which spread.
    open_key = F.when(F.col("key").isNotNull() & F.col("hot").isNull(), F.col("key")).otherwise(F.col("row").cast("string").cast("binary"))
    found = found.withColumn("open", open_key).join(rest, F.col("open") == F.col("rest_key"), "left")
    of = lambda name: F.coalesce(F.col(f"hot.{name}"), F.col(f"rest.{name}"), zero).cast("long")
    n_cross, w_cross = zero, zero
    if longest > 1:
        found = found.withColumn("bucket", F.explode_outer("cross")).join(gains, "bucket", "left")
        n_cross, w_cross = F.col("bucket").isNotNull().cast("long"), F.coalesce("gain", zero)
    return found.groupBy("row").agg(
        F.first("id").alias("id"), F.sum(of("n_words")).alias("n_words"),
        F.sum(of("n_features") + n_cross).alias("n_features"), F.sum(of("weight") + w_cross).alias("weight"),
    )


def noise(key: Column, seed: int) -> Column:
    """A Gumbel variable of the key, in thousandths: the same at every run."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    head = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((head + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, percent: int, longest: int = 1, buckets: int = BUCKETS, least_words: int = 20,
    seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
) -> DataFrame:
    """``id, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` counts
    the drawn rows from 1 and is NULL for the others.

    Of the rows with ``least_words`` words or more, ``percent`` in 100 (rounded down) with
    the highest scores are drawn; equal scores go to the smaller id, a NULL id first.
    Features are runs of 1 to ``longest`` words over the whole text. NULL and empty texts
    have no feature and weight 0; repeated rows are rows of their own with one noise; an
    empty table gives none, an empty target gives every bucket its smoothed share.
    """
    rows, goal = picked(docs, id=id_col, text=text_col), picked(target, text=target_text)
    scored = stored(weights(rows, goal, longest, buckets).select(
        "id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score")
    ), "scores")
    wanted = scored.where(F.col("n_words") >= least_words).count() * percent // 100
    order = [F.col("n_words") < least_words, F.col("score").desc(), F.col("id"), F.col("n_features"), F.col("weight")]
    placed = with_position(scored, order)
    rank = F.when(F.col("position") < wanted, F.col("position") + 1)
    return placed.select("id", F.col("n_features"), "weight", "score", rank.alias("rank"))
