"""Text pairs for fine-tuning: projection, split, vocabulary, encoding, scoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from dataloom.functions.columns import quoted
from dataloom.functions.parsing import stripped
from dataloom.plans.one_row import as_struct
from dataloom.plans.shared import checkpoint, stored

# Task prefixes, lengths, limits.
TASK_PREFIXES = {
    "Code to Comment": "translate code to comment: ",
    "Comment to Code": "translate comment to code: ",
}
MAX_LENGTH = 256
TEST_SHARE = 0.1
PASS_ABOVE = 0.8
PAD_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2
MAX_VOCABULARY = 200_000

_WORDS = r"\s+"


def to_pairs(df: DataFrame, input_col: str, target_col: str, keep: list[str] = ()) -> DataFrame:
    """The two columns as text, named input and target; NULL stays NULL."""
    return df.select(
        *[quoted(k) for k in keep],
        quoted(input_col).cast("string").alias("input"),
        quoted(target_col).cast("string").alias("target"),
    )


def trim_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: stripped(quoted(c).cast("string")) for c in columns})


def drop_blank_pairs(df: DataFrame) -> DataFrame:
    return df.filter((stripped(F.col("input")) != "") & (stripped(F.col("target")) != ""))


def add_prefix(df: DataFrame, task: str) -> DataFrame:
    return df.withColumn("input", F.concat(F.lit(TASK_PREFIXES[task]), F.col("input")))


# A hash is cut into two levels of 4096 buckets; hashes are even, so are the buckets.
_HASH_BITS, _LEVEL_BITS = 62, 12


def train_test_split(
    df: DataFrame, key: str, test: float = TEST_SHARE, seed: int = 0, exact: bool = True
) -> DataFrame:
    """Add ``split``: test or train, from a hash of the (unique) key.

    With ``exact`` the test part has ceil(test * rows) rows: those with the smallest
    hashes. The limiting hash is found by counting rows per hash bucket, twice, and
    ordering only the rows of the one bucket that holds it; the table is neither sorted
    nor shuffled. Without ``exact`` each row is in the test part with chance ``test``.
    """
    top = 1 << _HASH_BITS
    hashed = df.withColumn(
        "_h", F.xxhash64(F.lit(seed), quoted(key)).bitwiseAND(F.lit(top - 1))
    )
    if not exact:
        limit = int(test * top)
        return hashed.withColumn(
            "split", F.when(F.col("_h") < F.lit(limit), "test").otherwise("train")
        ).drop("_h")

    keys = hashed.select("_h", quoted(key).alias("_k"))

    def bucket(level: int) -> Column:
        return F.shiftright("_h", _HASH_BITS - level * _LEVEL_BITS)

    # One pass counts the buckets of the lower level; those of the upper are their sums.
    fine = checkpoint(keys.groupBy(bucket(2).alias("fine")).agg(F.count("*").alias("c"))).withColumn(
        "coarse", F.shiftright("fine", _LEVEL_BITS)
    )

    def crossing(counts: DataFrame, level: str, wanted: Column) -> DataFrame:
        """The bucket in which the running count passes ``wanted``, and the count before."""
        counts = counts.groupBy(F.col(level).alias("b")).agg(F.sum("c").alias("c"))
        # At most 4096 rows here.
        run = counts.withColumn("after", F.sum("c").over(Window.orderBy("b")))
        return run.filter(F.col("after") >= wanted).agg(
            F.min("b").alias("b"), F.min_by(F.col("after") - F.col("c"), "b").alias("before")
        )

    size = fine.agg(F.ceil(F.coalesce(F.sum("c"), F.lit(0)) * test).alias("want"))
    want = as_struct(size).getField("want")
    first = crossing(fine, "coarse", want)
    in_first = fine.withColumn("_f", as_struct(first)).filter(F.col("coarse") == F.col("_f.b"))
    second = crossing(in_first, "fine", want - as_struct(first).getField("before"))
    inside = keys.withColumns({"_f": as_struct(first), "_g": as_struct(second)}).filter(bucket(2) == F.col("_g.b"))
    ranked = inside.withColumn("_r", F.row_number().over(Window.orderBy("_h", "_k")))
    last = ranked.filter(
        F.col("_r") == want - F.col("_f.before") - F.col("_g.before")
    ).select(F.col("_h").alias("h"), F.col("_k").alias("k"))
    rows = hashed.withColumn("_last", as_struct(last))
    in_test = (F.col("_h") < F.col("_last.h")) | (
        (F.col("_h") == F.col("_last.h")) & (quoted(key) <= F.col("_last.k"))
    )
    return rows.withColumn(
        "split", F.when(F.coalesce(in_test, F.lit(False)), "test").otherwise("train")
    ).drop("_h", "_last")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _WORDS), "")


def build_vocab(
    df: DataFrame, columns: list[str], size: int, max_vocabulary: int = MAX_VOCABULARY
) -> DataFrame:
    """(token, n, token_id): the most frequent words, ids from 2 (0 pads, 1 is unknown)."""
    if size > max_vocabulary:
        raise ValueError(f"vocabulary size {size} above {max_vocabulary}")
    each = df.select(F.explode(F.array(*[quoted(c) for c in columns])).alias("text"))
    counted = (
        each.select(F.explode(F.split("text", _WORDS)).alias("token"))
        .filter("token <> ''")
        .groupBy("token")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(size)
    )
    # At most ``size`` rows reach this window.
    place = F.row_number().over(Window.orderBy(F.desc("n"), "token"))
    return counted.withColumn("token_id", (place + (FIRST_ID - 1)).cast("int"))


def _fixed_length(ids: pa.ChunkedArray | pa.Array, lengths: np.ndarray, width: int) -> np.ndarray:
    """Ragged ids laid out as rows of equal length, padded at the end."""
    table = np.full((len(lengths), width), PAD_ID, dtype=np.int32)
    table[np.arange(width) < lengths[:, None]] = ids
    return table


def encode_pairs(
    df: DataFrame, vocab: DataFrame, keep: list[str], max_in: int = MAX_LENGTH,
    max_tgt: int = MAX_LENGTH, max_vocabulary: int = MAX_VOCABULARY,
) -> DataFrame:
    """Fixed-length id arrays of both texts: input_ids, attention_mask, labels.

    A word has the ``token_id`` that ``vocab`` gives it, each word once. Up to
    ``max_vocabulary`` words go to every task, and texts are looked up in Arrow batches
    where they are, without a shuffle; a larger vocabulary stays where it is and is joined.
    """
    entries = vocab.select("token", "token_id").orderBy("token_id").limit(max_vocabulary + 1).collect()
    split = df.select(
        *[quoted(k) for k in keep],
        F.slice(words(F.coalesce(F.col("input"), F.lit(""))), 1, max_in).alias("_in"),
        F.slice(words(F.coalesce(F.col("target"), F.lit(""))), 1, max_tgt).alias("_tgt"),
    )
    if len(entries) > max_vocabulary:
        return _encode_by_join(split, vocab, keep, max_in, max_tgt)
    shared = df.sparkSession.sparkContext.broadcast(([r[0] for r in entries], [r[1] for r in entries]))
    ids = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        *split.schema.fields[:len(keep)],
        T.StructField("input_ids", ids), T.StructField("attention_mask", ids),
        T.StructField("labels", ids),
    ])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, numbers = (pa.array(v, t) for v, t in zip(shared.value, (pa.string(), pa.int32())))

        def look_up(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
            lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
            places = pc.index_in(column.flatten().cast(pa.string()), value_set=known)
            found = pc.fill_null(numbers.take(places), UNKNOWN_ID).to_numpy(zero_copy_only=False)
            return _fixed_length(found, lengths, width), lengths

        def as_lists(table: np.ndarray) -> pa.Array:
            offsets = np.arange(len(table) + 1, dtype=np.int32) * table.shape[1]
            return pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(table.reshape(-1), pa.int32())
            )

        for batch in batches:
            inputs, used = look_up(batch.column("_in"), max_in)
            labels, _ = look_up(batch.column("_tgt"), max_tgt)
            mask = (np.arange(max_in) < used[:, None]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep] + [as_lists(inputs), as_lists(mask), as_lists(labels)],
                names=[*keep, "input_ids", "attention_mask", "labels"],
            )

    return split.mapInArrow(encode, schema)


# A word with more than this share of all words is broadcast: there are at most 1 / HOT.
HOT = 0.001


def _encode_by_join(split: DataFrame, vocab: DataFrame, keep: list[str], max_in: int, max_tgt: int) -> DataFrame:
    """``encode_pairs`` with a vocabulary of any size.

    The different words of the texts meet the vocabulary, one row each; their ids then
    meet the words' places: those of the few hot words, known to the vocabulary or not,
    by a broadcast, all others by a shuffle, so that no task gets a hot word's places.
    """
    rows = stored(split.withColumn("_row", F.monotonically_increasing_id()), "pairs")
    each = rows.select("_row", F.posexplode(F.concat("_in", "_tgt")).alias("_at", "token"))
    used = each.groupBy("token").agg(F.count("*").alias("_times")).join(vocab.select("token", "token_id"), "token", "left")
    known = stored(used.select("token", F.coalesce("token_id", F.lit(UNKNOWN_ID)).cast("int").alias("_id"), "_times"), "words")
    hot = F.col("_times") > known.agg(F.sum("_times")).scalar() * HOT
    few = F.broadcast(known.filter(hot).select("token", F.col("_id").alias("_hot")))
    most = known.filter(~hot).select(F.col("token").alias("_word"), F.col("_id").alias("_rare"))
    # Places of hot words need no second look-up: keys of their own, which no word has, spread them.
    placed = each.join(few, "token", "left").withColumn(
        "_key", F.when(F.col("_hot").isNull(), F.col("token")).otherwise(F.concat(F.lit(" "), F.col("_row").cast("string")))
    ).join(most, F.col("_key") == F.col("_word"), "left")
    # At most ``max_in + max_tgt`` ids a row.
    packed = placed.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("_hot", "_rare").alias("_id")))).alias("_ids"))
    ids = F.transform(F.coalesce("_ids", F.array().cast("array<struct<_at: int, _id: int>>")), lambda p: p["_id"])
    n_in, n_tgt = F.size("_in"), F.size("_tgt")

    def padded(values: Column, used: Column, width: int) -> Column:
        return F.concat(values, F.array_repeat(F.lit(PAD_ID), F.lit(width) - used))

    return rows.join(packed, "_row", "left").select(
        *[quoted(k) for k in keep],
        padded(F.slice(ids, F.lit(1), n_in), n_in, max_in).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), n_in), F.array_repeat(F.lit(0), F.lit(max_in) - n_in)).alias("attention_mask"),
        padded(F.slice(ids, n_in + 1, n_tgt), n_tgt, max_tgt).alias("labels"),
    )


def score_predictions(df: DataFrame) -> DataFrame:
    """Add match_score: 1 - edit distance / longer length; equal empty texts score 1."""
    expected = F.coalesce(F.col("expected"), F.lit("")) if "expected" in df.columns else F.lit("")
    generated = F.coalesce(F.col("generated"), F.lit(""))
    longest = F.greatest(F.length(expected), F.length(generated))
    score = 1 - F.levenshtein(expected, generated) / F.when(longest > 0, longest)
    return df.withColumn("expected", expected).withColumn(
        "match_score", F.coalesce(score, F.lit(1.0))
    )


def score_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("tests"),
        F.bround(F.avg("match_score"), 2).alias("mean_score"),
        F.count_if(F.col("match_score") > PASS_ABOVE).alias("passed"),
    )
