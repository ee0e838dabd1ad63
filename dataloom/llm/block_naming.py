"""Exact duplicates by deterministic block naming.

A text without white space is cut into blocks of fixed size. The distinct blocks are
sorted and numbered: equal blocks get one integer name, different ones two. Adjacent
names are then paired, the distinct pairs sorted and numbered, and so on until one name
is left for a document. Together with the text's length it is an identity: two texts
have the same one if and only if they are equal.

A block's text is shuffled once, after each task has dropped its repeats. Rows find the
name of their block by a 128-bit key; that no two different blocks share a key is
checked over all blocks, and otherwise the naming starts again with another seed, so the
identity does not rest on a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dataloom.llm.common import WHITE_SPACE, picked, rows_of, text_or_empty
from dataloom.plans.shared import stored

# Bytes of a block.
BLOCK = 4096


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, f"[{WHITE_SPACE}]+", "")


def _blocks(rows: DataFrame, size: int, seed: int) -> DataFrame:
    """One row per block; an empty text has one empty block."""
    parts = rows.withColumn("n_bytes", F.octet_length("bytes")).withColumn("parts", F.expr(
        f"transform(sequence(0, greatest(0, (n_bytes - 1) div {size})), "
        f"i -> substring(bytes, i * {size} + 1, {size}))"
    ))
    kept = [c for c in parts.columns if c not in ("bytes", "parts")]
    return parts.select(*kept, F.size("parts").alias("width"), F.posexplode("parts").alias("place", "block")).withColumns({
        "key_a": F.xxhash64("block", F.lit(seed)), "key_b": F.xxhash64(F.lit(seed), "block"),
    })


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Integer names in sorted order, from the place in the sorted partition."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _named_blocks(docs: DataFrame, size: int) -> DataFrame:
    """row, id, n_chars, n_bytes, digest, width, place, name of every block of every row."""
    texts = docs.select("id", text_or_empty().alias("text")).withColumns({
        "row": F.monotonically_increasing_id(), "n_chars": F.char_length("text").cast("long"),
        "bare": without_space(F.col("text")),
    })
    seed = 0
    while True:
        blocks = _blocks(texts.select(F.col("bare").cast("binary").alias("bytes")), size, seed)
        names = _named(blocks.select("key_a", "key_b", "block").distinct(), ["block"])
        names = names.groupBy("key_a", "key_b").agg(F.min("name").alias("name"), F.count("*").alias("clash"))
        rows = _blocks(
            texts.select("row", "id", "n_chars", F.sha2("bare", 256).alias("digest"), F.col("bare").cast("binary").alias("bytes")),
            size, seed,
        ).drop("block").withColumn("digest", F.when(F.col("place") == 0, F.col("digest")))
        found = stored(rows.join(names, ["key_a", "key_b"]).drop("key_a", "key_b"), "blocks")
        if found.where("clash > 1").isEmpty():
            return found.drop("clash")
        seed += 1


def _paired(named: DataFrame) -> DataFrame:
    """Names of adjacent pairs; a last one without partner is paired with -1."""
    half = F.col("place").bitwiseAND(1)
    pairs = named.groupBy("row", F.shiftright("place", 1).alias("place")).agg(
        F.max(F.when(half == 0, F.col("name"))).alias("left"),
        F.coalesce(F.max(F.when(half == 1, F.col("name"))), F.lit(-1)).alias("right"),
        F.first(F.shiftright(F.col("width") + 1, 1)).alias("width"),
    )
    names = _named(pairs.select("left", "right").distinct(), ["left", "right"])
    return pairs.join(names, ["left", "right"]).select("row", "place", "width", "name")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``row, id, n_chars, n_bytes, digest, name`` of every row of ``docs``.

    ``(n_bytes, name)`` is equal exactly where the texts without white space are.
    ``digest`` is the SHA-256 of that text and takes no part in the naming.
    """
    level = named = _named_blocks(picked(docs, id=id_col, text=text_col), block)
    done = named.where("width = 1").select("row", "name")
    while not (rest := level.where("width > 1").select("row", "place", "width", "name")).isEmpty():
        level = stored(_paired(rest), "names")
        done = done.unionAll(level.where("width = 1").select("row", "name"))
    return named.where("place = 0").drop("place", "width", "name").join(done, "row")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Which row stays of every group of texts that are equal without white space.

    One row per row of ``docs``: ``id, n_chars, keep_id, group_size, kept, digest``. The
    row with the most code points in its own text stays, of those the smallest id. NULL
    text counts as empty, a NULL id comes after all others, of rows that repeat id and
    text one stays. An empty table gives no rows.
    """
    rows = stored(identities(docs, id_col, text_col, block), "identities")
    groups = rows.groupBy("n_bytes", "name").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("id").isNull().alias("none"), "id", "row")).alias("first"),
    )
    return rows.join(groups, ["n_bytes", "name"]).select(
        "id", "n_chars", F.col("first.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"), "digest",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = stored(exact_copies(docs, id_col, text_col), "copies")
    # Rows that repeat id, text and length are the same but for other columns.
    kept = rows.groupBy("id", "digest", "n_chars").agg(
        F.count("*").alias("n_rows"), F.max("kept").alias("kept")
    ).where("kept").drop("kept")
    text = text_or_empty(F.col(f"c{docs.columns.index(text_col)}"))
    keys = {
        "id": F.col(f"c{docs.columns.index(id_col)}"),
        "digest": F.sha2(without_space(text), 256), "n_chars": F.char_length(text).cast("long"),
    }
    return rows_of(docs, keys, kept)
