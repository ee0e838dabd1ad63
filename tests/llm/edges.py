"""Small frames with missing values, repeats, extremes and clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# Names that operators use for columns of their own.
CLASHES = ["id", "row", "name", "mark", "print", "node", "bucket", "root", "shard", "key", "tokens", "score"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def words(n: int, seed: int) -> str:
    own = random.Random(seed)
    return " ".join("".join(own.choice("abcdefgh") for _ in range(own.randint(2, 7))) for _ in range(n))


def edge_rows() -> list[tuple]:
    long_text = words(30_000, 1)
    base = words(120, 2)
    texts = [
        (1, base), (2, base), (2, base), (3, base + " "), (4, base.replace(" ", "\n")), (5, base.upper()),
        (6, ""), (7, None), (8, " \t\n "), (None, base), (None, None), (None, words(40, 3)), (9, long_text),
        (10, long_text + " end"), (11, "x"), (12, "Ünï çødé ß 漢字 🙂 " + words(30, 4)), (12, words(50, 5)),
        (13, "a" * 9000), (14, "<|endoftext|> " + words(10, 6)), (15, "...!!!"), (16, "the the the"),
        (17, words(200, 7) + "\n" + words(30, 8) + "\n\n" + words(30, 8)),
        (18, words(200, 9) + "\n" + words(30, 8).upper() + "\n" + words(30, 8)[:-1]),
    ]
    return [
        (i, t, [None, "en", "de"][k % 3], [None, "s1", "s2", "s1"][k % 4], None if t is None else len(t), *["x"] * len(CLASHES))
        for k, (i, t) in enumerate(texts)
    ]


def edge_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
