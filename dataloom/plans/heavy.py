"""The most frequent texts of columns, exactly.

Two steps. A mergeable summary of frequent items (Spark's ``approx_top_k``, a Misra-Gries
sketch) names candidates in one pass that shuffles nothing but summaries; a second pass
counts the candidates exactly. The sketch's error bound then proves, column by column,
whether any other text could be as frequent as the k-th candidate. Columns without
such proof, whose texts hardly repeat, are counted by 128-bit digests.

Equally frequent texts are ordered by the whole text without gathering them: where they
are few, tasks look for them by digest; where they are many, the smallest texts of the
column are taken in growing numbers until enough of them have the count in question.
Either way a task sends no more texts than asked for.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from dataloom.functions.columns import quoted
from dataloom.plans.long_form import frequencies, text_key
from dataloom.plans.shared import stored
from dataloom.plans.smallest import smallest_texts

# Candidates of a column, and what the summary keeps: its map has 16,384 places, and its
# estimates are off by at most 3.5 / 16,384 of the rows.
CANDIDATES = 1000
TRACKED = 12_288
_ERROR = 3.5 / 16_384
# Equally frequent texts that are looked for by digest.
FEW_TIES = 10_000


def top_texts(df: DataFrame, names: list[str], k: int, counted: DataFrame | None = None) -> DataFrame:
    """(column, string_value, n, rank): the k most frequent texts of each column, by its
    place in ``names``; of equally frequent ones the smallest.

    ``counted``, if there is one, holds stored ``frequencies`` of the columns.
    """
    if not names:
        return df.sparkSession.createDataFrame([], "column int, string_value string, n long, rank int")
    texts = df.select(*[quoted(n).alias(f"c{i}") for i, n in enumerate(names)])
    levels: dict[int, _Level] = {}
    if counted is None:
        counted, levels = _counts(texts, len(names), k)
    rest = [i for i in range(len(names)) if i not in levels]
    if rest:
        falling = Window.partitionBy("column").orderBy(F.desc("n"))
        spread = counted.filter(F.col("column").isin(rest)).groupBy("column", "n").agg(F.count("*").alias("texts"))
        # At most k rows a column.
        rows = spread.withColumn("rank", F.row_number().over(falling)).filter(F.col("rank") <= k).collect()
        levels |= {i: _level([r for r in rows if r["column"] == i], k) for i in rest}
    levels = {i: level for i, level in levels.items() if level is not None}
    if not levels:
        return df.sparkSession.createDataFrame([], "column int, string_value string, n long, rank int")
    # A slot for what is above a column's level, and one for what is on it.
    level = F.get(F.array(*[F.lit(levels[i].n if i in levels else None).cast("long") for i in range(len(names))]), F.col("column"))
    near = counted.select("column", "h1", "h2", "n").filter(F.col("n") >= level)
    slotted = near.withColumn("slot", F.col("column") * 2 + (F.col("n") == level).cast("int"))
    many = [i for i, found in levels.items() if found.ties > FEW_TIES]
    few = slotted.filter(~F.col("slot").isin([2 * i + 1 for i in many]))
    parts = [_found(texts, few, len(names), k)]
    for i in many:
        parts.append(_smallest_ties(texts, i, slotted.filter(F.col("slot") == 2 * i + 1).drop("slot"), levels[i].wanted))
    last = Window.partitionBy("column").orderBy(F.desc("n"), "string_value")
    whole = reduce(DataFrame.unionByName, parts)
    return whole.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k)


class _Level(NamedTuple):
    """The count at rank k of a column; all texts above it are chosen, and of the ``ties``
    that have it the ``wanted`` smallest."""

    n: int
    wanted: int
    ties: int


def _level(rows: Iterable[Row], k: int) -> _Level | None:
    """From (n, texts): how many texts have a count; None where there is no text."""
    above, found = 0, None
    for row in sorted(rows, key=lambda r: -r["n"]):
        if above >= k:
            break
        found = _Level(row["n"], k - above, row["texts"])
        above += row["texts"]
    return found


def _keys(text: Column) -> list[Column]:
    return [c.alias(n) for c, n in zip(text_key(text), ("h1", "h2"))]


def _long(texts: DataFrame, places: list[int]) -> DataFrame:
    cells = [x for i in places for x in (F.lit(i), F.col(f"c{i}"))]
    long = texts.select(F.stack(F.lit(len(places)), *cells).alias("column", "text")).filter("text is not null")
    return long.select("column", "text", *_keys(F.col("text")))


def _counts(texts: DataFrame, n_columns: int, k: int) -> tuple[DataFrame, dict[int, _Level | None]]:
    """(column, h1, h2, n), stored: counts of all texts that may be among the first k; and
    the levels of the columns for which the candidates are proven to be enough."""
    key = lambda i: text_key(F.col(f"c{i}"))[0]
    one = texts.select(*[c for i in range(n_columns) for c in (F.col(f"c{i}"), key(i).alias(f"h{i}"))]).agg(*[
        c for i in range(n_columns) for c in (
            F.expr(f"approx_top_k(h{i}, {CANDIDATES}, {TRACKED}) FILTER (WHERE c{i} IS NOT NULL)").alias(f"top{i}"),
            F.count(f"c{i}").alias(f"all{i}"),
        )
    ])
    rows = [F.struct(F.lit(i).alias("column"), F.col(f"all{i}").alias("all"), F.col(f"top{i}").alias("top")) for i in range(n_columns)]
    full = F.when(F.size("top") >= CANDIDATES, F.array_min(F.transform("top", lambda t: t["count"]))).otherwise(0)
    # At most CANDIDATES a column.
    candidates = F.broadcast(one.select(F.inline(F.array(*rows))).select(
        "column", "all", F.greatest(F.col("all") * 2 * _ERROR, full).alias("bound"), F.explode("top.item").alias("h1")
    ))
    exact = stored(_long(texts, range(n_columns)).join(candidates, ["column", "h1"]).groupBy("column", "h1", "h2").agg(
        F.count("*").alias("n"), F.max("all").alias("all"), F.max("bound").alias("bound")
    ), "counts")
    spread = exact.groupBy("column", "n").agg(F.count("*").alias("texts"), F.max("all").alias("all"), F.max("bound").alias("bound")).collect()
    levels: dict[int, _Level | None] = {}
    for i in range(n_columns):
        own = [r for r in spread if r["column"] == i]
        # Proven: k candidates are more frequent than any other text can be, or there is no other.
        if sum(r["texts"] for r in own if r["n"] > r["bound"]) >= k or own and sum(r["n"] * r["texts"] for r in own) == own[0]["all"]:
            levels[i] = _level(own, k)
    unproven = [i for i in range(n_columns) if i not in levels]
    if not unproven:
        return exact, levels
    every = frequencies(texts, [f"c{i}" for i in unproven])
    at = F.get(F.array(*map(F.lit, unproven)), F.col("column"))
    rest = every.select(at.alias("column"), "h1", "h2", "n")
    return stored(exact.filter(~F.col("column").isin(unproven)).select("column", "h1", "h2", "n").unionByName(rest), "counts"), levels


def _found(texts: DataFrame, wanted: DataFrame, n_columns: int, most: int) -> DataFrame:
    """(column, string_value, n) of the ``most`` smallest texts of each slot among those
    of the wanted digests, which are few: less than k, or FEW_TIES, a slot."""
    keys = ["column", "h1", "h2"]
    members = _long(texts, range(n_columns)).join(F.broadcast(wanted), keys)
    # One column for each slot, so that a task keeps the smallest of each.
    slots = [f"s{s}" for s in range(2 * n_columns)]
    apart = members.select(*[F.when(F.col("slot") == s, F.col("text")).alias(f"s{s}") for s in range(len(slots))])
    small = smallest_texts(apart, slots, most).select(
        F.floor(F.col("column") / 2).cast("int").alias("column"), F.col("value").alias("text"), *_keys(F.col("value"))
    )
    return small.join(F.broadcast(wanted), keys).select("column", F.col("text").alias("string_value"), "n")


def _smallest_ties(texts: DataFrame, place: int, ties: DataFrame, wanted: int) -> DataFrame:
    """The ``wanted`` smallest texts of one column among many equally frequent ones."""
    most = max(64, 4 * wanted)
    while True:
        small = stored(smallest_texts(texts, [f"c{place}"], most).select(
            F.lit(place).alias("column"), F.col("value").alias("text"), *_keys(F.col("value"))
        ), "smallest")
        hits = stored(ties.join(small.drop("column"), ["h1", "h2"]).select("column", F.col("text").alias("string_value"), "n"), "ties")
        if hits.count() >= wanted or small.count() < most:
            return hits
        most *= 8
