"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source x language x topic). The tokens of the cells are raked:
one margin after the other is scaled to its target weights, never above the tokens a cell
has, until all margins agree. What a value cannot fill is asked of the other values of its
margin first, so that every margin has the same total. A cell's fitted share of its tokens is the probability with
which each of its documents is drawn, so a mixture meets the targets without repeats.

Only the cells take part in the raking: one row for each combination of values, whatever
the number of documents. A hot source is one number by the time it is shuffled.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from dataloom.llm.common import WHITE_SPACE, by_place, place, text_or_empty
from dataloom.plans.shared import stored

# Share of all tokens that is drawn; exponent that tempers the margins' natural weights;
# largest error of a value's tokens, by its goal, at which margins agree; the least part of
# the error that the rounds planned at once must take away, else raking ends. ROUNDS are
# those of the SQL, which rakes the unfilled goals as they are.
SHARE = 0.7
POWER = 0.7
TOLERANCE = 1e-3
_GAIN = 0.02
ROUNDS = 10
# Rounds planned at once, before the cells are written.
_AT_ONCE = 5
# Cells that the driver rakes at most; more are raked by Spark.
_ON_DRIVER = 65_536

# A document table without a topic gets one from its whole text.
_WORD = f"[^{WHITE_SPACE}]+"
_SIGNS = f"[^\\p{{L}}\\p{{N}}{WHITE_SPACE}]+"
_LEGAL = "(?i)licen[sc]e"


def tokens_of(text: Column) -> Column:
    """Words and one end, so that every document weighs something."""
    return (F.regexp_count(text, F.lit(_WORD)) + 1).cast("long")


def topic_of(text: Column) -> Column:
    """``legal``: names a licence; ``marked``: a twelfth of it or more is signs; ``prose``."""
    signs = F.char_length(text) - F.char_length(F.regexp_replace(text, _SIGNS, ""))
    return (
        F.when(text.rlike(_LEGAL), "legal").when((signs > 0) & (signs * 12 >= F.char_length(text)), "marked").otherwise("prose")
    )


def draw(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that only the key and the seed decide."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _targets(cells: DataFrame, margins: list[str], weights: dict, total: float, share: float, power: float) -> DataFrame:
    """Adds the target tokens of each margin's value to every cell."""
    for m in margins:
        own = F.sum("n").over(Window.partitionBy(m)).cast("double")
        if m in weights:
            whole = float(sum(weights[m].values()))
            given = reduce(lambda c, v: c.when(F.col(m).eqNullSafe(F.lit(v)), F.lit(weights[m][v] / whole)), weights[m], F.when(F.lit(False), 0.0))
            cells = cells.withColumn(f"to_{m}", F.coalesce(given, F.lit(0.0)) * (total * share))
        else:
            cells = cells.withColumn(f"of_{m}", own)
    tempered = [m for m in margins if m not in weights]
    if tempered:
        # Each value's weight counts once: its cells' parts of it add up to one.
        sums = cells.agg(*[F.sum(F.col("n") * F.pow(f"of_{m}", F.lit(power - 1))).alias(m) for m in tempered]).first()
        for m in tempered:
            goal = F.pow(f"of_{m}", F.lit(power)) * (total * share / (sums[m] or 1.0))
            cells = cells.withColumn(f"to_{m}", goal).drop(f"of_{m}")
    return cells


def filled_goals(cells: DataFrame, margins: list[str]) -> DataFrame:
    """Clips the goals ``to_...`` of each margin to the tokens ``n`` of its values, and
    spreads the rest over its other values by their goals; all margins get the same total,
    the largest that each can fill."""
    own = {m: F.sum("n").over(Window.partitionBy(m)).cast("double") for m in margins}
    cells = stored(cells.withColumns({f"of_{m}": c for m, c in own.items()}), "goals")
    # A value's cells have parts of its goal that add up to it.
    part = lambda m: F.col(f"to_{m}") * F.col("n") / F.col(f"of_{m}")
    first = cells.agg(
        *[F.sum(part(m)).alias(f"to_{m}") for m in margins], *[F.sum(F.when(F.col(f"to_{m}") > 0, F.col("n"))).alias(f"of_{m}") for m in margins]
    ).first()
    total = min((min(first[f"to_{m}"] or 0.0, float(first[f"of_{m}"] or 0)) for m in margins), default=0.0)
    times, full = {m: total / first[f"to_{m}"] if first[f"to_{m}"] else 0.0 for m in margins}, None
    while True:
        over = {m: F.col(f"of_{m}") <= F.col(f"to_{m}") * times[m] for m in margins}
        now = cells.agg(
            *[F.count_if(over[m]).alias(f"k_{m}") for m in margins],
            *[F.coalesce(F.sum(F.when(over[m], F.col("n"))), F.lit(0)).cast("double").alias(f"of_{m}") for m in margins],
            *[F.coalesce(F.sum(F.when(~over[m], part(m))), F.lit(0.0)).alias(f"to_{m}") for m in margins],
        ).first()
        if full == (full := [now[f"k_{m}"] for m in margins]):
            break
        # Full values stay full: the others' factor only rises.
        times = {m: max(times[m], (total - now[f"of_{m}"]) / now[f"to_{m}"]) if now[f"to_{m}"] > 0 else times[m] for m in margins}
    goals = {f"to_{m}": F.least(F.col(f"of_{m}"), F.col(f"to_{m}") * times[m]) for m in margins}
    return cells.withColumns(goals).drop(*[f"of_{m}" for m in margins])


def _raked(cells: DataFrame, margins: list[str], rounds: int) -> DataFrame:
    for _ in range(rounds):
        for m in margins:
            now = F.sum("w").over(Window.partitionBy(m))
            cells = cells.withColumn("w", F.when(now > 0, F.least(F.col("n").cast("double"), F.col("w") * F.col(f"to_{m}") / now)).otherwise(0.0))
    return stored(cells, "cells")


def margin_error(cells: DataFrame, margins: list[str]) -> float:
    """The largest difference between a value's fitted tokens and its goal, by the goal."""
    apart = [
        F.when(F.col(f"to_{m}") > 0, F.abs(F.sum("w").over(Window.partitionBy(m)) / F.col(f"to_{m}") - 1)).otherwise(0.0).alias(m)
        for m in margins
    ]
    return float(cells.select(F.greatest(F.lit(0.0), *apart).alias("error")).agg(F.max("error")).first()[0] or 0.0)


def _agreed(cells: DataFrame, margins: list[str]) -> tuple[DataFrame, float]:
    """Cells raked until no error is above the tolerance or errors no longer fall."""
    before, error = float("inf"), margin_error(cells, margins)
    while TOLERANCE < error < before * (1 - _GAIN):
        cells, before = _raked(cells, margins, _AT_ONCE), error
        error = margin_error(cells, margins)
    return cells, error


def _agreed_here(cells: DataFrame, margins: list[str]) -> tuple[DataFrame, float]:
    """The same for few cells, on the driver."""
    rows = cells.collect()
    n = np.array([float(r["n"]) for r in rows])
    codes, goals = [], []
    for m in margins:
        values = {v: k for k, v in enumerate(dict.fromkeys(r[m] for r in rows))}
        codes.append(np.array([values[r[m]] for r in rows], np.int64))
        goals.append(np.zeros(len(values)))
        goals[-1][codes[-1]] = [r[f"to_{m}"] for r in rows]
    w = n.copy()

    def apart() -> float:
        sums = [np.bincount(c, w, len(g)) for c, g in zip(codes, goals)]
        return max([0.0, *(float(abs(s[g > 0] / g[g > 0] - 1).max(initial=0.0)) for s, g in zip(sums, goals))])

    before, error = float("inf"), apart()
    while TOLERANCE < error < before * (1 - _GAIN):
        for _ in range(_AT_ONCE):
            for c, g in zip(codes, goals):
                now = np.bincount(c, w, len(g))
                w = np.minimum(n, w * np.divide(g, now, out=np.zeros(len(g)), where=now > 0)[c])
        before, error = error, apart()
    return cells.sparkSession.createDataFrame([(*r[:-1], float(x)) for r, x in zip(rows, w)], cells.schema), error


def raked_cells(
    cells: DataFrame, margins: list[str], weights: dict[str, dict] | None = None, share: float = SHARE,
    power: float = POWER, rounds: int | None = None,
) -> DataFrame:
    """``cells(margins..., n)`` with each margin's goal ``to_...``, the fitted tokens ``w``,
    the ``probability`` w / n and the largest ``error`` of a value, by its goal.

    ``weights`` gives target shares of a margin's values, unnamed values get none; a margin
    without them is tempered: a value's weight is its tokens to the power of ``power``.
    Goals that a value cannot fill pass to the others of its margin, and raking goes on
    until no error is above ``TOLERANCE`` or errors no longer fall; an error left over is
    logged. With ``rounds``, goals stay as they are and are raked so often.
    """
    total = float(cells.agg(F.sum("n")).first()[0] or 0)
    goals = _targets(cells, margins, weights or {}, total, share, power)
    start = filled_goals(goals, margins) if rounds is None else goals
    fitted = stored(start.withColumn("w", F.col("n").cast("double")), "cells")
    if rounds is not None:
        for k in range(0, rounds, _AT_ONCE):
            fitted = _raked(fitted, margins, min(_AT_ONCE, rounds - k))
        error = margin_error(fitted, margins)
    else:
        few = fitted.count() <= _ON_DRIVER
        fitted, error = (_agreed_here if few else _agreed)(fitted, margins)
    if error > TOLERANCE:
        logging.getLogger(__name__).warning("margins differ from their goals by up to %.4f", error)
    return fitted.withColumn("probability", F.col("w") / F.col("n")).withColumn("error", F.lit(error))


def _celled(docs: DataFrame, id_col: str, text_col: str, margins: dict[str, str | None]) -> DataFrame:
    """All columns by place, with key, tokens and the margins' values."""
    rows = by_place(docs)
    text = text_or_empty(F.col(place(docs, text_col)))
    values = {
        m: topic_of(text) if c is None else F.col(place(docs, c)).cast("string") for m, c in margins.items()
    }
    key = F.coalesce(F.col(place(docs, id_col)).cast("string"), F.md5(text))
    return rows.withColumns({"key": key, "tokens": tokens_of(text)} | values)


MARGINS: dict[str, str | None] = {"source": "source", "lang": "lang", "topic": None}


def _drawn(docs, id_col, text_col, margins, seed, given) -> DataFrame:
    rows = _celled(docs, id_col, text_col, margins)
    cells = stored(rows.groupBy(*margins).agg(F.sum("tokens").alias("n")), "cells")
    fitted = raked_cells(cells, list(margins), **given).select(
        *[F.col(m).alias(f"at_{m}") for m in margins], "probability"
    )
    # One row for each cell; Spark broadcasts them where their written size allows.
    on = reduce(lambda a, b: a & b, [F.col(m).eqNullSafe(F.col(f"at_{m}")) for m in margins])
    joined = rows.join(fitted, on, "left").drop(*[f"at_{m}" for m in margins])
    return joined.withColumn("chosen", draw(F.col("key"), seed) < F.col("probability"))


def mixture(
    docs: DataFrame, margins: dict[str, str | None] = MARGINS, id_col: str = "doc_id", text_col: str = "text",
    seed: int = 0, **given,
) -> DataFrame:
    """``id``, the margins' values, ``tokens, probability, chosen`` of every row of ``docs``.

    ``margins`` maps a margin to a column, or to None for the topic of the text. ``given``
    goes to ``raked_cells``. NULL is a value of its own, NULL text counts as empty, rows
    that repeat an id share its fate, rows without id are drawn by their text. An empty
    table gives no rows.
    """
    rows = _drawn(docs, id_col, text_col, margins, seed, given)
    return rows.select(F.col(place(docs, id_col)).alias("id"), *margins, "tokens", "probability", "chosen")


def draw_mixture(
    docs: DataFrame, margins: dict[str, str | None] = MARGINS, id_col: str = "doc_id", text_col: str = "text",
    seed: int = 0, **given,
) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns."""
    rows = _drawn(docs, id_col, text_col, margins, seed, given).where("chosen")
    return rows.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def mixture_sql(
    margins: tuple[str, ...] = ("source", "lang", "topic"), share: float = SHARE, power: float = POWER,
    rounds: int = ROUNDS,
) -> str:
    """The same mixture of ``documents`` for an engine with RE2 patterns."""
    steps = []
    before = "start"
    for k in range(rounds):
        for m in margins:
            name = f"r{k}_{m}"
            steps.append(
                f"{name} AS (SELECT * REPLACE (LEAST(CAST(n AS DOUBLE), w * to_{m} / "
                f"sum(w) OVER (PARTITION BY {m})) AS w) FROM {before})"
            )
            before = name
    own = ", ".join(f"CAST(sum(n) OVER (PARTITION BY {m}) AS DOUBLE) AS of_{m}" for m in margins)
    goals = ", ".join(
        f"pow(of_{m}, {power}) * ((SELECT sum(n) FROM cells) * {share} / (SELECT sum(n * pow(of_{m}, {power - 1})) FROM sized)) AS to_{m}"
        for m in margins
    )
    on = " AND ".join(f"d.{m} IS NOT DISTINCT FROM c.{m}" for m in margins)
    return f"""
WITH texts AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
measured AS (SELECT *, length(text) - length(regexp_replace(text, '{_SIGNS}', '', 'g')) AS signs FROM texts),
docs AS (SELECT doc_id, source, lang,
    CASE WHEN regexp_matches(text, '{_LEGAL}') THEN 'legal'
         WHEN signs > 0 AND signs * 12 >= length(text) THEN 'marked' ELSE 'prose' END AS topic,
    CAST(len(regexp_extract_all(text, '{_WORD}')) + 1 AS BIGINT) AS tokens,
    CAST(('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), md5(text))), 1, 13)) AS BIGINT) / pow(2, 52) AS u
  FROM measured),
cells AS MATERIALIZED (SELECT {', '.join(margins)}, CAST(sum(tokens) AS BIGINT) AS n FROM docs GROUP BY ALL),
sized AS MATERIALIZED (SELECT *, {own} FROM cells),
start AS (SELECT {', '.join(margins)}, n, CAST(n AS DOUBLE) AS w, {goals} FROM sized),
{(',' + chr(10)).join(steps)}
SELECT d.doc_id, {', '.join(f'd.{m}' for m in margins)}, d.tokens, round(c.w / c.n, 6) AS probability,
  d.u < c.w / c.n AS chosen
FROM docs d JOIN {before} c ON {on}
"""
