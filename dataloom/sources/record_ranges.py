"""Records of CSV files and JSON arrays, found by many tasks in one file.

Spark cuts a file into byte ranges, and a range may begin anywhere: inside a quoted value,
inside a string, some levels deep. So each task reads its range twice over at once, as
if it began outside and as if it began inside, and reports both ends. Composing these
reports range after range, one small row each, tells how every range really began; that
picks one of the two readings. What lies in one piece of text is a record as it is, and
only records of several pieces are put together by a grouping.

CSV is read in lines. JSON is read in pieces that end with a closing brace, as an array
may have no line ends at all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dataloom.plans.shared import stored

# Ranges whose beginnings are broadcast; more are joined by a shuffle.
BROADCAST_RANGES = 100_000
_KEYS = ["file", "block"]


def _pieces(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """``value, file, block``: the pieces of all files, those of a range in order."""
    return spark.read.option("lineSep", ending).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )


def _walked(pieces: DataFrame, walk: Callable[[], Callable], columns: dict[str, pa.DataType]) -> DataFrame:
    """Each piece with its number in its range and what ``walk`` says of it; ``walk()``
    gives a function of one range's pieces in order."""
    names = ["value", *_KEYS, "row", *columns]
    kinds = ", ".join(f"{n} {'boolean' if t == pa.bool_() else 'long'}" for n, t in columns.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = step = None
        row = 0
        for batch in batches:
            rows, found = [], []
            for value, *place in zip(*(c.to_pylist() for c in batch.columns)):
                if place != key:
                    key, step, row = place, walk(), 0
                rows.append(row)
                found.append(step(value, row, place[1]))
                row += 1
            more = [pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * len(columns), columns.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int64()), *more], names)

    return stored(pieces.mapInArrow(run, f"value string, file string, block long, row long, {kinds}"), "pieces")


def _begun(pieces: DataFrame, ends: list[str], chain: Callable[[pd.DataFrame], pd.DataFrame], kinds: str) -> DataFrame:
    """How each range really begins: ``chain`` composes the last rows of a file's ranges."""
    # Each column by itself: a struct would have the pieces sorted, not hashed, by range.
    last = pieces.groupBy(*_KEYS).agg(*[F.max_by(c, "row").alias(c) for c in ends])
    schema = f"file string, block long, {kinds}"

    def run(ranges: pd.DataFrame) -> pd.DataFrame:
        return chain(ranges.sort_values("block").reset_index(drop=True))

    return stored(last.groupBy("file").applyInPandas(run, schema), "ranges")


def _with_beginnings(pieces: DataFrame, begun: DataFrame) -> DataFrame:
    small = begun.count() <= BROADCAST_RANGES
    return pieces.join(F.broadcast(begun) if small else begun, _KEYS)


def _put_together(parts: DataFrame, between: str, first: list[str]) -> DataFrame:
    """One row for each (``file, of_block, of_row``): its pieces in order."""
    pieces = F.sort_array(F.collect_list(F.struct("block", "row", "value")))
    return parts.groupBy("file", "of_block", "of_row").agg(
        F.array_join(F.transform(pieces, lambda p: p["value"]), between).alias("value"), *[F.max(c).alias(c) for c in first]
    )


# CSV


def ends_inside(line: str, inside: bool, delimiter: str = ",") -> bool:
    """Whether a quoted value is open behind a line that began ``inside`` one or not. A
    quote opens a value only where a field begins; within it two quotes are one."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside = False
            # What follows a closing quote belongs to the field.
            at = line.find(delimiter, at + 1) + 1
            if not at:
                return False
        found = line.find('"', at)
        if found < 0:
            return False
        if found == 0 or line[found - 1] == delimiter:
            inside, at = True, found + 1
            continue
        at = line.find(delimiter, found) + 1
        if not at:
            return False


def has_open_lines(spark: SparkSession, path: str) -> bool:
    """Whether any line leaves a quoted value open, so that a record has several lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = any(ends_inside(line, False) for line in batch.column(0).to_pylist())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([True])], ["open"])
                return

    quoted = spark.read.option("lineSep", "\n").text(path).select("value").where(F.contains("value", F.lit('"')))
    return not quoted.mapInArrow(run, "open boolean").isEmpty()


def _csv_walk() -> Callable:
    # As if the range began outside (0) and inside (1) a quoted value.
    state, record, head = [False, True], [-1, -1], [-1]

    def step(line: str, row: int, block: int) -> tuple:
        before = list(state)
        for k in (0, 1):
            if not state[k]:
                record[k] = row
        if block == 0 and head[0] < 0 and line.strip("﻿ \t\r"):
            head[0] = row
        if '"' in line:
            if row == 0 and block == 0:
                line = line.removeprefix("﻿")
            state[0] = ends_inside(line, state[0])
            state[1] = ends_inside(line, state[1]) if before[0] != before[1] else state[0]
        return *before, *state, *record, block == 0 and record[0] == head[0]

    return step


def _csv_chain(ranges: pd.DataFrame) -> pd.DataFrame:
    inside, owner, rows = False, (-1, -1), []
    for r in ranges.itertuples():
        rows.append((r.file, r.block, inside, *owner))
        after, record = (r.after_1, r.record_1) if inside else (r.after_0, r.record_0)
        if not after:
            owner = (-1, -1)
        elif record >= 0:
            owner = (r.block, record)
        inside = bool(after)
    frame = pd.DataFrame(rows, columns=["file", "block", "inside", "owner_block", "owner_row"])
    return frame.assign(unclosed=[False] * (len(frame) - 1) + [inside])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``value, head``: the records of CSV files with line breaks in quoted values, and
    whether a record is its file's first. A file whose last quoted value is not closed
    stops the reading: where its records end is then unknown."""
    names = ["before_0", "before_1", "after_0", "after_1", "record_0", "record_1", "head"]
    kinds = [pa.bool_()] * 4 + [pa.int64()] * 2 + [pa.bool_()]
    lines = _walked(_pieces(spark, path, "\n"), _csv_walk, dict(zip(names, kinds)))
    begun = _begun(
        lines, ["after_0", "after_1", "record_0", "record_1"], _csv_chain,
        "inside boolean, owner_block long, owner_row long, unclosed boolean",
    )
    unclosed = begun.where("unclosed").select("file").head()
    if unclosed is not None:
        raise ValueError(f"a quoted value is not closed at the end of {unclosed[0]}")
    real = lambda n: F.when(F.col("inside"), F.col(f"{n}_1")).otherwise(F.col(f"{n}_0"))
    read = _with_beginnings(lines, begun).select(
        *_KEYS, "row", "value", "head", (~real("before") & ~real("after")).alias("whole"), real("record").alias("record"),
        "owner_block", "owner_row",
    )
    own = F.col("record") >= 0
    parts = read.where("not whole").withColumns({
        "of_block": F.when(own, F.col("block")).otherwise(F.col("owner_block")),
        "of_row": F.when(own, F.col("record")).otherwise(F.col("owner_row")),
    })
    records = read.where("whole").select("value", "head").unionByName(_put_together(parts, "\n", ["head"]).select("value", "head"))
    bare = F.regexp_replace("value", "^﻿|\r$", "")
    return records.select(bare.alias("value"), "head").where(F.trim("value") != "")


# JSON

_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.DOTALL)
_REST_OF_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*', re.DOTALL)
_OPENING = "^\ufeff?\\s*\\["


def levels(piece: str, inside: bool) -> tuple[bool, int]:
    """Whether a piece that began ``inside`` a string or not ends inside one, and by how
    many levels of brackets and braces its end is deeper than its beginning."""
    if inside:
        end = _REST_OF_STRING.match(piece).end()
        if not piece.startswith('"', end):
            return True, 0
        piece = piece[end + 1:]
    inside = False
    if '"' in piece:
        piece = _STRING.sub("", piece)
        opened = piece.find('"')
        if opened >= 0:
            inside, piece = True, piece[:opened]
    return inside, piece.count("{") + piece.count("[") - piece.count("]") - piece.count("}")


def _json_walk() -> Callable:
    # As if the range began outside (0) and inside (1) a string: whether inside now, the
    # level, the least level at which a piece began, and the last piece that did.
    states = [[False, 0, 1 << 40, -1], [True, 0, 1 << 40, -1]]

    def step(piece: str, row: int, block: int) -> tuple:
        if row == 0 and block == 0:
            piece = re.sub(_OPENING, "", piece)
        found = []
        for state in states:
            inside, level, least, _ = state
            if not inside and level <= least:
                state[2:] = level, row
            inside, deeper = levels(piece, inside)
            # Outside a string the brace behind the piece closes a level.
            state[:2] = inside, level + deeper - (not inside)
            found += state
        return tuple(found)

    return step


def _json_chain(ranges: pd.DataFrame) -> pd.DataFrame:
    # Behind the opening bracket.
    inside, level, owner, rows = False, 1, (-1, -1), []
    for r in ranges.itertuples():
        rows.append((r.file, r.block, inside, level, *owner))
        k = int(inside)
        if level + getattr(r, f"least_{k}") == 1:
            owner = (r.block, getattr(r, f"start_{k}"))
        inside, level = bool(getattr(r, f"inside_{k}")), level + getattr(r, f"level_{k}")
    frame = pd.DataFrame(rows, columns=["file", "block", "inside", "level", "owner_block", "owner_row"])
    # The closing bracket and the brace that stands for the end of the file.
    closed = not inside and level == -1
    return frame.assign(broken=[False] * (len(frame) - 1) + [not closed])


def json_records(spark: SparkSession, path: str) -> DataFrame | None:
    """``value``: the records of files that each hold one JSON array of records; None if a
    file begins otherwise. An array that does not end with its file stops the reading, and
    so does an element that is no record."""
    names = [f"{n}_{k}" for k in (0, 1) for n in ("inside", "level", "least", "start")]
    kinds = [pa.bool_() if n.startswith("inside") else pa.int64() for n in names]
    pieces = _walked(_pieces(spark, path, "}"), _json_walk, dict(zip(names, kinds)))
    at_opening = (F.col("block") == 0) & (F.col("row") == 0)
    if not pieces.where(at_opening & ~F.col("value").rlike(_OPENING)).isEmpty():
        return None
    begun = _begun(
        pieces, names, _json_chain, "inside boolean, level long, owner_block long, owner_row long, broken boolean"
    ).withColumnsRenamed({"inside": "began_inside", "level": "began_level"})
    broken = begun.where("broken").select("file").head()
    if broken is not None:
        raise ValueError(f"the JSON array of {broken[0]} is not closed at its end")
    real = lambda n: F.when(F.col("began_inside"), F.col(f"{n}_1")).otherwise(F.col(f"{n}_0"))
    own = F.col("began_level") + real("least") == 1
    bare = F.when(at_opening, F.regexp_replace("value", _OPENING, "")).otherwise(F.col("value"))
    read = _with_beginnings(pieces, begun).select(
        *_KEYS, "row", bare.alias("value"),
        F.when(own, F.col("block")).otherwise(F.col("owner_block")).alias("of_block"),
        F.when(own, real("start")).otherwise(F.col("owner_row")).alias("of_row"),
        (~real("inside") & (F.col("began_level") + real("level") == 1)).alias("ends"),
    )
    alone = F.col("ends") & (F.col("of_block") == F.col("block")) & (F.col("of_row") == F.col("row"))
    records = read.where(alone).select("value").unionByName(_put_together(read.where(~alone), "}", []).select("value"))
    text = F.regexp_replace("value", "^[\\s,]+", "")
    no_record = F.raise_error(F.concat(F.lit("not a record of a JSON array: "), F.substring(text, 1, 100)))
    # Not a filter, which would be asked of pieces before they are put together.
    found = F.when(text.startswith("{"), F.array(F.concat(text, F.lit("}")))).when(
        text.rlike("^\\]\\s*$"), F.array().cast("array<string>")
    ).otherwise(no_record.cast("array<string>"))
    return records.select(F.explode(found).alias("value"))
