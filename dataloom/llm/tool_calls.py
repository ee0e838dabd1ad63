"""Linking tool calls to their results, in an order that respects their dependencies.

Calls and results meet by conversation and call id in a hash join, after repeated ones
have been reduced to the first. Calls are then layered: a call's level is one more than
the highest level among the calls it needs. Only id columns take part. A conversation with
a bounded number of needs is ordered by one task, whatever its depth; larger ones are
layered round by round by all tasks, so that no conversation has to fit into one.
Arguments are checked against the tool's schema and everything is written as canonical
JSON (sorted keys, no spaces, UTF-8).
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dataloom.llm.common import picked
from dataloom.plans.shared import scratch_path, stored

# Needs of a conversation that one task orders.
LOCAL_NEEDS = 50_000

# The types of a schema.
_TYPES = {
    "object": dict, "array": list, "string": str, "boolean": bool, "null": type(None),
    "integer": int, "number": (int, float),
}


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def parsed(text: str) -> Any:
    """The value of a JSON text; ValueError also for numbers beyond the doubles and for
    escapes of half a character, which UTF-8 cannot write."""

    def refused(name: str):
        raise ValueError(f"{name} is not JSON")

    def finite(number: str) -> float:
        value = float(number)
        return value if math.isfinite(value) else refused(number)

    value = json.loads(text, parse_constant=refused, parse_float=finite)
    canonical(value).encode()
    return value


def _equal(a: Any, b: Any) -> bool:
    """Equality of JSON values: ``true`` is not 1, but 1 is 1.0."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_equal(a[k], b[k]) for k in a)
    return a == b


def faults(value: Any, schema: dict, path: str = "$") -> list[str]:
    """What in ``value`` is against the schema: ``type, enum, required, properties,
    additionalProperties, items, minimum, maximum, minLength, maxLength``."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        fits = any(
            isinstance(value, _TYPES[k]) and (k == "boolean" or not isinstance(value, bool)) for k in kinds
        ) or ("integer" in kinds and isinstance(value, float) and value.is_integer())
        if not fits:
            return [f"{path}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and not any(_equal(value, own) for own in schema["enum"]):
        found.append(f"{path}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            found.append(f"{path}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            found.append(f"{path}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{path}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            found.append(f"{path}: too long")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            found += faults(item, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{path}.{name}: missing" for name in schema.get("required", []) if name not in value]
        for name in sorted(value):
            if name in own:
                found += faults(value[name], own[name], f"{path}.{name}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{path}.{name}: not allowed")
    return found


def levels(edges: DataFrame, calls: DataFrame, local: int = LOCAL_NEEDS) -> DataFrame:
    """``conversation, call_id, level`` of every call that no cycle holds up.

    ``edges(conversation, call_id, needs)`` must be among ``calls(conversation, call_id)``.
    Conversations of more than ``local`` edges take as many rounds as they have levels;
    each round is written, so a lost executor repeats one, and reads what the last one
    wrote, so plans do not grow.
    """
    edges = stored(edges.distinct(), "edges")
    ready = calls.join(edges, ["conversation", "call_id"], "left_anti").select("conversation", "call_id").withColumn("level", F.lit(0))
    # There are at most edges / local of them.
    large = stored(edges.groupBy("conversation").count().where(F.col("count") > local).select("conversation"), "large")
    if large.isEmpty():
        return ready.unionByName(_ordered(edges))
    small = edges.join(F.broadcast(large), "conversation", "left_anti")
    return ready.unionByName(_ordered(small)).unionByName(_layered(edges.join(F.broadcast(large), "conversation", "left_semi")))


def _ordered(edges: DataFrame) -> DataFrame:
    """Levels of the calls that need others, a conversation at a time."""
    names = ["conversation", "call_id", "level"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        found: list[tuple[str, str, int]] = []
        for conversation, own in groupby(rows, key=itemgetter(0)):
            found += [(conversation, call, level) for call, level in _local_levels(own)]
            if len(found) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)

    kinds = [pa.string(), pa.string(), pa.int32()]
    together = edges.select("conversation", "call_id", "needs").repartition("conversation").sortWithinPartitions("conversation")
    return together.mapInArrow(run, "conversation string, call_id string, level int")


def _local_levels(edges: Iterable[tuple[str, str, str]]) -> list[tuple[str, int]]:
    needed_by, open_needs, level = defaultdict(list), defaultdict(int), {}
    for _, call, need in edges:
        needed_by[need].append(call)
        open_needs[call] += 1
    waiting = [(need, 0) for need in needed_by if need not in open_needs]
    while waiting:
        done, at = waiting.pop()
        for call in needed_by[done]:
            open_needs[call] -= 1
            level[call] = max(level.get(call, 0), at + 1)
            if not open_needs[call]:
                waiting.append((call, level[call]))
    return [(call, level[call]) for call, n in open_needs.items() if not n]


def _layered(edges: DataFrame) -> DataFrame:
    """The same of large conversations: each round takes the calls whose needs are met."""
    spark, key, path = edges.sparkSession, ["conversation", "call_id"], scratch_path(edges.sparkSession, "levels")
    schema = "conversation string, call_id string, level int"
    left = stored(edges, "edges")
    others = left.select("conversation", F.col("needs").alias("call_id")).distinct()
    ready, level = stored(others.join(left, key, "left_anti"), "ready"), 0
    spark.createDataFrame([], schema).write.parquet(path)
    while not left.isEmpty():
        met = ready.select("conversation", F.col("call_id").alias("needs"))
        rest = stored(left.join(met, ["conversation", "needs"], "left_anti").select(*left.columns), "edges")
        level += 1
        ready = stored(left.select(*key).distinct().join(rest, key, "left_anti"), "ready")
        if ready.isEmpty():
            break
        ready.withColumn("level", F.lit(level)).write.mode("append").parquet(path)
        left = rest
    return spark.read.schema(schema).parquet(path)


def _first(rows: DataFrame, fields: list[str], count: str) -> DataFrame:
    """The first row of each call id, and how many there were."""
    return rows.groupBy("conversation", "call_id").agg(
        F.min(F.struct("position", *fields)).alias("first"), F.count("*").alias(count)
    ).select("conversation", "call_id", "first.*", count)


def _writer(schemas: dict[str, dict]):
    names = ["status", "faults", "json"]

    def status(call: dict) -> tuple[str, list[str], str]:
        out: dict[str, Any] = {"id": call["call_id"], "name": call["name"], "level": call["level"]}
        wrong: list[str] = []
        state = "ok"
        if call["position"] is None:
            state = "no_call"
        else:
            try:
                out["arguments"] = parsed(call["arguments"] or "")
                if call["name"] not in schemas:
                    state = "unknown_tool"
                elif wrong := faults(out["arguments"], schemas[call["name"]]):
                    state = "bad_arguments"
            except (ValueError, RecursionError) as error:
                state, wrong = "bad_json", [str(error)[:200]]
                out["arguments"] = call["arguments"]
            if call["call_id"] is None:
                state = "no_id" if state == "ok" else state
            elif call["missing"]:
                wrong = wrong + [f"needs {n}: missing" for n in call["missing"]]
                state = "missing_call" if state == "ok" else state
            elif call["level"] is None:
                state = "cycle" if state == "ok" else state
        if not call["n_results"] and state == "ok":
            state = "no_result"
        out["needs"] = call["needs"] or []
        out["result"] = call["content"]
        return state, wrong, canonical(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [status(row) for row in batch.to_pylist()]
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.list_(pa.string()), pa.string()))]
            kept = [c for c in batch.schema.names if c not in ("arguments", "content", "needs", "missing")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, *names])

    return run


def linked_calls(messages: DataFrame, schemas: dict[str, dict], **columns: str) -> DataFrame:
    """One row per call, and per result without call: ``conversation, call_id, position,
    name, level, n_calls, n_results, result_position, status, faults, json``.

    ``messages`` has ``conversation, position, kind ('call' or 'result'), call_id, name,
    arguments (JSON text), needs (ids of calls that must come first), content``; other
    column names are given as ``call_id="id"``. Within a conversation, rows ordered by
    level, then position, stand in topological order; ``position`` is that of the call.

    Of several calls or results of one id the first counts, ``n_calls`` and ``n_results``
    tell of the others. ``status``: ok, no_result, bad_json, bad_arguments, unknown_tool,
    missing_call (needs an id that no call has), cycle (its level is NULL), no_id (a call
    without id is never linked), no_call (a result without call). A NULL conversation is a
    conversation like any other; other kinds of rows are left out; an empty table gives
    no rows. ``schemas`` is a parameter, so its size is that of the program.
    """
    fields = ["conversation", "position", "kind", "call_id", "name", "arguments", "needs", "content"]
    rows = picked(messages, **{f: columns.get(f, f) for f in fields})
    # Joins must meet a NULL conversation too: its key is the text "n", others "v...".
    rows = rows.withColumn("of", F.col("conversation")).withColumn(
        "conversation", F.when(F.col("of").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("of").cast("string")))
    )
    all_calls = rows.where("kind = 'call'").withColumn("needs", F.array_distinct(F.coalesce("needs", F.array().cast("array<string>"))))
    calls = stored(_first(all_calls.where("call_id IS NOT NULL"), ["of", "name", "arguments", "needs"], "n_calls"), "calls")
    results = _first(rows.where("kind = 'result' AND call_id IS NOT NULL"), ["of", "content"], "n_results").select(
        "conversation", "call_id", F.col("position").alias("result_position"), F.col("of").alias("result_of"), "content", "n_results"
    )
    ids = calls.select("conversation", "call_id")
    wanted = calls.select("conversation", "call_id", F.explode("needs").alias("needs")).where("needs IS NOT NULL")
    there = wanted.join(ids.withColumnRenamed("call_id", "needs").withColumn("there", F.lit(True)), ["conversation", "needs"], "left")
    edges = stored(there, "needs")
    found = levels(edges.where("there").drop("there").select("conversation", "call_id", "needs"), ids)
    missing = edges.where("there IS NULL").groupBy("conversation", "call_id").agg(F.sort_array(F.collect_set("needs")).alias("missing"))
    key = ["conversation", "call_id"]
    linked = calls.join(results.hint("shuffle_hash"), key, "full_outer").join(found, key, "left").join(missing, key, "left")
    loose = all_calls.where("call_id IS NULL").select(
        *key, "position", "of", "name", "arguments", "needs", F.lit(1).cast("long").alias("n_calls"),
    )
    lone = rows.where("kind = 'result' AND call_id IS NULL").select(
        *key, F.col("position").alias("result_position"), F.col("of").alias("result_of"), "content", F.lit(1).cast("long").alias("n_results")
    )
    every = linked.unionByName(loose, allowMissingColumns=True).unionByName(lone, allowMissingColumns=True)
    none: Column = F.lit(0).cast("long")
    ready = every.select(
        F.coalesce("of", "result_of").alias("conversation"), "call_id", "position", "name", "level",
        F.coalesce("n_calls", none).alias("n_calls"), F.coalesce("n_results", none).alias("n_results"), "result_position",
        "arguments", "needs", "missing", "content",
    )
    kept = [f for f in ready.schema.fields if f.name not in ("arguments", "needs", "missing", "content")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return ready.mapInArrow(_writer(schemas), f"{schema}, status string, faults array<string>, json string")
