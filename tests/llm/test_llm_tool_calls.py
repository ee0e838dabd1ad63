"""Levels of calls against plain recursion, deep chains, and arguments beyond JSON's range."""

import random

import pytest

from dataloom.llm import tool_calls

MESSAGES = "conversation long, position int, kind string, call_id string, name string, arguments string, needs array<string>, content string"


def plain_levels(edges, calls):
    """One more than the highest level needed; none behind a cycle."""
    needs = {c: {n for a, n in edges if a == c} for c in calls}
    level, found = {}, True
    while found:
        found = {c for c in calls if c not in level and all(n in level for n in needs[c])}
        level |= {c: max((level[n] + 1 for n in needs[c]), default=0) for c in found}
    return level


@pytest.mark.parametrize("local", [0, 6, tool_calls.LOCAL_NEEDS])
def test_levels_of_random_graphs(spark, local):
    own, calls, edges = random.Random(local), [], []
    for c in range(7):
        names = [f"{k}" for k in range(own.randint(1, 9))]
        calls += [(f"v{c}", n) for n in names]
        pairs = {(own.choice(names), own.choice(names)) for _ in range(own.randint(0, 9))}
        if c % 3:
            pairs = {(a, b) for a, b in pairs if int(a) > int(b)}
        edges += [(f"v{c}", a, b) for a, b in pairs]
    got = tool_calls.levels(
        spark.createDataFrame(edges * 2, "conversation string, call_id string, needs string"),
        spark.createDataFrame(calls, "conversation string, call_id string"), local,
    ).collect()
    want = []
    for c in {c for c, _ in calls}:
        found = plain_levels([(a, b) for v, a, b in edges if v == c], [n for v, n in calls if v == c])
        want += [(c, n, level) for n, level in found.items()]
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_chain_of_a_thousand_calls(spark):
    rows = [(1, k, "call", f"c{k}", "f", "{}", [f"c{k - 1}"] if k else [], None) for k in range(1000)]
    linked = tool_calls.linked_calls(spark.createDataFrame(rows, MESSAGES), {"f": {"type": "object"}})
    assert linked._jdf.queryExecution().optimizedPlan().toString().count("Relation [") < 20
    assert {r.call_id: r.level for r in linked.collect()} == {f"c{k}": k for k in range(1000)}


@pytest.mark.parametrize("text", ['{"a":1e999}', '{"a":-1e999}', '{"a":"\\ud800"}', '{"\\udc00":1}', "NaN", "[" * 100_000, ""])
def test_arguments_that_cannot_be_written(spark, text):
    rows = [(1, 0, "call", "a", "f", text, [], None), (1, 1, "call", "b", "f", "{}", [], None)]
    got = {r.call_id: r for r in tool_calls.linked_calls(spark.createDataFrame(rows, MESSAGES), {"f": {}}).collect()}
    assert (got["a"].status, got["b"].status) == ("bad_json", "no_result")
    assert text[:50].replace("\\", "\\\\").replace('"', '\\"') in got["a"].json


def test_values_of_an_enum():
    schema = {"enum": [1, [0, {"a": True}], None]}
    assert [tool_calls.faults(v, schema) for v in (1, 1.0, [0, {"a": True}], None)] == [[]] * 4
    assert all(tool_calls.faults(v, schema) for v in (True, False, [False, {"a": True}], [0, {"a": 1}], "1", {}))
