"""Profiles that grow by merging, vocabularies of any size, metrics of any shape."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dataloom.operators import catalog, pairs, profile, profile_sketches as sketches, runs
from dataloom.plans.shared import scratch_path

SCHEMA = "k long, x double, flag boolean, t string, l array<double>"


def part_of(spark, start, n):
    own = random.Random(start)
    rows = [
        (k, own.choice([own.gauss(1e6, 3.0), None, float("nan")]), own.choice([True, False, None]), f"t{k % 700}", [1.0, float(k % 3)])
        for k in range(start, start + n)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_merged_profile(spark):
    parts = [part_of(spark, 0, 3000), part_of(spark, 3000, 1), part_of(spark, 3001, 4000), part_of(spark, 0, 0)]
    whole = parts[0].unionAll(parts[1]).unionAll(parts[2])
    got = {r.column: r for r in sketches.profile_of(sketches.sketched(parts)).collect()}
    exact = {r.column: r for r in profile.column_info(whole).collect()}
    assert set(got) == set(exact)
    for name, want in exact.items():
        own = got[name]
        assert (own.rows, own.missing, own.type) == (7001, want.missing, want.type)
        assert abs(own.unique_values - want.unique_values) <= max(1, 0.03 * want.unique_values)
        for field in ("min", "max", "mean", "std"):
            a, b = own[field], want[field]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9)), (name, field)
        assert (own.median is None) == (want.median is None)
    low, high = (whole.selectExpr(f"percentile(nanvl(x, null), {p})").first()[0] for p in (0.48, 0.52))
    assert low <= got["x"].median <= high


def test_merged_profile_of_nothing(spark):
    empty = part_of(spark, 0, 0)
    got = {r.column: r for r in sketches.profile_of(sketches.sketched([empty, empty])).collect()}
    assert all((r.rows, r.missing, r.unique_values, r.mean, r.std, r.missing_pct) == (0, 0, 0, None, None, None) for r in got.values())
    one = sketches.profile_of(sketches.sketched([part_of(spark, 5, 1).select("k")])).first()
    assert (one.rows, one.median, one.std) == (1, 5.0, None)


def test_new_values(spark):
    old, new = sketches.sketch_rows(part_of(spark, 0, 900)), sketches.sketch_rows(part_of(spark, 600, 900))
    found = {r.column: r.new_values for r in sketches.new_values(old, new).collect()}
    assert found["k"] == 600 and found["t"] == 0 and found["flag"] == 0


def test_old_rows_are_not_read_again(spark):
    book = catalog.Catalog(spark, scratch_path(spark, "catalog"))
    book.append_profile(7, part_of(spark, 0, 50))
    book.append_profile(8, part_of(spark, 0, 10))
    book.append_profile(7, part_of(spark, 50, 25))
    merged = book.merged_profile(7)
    files = merged.inputFiles()
    assert files and all("/dataset_sketches/" in f for f in files)
    assert {(r.column, r.rows) for r in merged.collect()} == {(c, 75) for c in ("k", "x", "flag", "t", "l")}
    book.delete(7)


@pytest.mark.parametrize("seed", [1, 2])
def test_vocabulary_by_join(spark, seed):
    own = random.Random(seed)
    names = [f"w{k}" for k in range(300)]
    text = lambda: own.choice([None, "", "  ", " ".join(own.choice(["the", "new", own.choice(names)]) for _ in range(own.randint(1, 40)))])
    rows = [(own.choice([None, k]), text(), text()) for k in range(200)] + [(7, "the " * 50, "the")] * 30
    df = spark.createDataFrame(rows, "id int, input string, target string").repartition(5)
    vocab = pairs.build_vocab(df, ["input", "target"], 200).where("token <> 'new'")
    few = pairs.encode_pairs(df, vocab, ["id"], max_in=16, max_tgt=8)
    many = pairs.encode_pairs(df, vocab, ["id"], max_in=16, max_tgt=8, max_vocabulary=50)
    assert many.schema.simpleString() == few.schema.simpleString()
    assert sorted(map(repr, many.collect())) == sorted(map(repr, few.collect()))
    assert pairs.encode_pairs(df.limit(0), vocab, ["id"], max_vocabulary=50).count() == 0


def test_metric_columns(spark):
    rows = [
        (1, '{"a": {"b": 1, "c": {"d": 2.5}}, "k": 1}'), (2, '{"a": {"b": 3}, "k": "x", "odd name": true}'), (3, "no"), (4, None),
        (5, "[1, 2]"), (6, '{"k": null, "list": [1, {"z": 2}]}'), (7, '{"a": {"b": 4000000000}}'),
    ]
    got = runs.metric_columns(spark.createDataFrame(rows, "id int, metrics string"))
    table = {r["id"]: r.asDict() for r in got.collect()}
    assert set(got.columns) == {"id", "a.b", "a.c.d", "k", "odd name", "list"}
    assert [table[i]["a.b"] for i in range(1, 8)] == [1, 3, None, None, None, None, 4000000000]
    assert (table[1]["a.c.d"], table[1]["k"], table[2]["k"], table[2]["odd name"], table[6]["list"]) == (2.5, "1", '"x"', True, '[1,{"z":2}]')
    assert table[6]["k"] in (None, "null")
    assert runs.metric_columns(spark.createDataFrame([(1, "x")], "id int, metrics string")).columns == ["id"]
    clash = runs.metric_columns(spark.createDataFrame([(1, '{"ID": 5}')], "id int, metrics string"))
    assert clash.columns == ["id", "ID_2"] and clash.first()["ID_2"] == 5
