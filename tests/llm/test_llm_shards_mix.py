"""Hilbert shards and raked mixing."""

import itertools
import zlib

import pytest
from edges import edge_docs, edge_rows, no_docs
from pyspark.sql import functions as F

from dataloom.llm import hilbert, mixing


def test_curve_is_a_walk(spark):
    for dimensions, depth in ((2, 4), (3, 3), (4, 2), (1, 3), (3, 1)):
        points = list(itertools.product(range(1 << depth), repeat=dimensions))
        frame = spark.createDataFrame([(list(p),) for p in points], "axes array<int>")
        rows = hilbert.with_curve(frame, "axes", "at", dimensions, depth).collect()
        order = [r.axes for r in sorted(rows, key=lambda r: r["at"])]
        assert sorted(r["at"] for r in rows) == list(range(len(points)))
        assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for a, b in zip(order, order[1:]))


def test_shards(spark, tmp_path):
    docs = edge_docs(spark)
    dims = {"source": "source", "lang": "lang", "length": F.char_length}
    found = hilbert.shards(docs, dims, n_shards=5)
    rows = found.collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in edge_rows()), key=repr)
    assert sorted(((r.id, r.size, r.crc) for r in rows), key=repr) == want
    own = {s: sorted(r.slot for r in rows if r.shard == s) for s in range(5)}
    assert all(slots == list(range(len(slots))) for slots in own.values())
    assert max(map(len, own.values())) - min(map(len, own.values())) <= 1
    by_curve = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert by_curve == sorted(by_curve)
    bounds = {r.shard: r for r in hilbert.manifest(found, ["length"]).collect()}
    assert all(bounds[r.shard].least_length <= r.length <= bounds[r.shard].most_length for r in rows)
    unique = docs.where("doc_id BETWEEN 3 AND 11").select("doc_id", "text", "lang", "source")
    hilbert.write_shards(unique, hilbert.shards(unique, dims, n_shards=3), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(repr, back.drop("shard").collect())) == sorted(map(repr, unique.collect()))
    assert hilbert.shards(no_docs(spark), dims).count() == 0


def test_raking_meets_targets(spark):
    cells = spark.createDataFrame(
        [(s, l, 1000 * (i + 1) * (j + 2)) for i, s in enumerate("abc") for j, l in enumerate(["x", "y", None])], "s string, l string, n long"
    )
    weights = {"s": {"a": 1, "b": 1, "c": 2}, "l": {"x": 1, "y": 1, None: 2}}
    rows = mixing.raked_cells(cells, ["s", "l"], weights, share=0.3, rounds=20).collect()
    total = sum(r.n for r in rows) * 0.3
    assert all(0 <= r.probability <= 1 for r in rows)
    for m, goals in weights.items():
        for value, weight in goals.items():
            assert abs(sum(r.w for r in rows if r[m] == value) - total * weight / 4) < total * 1e-3


@pytest.mark.parametrize("few", [1000, 0])
def test_raking_passes_on_what_values_cannot_fill(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "_ON_DRIVER", few)
    cells = spark.createDataFrame(
        [(s, l, t, n) for s in "abcd" for l in "xy" for t, n in (("prose", 9000), ("marked", 400), ("legal", 20))],
        "s string, l string, t string, n long",
    )
    rows = mixing.raked_cells(cells, ["s", "l", "t"]).collect()
    total = sum(r.n for r in rows)
    assert abs(sum(r.w for r in rows) - 0.7 * total) < 1e-3 * total
    for m in ("s", "l", "t"):
        for value in {r[m] for r in rows}:
            own = [r for r in rows if r[m] == value]
            assert abs(sum(r.w for r in own) / own[0][f"to_{m}"] - 1) <= mixing.TOLERANCE
    assert all(r.probability <= 1 and r.error <= mixing.TOLERANCE for r in rows)
    assert {round(r.probability, 3) for r in rows if r.t == "legal"} == {1.0}
    few = mixing.raked_cells(cells, ["s", "t"], {"t": {"legal": 1, "marked": 1}}, share=0.7).collect()
    assert abs(sum(r.w for r in few) - 4 * 2 * 420) < 5 and not any(r.w for r in few if r.t == "prose")


def test_mixture(spark):
    got = mixing.mixture(edge_docs(spark)).collect()
    rows = edge_rows()
    tokens = sorted(len((r[1] or "").encode().split()) + 1 for r in rows)
    assert sorted(r.tokens for r in got) == tokens
    assert {(r.lang, r.source) for r in got} == {(r[2], r[3]) for r in rows}
    one = {}
    for r in got:
        one.setdefault((r.id, r.lang, r.source, r.topic), set()).add(r.chosen) if r.id is not None else None
    assert all(len(v) == 1 for v in one.values())
    drawn = mixing.draw_mixture(edge_docs(spark))
    assert drawn.columns == edge_docs(spark).columns
    assert drawn.count() == sum(r.chosen for r in got)
    assert mixing.mixture(no_docs(spark)).count() == 0


def test_drawn_tokens_follow_the_targets(spark):
    docs = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"),
    )
    rows = mixing.draw_mixture(docs, weights={"source": {"big": 1, "small": 1}}, share=0.3).groupBy("source").count().collect()
    assert all(abs(r["count"] - 4500) < 300 for r in rows) and len(rows) == 2
