"""Text pairs, vocabulary, encoding, scores, runs, invariants of cleaning."""

import pytest
from pyspark.sql import functions as F

from dataloom.operators import clean, features, pairs, profile, runs
from dataloom.queries.tables import DIRTY_ORDERS, Tables


@pytest.fixture(scope="module")
def text(spark):
    rows = [(1, "a b  a", "x y"), (2, " c ", ""), (3, None, "a"), (4, "", "q " * 20)]
    return spark.createDataFrame(rows, "id int, input string, target string")


def test_vocabulary(text):
    vocab = pairs.build_vocab(text, ["input"], 10).orderBy("token_id").collect()
    assert [(r.token, r.n, r.token_id) for r in vocab] == [("a", 2, 2), ("b", 1, 3), ("c", 1, 4)]
    with pytest.raises(ValueError):
        pairs.build_vocab(text, ["input"], 10_000_000)


def test_encoding_pads_cuts_and_marks_unknown_words(text):
    vocab = pairs.build_vocab(text, ["input"], 2)
    rows = {r.id: r for r in pairs.encode_pairs(text, vocab, ["id"], 4, 3).collect()}
    assert rows[1].input_ids == [2, 3, 2, 0] and rows[1].attention_mask == [1, 1, 1, 0]
    assert rows[1].labels == [1, 1, 0] and rows[2].labels == [0, 0, 0]
    assert rows[2].input_ids == [1, 0, 0, 0]
    assert rows[3].input_ids == [0] * 4 and rows[3].labels == [2, 0, 0]
    assert rows[4].labels == [1, 1, 1]


def test_blank_pairs(text):
    assert [r.id for r in pairs.drop_blank_pairs(text).collect()] == [1]


def test_missing_text_stays_missing(text):
    assert pairs.to_pairs(text, "input", "target", ["id"]).filter("input is null").count() == 1


def test_scores(spark):
    rows = [("abc", "abc"), ("abcd", "abcx"), (None, ""), ("", "zz")]
    scored = pairs.score_predictions(spark.createDataFrame(rows, "expected string, generated string"))
    assert [r.match_score for r in scored.collect()] == [1.0, 0.75, 1.0, 0.0]
    total = pairs.score_summary(scored).first()
    assert (total.tests, total.mean_score, total.passed) == (4, 0.69, 2)
    alone = pairs.score_predictions(spark.createDataFrame([("x",)], "generated string"))
    assert alone.first().expected == ""


def test_pair_stats(text):
    got = profile.pair_stats(text.filter("input is not null")).first()
    assert (got.examples, got.mean_input_length, got.small_dataset) == (3, 3.0, True)


def test_configurations(spark):
    rows = spark.createDataFrame([(1, "m", 3), (2, None, None)], "job_id int, model string, epochs int")
    saved = runs.save_config(rows, ["model", "epochs"]).select("job_id", "config")
    saved = saved.unionAll(spark.createDataFrame([(3, None)], "job_id int, config string"))
    got = runs.load_config(saved, "model string, epochs int").orderBy("job_id").collect()
    assert [tuple(r) for r in got] == [(1, "m", 3), (2, None, None), (3, None, None)]


def test_cleaning_invariants(spark, folder):
    dirty = Tables(spark, folder).sql(DIRTY_ORDERS)
    rows, distinct = dirty.count(), clean.dedupe(dirty).count()
    assert distinct + profile.duplicate_count(dirty).first()[0] == rows
    cleaned = clean.clean(dirty)
    missing = {r.column: r.missing for r in profile.missing_by_column(cleaned).collect()}
    assert cleaned.count() == distinct
    assert [c for c, m in missing.items() if m] == ["o_orderstatus"]
    scaled = features.scale_minmax(dirty)
    for c in (x for x in scaled.columns if x.endswith("_normalized")):
        low, high = scaled.agg(F.min(c), F.max(c)).first()
        assert low == 0.0 and high == 1.0
    hot = features.one_hot_all(dirty.select("o_orderpriority"))
    flags = sum(F.col(f"`{c}`").cast("int") for c in hot.columns)
    assert hot.agg(F.max(flags)).first()[0] == 1
