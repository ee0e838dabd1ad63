"""Co-training and the class-based language model."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from edges import edge_docs, edge_rows, no_docs, words
from pyspark.sql import functions as F

from dataloom.llm import brown_lm, quality


def test_co_training_learns_from_both_views():
    own = np.random.default_rng(1)
    truth = own.integers(0, 2, 3000).astype(float)
    content = truth[:, None] * 2 + own.normal(size=(3000, 5))
    metadata = truth[:, None] * 1.5 + own.normal(size=(3000, 3))
    label = np.where(np.arange(3000) < 90, truth, np.nan)
    model = quality.co_train(content, metadata, label)
    first, second, both = model.scores(content[90:], metadata[90:])
    assert np.mean((both >= 0.5) == truth[90:]) > 0.95
    assert all(((0 <= s) & (s <= 1)).all() for s in (first, second, both))


def test_quality_on_held_out_labels(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 4 <> 0"))
    rows = quality.scores(docs, model).join(labels.where("doc_id % 4 = 0").withColumnRenamed("doc_id", "id"), "id").collect()
    right = np.mean([(r.score >= 0.5) == (r.quality == 1) for r in rows])
    clean = [r.score >= 0.5 for r in rows if r.quality == 1]
    assert right > 0.95 and np.mean(clean) > 0.97
    kept = quality.keep_good(edge_docs(spark), model)
    assert kept.columns == edge_docs(spark).columns
    scored = quality.scores(edge_docs(spark), model).collect()
    assert len(scored) == len(edge_rows()) and kept.count() == sum(r.score >= 0.5 for r in scored)


def test_quality_without_labels(spark):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        model = quality.train(edge_docs(spark), some)
        assert quality.keep_good(edge_docs(spark), model).count() == len(edge_rows())
    assert quality.scores(no_docs(spark), model).count() == 0


@pytest.mark.parametrize("marks", [[0] * 5, [1] * 5, [0, 0, 0, 1], [1]])
def test_quality_without_a_model_keeps_all(spark, marks):
    docs = spark.createDataFrame([(k, words(30, k), "s", "en") for k in range(50)], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model.joined is None and quality.keep_good(docs, model).count() == 50
    assert quality.scores(docs, model).where(model.kept(F.col("score"))).count() == 50


def test_quality_with_few_of_one_label_and_one_id_repeated(spark):
    good, bad = (lambda k: words(80, k)), (lambda k: "!!! 000 " * 30 + str(k))
    rows = [(k, good(k) if k % 9 else bad(k), "s", "en") for k in range(120)] + [(1, good(999 + k), "s", "en") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(k, int(k % 9 > 0)) for k in range(60)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert model.joined is not None
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert {k for k in range(120) if k % 9} <= kept and not kept & set(range(0, 120, 9))


def plain_base(rows):
    def tokens(text):
        return (text or "").encode().lower().split() + [None]

    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1

    counts = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    for i, text in rows:
        own = tokens(text)
        yield i, held(i), len(own), sum(counts[t] > 0 for t in own), n, sum(
            math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in own
        )


def test_language_model(spark):
    own = random.Random(5)
    verbs, nouns = [f"v{k}" for k in range(40)], [f"n{k}" for k in range(40)]
    rows = [(k, " ".join(own.choice(w) for _ in range(40) for w in (verbs, nouns))) for k in range(150)]
    rows += [(1000 + i, r[1]) if r[0] is not None else (None, r[1]) for i, r in enumerate(edge_rows())]
    rows += [rows[3], (7, "once " + words(20, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = brown_lm.scores(docs, symbols=60, bundles=16, classes=6).collect()
    line = lambda r: (str(r[0]), *r[1:5], round(r[5], 6))
    assert sorted((r.id is None, str(r.id), r.n_tokens, round(r.base_score, 6)) for r in got)
    assert sorted(map(line, plain_base(rows))) == sorted(line(tuple(r)[:6]) for r in got)
    inner = [r for r in got if r.id is not None and r.id < 150 and r.id != 7]
    assert sum(r.score for r in inner if r.held_out) > sum(r.base_score for r in inner if r.held_out) + 500
    assert all(r.score <= 0 for r in got)


def test_probabilities_add_up(spark):
    texts = spark.createDataFrame([(words(300, k % 9) + " " + words(20, k),) for k in range(40)], "text string")
    model, vocabulary = brown_lm.train(texts, symbols=50, bundles=8, classes=5, rounds=2)
    counts = {r.word.encode(): r.n for r in vocabulary.collect()}
    per_class = np.zeros(5)
    for word, n in counts.items():
        symbol = model.symbols.words.get(word) or model.symbols.bundle(word)
        kind = model.classes[symbol]
        per_class[kind] += (n - (model.discount if symbol > len(model.symbols.words) else 0)) / model.total[kind]
    per_class[1:] += 10 ** model.unknown[1:]
    per_class[0] = 1
    assert np.allclose(per_class, 1) and np.allclose((10 ** model.step).sum(axis=1), 1)


def test_exchange_gain_is_exact():
    own = np.random.default_rng(2)
    size, k = 12, 4
    grams = own.integers(0, 9, (size, size)).astype(float)
    classes = own.integers(0, k, size)

    def table(of):
        counts = np.zeros((k, k))
        np.add.at(counts, (of[:, None].repeat(size, 1), of[None].repeat(size, 0)), grams)
        return counts

    def likelihood(of):
        counts = table(of)
        x = lambda v: float(brown_lm._xlog(v).sum())
        return x(counts) - x(counts.sum(axis=0)) - x(counts.sum(axis=1))

    member = np.eye(k)[classes]
    itself = np.diag(grams).copy()
    rest = grams - np.diag(itself)
    found = brown_lm.gains(table(classes), classes, rest @ member, rest.T @ member, itself)
    for w in range(size):
        moved = [likelihood(np.where(np.arange(size) == w, c, classes)) for c in range(k)]
        assert np.allclose(np.diff(moved), np.diff(found[w]))


def test_language_model_without_rows(spark):
    assert brown_lm.scores(no_docs(spark), symbols=5, bundles=2, classes=3).count() == 0
