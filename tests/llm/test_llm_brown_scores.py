"""The class model's scores against plain sums, and its contexts against plain counts."""

import math

import numpy as np

from dataloom.llm import brown_lm
from edges import words


def plain_score(model, counts, text):
    """Base score and score of a text, token by token."""
    tokens = brown_lm.words_of(text)
    kinds = model.classes[model.symbols.of(tokens)]
    base = score = 0.0
    for k, word in enumerate([*tokens, None]):
        n = model.counts[0] if word is None else counts.get(word.decode(), 0)
        base += math.log10((n + 0.5) / model.base)
        score += model.step[kinds[k], kinds[k + 1]]
        if word is None:
            continue
        kind = kinds[k + 1]
        if n == 0:
            score += model.unknown[kind]
        else:
            score += math.log10(n if word in model.symbols.words else n - model.discount) - math.log10(model.total[kind])
    return base, score


def check(spark, rows, **given):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = docs.withColumn("held_out", brown_lm.held_out(docs["doc_id"])).fillna("")
    model, vocabulary = brown_lm.train(marked.where("not held_out"), **given)
    counts = {r.word: r.n for r in vocabulary.collect()}
    got = brown_lm.scores(docs, **given).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        base, score = plain_score(model, counts, texts[r.id] or "")
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_scores(spark):
    rows = [(k, words(40 + k, k % 7) + " the same words again" * (k % 3)) for k in range(40)] + [(50, None), (51, ""), (52, "one")]
    check(spark, rows, symbols=60, bundles=5, classes=6, rounds=2)


def test_one_document_of_words_seen_once(spark):
    check(spark, [(1, "alpha beta gamma delta epsilon")], symbols=10, bundles=3, classes=4, rounds=1)
    row = brown_lm.scores(spark.createDataFrame([(1, "alpha beta gamma delta epsilon")], "doc_id long, text string"), classes=4).first()
    assert row.n_tokens == 6 and row.score < row.n_tokens * math.log10(0.6)


def test_contexts(spark):
    own = np.random.default_rng(1)
    pairs = {(int(a), int(b)): int(n) for a, b, n in own.integers(0, 9, (60, 3)) + np.array([0, 0, 1])}
    bigrams = spark.createDataFrame([(*p, n) for p, n in pairs.items()], "a int, b int, n long").repartition(3)
    classes, k = np.array([0, 1, 2, 1, 2, 3, 3, 1, 2], np.int32), 4
    got = {}
    for r in brown_lm._contexts(brown_lm.neighbours_of(bigrams), classes, k).collect():
        got[r.symbol, r.slot] = got.get((r.symbol, r.slot), 0) + r.n
    want = {}
    for (a, b), n in pairs.items():
        places = [(a, 2 * k)] if a == b else [(a, classes[b]), (b, k + classes[a])]
        for place in places:
            want[place] = want.get(place, 0) + n
    assert got == want
    counts = np.zeros((k, k))
    for (a, b), n in pairs.items():
        counts[classes[a], classes[b]] += n
    assert (brown_lm.class_bigrams(brown_lm._contexts(brown_lm.neighbours_of(bigrams), classes, k), classes, k) == counts).all()
    better, after = brown_lm.exchange(bigrams, 9, k, 3)
    start = np.concatenate([[0], 1 + np.arange(8) % (k - 1)])
    begin = np.zeros((k, k))
    for (a, b), n in pairs.items():
        begin[start[a], start[b]] += n
    assert brown_lm.likelihood(after) >= brown_lm.likelihood(begin) and better[0] == 0


def test_neighbours_of_texts_move_as_packs(spark):
    texts = [words(200, k) + " end" * (k % 3) for k in range(30)] + [""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    common = sorted({w for t in texts for w in brown_lm.words_of(t)})[:40]
    symbols = brown_lm.Symbols({w: i + 1 for i, w in enumerate(common)}, 7)
    packs = brown_lm.text_neighbours(frame, symbols).collect()
    got = {}
    for row in packs:
        for symbol, other, n in zip(*(np.frombuffer(v, kind).tolist() for v, kind in zip(row, (np.int32, np.int32, np.int64)))):
            got[symbol, other] = got.get((symbol, other), 0) + n
    want = {}
    for text in texts:
        own = symbols.of(brown_lm.words_of(text)).tolist()
        for a, b in zip(own, own[1:]):
            for place in [(a, b)] + [(b, ~a)] * (a != b):
                want[place] = want.get(place, 0) + 1
    assert got == want and len(packs) < len(want) / 10
    # A pair may be in more than one row.
    bigrams = spark.createDataFrame([(1, 2, 3), (1, 2, 4), (0, 1, 1)], "a int, b int, n long").repartition(2)
    sums = {}
    for r in brown_lm._contexts(brown_lm.neighbours_of(bigrams), np.array([0, 1, 2], np.int32), 3).collect():
        sums[r.symbol, r.slot] = sums.get((r.symbol, r.slot), 0) + r.n
    assert sums == {(0, 1): 1, (1, 3): 1, (1, 2): 7, (2, 4): 7}


def test_packs_are_small_however_many_neighbours_a_task_holds(spark):
    bigrams = spark.createDataFrame([(a, b, a + b) for a in range(40) for b in range(40)], "a int, b int, n long").repartition(2)
    packs = brown_lm.neighbours_of(bigrams).collect()
    sizes = [len(r.symbols) // 4 for r in packs]
    assert max(sizes) <= brown_lm._PIECE and sum(sizes) == 2 * 1600 - 40
    assert all(len(r.others) == 4 * n and len(r["counts"]) == 8 * n for r, n in zip(packs, sizes))
