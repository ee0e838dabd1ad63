"""Importance resampling against plain counting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from edges import edge_docs, edge_rows, no_docs
from pyspark.sql import functions as F

from dataloom.llm import resampling

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_features(text, longest, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    grams = [" ".join(words[k: k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]


def plain_resample(docs, target, percent, longest, buckets, least, seed):
    """Rows of (id, n_features, weight, score, rank)."""
    own = [(i, *plain_features(t, longest, buckets)) for i, t in docs]
    s = Counter(b for _, _, f in own for b in f)
    t = Counter(b for x in target for b in plain_features(x, longest, buckets)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)
    ]
    rows = []
    for i, n_words, features in own:
        weight = sum(gain[b] for b in features)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(features), weight, score, n_words >= least])
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    drawn = {id(r): k + 1 for k, r in enumerate(order[: len(order) * percent // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=repr)


TARGET = ["Abc def GHI abc", None, "", "bad cab\nfed Ünï the the", "abc"]


@pytest.mark.parametrize("longest, percent", [(1, 10), (2, 50), (3, 100)])
def test_resample(spark, longest, percent):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    rows = resampling.resample(edge_docs(spark), target, percent, longest=longest, buckets=500, least_words=12, seed=7)
    want = plain_resample([(r[0], r[1]) for r in edge_rows()], TARGET, percent, longest, 500, 12, 7)
    assert sorted(map(tuple, rows.collect()), key=repr) == want


def test_lines_that_most_texts_share(spark):
    texts = [(k, "the same line\n" * (k % 5) + f"own{k} words here\nthe same line again\n \n") for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    target = spark.createDataFrame([("same words again",)], "text string")
    for longest in (1, 2):
        rows = resampling.resample(docs, target, 20, longest=longest, least_words=5)
        want = plain_resample(texts, ["same words again"], 20, longest, resampling.BUCKETS, 5, 2024)
        assert sorted(map(tuple, rows.collect()), key=repr) == want


def test_empty_tables(spark):
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(no_docs(spark), target, 10).count() == 0
    docs = [(1, "a b c"), (2, None)]
    rows = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), target, 100, least_words=1)
    assert sorted(map(tuple, rows.collect()), key=repr) == plain_resample(docs, [], 100, 1, resampling.BUCKETS, 1, 2024)


def test_draw_prefers_the_target(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wanted = docs.where("lang = 'de'").select("text")
    rows = resampling.resample(docs, wanted, 10, least_words=1).where("rank is not null")
    langs = rows.join(docs, F.col("id") == F.col("doc_id")).groupBy("lang").count().collect()
    assert max(langs, key=lambda r: r["count"]).lang == "de"
