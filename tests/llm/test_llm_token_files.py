"""Token files: round trips through the files, random access and the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from edges import edge_docs, edge_rows, no_docs
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from dataloom.llm import token_files as tf
from dataloom.plans.shared import scratch_path

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(VOCABULARY)
    own.encode_special_tokens = True
    return own


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, encoding="utf-8") as source:
        return tf.Encoder(source.read())


PARTS = [*"ab'st1.é漢🙂\n\t\r \u001c\u0085\u3000", "  ", " a", " b", " word", "'ll", "<|endoftext|>"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@given(st.lists(st.one_of(TEXT, st.text(max_size=20)), max_size=5))
@settings(max_examples=400, deadline=None)
def test_encoder(library, encoder, texts):
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_parts_cover_a_batch(monkeypatch):
    monkeypatch.setattr(tf, "_BYTES", 10)
    monkeypatch.setattr(tf, "_TEXTS", 3)
    texts = ["", "abc", "x" * 40, "abcdefghij", "k", "", "", "", "ab"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["id", "text"])
    parts = [p.column(1).to_pylist() for p in tf._parts(batch)]
    assert sum(parts, []) == texts and all(len(p) == 1 or (len(p) <= 3 and sum(map(len, p)) <= 10) for p in parts)


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(tf, "MEMORY", 5)
    with open(VOCABULARY, encoding="utf-8") as source:
        small = tf.Encoder(source.read())
    for k in range(20):
        texts = [f"w{k} w{k + 1} a b c", f"x{k}"]
        ids, _ = small.encode(pa.array(texts))
        assert ids.tolist() == sum((library.encode(t).ids for t in texts), [])
        assert len(small.known) <= 20


@pytest.mark.parametrize("length", [8, tf.LENGTH])
def test_round_trip(spark, library, length):
    files = tf.write_tokens(edge_docs(spark), VOCABULARY, scratch_path(spark, "test-tokens"), end=2, length=length)
    rows = tf.read_documents(files).orderBy("start").collect()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = {}
    for i, text, *_ in edge_rows():
        want.setdefault(i, []).append(library.encode(text or "", add_special_tokens=False).ids + [2])
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(list(r.ids))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    sums = tf.read_documents(files, ids=False).collect()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert sorted((r.start, r.ids_crc32) for r in sums) == [(r.start, crc(r.ids)) for r in rows]


def test_random_access(spark):
    docs = spark.createDataFrame([(k, f"text number {k} " * (k % 40)) for k in range(400)], "doc_id long, text string")
    files = tf.write_tokens(docs.repartition(4), VOCABULARY, scratch_path(spark, "test-tokens"), end=2, length=16)
    for part in files.manifest.collect():
        sequences = tf.Sequences(part.ids_path)
        assert len(sequences) == part.n_sequences == -(-part.n_tokens // 16)
        assert sequences.file.schema.field("ids").type == pa.list_(pa.uint16(), 16)
        stream = np.concatenate([sequences.stream(b) for b in range(sequences.file.num_record_batches)])
        real = 0
        for i in (len(sequences) - 1, 0, len(sequences) // 2, *range(len(sequences))):
            ids, mask = sequences[i]
            assert len(ids) == len(mask) == 16 and ids.tolist() == stream[16 * i: 16 * i + 16].tolist()
            assert not ids.flags.owndata
            real += int(mask.sum())
        assert sum(int(sequences[i][1].sum()) for i in range(len(sequences))) == part.n_tokens
        assert not stream[part.n_tokens:].any()
        with pytest.raises(IndexError):
            sequences[len(sequences)]


def test_large_vocabulary_ids(spark):
    docs = spark.createDataFrame([(1, "one")], "doc_id long, text string")
    files = tf.write_tokens(docs, VOCABULARY, scratch_path(spark, "test-tokens"), end=70_000)
    assert tf.read_documents(files).first().ids[-1] == 70_000


def test_empty(spark):
    files = tf.write_tokens(no_docs(spark), VOCABULARY, scratch_path(spark, "test-tokens"), end=2)
    assert files.manifest.count() == 0
    assert tf.read_documents(files).collect() == [] and tf.read_documents(files, ids=False).collect() == []


def test_a_name_of_the_attempt(spark):
    docs = spark.createDataFrame([(k, "a b c") for k in range(50)], "doc_id long, text string")
    files = tf.write_tokens(docs, VOCABULARY, scratch_path(spark, "test-tokens"), end=2)
    paths = [r.ids_path for r in files.manifest.collect()]
    assert len(set(paths)) == len(paths) and all(p.endswith(".ids.arrow") for p in paths)
