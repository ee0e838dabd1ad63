"""Tool calls, byte-level BPE, SpotSigs and the pipeline."""

import base64
import hashlib
import json
import math

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from edges import edge_docs, edge_rows, no_docs, words
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from dataloom.llm import block_naming, byte_bpe, mixing, quality, simhash, spotsigs, tool_calls
from dataloom.plans.shared import checkpoint

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    tokens = byte_bpe.read_ranks(VOCABULARY)
    return byte_bpe.Codec(tokens, byte_bpe.model_bytes(tokens), public_tokenizers.PATTERN)


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_codec(reference, codec, text):
    ids = codec.encode(text)
    assert ids.tolist() == reference.encode_ordinary(text)
    assert codec.decode(ids).decode() == text


def test_byte_bpe(spark, reference):
    got = byte_bpe.encode_decode(edge_docs(spark), VOCABULARY, public_tokenizers.PATTERN).collect()
    want = sorted(repr((r[0], reference.encode_ordinary(r[1] or ""), r[1] or "")) for r in edge_rows())
    assert sorted(repr((r.id, list(r.ids), r.decoded)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)
    assert byte_bpe.encode_decode(no_docs(spark), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def plain_signs(text):
    """Chains as tuples, where the operator has their hashes."""
    own, now = [], ""
    for c in (text or "").lower():
        if c.isalpha() or c.isnumeric():
            now += c
        elif now:
            own, now = own + [now], ""
    own = own + [now] if now else own
    found = set()
    for i, w in enumerate(own):
        if w in spotsigs.ANCHORS:
            chain = [x for x in own[i + 1:i + 1 + spotsigs.REACH] if x not in spotsigs.ANCHORS][:spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                found.add((w, *chain))
    return found or {tuple(own[i:i + spotsigs.CHAIN + 1]) for i in range(max(1, len(own) - spotsigs.CHAIN))}


def plain_likeness(a, b):
    return len(a & b) / len(a | b)


def test_edited_pairs(spark):
    rows = [(k, " ".join(f"the {words(1, 7 * k + j)} of {words(2, j % 5)}" for j in range(k))) for k in range(25)]
    rows += [(40, None), (41, ""), (42, "漢字 der Ünï the çødé und 🙂 wörter of the sea")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: r for r in spotsigs.edited_pairs(docs).withColumns({
        "near_edited": spotsigs.likeness(F.col("signs"), F.col("edited_signs")),
        "near_next": spotsigs.likeness(F.col("signs"), F.col("next_signs")),
    }).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + following[:cut]
        assert (got[i].n_chars, got[i].edited) == (len(text), edited)
        assert len(got[i].signs) == len(plain_signs(text)) and len(got[i].edited_signs) == len(plain_signs(edited))
        assert math.isclose(got[i].near_edited, plain_likeness(plain_signs(text), plain_signs(edited)))
        assert math.isclose(got[i].near_next, plain_likeness(plain_signs(text), plain_signs(following)))


def test_edited_pairs_edges(spark):
    got = spotsigs.edited_pairs(edge_docs(spark)).collect()
    assert sorted(str(r.id) for r in got) == sorted(str(r[0]) for r in edge_rows())
    assert spotsigs.edited_pairs(no_docs(spark)).count() == 0
    lone = spotsigs.edited_pairs(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert lone.edited == "abcdab"


def test_spots_are_dense(spark):
    own = [f"w{k}" for k in range(900)]
    texts = [
        own[:10] + ["the"] + own[10:300], own[:300] + ["the"] + own[300:302], own[:90] + ["the"] * 40 + own[90:180],
        [x for w in own[:60] for x in (w, *["of"] * 9)], own[:300], ["the", "w1", "w2"], ["w1", "the"],
    ]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "id int, text string")
    found = {r.id: set(r.signs) for r in spotsigs.with_signatures(docs, "text", "signs").collect()}
    assert all(len(found[k]) * (spotsigs.REACH + spotsigs.CHAIN + 1) >= len(set(t)) for k, t in enumerate(texts))
    assert [len(found[k]) for k in (0, 1, 4, 5, 6)] == [1 + 8 + 280, 298 + 1, 298, 1, 1]
    rest = [["the"] + own[600 + 9 * k:609 + 9 * k] for k in range(11)]
    pairs = [(2, " ".join(texts[0])), (1, " ".join(x for r in rest for x in r))]
    got = spotsigs.edited_pairs(spark.createDataFrame(pairs, "doc_id int, text string")).select(
        "id", spotsigs.likeness(F.col("signs"), F.col("edited_signs")).alias("near")
    )
    assert 0.4 < {r.id: r.near for r in got.collect()}[2] < 0.75


def test_spot_near_duplicates(spark):
    base = [" ".join(f"the {words(1, 100 * b + j)} of" for j in range(60)) for b in range(3)]
    rows = [(b * 100 + k, " ".join(x for j, x in enumerate(base[b].split(" ")) if j // 3 != 10 * k)) for b in range(3) for k in range(6)]
    rows += [(r[0], r[1]) for r in edge_rows()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [plain_signs(t) for _, t in rows]
    top = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if plain_likeness(sets[a], sets[b]) >= 0.8:
                    top[a] = top[b] = min(top[a], top[b])
    want = [
        (i, min((rows[m][0] for m in range(len(rows)) if top[m] == top[n] and rows[m][0] is not None), default=None), top.count(top[n]))
        for n, (i, _) in enumerate(rows)
    ]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in spotsigs.near_duplicates(docs).collect())
    assert spotsigs.near_duplicates(no_docs(spark)).count() == 0


MESSAGES = "conversation long, position int, kind string, call_id string, name string, arguments string, needs array<string>, content string, row string"


def test_linked_calls(spark):
    call = lambda c, p, i, needs=(), args='{"b": 1, "a": "é"}', name="f": (c, p, "call", i, name, args, list(needs), None, "x")
    result = lambda c, p, i, text="r": (c, p, "result", i, None, None, None, text, "x")
    rows = [
        call(1, 0, "a", ["b"]), call(1, 1, "b"), call(1, 2, "c", ["a", "b"]), result(1, 3, "a"), result(1, 4, "a", "late"), result(1, 5, "b"),
        call(2, 0, "a", ["b"]), call(2, 1, "b", ["a"]), call(2, 2, "d", ["a"]), result(2, 3, "zzz"),
        call(3, 0, "a", ["no"]), call(3, 1, "b", [], '{"a": 1}'), call(3, 2, "c", [], "{oops"), call(3, 3, "d", [], "{}", "g"),
        call(3, 4, None), result(3, 5, None), call(3, 6, "e", [], '{"a": NaN}'), call(3, 7, "b"), result(3, 8, "c"),
        call(None, 0, "a"), result(None, 1, "a", None), (4, 0, "other", "q", None, None, None, "text", "x"),
    ]
    schema = {"f": {"type": "object", "required": ["a"], "properties": {"a": {"type": "string"}}}}
    got = {(r.conversation, r.call_id, r.position): r for r in tool_calls.linked_calls(spark.createDataFrame(rows, MESSAGES), schema).collect()}
    state = {k: (r.status, r.level) for k, r in got.items()}
    assert state == {
        (1, "a", 0): ("ok", 1), (1, "b", 1): ("ok", 0), (1, "c", 2): ("no_result", 2),
        (2, "a", 0): ("cycle", None), (2, "b", 1): ("cycle", None), (2, "d", 2): ("cycle", None), (2, "zzz", None): ("no_call", None),
        (3, "a", 0): ("missing_call", 0), (3, "b", 1): ("bad_arguments", 0), (3, "c", 2): ("bad_json", 0),
        (3, "d", 3): ("unknown_tool", 0), (3, None, 4): ("no_id", None), (3, None, None): ("no_call", None),
        (3, "e", 6): ("bad_json", 0), (None, "a", 0): ("ok", 0),
    }
    assert got[1, "a", 0].json == '{"arguments":{"a":"é","b":1},"id":"a","level":1,"name":"f","needs":["b"],"result":"r"}'
    assert (got[1, "a", 0].n_results, got[3, "b", 1].n_calls, got[3, "b", 1].faults) == (2, 2, ["$.a: not string"])
    assert tool_calls.linked_calls(spark.createDataFrame([], MESSAGES), schema).count() == 0


def test_schema_faults():
    schema = {"type": "object", "additionalProperties": False, "properties": {
        "n": {"type": "integer", "minimum": 1, "maximum": 3}, "s": {"type": ["string", "null"], "minLength": 1, "maxLength": 2},
        "l": {"type": "array", "items": {"enum": [1, "x"]}},
    }}
    assert tool_calls.faults({"n": 2, "s": None, "l": [1, "x"]}, schema) == []
    assert tool_calls.faults({"n": 2.0}, schema) == []
    assert tool_calls.faults({"n": True, "s": "", "l": [2], "z": 0}, schema) == [
        "$.l[0]: not in enum", "$.n: not integer", "$.s: too short", "$.z: not allowed",
    ]
    assert tool_calls.faults({"n": 4, "s": "abc"}, schema) == ["$.n: above maximum", "$.s: too long"]
    assert json.loads(tool_calls.canonical({"b": [1.5], "a": "ß"})) == {"a": "ß", "b": [1.5]}


def test_pipeline(spark, folder, reference):
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "simhash_near_dedup", "mixing", "byte_bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        steps.append(checkpoint(stage(spark, steps[-1], folder)))
        assert steps[-1].schema == docs.schema
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert all(a >= b for a, b in zip(ids, ids[1:]))
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert ids[1] == {r.id for r in quality.scores(docs, model).collect() if r.score >= 0.5}
    assert ids[2] == {r.id for r in block_naming.exact_copies(steps[1]).collect() if r.kept}
    assert ids[3] == {r.component for r in simhash.near_duplicates(steps[2]).collect()}
    assert ids[4] == {r.id for r in mixing.mixture(steps[3]).collect() if r.chosen}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == ids[4] and len(got) == len(ids[4])
    assert all(list(r.ids) == reference.encode_ordinary(texts[r.doc_id]) and r.decoded == texts[r.doc_id] for r in got)
    assert hashlib.sha256(got[0].decoded.encode()).digest()


def test_pipeline_stages_on_edges(spark, folder):
    for docs in (edge_docs(spark), no_docs(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns
            assert out.count() <= len(edge_rows())
