"""Exact copies, SimHash near-duplicates and fuzzy lines against plain Python."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from edges import CLASHES, edge_docs, edge_rows, no_docs, words
from hypothesis import given, settings, strategies as st

from dataloom.llm import block_naming, components, fuzzy_lines, simhash


def bare(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def union(n, pairs):
    above = list(range(n))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


def plain_print(text, n=3):
    pieces = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not pieces:
        return 0
    grams = [" ".join(pieces[i:i + n]) for i in range(max(1, len(pieces) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 2), (5, 5), (9, 8), (8, 7), (7, 6), (20, 1)] + [(30, x) for x in range(31, 60)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(x, 1) for x in (1, 2, 3, 20)} | {(x, 6) for x in (6, 7, 8, 9)} | {(x, 30) for x in range(30, 60)}
    chain = spark.range(60).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in components.components(chain).collect()} == {0}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [4, 4096])
def test_exact_copies(spark, block):
    got = block_naming.exact_copies(edge_docs(spark), block=block).collect()
    rows = edge_rows()
    groups = {}
    for r in rows:
        groups.setdefault(bare(r[1]), []).append(r)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
    for r in got:
        own = by_digest[r.digest]
        first = min(own, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert (r.keep_id, r.group_size) == (first[0], len(own))
        assert not r.kept or r.id == first[0]


def test_block_names_are_one_to_one(spark):
    texts = [words(3, k % 7) * (k % 5) for k in range(60)] + ["ab", "a", "b", "ba", "aab", "aaab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: (r.n_bytes, r.name) for r in block_naming.identities(docs, block=3).collect()}
    for a in range(len(texts)):
        for b in range(a):
            assert (got[a] == got[b]) == (bare(texts[a]) == bare(texts[b]))


def test_drop_exact_copies_keeps_columns(spark):
    got = block_naming.drop_exact_copies(edge_docs(spark))
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    assert len(rows) == len({bare(r[1]) for r in edge_rows()}) == len({bare(r.text) for r in rows})


@given(st.text(max_size=60))
@settings(max_examples=60, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_print(text)


def test_tree_finds_all_near_pairs():
    own = np.random.default_rng(3)
    base = own.integers(0, 1 << 63, 300, dtype=np.uint64)
    points = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << own.integers(0, 64, 300, dtype=np.uint64)) for _ in range(6)]))
    tree, leaves = simhash.grow(points[::7], 4)
    assert leaves > 8
    home, row = simhash.route(tree, points, 0)
    assert sorted(row.tolist()) == list(range(len(points)))
    place = dict(zip(row.tolist(), home.tolist()))
    shard, row = simhash.route(tree, points, 2)
    seen = set(zip(shard.tolist(), row.tolist()))
    far = np.bitwise_count(points[:, None] ^ points[None, :])
    near = {(int(a), int(b)) for a, b in zip(*np.nonzero(far <= 2))}
    assert all((place[a], b) in seen for a, b in near)
    found = {(int(a), int(b)) for q, p in simhash.near_pairs(points, points, 2) for a, b in zip(q, p)}
    assert found == near


def test_near_duplicates(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    rows += [(100 + k, words(400, 50) + f" tail{k}") for k in range(30)] + [(200 + k, words(60, 60 + k)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [plain_print(t) for _, t in rows]
    top = union(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 2])
    want = sorted((
        (i, p, min((rows[k][0] for k in range(len(rows)) if top[k] == top[n] and rows[k][0] is not None), default=None), top.count(top[n]))
        for n, ((i, _), p) in enumerate(zip(rows, prints))
    ), key=repr)
    got = simhash.near_duplicates(docs).collect()
    assert sorted(((r.id, r.print % (1 << 64), r.component, r.group_size) for r in got), key=repr) == want
    kept = simhash.drop_near_duplicates(docs).collect()
    assert len(kept) == len(set(top))
    assert {r.doc_id for r in kept} == {w[2] for w in want}


def test_links_cut_into_shards(spark):
    own = np.random.default_rng(5)
    base = own.integers(0, 1 << 63, 400, dtype=np.uint64)
    points = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40)])).view(np.int64)
    frame = spark.createDataFrame([(int(p),) for p in points], "print long")
    links = simhash.links(frame, 2, shard_points=100).collect()
    place = {int(p): i for i, p in enumerate(points)}
    far = np.bitwise_count(points.view(np.uint64)[:, None] ^ points.view(np.uint64)[None, :])
    assert union(len(points), [(place[r.a], place[r.b]) for r in links]) == union(len(points), list(zip(*np.nonzero(far <= 2))))


def plain_lines(rows):
    """Kept line numbers of each (id, text), by comparing all pairs."""
    lines, seen = [], {}
    for i, text in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0)):
        for n, line in enumerate(text.split("\n")):
            lines.append((i, text, n, fuzzy_lines.plain_line(line)))
    nodes = sorted({line[3] for line in lines if line[3]})
    sets = [fuzzy_lines.shingles(x) for x in nodes]
    top = union(len(nodes), [(a, b) for a in range(len(nodes)) for b in range(a) if fuzzy_lines.similarity(sets[a], sets[b]) >= 0.8])
    root = dict(zip(nodes, top))
    kept = {}
    for i, text, n, line in lines:
        own = kept.setdefault((i, text), [])
        if not line or root[line] not in seen:
            own.append(n)
        if line:
            seen.setdefault(root[line], True)
    return kept


def test_kept_lines(spark):
    common = words(40, 70)
    rows = [(r[0], r[1]) for r in edge_rows() if r[0] is not None and r[0] != 12]
    rows += [(300 + k, f"{words(30, 80 + k)}\n{common} {words(1, k)}\n{words(25, 90)}\n\n  {words(12, 95).upper()} ") for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_lines(rows)
    got = fuzzy_lines.kept_lines(docs).collect()
    assert len(got) == len(want)
    assert {r.id: r.kept for r in got} == {i: k for (i, _), k in want.items()}


def test_dedup_lines_edges(spark):
    docs = edge_docs(spark)
    got = fuzzy_lines.dedup_lines(docs)
    assert got.columns == docs.columns
    assert got.count() == len(edge_rows())
    texts = {r.doc_id: r.text for r in got.where("doc_id IN (7, 17, 18)").collect()}
    assert texts[7] is None
    assert texts[17] == "\n".join(edge_rows()[-2][1].split("\n")[:3])
    assert texts[18] == edge_rows()[-1][1].split("\n")[0]


def test_banding_recall():
    own = np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    met = total = 0
    for _ in range(150):
        line = own.choice(letters, 300)
        other = line.copy()
        other[own.integers(0, 300, 3)] = "#"
        a, b = "".join(line), "".join(other)
        if fuzzy_lines.similarity(fuzzy_lines.shingles(a), fuzzy_lines.shingles(b)) >= 0.8:
            total += 1
            met += bool((fuzzy_lines.signatures([a])[0] == fuzzy_lines.signatures([b])[0]).any())
    assert total > 50 and met >= 0.99 * total


def test_empty_tables(spark):
    assert block_naming.exact_copies(no_docs(spark)).count() == 0
    assert block_naming.drop_exact_copies(no_docs(spark)).count() == 0
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    assert simhash.drop_near_duplicates(no_docs(spark)).count() == 0
    assert fuzzy_lines.kept_lines(no_docs(spark)).count() == 0


def test_parity_maps_never_deny_a_link(spark):
    own = np.random.default_rng(13)
    letters = np.array(list("abcdefghij "))
    lines = []
    for k in range(60):
        line = own.choice(letters, int(own.integers(20, 400)))
        other = line.copy()
        other[own.integers(0, len(line), int(own.integers(0, 6)))] = "#"
        lines += ["".join(line), "".join(other)]
    _, n, parity = fuzzy_lines.signed([x.encode() for x in lines])
    assert n.tolist() == [len(fuzzy_lines.shingles(x)) for x in lines]
    sketches = [(int(a), p.tolist()) for a, p in zip(n, parity)]
    frame = spark.createDataFrame([(k, *(sketches[k + i] for i in (0, 1))) for k in range(0, 120, 2)], "k int, a struct<n:int,parity:array<long>>, b struct<n:int,parity:array<long>>")
    may = {r.k: r.may for r in frame.select("k", fuzzy_lines.may_be_near(frame["a"], frame["b"], 0.8).alias("may")).collect()}
    near = {k: fuzzy_lines.similarity(fuzzy_lines.shingles(lines[k]), fuzzy_lines.shingles(lines[k + 1])) >= 0.8 for k in may}
    assert 10 < sum(near.values()) < 50 and all(may[k] for k in may if near[k])
    assert not all(may.values())
