"""Buckets of many near copies cost a few comparisons a member."""

import numpy as np
from pyspark.sql import functions as F

from dataloom.llm import buckets, fuzzy_lines


def test_stragglers_that_link_are_not_all_compared(spark):
    # Two clusters in one bucket: whichever holds the hub, the other one's members are stragglers.
    nodes = spark.range(400).select((F.xxhash64("id")).alias("node"), (F.col("id") % 2).alias("sketch"))
    compared = []

    def prepared(wanted):
        def verified(pairs):
            compared.append(pairs.count())
            return pairs

        return nodes, verified

    members = nodes.select(F.lit(7).cast("long").alias("bucket"), "node")
    roots = buckets.linked(members, lambda left, right: left == right, prepared)
    found = roots.join(nodes, "node").groupBy("sketch").agg(F.count("*").alias("n"), F.count_distinct("root").alias("roots")).collect()
    assert sorted((r.sketch, r.n, r.roots) for r in found) == [(0, 200, 1), (1, 200, 1)]
    assert sum(compared) < 1600


def test_no_link_is_lost(spark):
    # Links of a path, in an order that the hub does not see.
    nodes = spark.range(60).select((F.col("id") * 37 % 61).alias("node"), F.col("id").alias("sketch"))

    def prepared(wanted):
        return nodes, lambda pairs: pairs

    members = nodes.select(F.lit(1).cast("long").alias("bucket"), "node")
    roots = buckets.linked(members, lambda left, right: F.abs(left - right) <= 1, prepared).collect()
    assert {r.root for r in roots} == {0} and len(roots) == 60


def test_only_shared_buckets_become_rows(spark, monkeypatch):
    # So small packs that a task adds up what it remembers many times.
    monkeypatch.setattr(fuzzy_lines, "_PACKED", 60)
    own = np.random.default_rng(3)
    lines = [(int(node), own.integers(0, 900, fuzzy_lines.BANDS)) for node in own.integers(0, 120, 200)]
    lines += [(1000 + k, np.full(fuzzy_lines.BANDS, 5000)) for k in range(80)]
    rows = [(node, b.astype(np.int64).tobytes()) for node, b in lines] + [(7, None)]
    frame = spark.createDataFrame(rows, "node long, buckets binary").repartition(4)
    nodes = {}
    for node, found in lines:
        for b in found.tolist():
            nodes.setdefault(b, set()).add(node)
    want = {(b, node) for b, of in nodes.items() if len(of) > 1 for node in of}
    got = [tuple(r) for r in fuzzy_lines._members(frame).select("bucket", "node").collect()]
    assert set(got) == want and len(want) < sum(map(len, nodes.values()))
    assert fuzzy_lines._members(frame.where("node < 0")).count() == 0


def test_short_and_repeating_lines_have_the_buckets_of_their_shingles():
    # A line's buckets do not depend on the lines beside it, nor on how often a shingle comes.
    lines = ["x", "ab" * 40, "ab" * 20, "é漢🙂", "twelve chars", "x" * 9]
    together = fuzzy_lines.signatures(lines)
    assert all((together[i] == fuzzy_lines.signatures([line])[0]).all() for i, line in enumerate(lines))
    assert (together[1] == together[2]).all() and not (together[0] == together[5]).any()


def test_buckets_with_the_same_members_are_one(spark):
    # Two near copies share eight buckets, one of them is also in a bucket with others.
    rows = [(b, n) for b in range(8) for n in (1, 2)] + [(20, 1), (20, 2), (20, 3), (30, 4), (40, 1), (40, 1)]
    shared = buckets._shared(spark.createDataFrame(rows, "bucket long, node long")).collect()
    of = {}
    for r in shared:
        of.setdefault(r.bucket, set()).add(r.node)
    assert sorted(map(sorted, of.values())) == [[1, 2], [1, 2, 3]] and all(r.hub in of[r.bucket] for r in shared)


def test_near_lines_are_told_by_their_differences():
    own = np.random.default_rng(5)
    text = "".join(own.choice(list("abcdefgh é🙂"), 400))
    found = set()
    for k in range(300):
        left = text[:own.integers(1, 400)] * own.integers(1, 3)
        right = list(left)
        for at in own.integers(0, len(left), own.integers(0, 4)):
            right[at] = "xyz"[own.integers(3)] * own.integers(0, 3)
        right = "".join(right) or "x"
        sets = fuzzy_lines.shingles(left), fuzzy_lines.shingles(right)
        for n in (len(sets[0]), len(sets[0]) // 2):
            assert fuzzy_lines.near_lines(left, right, n) == (fuzzy_lines.similarity(*sets) >= 0.8)
        found.add(fuzzy_lines.similarity(*sets) >= 0.8)
    assert found == {True, False}


def test_pairs_are_told_together(monkeypatch):
    own = np.random.default_rng(7)
    # Letters of ASCII, of a second alphabet, and of one too large for seven bits.
    alphabets = ["abc .", "abcdé漢🙂ж ", "".join(map(chr, range(0x4E00, 0x4E00 + 300)))]
    lefts, rights = [], []
    for k in range(400):
        left = "".join(own.choice(list(alphabets[k % 3]), int(own.integers(1, 300)))) * int(own.integers(1, 3))
        right = list(left[int(own.integers(0, 9)):])
        for at in own.integers(0, max(1, len(right)), int(own.integers(0, 4))):
            right[at:at + 1] = "x" * int(own.integers(0, 3))
        lefts.append(left)
        rights.append("".join(right) or "y")
    long = "".join(own.choice(list(alphabets[0]), 70_000))
    lefts += [long, "short", "a" * 9, "a" * 50, "\x00" * 12, "abcdefgh\x7f"]
    rights += [long + "d", "short one", "a" * 60, "a" * 9, "\x01" * 12, "abcdefgh\x00"]
    want = [fuzzy_lines.similarity(fuzzy_lines.shingles(a), fuzzy_lines.shingles(b)) >= 0.8 for a, b in zip(lefts, rights)]
    alone, near_lines = [], fuzzy_lines.near_lines
    monkeypatch.setattr(fuzzy_lines, "near_lines", lambda *pair: alone.append(pair) or near_lines(*pair))
    for room in (1, 2_000, 1 << 17):
        monkeypatch.setattr(fuzzy_lines, "_AT_ONCE", room)
        assert fuzzy_lines.near_pairs(lefts, rights, [0] * len(lefts)).tolist() == want
    assert 50 < sum(want) < 350
    # One by one only lines shorter than a shingle, long ones and those of more than 128 different characters.
    assert len(alone) > 3 and all(min(len(a), len(b)) < 9 or a is long or len({*a, *b}) > 128 for a, b, *_ in alone)
    assert sum(a is long for a, *_ in alone) == 3
    assert fuzzy_lines.near_pairs([], [], []).tolist() == []
    # Longer shingles do not fit.
    assert fuzzy_lines.near_pairs(["ab" * 20], ["ab" * 30], [2], 10).tolist() == [True]
