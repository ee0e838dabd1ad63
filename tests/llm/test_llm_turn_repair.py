"""Turn repair against every possible audit, a plain programme, and hash collisions."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from dataloom.llm import queries as llm, turn_repair as tr

SPACE = " \t\n\v\f\r"


def plain_faults(rows):
    """Faults of (role, text) rows in order."""
    seen, found = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        fault = tr.BLANK if not bare else tr.DUPLICATE if (role, text) in seen else tr.TRUNCATED if bare[-1] not in ".!?" else tr.NONE
        seen.add((role, text))
        found.append(fault)
    return found


def plain_repair(rows, faults):
    """(cost, audit, repaired rows), strings compared as strings."""
    legal_next = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def spread(best):
        for _ in range(4):
            for state, (cost, audit, told) in list(best.items()):
                for c in legal_next[state].replace("s", ""):
                    offer(best, c, (cost + 2, audit + "I", told + ((name[c], ""),)))
        return best

    def offer(best, state, item):
        if state not in best or item < best[state]:
            best[state] = item

    best = {"": (0, "", ())}
    for (role, text), fault in zip(rows, faults):
        best, after = spread(best), {}
        for state, (cost, audit, told) in best.items():
            offer(after, state, (cost + 3, audit + "D", told))
            if fault in (tr.BLANK, tr.DUPLICATE):
                continue
            extra = int(fault == tr.TRUNCATED)
            if role[:1] and role[:1] in legal_next[state]:
                offer(after, role[:1], (cost + extra, audit + "K", told + ((role, text),)))
            for c in legal_next[state].replace("s", ""):
                offer(after, c, (cost + 2 + extra, audit + "R", told + ((name[c], text),)))
        best = after
    return min(item for state, item in spread(best).items() if state in ("", "a"))


def every_audit(initials, faults):
    """The least (cost, audit) of all strings of edits, tried one by one."""
    n, found = len(initials), []
    for size in range(n, n + 5):
        for audit in itertools.product("DIKR", repeat=size):
            if sum(e != "I" for e in audit) != n:
                continue
            rows, roles, cost = iter(zip(initials, faults)), [], 0
            for edit in audit:
                initial, fault = next(rows) if edit != "I" else (None, None)
                if edit != "D" and fault in (tr.BLANK, tr.DUPLICATE):
                    break
                cost += {"D": 3, "I": 2, "R": 2, "K": 0}[edit] + (edit in "KR" and fault == tr.TRUNCATED)
                if edit != "D":
                    roles.append({initial} if edit == "K" else {"u", "a"})
            else:
                body = roles[1:] if roles and audit and "s" in roles[0] else roles
                if (not roles or body) and len(body) % 2 == 0 and all("ua"[k % 2] in r for k, r in enumerate(body)):
                    found.append((cost, "".join(audit)))
    return min(found)


def solved(initials, faults):
    best = {tr.START: (0, tr.Audit(None))}
    for initial, fault in zip(initials, faults):
        best = tr.advance(best, initial, fault)
    return tr.closed(best)


ROWS = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.sampled_from([0, 0, 0, 1, 2, 3])), max_size=14)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_every_audit(n):
    for initials in itertools.product("suat", repeat=n):
        for faults in itertools.product((tr.NONE, tr.BLANK, tr.TRUNCATED), repeat=n):
            if n < 3 or hash((initials, faults)) % 7 == 0:
                assert solved(initials, faults) == every_audit(initials, faults)


@given(ROWS)
@settings(max_examples=400, deadline=None)
def test_plain_programme(rows):
    cost, audit, _ = plain_repair([(r, "") for r, _ in rows], [f for _, f in rows])
    assert solved([r for r, _ in rows], [f for _, f in rows]) == (cost, audit)


@given(ROWS)
@settings(max_examples=200, deadline=None)
def test_collisions_are_verified(rows):
    kept, tr.Audit.modulus = tr.Audit.modulus, 3
    try:
        cost, audit, _ = plain_repair([(r, "") for r, _ in rows], [f for _, f in rows])
        assert solved([r for r, _ in rows], [f for _, f in rows]) == (cost, audit)
    finally:
        tr.Audit.modulus = kept


@given(st.text("DIKR", max_size=40), st.text("DIKR", max_size=40), st.text("DIKR", max_size=40), st.sampled_from([2, 7, tr.Audit.modulus]))
@settings(max_examples=400, deadline=None)
def test_order_of_audits(shared, left, right, modulus):
    kept, tr.Audit.modulus = tr.Audit.modulus, modulus
    try:
        root = tr.Audit(None)
        for edit in shared:
            root = tr.Audit(root, edit)
        ends = []
        for tail in (left, right):
            node = root
            for edit in tail:
                node = tr.Audit(node, edit)
            ends.append(node)
        assert tr.compare(*ends) == (shared + left > shared + right) - (shared + left < shared + right)
        assert ends[0].text() == shared + left and ends[0].ancestor(len(shared)) is root
    finally:
        tr.Audit.modulus = kept


@given(ROWS, st.lists(st.integers(0, 14), max_size=4))
@settings(max_examples=200, deadline=None)
def test_blocks_give_the_whole(rows, cuts):
    bounds = sorted({0, len(rows), *(min(c, len(rows)) for c in cuts)})
    costs, ranks, audits = [], [], []
    for a, b in zip(bounds, bounds[1:]):
        part = tr._Block("c", a, False)
        for k, (initial, fault) in enumerate(rows[a:b]):
            part.add(k, initial, initial, b"", fault)
        record = part.record(0, False)
        costs.append(record["costs"]), ranks.append(record["ranks"]), audits.append(record["audits"])
    cost, chosen = tr.choose(costs, ranks)
    audit = "".join(a[4 * e + x] for a, (e, x) in zip(audits, chosen)) + tr._CLOSING[chosen[-1][1] if chosen else tr.START]
    assert (cost, audit) == solved([r for r, _ in rows], [f for _, f in rows])


def plain_report(rows):
    """What ``repair`` reports for (turn, role, text) rows of a conversation."""
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{r[1]}\0{r[2]}".encode()).digest())
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=order)
    faults = plain_faults([r[1:] for r in rows])
    cost, audit, told = plain_repair([r[1:] for r in rows], faults)
    initials = [r[1][:1] for r in rows]
    turns = {r[0] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    counts = [faults.count(k) for k in (tr.BLANK, tr.DUPLICATE, tr.TRUNCATED)]
    return gaps, *counts, illegal, cost, audit, "\n".join(f"{r}:{x}" for r, x in told)


SCHEMA = "conv_id long, turn int, role string, text string, part string, seq string, conversation string"


def rows_of(seed):
    own = random.Random(seed)
    texts = [None, "", " \t", "yes", "Yes.", "No!", "Why?\n", "and then", "ü."]
    rows = [
        (own.choice([None, *range(12)]), own.choice([None, *range(6)]), own.choice(["user", "assistant", "system", "tool", "", None]),
         own.choice(texts)) for _ in range(150)
    ]
    # A long conversation, one turn many times, and one text throughout.
    rows += [(100, k, own.choice(["user", "assistant"]), own.choice(texts) or "x") for k in range(300)]
    rows += [(101, 5, "user", "Again.")] * 90 + [(102, k, "user", f"{k}.") for k in range(80)]
    return rows


@pytest.mark.parametrize("block", [7, tr.BLOCK])
def test_repair(spark, block):
    rows = rows_of(block)
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(5)
    report, turns = tr.repair(frame, block=block)
    texts = dict(map(tuple, tr.joined_turns(turns).collect()))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    got = {r.conversation: (*[r[n] for n in names], texts.get(r.conversation, "")) for r in report.collect()}
    groups = defaultdict(list)
    for conversation, *row in rows:
        groups[conversation].append(tuple(row))
    assert got == {c: plain_report(g) for c, g in groups.items()}


def test_no_rows(spark):
    report, turns = tr.repair(spark.createDataFrame([], SCHEMA))
    assert report.count() == 0 and turns.count() == 0


def test_query(spark, folder):
    damage = defaultdict(list)
    for conv, turn, role, text in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        dealt = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        rows = damage[conv]
        if dealt:
            text = "" if dealt == 1 else "".join(c for c in text if c not in ".!?") if dealt == 2 else text
            rows += [(turn, "user" if dealt == 4 else role, text)] * (2 if dealt == 3 else 1)
    want = {}
    for conv, rows in damage.items():
        *numbers, told = plain_report(rows)
        want[conv] = (*numbers, hashlib.sha256(told.encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in llm.turns_repaired(spark, folder).collect()}
    assert got == want


def test_query_on_nulls(spark, tmp_path):
    rows = [(None, None, None, None), (None, 2, "user", "Hi."), (1, 3, "user", "Hi."), (2, 7, "assistant", None)]
    for k in range(40):
        rows.append((3 + k, 1, "user", "Hi."))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in llm.turns_repaired(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    dropped = [c for c in range(3, 43) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    assert dropped
    for conv in dropped:
        r = got[conv]
        assert (r.gaps, r.blank, r.illegal, r.cost, r.audit, r.repaired_sha256) == (0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_plan_holds_no_global_window(spark, folder):
    report, turns = tr.repair(llm.damaged(spark.read.parquet(f"{folder}/conversations.parquet")))
    for frame in (report, turns.select(F.col("text"))):
        assert "SinglePartition" not in frame._jdf.queryExecution().executedPlan().toString()
