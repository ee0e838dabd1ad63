"""Repair of the turn structure of conversations by cheapest edits.

A conversation is legal when its roles read: nothing, or at most one system turn and then
user and assistant in turn, ending with the assistant. Rows are kept, given another role or
deleted, and empty turns are inserted; a dynamic programme over the four states of that
grammar finds the cheapest edits and, of equally cheap ones, the audit (the edits'
initials in order) that is least in ASCII.

Audits share their beginnings: each is a linked node with its last edit, its depth, a
rolling hash of the whole and its ancestors at powers of two. Two audits of equal cost are
compared by searching their longest common beginning with these ancestors' hashes; that
the beginning is really common is verified node by node up to the first shared node, so
no result rests on a hash.

Long conversations are cut into blocks. Rows are sorted over range partitions; a block is a
run of one conversation in one task, solved from every state it may begin in. A block's
edits end with a row, so edits to insert belong to the row behind them, and no audit of
a block is a proper beginning of another: the order of its exits by audit, with the
costs, is all that is needed to choose, block after block, the least audit of a
conversation of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from dataloom.llm.common import WHITE_SPACE, picked
from dataloom.plans.shared import stored

# Costs of the edits, and of keeping a truncated row.
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
# Faults of a row; the first that applies counts.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
# States: nothing yet, behind the system turn, behind a user's, behind an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# What ends a conversation legally from each state.
_CLOSING = ("", "II", "I", "")
# The turn that may follow each state, beside a system turn at the start.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
# Rows of a block.
BLOCK = 4096


class Audit:
    """A persistent audit: its last edit behind the audit before it."""

    __slots__ = ("edit", "depth", "hash", "up")
    modulus, base = (1 << 61) - 1, 1_000_003

    def __init__(self, before: Audit | None, edit: str = ""):
        self.edit = edit
        if before is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = before.depth + 1
        self.hash = (before.hash * self.base + ord(edit)) % self.modulus
        up, k = [before], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = tuple(up)

    def ancestor(self, depth: int) -> Audit:
        node = self
        while node.depth > depth:
            node = node.up[min(len(node.up), (node.depth - depth).bit_length()) - 1]
        return node

    def text(self) -> str:
        edits, node = [], self
        while node.up:
            edits.append(node.edit)
            node = node.up[0]
        return "".join(reversed(edits))


def _verified(a: Audit, b: Audit) -> int:
    """Order of two audits of one depth, node by node up to the first shared one; the
    difference nearest to the beginning decides."""
    order = 0
    while a is not b:
        if a.edit != b.edit:
            order = -1 if a.edit < b.edit else 1
        if not a.up:
            break
        a, b = a.up[0], b.up[0]
    return order


def compare(a: Audit, b: Audit) -> int:
    """-1, 0 or 1 as audit ``a`` is less than, equal to or greater than ``b`` in ASCII."""
    if a is b:
        return 0
    depth = min(a.depth, b.depth)
    x, y = a.ancestor(depth), b.ancestor(depth)
    if x.hash == y.hash:
        # By hash one is a beginning of the other.
        return _verified(x, y) or (a.depth > b.depth) - (a.depth < b.depth)
    for k in reversed(range(len(x.up))):
        if k < len(x.up) and x.up[k].hash != y.up[k].hash:
            x, y = x.up[k], y.up[k]
    # By hash the beginnings before these two are common.
    return _verified(x.up[0], y.up[0]) or (-1 if x.edit < y.edit else 1)


Best = dict[int, tuple[int, Audit]]


def _offer(best: Best, state: int, cost: int, before: Audit, edit: str) -> None:
    held = best.get(state)
    if held is not None and held[0] < cost:
        return
    audit = Audit(before, edit)
    if held is None or cost < held[0] or compare(audit, held[1]) < 0:
        best[state] = cost, audit


def advance(best: Best, initial: str, fault: int) -> Best:
    """The best audits behind one more row; inserted turns come before the row."""
    best = dict(best)
    # No audit gains by inserting more turns in one place than there are states.
    for _ in STATES[1:]:
        for state, (cost, audit) in list(best.items()):
            _offer(best, _NEXT[state], cost + INSERT, audit, "I")
    after: Best = {}
    extra = CUT_SHORT if fault == TRUNCATED else 0
    for state, (cost, audit) in best.items():
        _offer(after, state, cost + DELETE, audit, "D")
        if fault in (BLANK, DUPLICATE):
            continue
        follows = _NEXT[state]
        if initial == _ROLE[follows][0]:
            _offer(after, follows, cost + extra, audit, "K")
        else:
            _offer(after, follows, cost + REROLE + extra, audit, "R")
        if state == START and initial == "s":
            _offer(after, SYSTEM, cost + extra, audit, "K")
    return after


def closed(best: Best) -> tuple[int, str]:
    """Cost and text of the best audit that ends a conversation."""
    cheapest = min(cost + INSERT * len(_CLOSING[s]) for s, (cost, _) in best.items())
    ends = [(audit, _CLOSING[s]) for s, (cost, audit) in best.items() if cost + INSERT * len(_CLOSING[s]) == cheapest]
    audit, closing = min(ends, key=cmp_to_key(lambda a, b: compare(a[0], b[0])))
    return cheapest, audit.text() + closing


class _Block:
    """A run of rows of one conversation in one task."""

    def __init__(self, conversation, seq: int, first: bool):
        self.conversation, self.seq, self.first = conversation, seq, first
        # A conversation that begins here has one state to begin in.
        self.entries = [START] if first else list(STATES)
        self.best: dict[int, Best] = {e: {e: (0, Audit(None))} for e in self.entries}
        self.rows: list[dict] = []
        self.faults, self.illegal, self.turns = [0, 0, 0, 0], 0, 0
        self.low = self.high = None

    def add(self, turn, role: str, initial: str, digest, fault: int) -> None:
        self.best = {e: advance(best, initial, fault) for e, best in self.best.items()}
        self.faults[fault] += 1
        if self.rows:
            self.illegal += not legal(self.rows[-1]["initial"], initial)
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.rows.append({"turn": turn, "role": role, "initial": initial, "digest": digest})

    def record(self, part: int, whole: bool) -> dict:
        record = {
            "conversation": self.conversation, "part": part, "seq": self.seq, "whole": whole, "faults": self.faults,
            "illegal": self.illegal, "turns": self.turns, "low": self.low, "high": self.high,
            "initials": [self.rows[0]["initial"], self.rows[-1]["initial"]], "rows": self.rows,
        }
        if whole:
            cost, audit = closed(self.best[START])
            return record | {"cost": cost, "audit": audit}
        costs, ranks, audits = [], [], []
        for entry in STATES:
            best = self.best.get(entry, {})
            ordered = sorted(best, key=cmp_to_key(lambda a, b: compare(best[a][1], best[b][1])))
            for leave in STATES:
                costs.append(best[leave][0] if leave in best else None)
                ranks.append(ordered.index(leave) if leave in best else None)
                audits.append(best[leave][1].text() if leave in best else None)
        return record | {"costs": costs, "ranks": ranks, "audits": audits}


def legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _solve(rows: Iterator[tuple], block: int) -> Iterator[tuple[_Block, bool]]:
    """The blocks of a task's rows and whether each is surely a whole conversation; the
    first and last conversations of a task may go on in other tasks."""
    now, seen, seq = None, 0, 0
    for conversation, turn, role, initial, digest, fault, again, copies in rows:
        for copy in range(copies):
            if now is None or now.conversation != conversation or len(now.rows) >= block:
                fresh = now is None or now.conversation != conversation
                if now is not None:
                    yield now, fresh and now.first
                seen += fresh
                seq += 1
                # Of the task's first conversation earlier rows may stand in another task.
                now = _Block(conversation, seq, fresh and seen > 1)
            repeated = fault != BLANK and (again or copy > 0)
            now.add(turn, role, initial, digest, DUPLICATE if repeated else fault)
    if now is not None:
        yield now, False


_RECORD = (
    "part int, seq long, whole boolean, faults array<long>, illegal long, turns long, low long, high long, "
    "initials array<string>, cost long, audit string, costs array<long>, ranks array<int>, "
    "audits array<string>, rows array<struct<turn: long, role: string, initial: string, digest: binary>>"
)


def _digest(role: str | Column, text: str | Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws("\u0000", role, text), 256))


def marked_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number (``copies``), the fault that the row shows itself and
    whether its role and text stand in an earlier turn (``again``)."""
    last = F.regexp_extract("text", f"([^{WHITE_SPACE}])[{WHITE_SPACE}]*\\z", 1)
    fault = F.when(~F.col("text").rlike(f"[^{WHITE_SPACE}]"), BLANK).when(~last.isin(".", "!", "?"), TRUNCATED)
    narrow = rows.select(
        "conversation", "turn", "role", F.substring("role", 1, 1).alias("initial"),
        _digest("role", "text").alias("digest"), F.coalesce(fault, F.lit(NONE)).alias("fault"),
    )
    keys = ["conversation", "turn", "role", "initial", "digest", "fault"]
    distinct = narrow.groupBy(*keys).agg(F.count("*").alias("copies"))
    # The struct orders a NULL turn before all others.
    firsts = distinct.groupBy(F.col("conversation").alias("of"), F.col("digest").alias("said")).agg(
        F.min(F.struct("turn")).alias("earliest"), F.count("*").alias("times")
    ).where("times > 1")
    joined = distinct.join(firsts, F.col("conversation").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("said")), "left")
    again = F.col("earliest").isNotNull() & ~F.col("turn").eqNullSafe(F.col("earliest.turn"))
    return joined.select(*keys, again.alias("again"), "copies")


def solved_blocks(marked: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks of all conversations, in a stored table."""
    ordered = marked.orderBy("conversation", "turn", "role", "digest").select(
        "conversation", "turn", "role", "initial", "digest", "fault", "again", "copies"
    )
    schema = f"conversation {marked.schema['conversation'].dataType.simpleString()}, {_RECORD}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        target = None

        def rows() -> Iterator[tuple]:
            nonlocal target
            for batch in batches:
                target = target or _arrow(batch.schema.field(0).type)
                yield from zip(*(c.to_pylist() for c in batch.columns))

        waiting, n_waiting = [], 0
        for solved, whole in _solve(rows(), block):
            waiting.append(solved.record(part, whole))
            n_waiting += len(solved.rows)
            if n_waiting >= block:
                yield pa.RecordBatch.from_pylist(waiting, target)
                waiting, n_waiting = [], 0
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, target)

    return stored(ordered.mapInArrow(run, schema), "blocks")


def _arrow(id_type: pa.DataType) -> pa.Schema:
    row = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("initial", pa.string()), ("digest", pa.binary())])
    whole, text = pa.int64(), pa.string()
    return pa.schema([
        ("conversation", id_type), ("part", pa.int32()), ("seq", whole), ("whole", pa.bool_()),
        ("faults", pa.list_(whole)), ("illegal", whole), ("turns", whole), ("low", whole), ("high", whole),
        ("initials", pa.list_(text)), ("cost", whole), ("audit", text), ("costs", pa.list_(whole)),
        ("ranks", pa.list_(pa.int32())), ("audits", pa.list_(text)), ("rows", pa.list_(row)),
    ])


def choose(costs: list[list], ranks: list[list]) -> tuple[int, list[tuple[int, int]]]:
    """The least cost of a chain of blocks and, block by block, the states in which the
    least audit enters and leaves. ``costs[b][4 * enter + leave]``; None: no way."""
    rest = [[INSERT * len(_CLOSING[s]) for s in STATES]]
    for cost in reversed(costs):
        rest.append([
            min((cost[4 * e + x] + rest[-1][x] for x in STATES if _given(cost[4 * e + x])), default=1 << 60) for e in STATES
        ])
    rest.reverse()
    state, chosen = START, []
    for b, cost in enumerate(costs):
        ways = [x for x in STATES if _given(cost[4 * state + x]) and cost[4 * state + x] + rest[b + 1][x] == rest[b][state]]
        leave = min(ways, key=lambda x: ranks[b][4 * state + x])
        chosen.append((state, leave))
        state = leave
    return int(rest[0][START]), chosen


def _given(cost) -> bool:
    return cost is not None and cost == cost


_CHAIN = (
    "n_blocks long, part int, seq long, enter int, leave int, last boolean, cost long, blank long, duplicate long, "
    "truncated long, illegal long, gaps long"
)


def _chained(blocks: DataFrame) -> DataFrame:
    """The choice for every block of conversations that no single task is sure to have
    seen whole; one row for each ``BLOCK`` rows, without rows and audits."""
    parts = blocks.where("not whole").select(
        "conversation", "part", "seq", "faults", "illegal", "turns", "low", "high", "initials", "costs", "ranks"
    )
    schema = f"conversation {blocks.schema['conversation'].dataType.simpleString()}, {_CHAIN}"

    def run(chain: pd.DataFrame) -> pd.DataFrame:
        chain = chain.sort_values(["part", "seq"])
        cost, chosen = choose([list(c) for c in chain["costs"]], [list(r) for r in chain["ranks"]])
        faults = [sum(int(f[k]) for f in chain["faults"]) for k in range(4)]
        ends = list(chain["initials"])
        illegal = int(chain["illegal"].sum()) + sum(not legal(a[1], b[0]) for a, b in zip(ends, ends[1:]))
        known = chain[chain["low"].notna()]
        gaps = 0
        if len(known):
            lows, highs = [int(v) for v in known["low"]], [int(v) for v in known["high"]]
            distinct = int(known["turns"].sum()) - sum(a == b for a, b in zip(highs, lows[1:]))
            gaps = highs[-1] - lows[0] + 1 - distinct
        n = len(chain)
        return pd.DataFrame({
            "conversation": chain["conversation"], "n_blocks": n, "part": chain["part"], "seq": chain["seq"],
            "enter": [e for e, _ in chosen], "leave": [x for _, x in chosen], "last": [k == n - 1 for k in range(n)],
            "cost": cost, "blank": faults[BLANK], "duplicate": faults[DUPLICATE], "truncated": faults[TRUNCATED],
            "illegal": illegal, "gaps": gaps,
        })

    return stored(parts.groupBy("conversation").applyInPandas(run, schema), "chains")


def resolved(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``report`` (one row a conversation: ``conversation, gaps, blank, duplicate, truncated,
    illegal, cost, audit``) and ``pieces`` (one row a block: ``conversation, part, seq,
    enter, audit, rows``)."""
    chains = _chained(blocks)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    whole = blocks.where("whole").select(
        "conversation", F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps"),
        *[F.get("faults", F.lit(k)).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))],
        "illegal", "cost", "audit",
    )
    closing = F.when(F.col("last"), F.get(F.array(*map(F.lit, _CLOSING)), F.col("leave"))).otherwise("")
    open_blocks = blocks.where("not whole").select("part", "seq", "conversation", "rows", "audits").join(
        chains.drop("conversation"), ["part", "seq"]
    ).withColumn("audit", F.concat(F.get("audits", 4 * F.col("enter") + F.col("leave")), closing))
    of_open = open_blocks.groupBy("conversation").agg(
        *[F.first(n).alias(n) for n in numbers],
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "seq", "audit"))), lambda p: p["audit"]), "").alias("audit"),
    )
    report = whole.unionByName(of_open)
    columns = ["conversation", "part", "seq", "enter", "audit", "rows"]
    pieces = blocks.where("whole").withColumn("enter", F.lit(START)).select(*columns).unionByName(open_blocks.select(*columns))
    return report, pieces


_EDITED = "part int, seq long, at long, edit string, turn long, role string, old_role string, digest binary"


def edits_of(pieces: DataFrame) -> DataFrame:
    """The turns of the repaired conversations without their texts: ``conversation, part,
    seq, at`` (their order), ``edit, turn, role, old_role, digest``; the last three and the turn of an
    inserted one are NULL but for the role."""
    schema = f"conversation {pieces.schema['conversation'].dataType.simpleString()}, {_EDITED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = pa.schema([
                ("conversation", batch.schema.field(0).type), ("part", pa.int32()), ("seq", pa.int64()), ("at", pa.int64()),
                ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("old_role", pa.string()), ("digest", pa.binary()),
            ])
            for k in range(len(batch)):
                piece = batch.slice(k, 1).to_pylist()[0]
                found = list(_edited(piece["enter"], piece["audit"], piece["rows"]))
                if found:
                    same = {n: piece[n] for n in ("conversation", "part", "seq")}
                    yield pa.RecordBatch.from_pylist([same | turn for turn in found], kind)

    return pieces.select("conversation", "part", "seq", "enter", "audit", "rows").mapInArrow(run, schema)


def _edited(state: int, audit: str, rows: list[dict]) -> Iterator[dict]:
    left = iter(rows)
    for at, edit in enumerate(audit):
        row = next(left) if edit != "I" else {"turn": None, "role": None, "initial": "", "digest": None}
        if edit == "D":
            continue
        system = edit == "K" and state == START and row["initial"] == "s"
        state = SYSTEM if system else _NEXT[state]
        yield {
            "at": at, "edit": edit, "turn": row["turn"], "role": row["role"] if edit == "K" else _ROLE[state],
            "old_role": row["role"], "digest": row["digest"],
        }


def repair(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """``report`` and ``turns`` of the repaired conversations.

    ``report``: ``conversation, gaps, blank, duplicate, truncated, illegal, cost, audit``.
    ``turns``: ``conversation, part, seq, at, edit, turn, role, text``; ``part, seq, at`` give
    their order, deleted rows are left out, inserted ones have an empty text and no turn.

    Rows stand in the order of their turns, a NULL turn first; rows of one turn in that of
    role and text digest, equal rows side by side. A NULL role or text is one space, so
    such a text is blank and such a role fits nowhere; a NULL conversation is one like any
    other; an empty table gives empty results. Texts are compared by SHA-256. A conversation
    may have any number of rows: no task holds more than ``block`` of them at once.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" "))
    plain = picked(rows, conversation=conversation, turn=turn, role=role, text=text).select(
        "conversation", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text")
    )
    report, pieces = resolved(solved_blocks(marked_rows(plain), block))
    # Equal rows have one text; what is repeated is deleted, so each is asked for once.
    texts = plain.select("conversation", "turn", _digest("role", "text").alias("digest"), "text").groupBy(
        "conversation", "turn", "digest"
    ).agg(F.first("text").alias("text"))
    edited = edits_of(pieces)
    left, right = edited.alias("l"), texts.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("conversation", "turn", "digest")]
    turns = left.join(right, on[0] & on[1] & on[2], "left").select(
        *[F.col(f"l.{c}").alias(c) for c in ("conversation", "part", "seq", "at", "edit", "turn", "role")],
        F.coalesce("r.text", F.lit("")).alias("text"),
    )
    return report, turns


def joined_turns(turns: DataFrame) -> DataFrame:
    """``conversation, joined``: each conversation's turns as ``role:text``, a line feed
    between them."""
    lines = F.sort_array(F.collect_list(F.struct("part", "seq", "at", F.concat("role", F.lit(":"), "text").alias("line"))))
    return turns.groupBy("conversation").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("joined"))
