"""A class-based bigram model: exchange clustering of words, class transitions, emissions.

Words are counted over all training documents. Frequent words are symbols of their own,
all others are taken together by their ending into a fixed number of bundles, so the
symbols are bounded while the vocabulary is not. Exchange clustering moves a symbol to the
class that raises the likelihood of the class bigrams most; its gain is computed exactly
from the symbol's neighbours by class. A token's probability is that of its class after
the class before it, times that of the word in its class. Counts of rare words, and the
words that training has not seen, are met by a join and not by a table in memory.

Per class the probabilities of its known words and of one unknown word add up to one:
the unknown word gets what absolute discounting takes from the rare words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dataloom.llm.common import picked, text_or_empty
from dataloom.plans.shared import stored

# Symbols of their own at most, seen so often at least and no longer than so many bytes;
# bundles of all other words; classes (the first is that of the end alone); rounds.
SYMBOLS = 65_536
OFTEN = 3
LONG = 64
BUNDLES = 512
CLASSES = 32
ROUNDS = 3
# Share of the symbols that may move at once, one part after the other.
_PARTS = 2
# Entries that a task counts before it passes them on.
_ENTRIES = 400_000
# Weight of the class's own frequency beside its transitions.
_PRIOR = 10.0
END = 0
_PACKS = ["symbols", "others", "counts"]
# Neighbours in one row of a shuffle, so that a batch of such rows stays small.
_PIECE = 64
_PIECES = "part int, symbols binary, others binary, counts binary"


def words_of(text: str | bytes) -> list[bytes]:
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).lower().split()


def _bytes(column: pa.Array) -> Iterator[bytes]:
    """Texts as their UTF-8 bytes, some at a time."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).cast(pa.binary()).to_pylist()


def held_out(id_column: Column) -> Column:
    """Whether a document is kept from training: CRC-32 of its id leaves 1 by 5. A missing
    id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all texts (column ``text``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
            )

        for batch in batches:
            for text in _bytes(batch.column(0)):
                counts.update(words_of(text))
                if len(counts) >= _ENTRIES:
                    yield rows()
                    counts.clear()
        yield rows()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Symbols:
    """Symbol 0 is the end; then the frequent words; then the bundles."""

    words: dict[bytes, int]
    bundles: int

    @property
    def size(self) -> int:
        return 1 + len(self.words) + self.bundles

    def bundle(self, word: bytes) -> int:
        return 1 + len(self.words) + zlib.crc32(word[-3:]) % self.bundles

    def found(self, words: list[bytes]) -> np.ndarray:
        """The symbol of each word."""
        found = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        rare = np.flatnonzero(found < 0)
        found[rare] = np.fromiter((self.bundle(words[i]) for i in rare.tolist()), np.int64, len(rare))
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        """Symbols of a text, between two ends."""
        return np.concatenate([[END], self.found(words), [END]])


def _pieces(a: np.ndarray, b: np.ndarray, n: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """``part, symbols, others, counts``: each bigram for both of its symbols, packed by
    part of the symbols. A neighbour before the symbol is written as its complement."""
    a, b, n = a.astype(np.int32), b.astype(np.int32), n.astype(np.int64)
    yield from _dealt(a, b, n, parts)
    apart = a != b
    yield from _dealt(b[apart], ~a[apart], n[apart], parts)


def _dealt(symbol: np.ndarray, other: np.ndarray, n: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    part = (symbol % parts).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    sizes = np.bincount(part, minlength=parts)
    pieces = -(-sizes // _PIECE)
    of = np.repeat(np.arange(parts, dtype=np.int32), pieces)
    first = np.cumsum(pieces) - pieces
    begins = np.repeat(np.cumsum(sizes) - sizes, pieces) + (np.arange(len(of)) - np.repeat(first, pieces)) * _PIECE
    bounds = np.append(begins, len(order))
    for at in range(0, len(of), 2_000):
        cut = bounds[at:at + 2_001]
        some = order[cut[0]:cut[-1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(of[at:at + 2_000]), *(_binary(v[some], cut - cut[0]) for v in (symbol, other, n))], ["part", *_PACKS]
        )


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The values between two bounds, as the bytes of one row."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _values(column: pa.Array, kind: type) -> np.ndarray:
    """The integers of all rows."""
    column = column.cast(pa.binary())
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[bounds[0]:bounds[-1]].view(kind)


def _parts(texts: DataFrame) -> int:
    """Parts of the symbols: some for each task that the session shuffles into."""
    return min(1 << 14, 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _together(pieces: DataFrame) -> DataFrame:
    """``symbols, others, counts``, a stored table of packed arrays (32-bit integers, the
    counts 64), dealt by symbol, so that a task holds nearly all neighbours of its symbols.

    A task adds up what it meets of the same neighbours as long as that makes them fewer;
    it holds a bounded number of them, and some may be in more than one pack. Packs are
    moved and read without work for each row, and hold so few that a batch of them is
    small, however many rows a task reads.
    """
    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        pairs, n = (np.concatenate([h[i] for h in held]) for i in range(2))
        order = np.argsort(pairs)
        pairs = pairs[order]
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        return pairs[first], np.add.reduceat(n[order], first)

    def rows(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(pairs), step := 2_000 * _PIECE):
            some = pairs[at:at + step]
            bounds = np.append(np.arange(0, len(some), _PIECE), len(some))
            values = (some >> 32).astype(np.int32), (some & 0xFFFFFFFF).astype(np.uint32), n[at:at + step]
            yield pa.RecordBatch.from_arrays([_binary(v, bounds) for v in values], _PACKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0
        for batch in batches:
            if not len(batch):
                continue
            symbol, other, n = map(_values, batch.columns[1:], (np.int32, np.int32, np.int64))
            held.append(((symbol.astype(np.int64) << 32) | other.view(np.uint32), n.copy()))
            room += len(n)
            if room >= 4 * _ENTRIES:
                held = [added(held)]
                room = len(held[0][0])
                if room >= 2 * _ENTRIES:
                    yield from rows(*held[0])
                    held, room = [], 0
        if held:
            yield from rows(*added(held))

    return stored(pieces.repartition("part").mapInArrow(run, "symbols binary, others binary, counts binary"), "neighbours")


def text_neighbours(texts: DataFrame, symbols: Symbols) -> DataFrame:
    """``symbols, others, counts``: how often symbols follow each other in the texts (column
    ``text``), as ``neighbours_of`` has them."""
    shared, parts = texts.sparkSession.sparkContext.broadcast(symbols), _parts(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, held, room = shared.value.size, [], 0

        def rows():
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            yield from _pieces(pairs // size, pairs % size, n, parts)

        for batch in batches:
            for text in _bytes(batch.column(0)):
                own = shared.value.of(words_of(text))
                held.append(own[:-1] * size + own[1:])
                room += len(own)
                if room >= 4 * _ENTRIES:
                    yield from rows()
                    room = 0
        if held:
            yield from rows()

    return _together(texts.select("text").mapInArrow(run, _PIECES))


def neighbours_of(bigrams: DataFrame) -> DataFrame:
    """``symbols, others, counts`` of bigrams ``a, b, n`` (symbol b follows symbol a n
    times; a pair may be in more than one row): each for both of its symbols."""
    parts = _parts(bigrams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield from _pieces(*(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)), parts)

    return _together(bigrams.select("a", "b", "n").mapInArrow(run, _PIECES))


def _contexts(neighbours: DataFrame, classes: np.ndarray, k: int) -> DataFrame:
    """``symbol, slot, n``, a stored table: neighbours by class. Slots below k: behind it;
    from k: before it; 2k: the symbol itself behind itself. A task adds up a table of all
    symbols and slots, whose size is a parameter; a symbol that two tasks hold has its
    slots twice, to be added up."""
    shared = neighbours.sparkSession.sparkContext.broadcast(classes)
    wide = 2 * k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.astype(np.int64)
        sums = np.zeros(len(own) * wide, np.int64)
        for batch in batches:
            for at in range(0, len(batch), 2_000):
                symbol, other, n = map(_values, batch.slice(at, 2_000).columns, (np.int32, np.int32, np.int64))
                before = other < 0
                slot = np.where(symbol == other, 2 * k, own[np.where(before, ~other, other)] + k * before)
                np.add.at(sums, symbol.astype(np.int64) * wide + slot, n)
        found = np.flatnonzero(sums)
        for at in range(0, len(found), 50_000):
            some = found[at:at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array((some // wide).astype(np.int32)), pa.array((some % wide).astype(np.int32)), pa.array(sums[some])],
                ["symbol", "slot", "n"],
            )

    return stored(neighbours.mapInArrow(run, "symbol int, slot int, n long"), "contexts")


def class_bigrams(contexts: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """How often class j follows class i: k x k numbers, from the symbols' contexts."""
    shared = contexts.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = shared.value.astype(np.int64), np.zeros((k, k), np.int64)
        for batch in batches:
            symbol, slot, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            mine = own[symbol]
            np.add.at(sums, (mine, np.where(slot == 2 * k, mine, slot)), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k, dtype=np.int32)), pa.array(sums.ravel())], ["at", "n"])

    behind = contexts.where((F.col("slot") < k) | (F.col("slot") == 2 * k))
    rows = behind.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(k * k)
    counts[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return counts.reshape(k, k)


def _xlog(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def gains(counts: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray, itself: np.ndarray) -> np.ndarray:
    """Change of the log likelihood if each symbol joined each class instead of its own:
    (symbols, classes), the same constant for all classes of a symbol.

    ``after[i, j]`` and ``before[i, j]`` count class j behind and before symbol i, without
    the symbol itself, which follows itself ``itself[i]`` times.
    """
    n, k = after.shape
    rows, every = np.arange(n), np.arange(k)
    rest = np.repeat(counts[None], n, axis=0)
    rest[rows, own] -= after
    rest[rows, :, own] -= before
    rest[rows, own, own] -= itself
    rest = np.maximum(rest, 0)
    left, right = rest.sum(axis=2), rest.sum(axis=1)
    out = _xlog(rest + after[:, None, :]) - _xlog(rest)
    back = _xlog(rest + before[:, :, None]) - _xlog(rest)
    diagonal = rest[:, every, every]
    gain = out.sum(axis=2) - out[:, every, every] + back.sum(axis=1) - back[:, every, every]
    gain += _xlog(diagonal + after + before + itself[:, None]) - _xlog(diagonal)
    # The neighbours' own totals are the same wherever the symbol goes.
    for total, added in ((left + before, after), (right + after, before)):
        more = (added.sum(axis=1) + itself)[:, None]
        gain -= _xlog(total + more) - _xlog(total)
    return gain


def likelihood(counts: np.ndarray) -> float:
    """The logarithm of the likelihood of class bigrams, but for what classes do not change."""
    return float(_xlog(counts).sum() - _xlog(counts.sum(axis=0)).sum() - _xlog(counts.sum(axis=1)).sum())


def exchange(
    bigrams: DataFrame, size: int, k: int = CLASSES, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray]:
    """The class of each symbol, and how often class j follows class i, from ``a, b, n``."""
    return clustered(neighbours_of(bigrams), size, k, rounds)


def clustered(
    neighbours: DataFrame, size: int, k: int = CLASSES, rounds: int = ROUNDS
) -> tuple[np.ndarray, np.ndarray]:
    """The class of each symbol, and how often class j follows class i, from stored
    ``symbols, others, counts``.

    Class 0 holds the end alone; other symbols begin dealt by rank. A turn is one pass over
    the bigrams; then a part of the symbols moves, all against the same counts. Should a
    turn lower the likelihood, it is taken back and the exchange ends.
    """
    classes = np.concatenate([[0], 1 + np.arange(size - 1) % (k - 1)]).astype(np.int32)
    last = None
    for turn in range(rounds * _PARTS + 1):
        everything = _contexts(neighbours, classes, k)
        counts = class_bigrams(everything, classes, k)
        if last is not None and likelihood(counts) < likelihood(last[1]):
            return last
        if turn == rounds * _PARTS:
            break
        last = classes.copy(), counts
        shared = neighbours.sparkSession.sparkContext.broadcast((counts, classes))

        def move(part: pd.DataFrame) -> pd.DataFrame:
            counts, classes = shared.value
            symbols, place = np.unique(part["symbol"].to_numpy(), return_inverse=True)
            table = np.zeros((len(symbols), 2 * k + 1))
            np.add.at(table, (place, part["slot"].to_numpy()), part["n"].to_numpy(float))
            best = np.empty(len(symbols), np.int32)
            for at in range(0, len(symbols), 256):
                some = table[at:at + 256]
                gain = gains(counts, classes[symbols[at:at + 256]], some[:, :k], some[:, k:2 * k], some[:, 2 * k])
                gain[:, 0] = -np.inf  # the end stays alone
                best[at:at + 256] = gain.argmax(axis=1)
            return pd.DataFrame({"symbol": symbols, "class": best})

        contexts = everything.where((F.col("symbol") != END) & (F.col("symbol") % _PARTS == turn % _PARTS))
        # At most as many rows as there are symbols, which is a parameter.
        moved = contexts.groupBy((F.col("symbol") % 64).alias("part")).applyInPandas(move, "symbol int, class int").toPandas()
        classes[moved["symbol"].to_numpy(np.int64)] = moved["class"].to_numpy(np.int32)
    return classes, counts


@dataclass
class Model:
    symbols: Symbols
    classes: np.ndarray
    n: int  # training tokens
    v: int  # distinct ones
    counts: np.ndarray  # of each symbol that is a word or the end, 0 for bundles
    step: np.ndarray  # log10 of class j behind class i
    total: np.ndarray  # tokens of each class, and the half for its unknown word
    unknown: np.ndarray  # log10 of the unknown word in its class
    discount: float

    @property
    def base(self) -> float:
        """Denominator of the comparison model."""
        return self.n + 0.5 * (self.v + 1)


def _transitions(counts: np.ndarray) -> np.ndarray:
    share = (counts.sum(axis=0) + 1) / (counts.sum() + len(counts))
    return np.log10((counts + _PRIOR * share) / (counts.sum(axis=1, keepdims=True) + _PRIOR))


def _frequent(vocabulary: DataFrame, most: int) -> pd.DataFrame:
    """The words that are seen most, at most ``most`` of them, by falling count.

    Words are cut off at a count: steps of a sixty-fourth of a power of two are counted
    first (some thousands at most), so that only the chosen words reach the driver.
    """
    often = vocabulary.where((F.col("n") >= OFTEN) & (F.octet_length("word") <= LONG)).withColumn(
        "step", F.floor(F.log2("n") * 64).cast("int")
    )
    steps = sorted((r["step"], r["count"]) for r in often.groupBy("step").count().collect())
    cut, room = (steps[-1][0] + 1 if steps else 0), most
    for step, count in reversed(steps):
        if count > room:
            break
        cut, room = step, room - count
    chosen = often.where(F.col("step") >= cut).select("word", "n").toPandas()
    return chosen.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


def train(
    texts: DataFrame, symbols: int = SYMBOLS, bundles: int = BUNDLES, classes: int = CLASSES, rounds: int = ROUNDS,
) -> tuple[Model, DataFrame]:
    """The model of ``texts`` (column ``text``) and the stored ``word, n`` of all its words.

    Without texts every class is as likely and every word unknown.
    """
    vocabulary = stored(word_counts(texts), "words")
    ends = texts.count()
    of = vocabulary.agg(
        F.count("*"), F.sum("n"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    ).first()
    top = _frequent(vocabulary, symbols)
    table = Symbols({w.encode(): i + 1 for i, w in enumerate(top["word"])}, bundles)
    own, counts = clustered(text_neighbours(texts, table), table.size, classes, rounds)
    # From the words seen once and twice; below 1 also where none was seen twice.
    discount = (of[2] + 0.5) / (of[2] + 2 * of[3] + 1)
    # Rare words and their number by class: a bundle's class is that of its words.
    shared = texts.sparkSession.sparkContext.broadcast((table, own))

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = shared.value
        sums = np.zeros(len(own), np.int64)
        for batch in batches:
            rare = [w for w in _bytes(batch.column(0)) if w not in table.words]
            np.add.at(sums, np.fromiter(map(table.bundle, rare), np.int64, len(rare)), 1)
        by = np.bincount(own, sums, classes).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes, dtype=np.int32)), pa.array(by)], ["class", "n"])

    rare = np.zeros(classes)
    for row in vocabulary.select("word").mapInArrow(kinds, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        rare[row["class"]] = row["n"]
    total = counts.sum(axis=0) + 0.5
    known = np.concatenate([[ends], top["n"].to_numpy(np.int64), np.zeros(bundles, np.int64)])
    return Model(
        table, own, int(of[1] or 0) + ends, int(of[0]) + (ends > 0), known, _transitions(counts), total,
        np.log10((discount * rare + 0.5) / total), discount,
    ), vocabulary


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **given) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from the rows that are not held out and scores all. NULL text counts
    as empty: it has the end as its one token. A NULL id is a training row; repeated rows
    count and are scored each; an empty table gives no rows. ``given`` goes to ``train``.
    """
    rows = picked(docs, id=id_col, text=text_col).select("id", held_out(F.col("id")).alias("held_out"), text_or_empty().alias("text"))
    model, vocabulary = train(rows.where("NOT held_out"), **given)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        first_bundle = 1 + len(m.symbols.words)
        by_class = np.log10(m.total)[m.classes]
        with np.errstate(divide="ignore"):
            emit = np.where(m.counts > 0, np.log10(np.maximum(m.counts, 1)) - by_class, 0.0)
        emit[END] = 0.0  # alone in its class
        emit[first_bundle:] = 0.0  # rare words follow by the join
        plain = np.log10((m.counts + 0.5) / m.base)
        plain[first_bundle:] = 0.0
        names = ["row", "id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "classes"]
        def scored(batch: pa.RecordBatch, texts: list[list[bytes]]) -> pa.RecordBatch:
            words = [w for text in texts for w in text]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
            first = np.cumsum(lengths) - lengths
            # Each text's words and its end; the end of one text also stands before the next.
            tokens, is_word = np.full(lengths.sum(), END), np.ones(lengths.sum(), bool)
            is_word[first + lengths - 1] = False
            tokens[is_word] = m.symbols.found(words)
            kinds = m.classes[tokens]
            rare = tokens >= first_bundle
            n_rare = np.add.reduceat(rare, first, dtype=np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_rare)]).astype(np.int32))
            step = m.step[np.roll(kinds, 1), kinds]
            return pa.RecordBatch.from_arrays([
                *(batch.column(i) for i in range(3)), pa.array(lengths),
                pa.array(lengths - n_rare - int(m.counts[END] == 0)),
                pa.array(np.add.reduceat(plain[tokens], first)), pa.array(np.add.reduceat(step + emit[tokens], first)),
                pa.ListArray.from_arrays(offsets, pa.array([words[i] for i in np.flatnonzero(rare[is_word]).tolist()], pa.string())),
                pa.ListArray.from_arrays(offsets, pa.array(kinds[rare].astype(np.int32))),
            ], names)

        for batch in batches:
            texts, begin, room = [], 0, 0
            for i, text in enumerate(_bytes(batch.column(3))):
                texts.append(words_of(text))
                room += len(texts[-1])
                if room >= _ENTRIES or i + 1 == len(batch):
                    yield scored(batch.slice(begin, len(texts)), texts)
                    texts, begin, room = [], i + 1, 0

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "held_out", "text")
    parts = stored(numbered.mapInArrow(
        run, f"row long, id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
        "rare array<string>, classes array<int>"
    ), "parts")
    at = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("class") + 1)
    tokens = parts.select("row", F.explode(F.arrays_zip("rare", "classes")).alias("t")).select(
        "row", F.col("t.rare").alias("word"), F.col("t.classes").alias("class")
    )
    met = tokens.join(vocabulary, "word", "left")
    n = F.coalesce("n", F.lit(0))
    sums = met.groupBy("row").agg(
        F.count("n").alias("more_known"), F.sum(F.log10((n + 0.5) / model.base)).alias("more_base"),
        F.sum(F.when(F.col("n").isNull(), at(model.unknown)).otherwise(
            F.log10(F.col("n") - F.lit(model.discount)) - at(np.log10(model.total))
        )).alias("more_score"),
    )
    more = lambda c: F.coalesce(c, F.lit(0))
    return parts.drop("rare", "classes").join(sums, "row", "left").select(
        "id", "held_out", "n_tokens", (F.col("n_known") + more("more_known")).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base_score") + more("more_base")).alias("base_score"), (F.col("score") + more("more_score")).alias("score"),
    )
