"""Line deduplication by MinHash over character shingles.

Lines are compared without case (A-Z) and with white space made single. A line's MinHash
values are cut into bands; lines that agree in a band share a bucket. Members of a bucket
whose parity maps allow it are compared by the exact Jaccard similarity of their shingle
sets, links are joined by a distributed union-find, and of every component the first line
stays.

With 12 bands of 3 values two lines of similarity 0.8 share a bucket with probability
1 - (1 - 0.8 ** 3) ** 12 = 0.9998; shingles of 9 characters keep unrelated lines apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from dataloom.llm.buckets import linked
from dataloom.llm.common import by_place, picked, place, text_or_empty
from dataloom.plans.shared import stored

SHINGLE = 9
BANDS = 12
VALUES = 3
SIMILARITY = 0.8
# Bits of the filter that leaves out lines which are no candidates: 8 MB, whatever the input.
_FILTER_BITS = 26
# Lines that one task remembers, so as not to sign a repeated line again.
_MEMORY = 200_000
# Bits of a line's parity map: the longest lines still tell apart in them.
MAP_BITS = 1 << 10
# Bits of a character in a shingle that is told by its characters.
_PACKED_BITS = 7
# Characters of a pair that is told alone, so that long near copies need no arrays.
_LONG = 1 << 17
# Characters signed at once.
_AT_ONCE = 1 << 17
# Buckets that a task packs at once.
_PACKED = 1_200_000
_FLIP, _ODD = np.random.default_rng(20240229).integers(0, 1 << 32, (2, BANDS * VALUES), dtype=np.uint32) | np.array([[0], [1]], np.uint32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Characters of a text that are searched in the time in which one more shingle is cut out.
_SEARCHED = 1_000
# White space other than spaces and line ends.
_OTHER_SPACE = b"\t", b"\x0b", b"\x0c", b"\r"


def plain_lines(text: str | bytes) -> list[bytes]:
    """The lines of a text in the form in which they are compared."""
    text = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    lines = text.lower().split(b"\n")
    if b"  " in text or any(space in text for space in _OTHER_SPACE):
        return [b" ".join(line.split()) for line in lines]
    return [line.strip(b" ") for line in lines]


def _bytes(column: pa.Array) -> Iterator[bytes]:
    """Texts as their UTF-8 bytes, some at a time."""
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).cast(pa.binary()).to_pylist()


def plain_line(line: str) -> str:
    return plain_lines(line)[0].decode("utf-8", "surrogatepass")


def line_key(line: bytes) -> int:
    """64-bit identity of a compared line, as a signed long."""
    return xxhash.xxh64_intdigest(line, 42) - (1 << 63)


def shingles(line: str, size: int = SHINGLE) -> set[str]:
    """The character shingles; a shorter line is its own one."""
    return {line[i:i + size] for i in range(max(1, len(line) - size + 1))}


def similarity(left: set[str], right: set[str]) -> float:
    both = len(left & right)
    return both / (len(left) + len(right) - both)


def _alike(left: str, right: str) -> int:
    """How many characters two texts have in common at their beginnings."""
    low, high = 0, min(len(left), len(right))
    while low < high:
        middle = (low + high + 1) // 2
        if left[low:middle] == right[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _unlike(line: str, other: str, begin: int, end: int, size: int) -> int:
    """The distinct shingles of ``line`` that ``other`` does not hold. Its first ``begin``
    and its last ``end`` characters, which do not meet, are those of ``other`` too."""
    # A shingle that lies in one of both stretches is a shingle of the other line.
    last = len(line) - max(end, size - 1)
    parts = {line[i:i + size] for i in range(max(0, begin - size + 1), last)}
    if len(parts) * (len(other) + 200) < _SEARCHED * len(other):
        return sum(part not in other for part in parts)
    return len(parts - shingles(other, size))


def near_lines(left: str, right: str, n: int, size: int = SHINGLE, least: float = SIMILARITY) -> bool:
    """Whether the exact similarity of two lines is ``least`` or more. ``n`` is a number of
    shingles that the left one is known to have, fewer perhaps than it has."""
    shorter, longer = sorted((len(left), len(right)))
    begin = _alike(left, right)
    end = min(_alike(left[::-1], right[::-1]), shorter - begin)
    if shorter < size or 3 * (longer - begin - end) > shorter:
        return similarity(shingles(left, size), shingles(right, size)) >= least
    only_left, only_right = _unlike(left, right, begin, end, size), _unlike(right, left, begin, end, size)

    def near(n: int) -> bool:
        return (n - only_left) / (n + only_right) >= least

    # The similarity grows with the number of shingles, which lies between these two.
    if near(max(n, 1)):
        return True
    return near(len(left) - size + 1) and near(len(shingles(left, size)))


def _mixed(x: np.ndarray) -> np.ndarray:
    out = x >> np.uint64(31)
    out ^= x
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def _rolled(codes: np.ndarray, size: int, step: int = int(_STEP)) -> np.ndarray:
    """The polynomial of every window, put together from those of windows half as wide."""
    out, wide = codes, 1
    for bit in bin(size)[3:]:
        left = out[:-wide] * np.uint64(pow(step, wide, 1 << 64))
        left += out[wide:]
        out, wide = left, 2 * wide
        if bit == "1":
            left = out[:-1] * np.uint64(step)
            left += codes[wide:]
            out, wide = left, wide + 1
    return out


def _near_packed(lines: list[str], letters: set[str], size: int, least: float) -> np.ndarray:
    """Of every two lines in turn, whether their exact similarity is ``least`` or more.

    A shingle is its characters, seven bits each, so that none is taken for another, and one
    more bit that tells the two lines apart; sorted, the shingles of both stand side by side.
    """
    one, text = np.uint64(1), "".join(lines)
    if letters:
        place = np.zeros(0x110000, np.uint8)
        place[np.frombuffer("".join(letters).encode("utf-32-le"), np.uint32)] = np.arange(len(letters))
        codes = place[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    else:
        codes = np.frombuffer(text.encode(), np.uint8)
    shingle = _rolled(codes.astype(np.uint64), size, 1 << _PACKED_BITS)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines)).reshape(-1, 2)
    begins = np.cumsum(lengths).reshape(-1, 2) - lengths
    ends = begins + lengths - size + 1
    # Windows that reach into the other line become one more copy of the first one.
    shingle[ends[:, :1] + np.arange(size - 1)] = shingle[begins[:, :1]]
    shingle <<= one
    for (left, right), (_, end) in zip(begins.tolist(), ends.tolist()):
        shingle[right:end] |= one
        shingle[left:end].sort()
    turned = shingle[1:] ^ shingle[:-1]
    bounds = np.stack([begins[:, 0], ends[:, 1] - 1], axis=1).ravel()[:-1]
    both = np.add.reduceat(turned == one, bounds, dtype=np.int64)[::2]
    held = np.add.reduceat(turned != 0, bounds, dtype=np.int64)[::2] + 1
    return both / (held - both) >= least


def near_pairs(lefts: list[str], rights: list[str], n: list[int], size: int = SHINGLE, least: float = SIMILARITY) -> np.ndarray:
    """``near_lines`` of many pairs, those together that are not long and whose shingles
    fit into 63 bits."""
    near = np.zeros(len(n), bool)
    # Pairs of ASCII lines need no letters; others share an alphabet of their own.
    groups = {True: ([], [], set()), False: ([], [], set())}

    def flush(ascii: bool):
        at, lines, letters = groups[ascii]
        if at:
            near[at] = _near_packed(lines, letters, size, least)
        groups[ascii] = [], [], set()

    room = {True: 0, False: 0}
    for i, (left, right) in enumerate(zip(lefts, rights)):
        ascii, both = left.isascii() and right.isascii(), len(left) + len(right)
        letters = set() if ascii else {*left, *right}
        if size * _PACKED_BITS > 63 or min(len(left), len(right)) < size or both > _LONG or len(letters) > 1 << _PACKED_BITS:
            near[i] = near_lines(left, right, n[i], size, least)
            continue
        if room[ascii] >= _AT_ONCE or len(letters | groups[ascii][2]) > 1 << _PACKED_BITS:
            flush(ascii)
            room[ascii] = 0
        at, lines, alphabet = groups[ascii]
        at.append(i)
        lines += left, right
        alphabet |= letters
        room[ascii] += both
    flush(True)
    flush(False)
    return near


def _windows(lines: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all windows over the lines, where each line's begin, and their numbers.
    Windows that reach into the next line stand between those of two lines."""
    text = b"\n".join(lines)
    if text.isascii():
        codes = np.frombuffer(text, np.uint8).astype(np.uint64)
    else:
        text = text.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(text, np.uint32).astype(np.uint64)
    ends = np.append(np.flatnonzero(codes == 10), len(codes))
    lengths = np.diff(ends, prepend=-1) - 1
    wide = np.maximum(lengths, size)
    if (lengths < size).any():
        # A line shorter than a shingle is filled up, with a character that texts do not hold.
        codes = np.insert(codes, np.repeat(ends, wide - lengths), 0x110000)
    begins = np.cumsum(wide + 1) - (wide + 1)
    return _mixed(_rolled(codes, size)), begins, wide - size + 1


def _distinct(lines: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each line's distinct shingles, line after line, and their numbers."""
    hashes, begins, windows = _windows(lines, size)
    # Sorted, a line's repeated shingles stand together.
    for begin, end in zip(begins.tolist(), (begins + windows).tolist()):
        hashes[begin:end].sort()
    before = np.cumsum(windows) - windows
    hashes = hashes[np.repeat(begins - before, windows) + np.arange(windows.sum())]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[before] = True
    return hashes[new], np.add.reduceat(new, before, dtype=np.int64)


def sketches(lines: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Of every line: the number of its shingles; and their parity map (lines, 16), in
    which each shingle turns over one of 1024 bits. Two maps differ in at most as many bits
    as the sets differ in shingles."""
    all_of, counts = _distinct(lines, size)
    bits = np.repeat(np.arange(len(lines)) * MAP_BITS, counts) + (all_of >> np.uint64(54)).astype(np.int64)
    odd = np.bincount(bits, minlength=len(lines) * MAP_BITS).astype(np.uint8) & 1
    return counts, np.packbits(odd).reshape(-1, MAP_BITS // 8).view(np.int64)


def _buckets(lines: list[bytes], size: int) -> np.ndarray:
    # A repeated shingle does not change the smallest value.
    hashes, begins, windows = _windows(lines, size)
    low = hashes.astype(np.uint32)
    # Every other stretch lies between two lines.
    bounds = np.stack([begins, begins + windows], axis=1).ravel()[:-1]
    turned, out = np.empty_like(low), np.empty((len(lines), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(lines), band + 1, np.uint64) * _STEP
        for i in range(band * VALUES, (band + 1) * VALUES):
            np.bitwise_xor(low, _FLIP[i], out=turned)
            np.multiply(turned, _ODD[i], out=turned)
            key = _mixed((key ^ np.minimum.reduceat(turned, bounds)[::2]) * _STEP)
        out[:, band] = key
    return out.view(np.int64)


def signatures(lines: list[str], size: int = SHINGLE) -> np.ndarray:
    """Buckets of every line: (lines, BANDS) signed longs."""
    return _buckets([line.encode("utf-8", "surrogatepass") for line in lines], size)


def signed(lines: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every line: its buckets, the number of its shingles and their parity map."""
    return _buckets(lines, size), *sketches(lines, size)


def may_be_near(left: Column, right: Column, least: float) -> Column:
    """Whether two sketches allow the similarity: sets of a and b shingles that are so
    near differ in at most (a + b) * (1 - least) / (1 + least) of them."""
    differing = reduce(Column.__add__, [
        F.bit_count(F.get(left["parity"], F.lit(i)).bitwiseXOR(F.get(right["parity"], F.lit(i)))) for i in range(MAP_BITS // 64)
    ])
    allowed = (left["n"] + right["n"]) * ((1 - least) / (1 + least)) + 1e-9
    return (F.abs(left["n"] - right["n"]) <= allowed) & (differing <= allowed)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty()
    return picked(docs, id=id_col, text=text_col).select("id", F.xxhash64(text).alias("mark"), text.alias("text"))


def _lists(table: np.ndarray, there: np.ndarray) -> pa.Array:
    """The rows of the table, one where ``there``, NULL elsewhere."""
    offsets = np.concatenate([[0], np.cumsum(np.where(there, table.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ravel()), mask=pa.array(~there))


def _signed(rows: DataFrame, size: int) -> DataFrame:
    """``id, mark, line, n_lines, node, buckets``: every line, those that are blank without
    a node; the number of lines with the first one; a line's buckets, packed, only where a
    task meets the line for the first time."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at, numbers, many, nodes, first, fresh, room = [], [], [], [], [], [], 0

            def flush():
                packs = [None] * len(at)
                if fresh:
                    packed, wide = _buckets(fresh, size).tobytes(), 8 * BANDS
                    for i, place in enumerate(first):
                        packs[place] = packed[i * wide:(i + 1) * wide]
                take = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([
                    batch.column(0).take(take), batch.column(1).take(take), pa.array(numbers, pa.int32()),
                    pa.array(many, pa.int32()), pa.array(nodes, pa.int64()), pa.array(packs, pa.binary()),
                ], ["id", "mark", "line", "n_lines", "node", "buckets"])

            for i, text in enumerate(_bytes(batch.column(2))):
                lines = plain_lines(text)
                for number, line in enumerate(lines):
                    key = line_key(line) if line else None
                    if line and key not in seen:
                        if len(seen) >= _MEMORY:
                            seen.clear()
                        seen.add(key)
                        first.append(len(at))
                        fresh.append(line)
                        room += len(line)
                    at.append(i), numbers.append(number), nodes.append(key), many.append(None if number else len(lines))
                    if room >= _AT_ONCE or len(at) >= 20_000:
                        yield flush()
                        at, numbers, many, nodes, first, fresh, room = [], [], [], [], [], [], 0
            if at:
                yield flush()

    return rows.mapInArrow(run, f"id {kind}, mark long, line int, n_lines int, node long, buckets binary")


def _members(signed_lines: DataFrame) -> DataFrame:
    """``bucket, node`` of the buckets with more than one node, a stored table; rows may repeat.

    Most buckets have one node, so buckets and nodes are moved as packed arrays, dealt by
    bucket, and only those of shared buckets become rows. A task remembers each of its
    buckets once, however many nodes it has.
    """
    parts = min(1 << 14, 4 * int(signed_lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room = [], 0

        def rows():
            buckets, nodes = (np.concatenate([h[i] for h in held]) for i in range(2))
            held.clear()
            part = ((buckets.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            cut = [0, *np.cumsum(np.bincount(part, minlength=parts)).tolist()]
            for at in range(0, parts, some := max(1, parts // 8)):
                there = [i for i in range(at, min(parts, at + some)) if cut[i] < cut[i + 1]]
                packs = [[v[order[cut[i]:cut[i + 1]]].tobytes() for i in there] for v in (buckets, nodes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(there, pa.int32()), *(pa.array(p, pa.binary()) for p in packs)], ["part", "buckets", "nodes"]
                )

        for batch in batches:
            if len(batch):
                held.append((
                    np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64),
                    np.repeat(batch.column(1).to_numpy(zero_copy_only=False), BANDS),
                ))
                room += len(batch) * BANDS
            if room >= _PACKED:
                yield from rows()
                room = 0
        if held:
            yield from rows()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of every bucket one node, and whether it has been passed on.
        known = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        held, room = [], 0

        def found():
            nonlocal known, held, room
            buckets, nodes = (np.concatenate([known[i], *(h[i] for h in held)]) for i in range(2))
            done = np.concatenate([known[2], np.zeros(room, bool)])
            held, room = [], 0
            order = np.lexsort((~done, nodes, buckets))
            buckets, nodes, done = buckets[order], nodes[order], done[order]
            begins = np.ones(len(buckets), bool)
            begins[1:] = buckets[1:] != buckets[:-1]
            new = begins.copy()
            new[1:] |= nodes[1:] != nodes[:-1]
            buckets, nodes, done, begins = buckets[new], nodes[new], done[new], begins[new]
            first = np.flatnonzero(begins)
            many = np.diff(first, append=len(buckets)) > 1
            out = np.flatnonzero(np.repeat(many, np.diff(first, append=len(buckets))) & ~done)
            known = buckets[first], nodes[first], many | done[first]
            for at in range(0, len(out), 50_000):
                some = out[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(buckets[some]), pa.array(nodes[some])], ["bucket", "node"])

        for batch in batches:
            for row in zip(*batch.columns[1:]):
                held.append([np.frombuffer(v.as_buffer(), np.int64) for v in row])
                room += len(held[-1][0])
                if room >= _PACKED:
                    yield from found()
        if held:
            yield from found()

    packs = signed_lines.where("buckets IS NOT NULL").select("buckets", "node").mapInArrow(
        deal, "part int, buckets binary, nodes binary"
    )
    return stored(packs.repartition("part").mapInArrow(shared, "bucket long, node long"), "members")


def _bit(node: np.ndarray) -> np.ndarray:
    return _mixed(node.view(np.uint64) * _STEP) >> np.uint64(64 - _FILTER_BITS)


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the wanted nodes (``node``, each once).

    A bit filter of fixed size goes to the tasks that read the documents; only lines that
    pass it are shuffled, and an exact join then leaves the wanted ones.
    """
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = _bit(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([
                pa.array((spot >> np.uint64(6)).astype(np.int64)),
                pa.array((np.uint64(1) << (spot & np.uint64(63))).view(np.int64)),
            ], ["word", "bits"])

    words = wanted.select("node").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(1 << (_FILTER_BITS - 6), np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, seen = shared.value, set()
        for batch in batches:
            nodes, texts = [], []
            for text in _bytes(batch.column(0)):
                for line in plain_lines(text):
                    if line:
                        key = line_key(line)
                        if key not in seen:
                            if len(seen) >= _MEMORY:
                                seen.clear()
                            seen.add(key)
                            nodes.append(key)
                            texts.append(line)
            if nodes:
                spot = _bit(np.array(nodes, np.int64))
                hit = np.flatnonzero((filled[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[i] for i in hit], pa.int64()), pa.array([texts[i] for i in hit], pa.string())], ["node", "text"]
                )

    lines = rows.select("text").mapInArrow(found, "node long, text string")
    return lines.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def _sketched(texts: DataFrame, size: int) -> DataFrame:
    """``node, text, n, parity`` of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                n, parity = sketches([t.as_py().encode("utf-8", "surrogatepass") for t in part.column(1)], size)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int32()), _lists(parity, np.ones(len(part), bool))],
                    ["node", "text", "n", "parity"],
                )

    return texts.select("node", "text").mapInArrow(run, "node long, text string, n int, parity array<long>")


def _preparer(rows: DataFrame, size: int, least: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [np.zeros(0, bool)]
            for at in range(0, len(batch), 256):
                left, right, n = batch.slice(at, 256).columns[2:]
                keep.append(near_pairs(left.to_pylist(), right.to_pylist(), n.to_pylist(), size, least))
            yield batch.select([0, 1]).filter(pa.array(np.concatenate(keep)))

    def prepared(nodes: DataFrame):
        texts = stored(_sketched(_texts(rows, nodes), size), "texts")
        of_a = texts.select(F.col("node").alias("a"), F.col("text").alias("left"), "n")
        of_b = texts.select(F.col("node").alias("b"), F.col("text").alias("right"))

        def verified(pairs: DataFrame) -> DataFrame:
            return pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "left", "right", "n").mapInArrow(check, "a long, b long")

        return texts.select("node", F.struct("n", "parity").alias("sketch")), verified

    return prepared


def kept_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = SIMILARITY,
) -> DataFrame:
    """``id, mark, n_lines, kept`` of every document: the numbers (from 0) of lines that stay.

    Of lines connected by similarity ``least`` or more, the first by id and number stays.
    Blank lines always stay. NULL text counts as empty (one blank line); a NULL id comes
    after all others; rows that repeat id and text are one document; an empty table gives
    no rows.
    """
    rows = _rows(docs, id_col, text_col)
    lines = stored(_signed(rows, size), "lines")
    roots = linked(_members(lines), partial(may_be_near, least=least), _preparer(rows, size, least))
    rooted = lines.where("node IS NOT NULL").select("id", "mark", "line", "node").join(roots, "node", "left")
    stays = rooted.groupBy(F.coalesce("root", "node").alias("root")).agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark", "line")).alias("first")
    ).select("first.id", "first.mark", "first.line", F.lit(None).cast("int").alias("n_lines"))
    blank = lines.where("node IS NULL").select("id", "mark", "line", F.lit(None).cast("int")).distinct()
    whole = lines.where("line = 0").select("id", "mark", F.lit(None).cast("int"), "n_lines")
    # A document's lists are as long as its lines.
    return stays.unionAll(blank).unionAll(whole).groupBy("id", "mark").agg(
        F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_list("line")).alias("kept")
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = SIMILARITY,
) -> DataFrame:
    """``docs`` with all columns; the text holds only the lines that stay."""
    found = stored(kept_lines(docs, id_col, text_col, size, least), "kept")
    placed, names = by_place(docs), [f"c{i}" for i in range(len(docs.columns))]
    id_at, text_at = place(docs, id_col), place(docs, text_col)
    text = text_or_empty(F.col(text_at))
    on = placed[id_at].eqNullSafe(found["id"]) & (F.xxhash64(text) == found["mark"])
    parts = F.transform("kept", lambda i: F.element_at(F.split(text, "\n", -1), i + 1))
    cut = F.when(F.col(text_at).isNull(), F.col(text_at)).otherwise(F.array_join(parts, "\n"))
    joined = placed.join(found, on)
    return joined.select(*[cut.alias(n) if n == text_at else F.col(n) for n in names]).toDF(*docs.columns)
