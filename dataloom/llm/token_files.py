"""Token ids in Arrow files of equal-length sequences.

Documents are encoded in ascending order of their ids, each closed by an end token, and
the stream of a range of ids is cut into sequences of one length. A range is one Arrow
IPC file: its record batches hold a fixed-size list of ids and one of mask bits (true:
a token; false: padding behind the last document of the file), not compressed, so that a
memory map gives sequence ``i`` without a copy or a search. A second Arrow file tells where
each document begins. Files are written by the tasks under names of their own attempt;
the manifest, a table that Spark commits, names those that count, so a lost or repeated
task leaves at most a file that nobody reads.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from dataloom.llm.common import picked, text_or_empty

# Ids of a sequence, and sequences of a record batch.
LENGTH = 2048
SEQUENCES = 256
# Pieces of text, and ids of them, that a task remembers.
MEMORY = 1_000_000
MEMORY_IDS = 16_000_000
# Texts, and bytes of them, that are encoded together, and pieces in one call.
_TEXTS, _BYTES, _PIECES = 4096, 8_000_000, 500

# A space between two characters that are no white space begins a new piece: whatever
# stands before it does not change the tokens behind it.
_CUT = re.compile(r" (?=\S)(?<=\S )")
# Fixed value: how the library cuts printable ASCII texts before the merges.
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+")
# Fixed value: how byte-level vocabularies write a space.
_SPACE = "Ġ"
# A piece that is empty or has white space at an end: not every space was such a one.
_ODD = "^$|^[\\s\\p{Z}\\x{85}\\x1c-\\x1f]|[\\s\\p{Z}\\x{85}\\x1c-\\x1f]$"


class TokenFiles(NamedTuple):
    """A written table: ``manifest`` has a row for each file (``part``, ``ids_path``,
    ``index_path``, ``n_documents``, ``n_tokens``, ``n_sequences``)."""

    manifest: DataFrame
    id_type: str


class Encoder:
    """The tokenizer of one task, with the ids of pieces it has met."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(vocabulary)
        # The strings of special tokens are ordinary text.
        self.model.encode_special_tokens = True
        tokens = self.model.get_vocab(with_added_tokens=True)
        self.spaces = np.zeros(max(tokens.values()) + 1, bool)
        self.spaces[[i for token, i in tokens.items() if token.startswith(_SPACE)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _learn(self, piece: str, ids: list[int]) -> None:
        self.known[piece] = len(self.known)
        self.ids.extend(ids)
        self.ends.append(len(self.ids))

    def _learn_all(self, new: list[str]) -> None:
        """Learn pieces by their words and signs, most of which have been met before."""
        parts = {p: _WORDS.findall(p) if p.isascii() and p.replace("\n", " ").isprintable() else [p] for p in new}
        self._learn_words([w for w in dict.fromkeys(w for ws in parts.values() for w in ws) if w not in self.known])
        for piece, words in parts.items():
            if len(words) != 1:
                ids = array("I")
                for word in words:
                    place = self.known[word]
                    ids += self.ids[self.ends[place]: self.ends[place + 1]]
                self._learn(piece, ids)

    def _learn_words(self, new: list[str]) -> None:
        # Words with one space, at the beginning, are encoded many at a time: of their
        # tokens just the first begins with a space.
        spaced = [p for p in new if p.rfind(" ") == 0 and len(p) > 1]
        other = [p for p in new if p.rfind(" ") != 0 or len(p) == 1]
        for piece, coded in zip(other, self.model.encode_batch_fast(other, add_special_tokens=False)):
            self._learn(piece, coded.ids)
        groups = [spaced[at: at + _PIECES] for at in range(0, len(spaced), _PIECES)]
        for group, coded in zip(groups, self.model.encode_batch_fast(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(coded.ids, np.uint32)
            starts = np.flatnonzero(self.spaces[ids])
            if len(starts) != len(group):
                raise ValueError("a token runs over two pieces")
            first = len(self.known)
            self.known.update(zip(group, range(first, first + len(group))))
            self.ends.extend((len(self.ids) + np.append(starts[1:], len(ids))).tolist())
            self.ids.frombytes(ids.tobytes())

    def _places(self, pieces: list[str]) -> np.ndarray:
        """Places of the pieces in the memory, which learns those it does not know."""
        if len(self.known) + len(pieces) > MEMORY or len(self.ids) > MEMORY_IDS:
            self._forget()
        new = list(dict.fromkeys(p for p in pieces if p not in self.known))
        if new:
            self._learn_all(new)
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of ids of each."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        cut = pc.split_pattern(texts, " ")
        pieces = cut.flatten().dictionary_encode()
        if pc.any(pc.match_substring_regex(pieces.dictionary, _ODD)).as_py():
            cut = pa.array([_CUT.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
            pieces = cut.flatten().dictionary_encode()
        words = pieces.dictionary.to_pylist()
        codes = pieces.indices.to_numpy()
        offsets = cut.offsets.to_numpy()
        firsts = offsets[:-1] - offsets[0]
        inner = np.ones(len(codes), bool)
        inner[firsts] = False
        wanted = np.zeros(len(words), bool)
        wanted[codes[inner]] = True
        wanted = np.flatnonzero(wanted)
        # Both kinds are looked up at once, so that the memory is not emptied between them.
        found = self._places([*(" " + words[w] for w in wanted), *(words[codes[f]] for f in firsts)])
        place_of = np.zeros(len(words), np.int64)
        place_of[wanted] = found[: len(wanted)]
        places = place_of[codes]
        places[firsts] = found[len(wanted):]
        ends = np.frombuffer(self.ends, np.int64)
        starts, sizes = ends[places], ends[places + 1] - ends[places]
        before = np.cumsum(sizes) - sizes
        at = np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))
        ids = np.frombuffer(self.ids, np.uint32)[at] if len(at) else np.empty(0, np.uint32)
        return ids, np.add.reduceat(sizes, firsts)


@lru_cache(maxsize=1)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a bounded number of texts and, but for single texts, of bytes."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    at, before = 0, 0
    while at < len(batch):
        to = max(at + 1, min(at + _TEXTS, int(np.searchsorted(ends, before + _BYTES, "right"))))
        yield batch.slice(at, to - at)
        at, before = to, int(ends[to - 1])


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; plain paths and ``file:`` are folders
    that all executors share."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class _FileWriter:
    """The two files of one task."""

    def __init__(self, folder: str, name: str, id_type: pa.DataType, width: np.dtype, length: int):
        self.width, self.length, self.size = width, length, length * SEQUENCES
        self.ids_path, self.index_path = f"{folder}/{name}.ids.arrow", f"{folder}/{name}.index.arrow"
        kind = pa.from_numpy_dtype(width)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.index_schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.system, _ = _place(folder)
        self.system.create_dir(_place(folder)[1])
        self.outputs = [self.system.open_output_stream(_place(p)[1]) for p in (self.ids_path, self.index_path)]
        self.files = [ipc.new_file(o, s) for o, s in zip(self.outputs, (self.schema, self.index_schema))]
        self.waiting, self.n_waiting = [], 0
        self.n_tokens = self.n_documents = self.n_sequences = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        starts = self.n_tokens + np.cumsum(sizes) - sizes
        index = [doc_ids, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())]
        self.files[1].write_batch(pa.RecordBatch.from_arrays(index, schema=self.index_schema))
        self.n_documents += len(sizes)
        self.n_tokens += len(ids)
        self.waiting.append(ids.astype(self.width))
        self.n_waiting += len(ids)
        if self.n_waiting >= self.size:
            stream = np.concatenate(self.waiting)
            whole = len(stream) // self.size * self.size
            for at in range(0, whole, self.size):
                self._write(stream[at: at + self.size], self.size)
            self.waiting, self.n_waiting = [stream[whole:].copy()], len(stream) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        columns = [pa.FixedSizeListArray.from_arrays(a, self.length) for a in (pa.array(ids), mask)]
        self.files[0].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.n_sequences += len(ids) // self.length

    def close(self) -> None:
        stream = np.concatenate(self.waiting) if self.waiting else np.empty(0, self.width)
        if len(stream):
            padding = np.zeros(-len(stream) % self.length, self.width)
            self._write(np.concatenate([stream, padding]), len(stream))
        for part in (*self.files, *self.outputs):
            part.close()


def write_tokens(
    docs: DataFrame, vocabulary: str, folder: str, end: int, length: int = LENGTH, id_col: str = "doc_id",
    text_col: str = "text",
) -> TokenFiles:
    """Encode every text of ``docs`` and write the files below ``folder``, which all
    executors share (a mounted folder, or an address that Arrow's file systems know).

    ``vocabulary`` is the path of the tokenizer's file, read on the driver and broadcast
    (its size is fixed); ``end`` is appended to each document. Ids take 16 bits where the
    vocabulary allows, else 32. The rows are sorted by id over range partitions, one file
    each; equal ids stand in the order of their texts' hashes and may spread over files.
    NULL and empty texts hold the end token alone; a NULL id comes first; repeated rows
    are all written; an empty table writes no file. Texts are never cut: a document may
    run over many sequences, and a sequence may hold many documents.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as source:
        model = source.read()
    highest = max(Tokenizer.from_str(model).get_vocab(with_added_tokens=True).values())
    width = np.dtype(np.uint16 if max(end, highest) < 1 << 16 else np.uint32)
    shared = spark.sparkContext.broadcast(model)
    rows = picked(docs, id=id_col, text=text_col).select("id", text_or_empty().alias("text"))
    numbered = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ordered = numbered.orderBy("id", "hash", "row").select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, task = _encoder(shared.value), None, TaskContext.get()
        part = task.partitionId()
        for batch in batches:
            for some in _parts(batch):
                if writer is None:
                    name = f"part-{part:06d}-{task.taskAttemptId()}"
                    writer = _FileWriter(folder, name, some.column(0).type, width, length)
                ids, sizes = encoder.encode(some.column(1))
                writer.add(some.column(0), np.insert(ids, np.cumsum(sizes), end), sizes + 1)
        if writer is not None:
            writer.close()
            row = [part, writer.ids_path, writer.index_path, writer.n_documents, writer.n_tokens, writer.n_sequences]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names)

    names = ["part", "ids_path", "index_path", "n_documents", "n_tokens", "n_sequences"]
    kinds = "part long, ids_path string, index_path string, n_documents long, n_tokens long, n_sequences long"
    ordered.mapInArrow(write, kinds).write.mode("errorifexists").parquet(f"{folder}/manifest")
    return TokenFiles(spark.read.schema(kinds).parquet(f"{folder}/manifest"), rows.schema["id"].dataType.simpleString())


class Sequences:
    """Random access to the sequences of one file: ``sequences[i]`` is the ids and the mask
    of sequence ``i``; the ids are a view of the mapped file."""

    def __init__(self, path: str):
        system, inner = _place(path)
        source = pa.memory_map(inner) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner)
        self.file = ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self._at, self._batch = -1, None

    def batch(self, number: int) -> pa.RecordBatch:
        if number != self._at:
            self._at, self._batch = number, self.file.get_batch(number)
        return self._batch

    def stream(self, number: int) -> np.ndarray:
        """All ids of a record batch, in their order."""
        return self.batch(number).column(0).flatten().to_numpy(zero_copy_only=True)

    def __len__(self) -> int:
        batches = self.file.num_record_batches
        return (batches - 1) * SEQUENCES + len(self.batch(batches - 1)) if batches else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        at = i % SEQUENCES * self.length
        mask = self.batch(i // SEQUENCES).column(1).slice(i % SEQUENCES, 1).flatten()
        return self.stream(i // SEQUENCES)[at: at + self.length], mask.to_numpy(zero_copy_only=False)

    def span(self, start: int, size: int) -> Iterator[np.ndarray]:
        """The ids ``start`` to ``start + size`` of the file's stream, batch by batch."""
        room = self.length * SEQUENCES
        while size > 0:
            inside = start % room
            taken = min(size, room - inside)
            yield self.stream(start // room)[inside: inside + taken]
            start, size = start + taken, size - taken


def read_documents(files: TokenFiles, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document, read from the files; ``start``
    counts the ids of all documents before it. With ``ids=False`` the CRC-32 of the ids
    as little-endian unsigned 32-bit integers (``ids_crc32``) instead. One task reads a
    file, a batch at a time."""
    manifest = files.manifest
    n_files = max(1, manifest.count())
    # One row for each file.
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    work = manifest.withColumn("before", before).select("part", "ids_path", "index_path", "before")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sequences = Sequences(row["ids_path"])
                system, inner = _place(row["index_path"])
                with system.open_input_file(inner) as source:
                    index = ipc.open_file(source)
                    for number in range(index.num_record_batches):
                        part = index.get_batch(number)
                        starts, sizes = part.column(1).to_pylist(), part.column(2).to_pylist()
                        step = 64 if ids else len(part)
                        for at in range(0, len(part), step):
                            spans = [sequences.span(s, n) for s, n in zip(starts[at: at + step], sizes[at: at + step])]
                            if ids:
                                found = pa.array([np.concatenate([*s]).astype(np.int32) for s in spans], pa.list_(pa.int32()))
                            else:
                                found = pa.array(map(_crc, spans), pa.int64())
                            some = part.slice(at, step)
                            begin = pc.add(some.column(1), row["before"])
                            yield pa.RecordBatch.from_arrays([some.column(0), begin, some.column(2), found], names)

    names = ["doc_id", "start", "n_tokens", "ids" if ids else "ids_crc32"]
    kinds = f"doc_id {files.id_type}, start long, n_tokens long, " + ("ids array<int>" if ids else "ids_crc32 long")
    return work.repartitionByRange(n_files, "part").mapInArrow(read, kinds)


def _crc(spans: Iterator[np.ndarray]) -> int:
    crc = 0
    for ids in spans:
        crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
    return crc
