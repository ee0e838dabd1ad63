"""Byte-level BPE through a SentencePiece model made from a rank file.

Every token of the vocabulary becomes a piece: its bytes are written as one printable
character each, its score is the negative rank, so that SentencePiece joins the pair of
lowest rank first, the leftmost of equals, as byte-level BPE does. The model changes
nothing in a text (identity normaliser, no dummy prefix, no white-space marks). Texts are
cut by the vocabulary's pattern; a piece of text that is itself a token is that token,
all others go through the model. Decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from dataloom.llm.common import picked, text_or_empty

# Pieces of text whose ids a task remembers.
MEMORY = 200_000
# Longest piece of text (in characters) that is remembered.
_SHORT = 40


def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable, else above U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    moved = {b: 0x100 + i for i, b in enumerate(others)}
    return [chr(moved.get(b, b)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank: lines of a base64 token and its rank. The file
    belongs to an installed package and is read on the driver only."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [rank for rank, _ in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    return [token for _, token in tokens]


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised model: piece ``i`` is token ``i``; one unknown piece stands behind."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    letters = byte_characters()
    model = proto.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(letters[b] for b in token), score=-float(rank))
    model.pieces.add(piece="<unk>", score=0.0, type=proto.ModelProto.SentencePiece.UNKNOWN)
    trainer, normaliser = model.trainer_spec, model.normalizer_spec
    trainer.model_type, trainer.vocab_size = proto.TrainerSpec.BPE, len(model.pieces)
    trainer.unk_id, trainer.bos_id, trainer.eos_id, trainer.pad_id = len(tokens), -1, -1, -1
    normaliser.name, normaliser.precompiled_charsmap = "identity", b""
    normaliser.add_dummy_prefix = normaliser.remove_extra_whitespaces = False
    normaliser.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, tokens: list[bytes], model: bytes, pattern: str):
        self.tokens, self.pattern = tokens, regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.rank = {token: i for i, token in enumerate(tokens)}
        self.letters = str.maketrans(dict(enumerate(byte_characters())))
        self.known: dict[str, list[int]] = {}

    def _ids(self, piece: str) -> list[int]:
        raw = piece.encode()
        if (whole := self.rank.get(raw)) is not None:
            return [whole]
        return self.model.encode(raw.decode("latin-1").translate(self.letters), out_type=int)

    def encode(self, text: str) -> np.ndarray:
        ids: list[int] = []
        known = self.known
        for match in self.pattern.finditer(text):
            piece = match.group()
            found = known.get(piece)
            if found is None:
                found = self._ids(piece)
                if len(piece) <= _SHORT:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[piece] = found
            ids += found
        return np.array(ids, dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def _codec(model: bytes, pattern: str, tokens: tuple[bytes, ...]) -> Codec:
    return Codec(list(tokens), model, pattern)


def encode_decode(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True
) -> DataFrame:
    """``id, n_tokens, ids, decoded`` of every row of ``docs``; with ``ids=False`` the
    SHA-256 of both (``ids_sha256``: little-endian unsigned 32-bit integers) instead.

    ``vocabulary`` is the path of the rank file, ``pattern`` cuts texts before the merges.
    NULL and empty texts have no tokens and decode to the empty text; a NULL id and
    repeated rows keep their rows; an empty table gives none. Special tokens are ordinary
    text. The vocabulary's size is fixed, so it is broadcast.
    """
    rows = picked(docs, id=id_col, text=text_col).select("id", text_or_empty().alias("text"))
    tokens = tuple(read_ranks(vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast((model_bytes(list(tokens)), pattern, tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(*shared.value)
        for batch in batches:
            # Few rows at a time, as ids take more memory than text.
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                coded = [codec.encode(t.as_py()) for t in part.column(1)]
                lengths = pa.array([len(c) for c in coded], pa.int64())
                plain = [codec.decode(c) for c in coded]
                if ids:
                    found = pa.array([c.astype(np.int32) for c in coded], pa.list_(pa.int32()))
                    back = pa.array([p.decode("utf-8") for p in plain], pa.string())
                else:
                    found = pa.array([hashlib.sha256(c.tobytes()).hexdigest() for c in coded], pa.string())
                    back = pa.array([hashlib.sha256(p).hexdigest() for p in plain], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), lengths, found, back], names)

    names = ["id", "n_tokens", *(["ids", "decoded"] if ids else ["ids_sha256", "decoded_sha256"])]
    kinds = [rows.schema["id"].dataType.simpleString(), "long", *(["array<int>", "string"] if ids else ["string", "string"])]
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
