"""Byte-level BPE through a sentencepiece model written from the vocabulary.

The rank file lists byte strings with their merge rank.  Each byte is shown as
one printable character (the usual byte-level alphabet), each vocabulary entry
as the string of its bytes' characters, and the entries become the pieces of a
sentencepiece BPE model: id = rank, score = -rank, identity normalisation, no
dummy prefix, no white-space handling.  The model's protocol buffer is written
out here directly; nothing is trained.  sentencepiece then merges the adjacent
pair with the highest score, which is the pair with the lowest rank.

Texts are cut by the tokenizer's pattern first and every match (pre-token) is
encoded by itself.  Decoding maps ids to pieces, characters and bytes.

Defined cases: a null or empty text has no ids and decodes to no bytes; every
row gets its own result, repeated rows and null ids included; texts of any length
are encoded whole; columns other than ``doc_id`` and ``text`` are not read, so
their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import importable

#: Pre-tokens remembered per worker, and the longest that is remembered.
CACHE, LONGEST = 400_000, 64
CHUNK = 1_000_000
NORMAL, UNKNOWN, BPE_MODEL = 1, 2, 2


def byte_alphabet() -> dict[int, str]:
    """A printable character for each byte: itself where printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


TO_CHAR = byte_alphabet()
TO_BYTE = {ord(c): b for b, c in TO_CHAR.items()}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _piece(text: str, score: float, kind: int) -> bytes:
    return _block(1, _block(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))


def read_ranks(path: str) -> list[bytes]:
    """Vocabulary entries by rank."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(entry) for entry, rank in map(bytes.split, f)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def model_of(entries: list[bytes]) -> bytes:
    """Serialised sentencepiece model: the entries by rank, then the unknown piece."""
    pieces = b"".join(_piece("".join(TO_CHAR[b] for b in e), -float(rank), NORMAL) for rank, e in enumerate(entries))
    n = len(entries)
    none = (1 << 64) - 1  # -1: there is no such piece
    trainer = (_number(3, BPE_MODEL) + _number(4, n + 1) + _number(40, n)
               + _number(41, none) + _number(42, none) + _number(43, none))
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return pieces + _piece("<unk>", 0.0, UNKNOWN) + _block(2, trainer) + _block(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary and pattern."""

    def __init__(self, model: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        self.bytes = [self.pieces.id_to_piece(i).translate(TO_BYTE).encode("latin-1")
                      for i in range(self.pieces.get_piece_size() - 1)]
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def ids(self, tokens: list[str]) -> list[list[int]]:
        shown = [t.encode().decode("latin-1").translate(TO_CHAR) for t in tokens]
        return self.pieces.encode(shown, out_type=int, num_threads=1)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def parts(self, tokens: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """For each pre-token its ids as text, their number and the bytes they decode to."""
        known = self.known
        new = [t for t in tokens if t not in known]
        made = {t: (" ".join(map(str, i)), len(i), self.decode(i)) for t, i in zip(new, self.ids(new), strict=True)}
        if len(known) + len(made) > CACHE or any(len(t) > LONGEST for t in new):
            made |= {t: known[t] for t in tokens if t in known}
            self.known = {} if len(known) + len(made) > CACHE else known
            return made
        known.update(made)
        return known

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.ids(self.pattern.findall(text)) for i in ids]

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, hash of the ids and hash of the decoded bytes of each text.

        New pre-tokens of about ``CHUNK`` characters are encoded in one call.
        """
        at = 0
        while at < len(texts):
            begin, size = at, 0
            while at < len(texts) and (size < CHUNK or at == begin):
                size += len(texts[at])
                at += 1
            cut = [self.pattern.findall(t) for t in texts[begin:at]]
            parts = self.parts(set().union(*cut))
            for tokens in cut:
                found = [parts[t] for t in tokens]
                ids = " ".join([p[0] for p in found]).encode()
                back = b"".join([p[2] for p in found])
                yield sum([p[1] for p in found]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()


@lru_cache(maxsize=2)
def codec(model: bytes, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(model, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` of every document row."""
    importable(docs.sparkSession)
    model = model_of(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = codec(model, pattern)
            ids = pa.array((made.encode(t.as_py() or "") for t in batch.column(1)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``(doc_id, text)`` of every row of :func:`encode`; bytes that are not UTF-8 become U+FFFD."""
    importable(encoded.sparkSession)
    model = model_of(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = codec(model, pattern)
            texts = pa.array((made.decode(ids.as_py() or []).decode("utf-8", "replace") for ids in batch.column(1)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every document row."""
    importable(docs.sparkSession)
    model = model_of(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = codec(model, pattern)
            rows = list(made.digests([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
