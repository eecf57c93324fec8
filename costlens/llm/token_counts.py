"""Token counts of whole texts, by a public tokenizer file, in Arrow batches.

The tasks encode with the library the file belongs to (``.json``: tokenizers,
``.model``: sentencepiece) and return lengths only; no id leaves a worker and
nothing is shuffled.

* A text is split into pieces at every safe boundary, one longer than ``LONG``
  characters by and by, so that memory does not follow the longest text.
  A boundary is safe where the library cuts by itself: no pre-token, added
  token or merge spans it.  A stretch without one stays whole.
* Equal pieces are encoded once; a worker remembers up to ``CACHE`` of them.
* New pieces of all rows are packed into calls of about ``BATCH_BYTES`` bytes
  each, whatever the number of rows, so that calls cost alike.  Byte-level
  pieces that meet at a safe boundary in any order are joined to texts of about
  ``LONG`` characters, which saves the library's cost per text; the byte
  lengths of the ids tell which tokens belong to which piece.

Safe boundaries: with byte-level pre-tokens (``ByteLevel`` with its own
pattern) the places between an ASCII letter or digit and a space, line feed or
one of ``.,;:!?``, between one of these marks and a space or line feed, and
between a Han or Kana character and CJK punctuation; the pattern never matches
across these.  With sentencepiece the single space between two ASCII letters or
digits, which the second piece's dummy prefix stands for, if no entry of the
vocabulary goes on after an inner word start.  Any other tokenizer gets every
text whole.

Defined cases: a null or empty text has no bytes and no tokens; every row gets
its own result, repeated rows and null ids included; special strings inside a
text are what the library makes of them by default; columns other than
``doc_id`` and ``text`` are not read, so their names cannot clash; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter as Tally
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .scratch import importable

#: Characters of a text that are split at once and of joined pieces; bytes of one call of the library.
LONG, BATCH_BYTES = 4_096, 1 << 17
#: Calls whose texts are held as Python strings at once.
HELD_CALLS = 16
#: Pieces remembered per worker, and the longest that is remembered.
CACHE, LONGEST = 400_000, 64
LIMIT = 1024

BEFORE_SPACE = re.compile(r"(?<=[A-Za-z0-9])(?=[ .,;:!?\n])|(?<=[.,;:!?])(?=[ \n])|(?<=[ぁ-ゖァ-ヺ一-龥])(?=[、。！，？])")
#: The pieces between these boundaries: a word of ASCII letters and digits at once, all else up to the next boundary.
PIECE = re.compile(rf"[ .,;:!?\n]?[A-Za-z0-9]++(?=[ .,;:!?\n])|(?s:.+?)(?:{BEFORE_SPACE.pattern}|\Z)")
#: Pieces that have a safe boundary at either end, whichever of them come before and behind.
JOINABLE = re.compile(r"[ .,;:!?\n](?s:.*)[A-Za-z0-9]")
SINGLE_SPACE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
WORD_START = "▁"


def split_at(text: str, boundary: re.Pattern | None, long: int = LONG) -> list[str]:
    """The text in pieces of ``long`` characters and up to the next boundary; what the boundary matches is left out."""
    pieces, start = [], 0
    while boundary and len(text) - start > long:
        found = boundary.search(text, start + long)
        if not found:
            break
        pieces.append(text[start:found.start()])
        start = found.end()
    return [*pieces, text[start:]]


def _json_boundary(made: dict) -> re.Pattern | None:
    """Where a tokenizers file cuts by itself; None if that is not known."""
    pre = made.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not made.get("normalizer")
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or BEFORE_SPACE.search(t["content"]))
                for t in made.get("added_tokens", []))
    return BEFORE_SPACE if plain and added and not made.get("post_processor") else None


def _id_bytes(made: dict) -> np.ndarray | None:
    """Bytes that each id of a byte-level BPE file stands for, one character of its entry a byte; None if that is not so."""
    model = made["model"]
    if model.get("type") != "BPE" or any(model.get(k) for k in (
            "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "dropout")):
        return None
    sizes = {i: len(entry) for entry, i in model["vocab"].items()}
    sizes |= {t["id"]: len(t["content"].encode()) for t in made.get("added_tokens", [])}
    out = np.zeros(max(sizes) + 1, np.int64)
    out[list(sizes)] = list(sizes.values())
    return out


def _joining(encode_batch: Callable, id_bytes: np.ndarray) -> Callable[[list[str]], list[int]]:
    """Counts of pieces; those that join in any order are encoded as few longer texts."""
    def plain(pieces: list[str]) -> list[int]:
        return list(map(len, encode_batch(pieces, add_special_tokens=False)))

    def joined(pieces: list[str]) -> list[int]:
        texts, start, size = [], 0, 0
        for i, p in enumerate(pieces, 1):
            size += len(p)
            if size >= LONG or i == len(pieces):
                texts.append("".join(pieces[start:i]))
                start, size = i, 0
        ids = np.concatenate([np.array(e.ids, np.int64) for e in encode_batch(texts, add_special_tokens=False)])
        ends = np.cumsum(id_bytes[ids])
        behind = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in pieces])
        last = np.searchsorted(ends, behind)
        if last[-1] != len(ends) - 1 or not np.array_equal(ends[last], behind):
            return plain(pieces)  # a byte without an entry
        return np.diff(last, prepend=-1).tolist()

    def encode(pieces: list[str]) -> list[int]:
        inner = [p for p in pieces if JOINABLE.fullmatch(p)]
        if len(inner) < 2:
            return plain(pieces)
        known = dict(zip(inner, joined(inner), strict=True))
        other = [p for p in pieces if p not in known]
        known.update(zip(other, plain(other), strict=True))
        return [known[p] for p in pieces]
    return encode


class Counter:
    """Lengths of encoded texts by one tokenizer."""

    def __init__(self, kind: str, content: bytes):
        self.encode: Callable[[list[str]], list[int]]
        self.boundary: re.Pattern | None
        self.known: dict[str, int] = {}
        if kind == ".json":
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task, as Spark plans it
            import tokenizers

            made = tokenizers.Tokenizer.from_str(content.decode())
            made.no_truncation()
            made.no_padding()
            self.encode = lambda texts: list(map(len, made.encode_batch_fast(texts, add_special_tokens=False)))
            file = json.loads(content)
            self.boundary = _json_boundary(file)
            if self.boundary and (id_bytes := _id_bytes(file)) is not None:
                self.encode = _joining(made.encode_batch_fast, id_bytes)
        elif kind == ".model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.encode = lambda texts: list(map(len, model.encode(texts, num_threads=1)))
            pieces = map(model.id_to_piece, range(model.get_piece_size()))
            inner = any(WORD_START in p.lstrip(WORD_START) for p in pieces)
            self.boundary = None if inner or model.encode("a a") != 2 * model.encode("a") else SINGLE_SPACE
        else:
            raise ValueError(f"neither .json nor .model: {kind}")

    def pieces(self, text: str, long: int) -> list[str] | Tally[str]:
        """The text's pieces; those of a text longer than ``long`` with their numbers."""
        if not self.boundary:
            return [text]
        split = PIECE.findall if self.boundary is BEFORE_SPACE else self.boundary.split
        if len(text) <= long:
            return split(text)
        tally: Tally[str] = Tally()
        for part in split_at(text, self.boundary, long):
            tally.update(split(part))
        return tally

    def counts(self, texts: list[str], long: int = LONG, batch_bytes: int = BATCH_BYTES) -> list[int]:
        """Number of tokens of each text."""
        cut = [self.pieces(t, long) for t in texts]
        known = self.known
        known[""] = 0
        distinct: dict[str, None] = {}
        for pieces in cut:
            distinct.update(dict.fromkeys(pieces))
        call: list[str] = []
        size = 0
        for piece in [p for p in distinct if p not in known]:
            call.append(piece)
            size += len(piece) if piece.isascii() else len(piece.encode())
            if size >= batch_bytes:
                known.update(zip(call, self.encode(call), strict=True))
                call, size = [], 0
        if call:
            known.update(zip(call, self.encode(call), strict=True))
        out = [sum([known[p] * n for p, n in pieces.items()]) if isinstance(pieces, Tally)
               else sum(map(known.__getitem__, pieces)) for pieces in cut]
        if len(known) > CACHE:
            known.clear()
        for piece in (p for p in distinct if len(p) > LONGEST):
            known.pop(piece, None)
        return out


@lru_cache(maxsize=2)
def counter(kind: str, content: bytes) -> Counter:
    """One tokenizer per worker process."""
    return Counter(kind, content)


def _held(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of the column of about ``most`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(sizes):
        size += int(n)
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT, long: int = LONG,
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every document row.

    ``n_bytes`` is the size in UTF-8; ``over_limit`` says that there are more
    than ``limit`` tokens.  ``long`` and ``batch_bytes`` change the cost only.
    """
    importable(docs.sparkSession)
    kind, content = Path(vocabulary).suffix, Path(vocabulary).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, texts = counter(kind, content), batch.column(1)
            for start, end in _held(texts, HELD_CALLS * batch_bytes):
                part = texts.slice(start, end - start)
                tokens = pa.array(made.counts([t or "" for t in part.to_pylist()], long, batch_bytes), pa.int64())
                n_bytes = pc.fill_null(pc.binary_length(part), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), n_bytes, tokens, pc.greater(tokens, limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {doc_id}, n_bytes bigint, n_tokens bigint, over_limit boolean")
