"""Encoding a corpus with a public tokenizer, and back.

``tokenizers`` runs over Arrow batches in the Python workers; one tokenizer is loaded per worker from a vocabulary file
whose path is a parameter. The file must be readable on every executor. A byte-level vocabulary writes each byte of the
UTF-8 text as one printable character; ``byte_alphabet`` is that table, by which ids are decoded without the library and
characters split over several tokens are put together again.

A byte-level pre-tokenizer never joins a non-space character with the white space after it, so a text may be cut there
and the pieces encoded apart with the same ids. Pieces recur: each worker keeps the ids of the last some hundred thousand
short pieces and gives only unseen ones to the library. Long pieces without spaces are cut further between a CJK mark or
a digit and a letter, which are boundaries of the pre-tokenizer too.

Defined results: a null, empty or absent text has an empty list of ids (and no offsets); control-token look-alikes are
ordinary text; no special tokens are added; rows are never dropped or merged, so repeated rows stay repeated; a text of
any length is encoded whole; extra columns do not pass through.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts handed to the library at once, and characters after which a smaller group is closed.
GROUP_ROWS, GROUP_CHARS = 512, 2_000_000
#: Where the vocabulary files of the public tokenizers are.
VOCABULARIES = "/opt/tokenizers"


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task, one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


class WholeEncoder:
    """Ids of whole texts by the ``tokenizers`` library alone."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class PlainEncoder:
    """Ids of whole texts by ``tiktoken`` ranks or a ``sentencepiece`` model."""

    def __init__(self, path: str):
        if path.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            coder = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.encode = coder.encode_ordinary
        else:
            import sentencepiece

            self.encode = sentencepiece.SentencePieceProcessor(model_file=path).encode

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [array("i", self.encode(t)).tobytes() for t in texts]


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary file."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    special = {t["id"]: t["content"].encode() for t in content.get("added_tokens", [])}
    alphabet = byte_alphabet()
    size = max([*content["model"]["vocab"].values(), *special], default=-1) + 1
    found = [b""] * size
    for piece, i in content["model"]["vocab"].items():
        found[i] = special[i] if i in special else bytes(alphabet[c] for c in piece)
    for i, piece in special.items():
        found[i] = piece
    return found


def decode(ids, path: str) -> str:
    """Text of a list of ids; bytes that form no character (a cut inside one) become U+FFFD."""
    pieces = token_bytes(path)
    return b"".join(pieces[i] for i in ids).decode("utf-8", errors="replace")


def character_spans(ids, path: str) -> list[tuple[int, int]]:
    """Start and end of each token in code points; a character split over tokens belongs to each of them."""
    pieces = token_bytes(path)
    raw = np.frombuffer(b"".join(pieces[i] for i in ids), dtype=np.uint8)
    if not len(raw):
        return []
    starts = (raw & 0xC0) != 0x80
    index = np.cumsum(starts) - 1  # the character each byte is of
    ends = np.cumsum([len(pieces[i]) for i in ids])
    begins = ends - [len(pieces[i]) for i in ids]
    return list(zip(index[begins].tolist(), (index[ends - 1] + 1).tolist(), strict=True))


class PieceEncoder:
    """Ids of whole texts as little-endian int32 bytes, through a bounded table of pieces already encoded."""

    # U+001C to U+001F are white space to Python, not to the pre-tokenizer
    PIECE = re.compile("[^\\S\x1c-\x1f]*[\\S\x1c-\x1f]+|[^\\S\x1c-\x1f]+")
    FINER = re.compile("(?<=[、。，！？：])(?=[一-鿿ぁ-ヺA-Za-z0-9])|(?<=[0-9])(?=[一-鿿ぁ-ヺA-Za-z])|(?<=[一-鿿ぁ-ヺA-Za-z])(?=[0-9])")
    LONG, KEPT_CHARS, KEPT = 20, 48, 300_000

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [self.PIECE.findall(t) for t in texts]
        pieces = set(chain.from_iterable(cut))
        if len(self.known) + len(pieces) > self.KEPT:
            self.known = {}
        long = {p: parts for p in pieces.difference(self.known) if len(p) > self.LONG and len(parts := self.FINER.split(p)) > 1}
        new = list((pieces - long.keys()).union(chain.from_iterable(long.values())).difference(self.known))
        found = {p: array("i", e.ids).tobytes() for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True)}
        self.known.update((p, ids) for p, ids in found.items() if len(p) <= self.KEPT_CHARS)
        known = self.known
        of = lambda p: known[p] if p in known else found[p]
        found |= {p: b"".join(map(of, parts)) for p, parts in long.items()}
        return [b"".join(map(of, pieces)) for pieces in cut]


@lru_cache(maxsize=4)
def text_encoder(path: str):
    """The encoder of a vocabulary file, by its kind; only byte-level ones may be fed in pieces."""
    if not path.endswith(".json"):
        return PlainEncoder(path)
    with open(path, encoding="utf-8") as f:
        byte_level = (json.load(f).get("pre_tokenizer") or {}).get("type") == "ByteLevel"
    return PieceEncoder(path) if byte_level else WholeEncoder(path)


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    group: list[str] = []
    chars = 0
    for text in texts:
        group.append(text or "")
        chars += len(group[-1])
        if len(group) >= GROUP_ROWS or chars >= GROUP_CHARS:
            yield group
            group, chars = [], 0
    if group:
        yield group


def _encoder(key: str, path: str, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            done = 0
            for group in _groups(texts):
                part = keys.slice(done, len(group))
                done += len(group)
                rows = encoder(group)
                sizes = np.fromiter((len(x) // 4 for x in rows), dtype=np.int64, count=len(rows))
                if what == "sizes":
                    yield pa.RecordBatch.from_arrays([part, pa.array(sizes)], names=[key, "n_tokens"])
                    continue
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(rows), dtype=np.int32)))
                if what == "ids":
                    yield pa.RecordBatch.from_arrays([part, ids], names=[key, "ids"])
                else:
                    spans = [character_spans(np.frombuffer(x, dtype=np.int32), path) for x in rows]
                    bounds = [pa.array([[s[i] for s in row] for row in spans], pa.list_(pa.int32())) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([part, ids, *bounds], names=[key, "ids", "starts", "ends"])

    return run


def encode(df: DataFrame, key: str, text: str, path: str, offsets: bool = False) -> DataFrame:
    """``(key, ids)`` of every row, with ``starts`` and ``ends`` in code points when ``offsets`` is set."""
    key_type = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {key_type}, ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    return df.select(key, text).mapInArrow(_encoder(key, path, "spans" if offsets else "ids"), schema)


def token_counts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """``(key, n_tokens)`` of every row."""
    return df.select(key, text).mapInArrow(_encoder(key, path, "sizes"), f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long")


def decode_rows(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """``(key, text)`` of every row of ids; a null list gives an empty text."""

    def run(batches):
        for batch in batches:
            texts = [decode(x or [], path) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")
