"""Byte-level BPE through a sentencepiece model written directly from a rank file.

The model is a vocabulary, not a training result: byte ``b`` is the character ``U+0100 + b``, a token of rank
``r`` is the piece of its bytes' characters with score ``-r``, normalisation is the identity. sentencepiece then
merges the pair of the highest score, leftmost first, which is the lowest rank first. A pre-token that is itself a
token is that token. Decoding maps ids to pieces and characters back to bytes.

Nulls count as empty texts and give no tokens; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import base64
import struct
from functools import lru_cache

import numpy as np
import regex
import sentencepiece
from pyspark.sql import DataFrame

from strata.llm.text import CHUNK, map_columns

SCHEMA = "tokens binary, decoded binary"
#: Chunks kept per worker before the cache is emptied; longer chunks are never kept. Only speed depends on these.
CACHED, CACHED_CHARS = 600_000, 48
FIRST_CHAR = 0x100
NORMAL, UNKNOWN, BPE_MODEL = 1, 2, 2


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def as_piece(token: bytes) -> str:
    return "".join(chr(FIRST_CHAR + b) for b in token)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | float | bool | bytes) -> bytes:
    """One protocol buffer field: bytes length-delimited, floats as 32 bits, integers as varints."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(int(value))


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model: piece ``r`` is the token of rank ``r``, one unknown piece follows the last.

    Ranks must be 0 to n-1 and contain every byte, so that the unknown piece is never used.
    """
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing[:5]}")
    pieces = [_field(1, as_piece(t).encode()) + _field(2, float(-r)) + _field(3, NORMAL) for r, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN))
    trainer = _field(3, BPE_MODEL) + _field(4, len(pieces)) + _field(40, len(tokens))
    trainer += b"".join(_field(absent, -1) for absent in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(flag, False) for flag in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Coder(dict):
    """Encodes texts chunk by chunk; as a dict it keeps the ids of chunks seen, as little-endian 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.ranks = read_ranks(path)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        self.pattern = regex.compile(pattern)
        self.chars = {b: FIRST_CHAR + b for b in range(256)}
        back = {FIRST_CHAR + b: b for b in range(256)}
        by_id = (self.pieces.id_to_piece(i) for i in range(len(self.ranks)))
        self.token_bytes = [p.translate(back).encode("latin-1") for p in by_id]

    def encode_token(self, text: str) -> list[int]:
        raw = text.encode()
        if (rank := self.ranks.get(raw)) is not None:
            return [rank]
        return self.pieces.encode(raw.decode("latin-1").translate(self.chars))

    def __missing__(self, chunk: str) -> bytes:
        ids = [i for t in self.pattern.findall(chunk) for i in self.encode_token(t)]
        out = np.array(ids, "<u4").tobytes()
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, CHUNK.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    """One per worker process."""
    return Coder(path, pattern)


def encode_decode(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``tokens`` (ids as little-endian unsigned 32-bit integers) and ``decoded`` (the bytes they stand for)
    of every whole text. ``ranks`` is a path on every worker, ``pattern`` splits a text into pre-tokens; it must
    not match across the end of a run that is not white space.
    """

    def run(ids, texts):
        own = coder(ranks, pattern)
        tokens = [own.encode(t or "") for t in texts]
        return {id_col: ids, "tokens": tokens, "decoded": [own.decode(t) for t in tokens]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, text_col), run, f"`{id_col}` {kind}, {SCHEMA}")
