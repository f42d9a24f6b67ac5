"""Byte-level BPE encoding and decoding through a sentencepiece model written from the vocabulary itself.

The rank file of a byte-level vocabulary is turned into a serialised sentencepiece BPE model: every token's bytes are
mapped to printable characters, one per byte, and the piece's score is its negative rank, so that "highest score first,
leftmost on ties" is "lowest rank first, leftmost on ties". Normalisation is the identity and no dummy prefix is added.
The regular expression of the vocabulary cuts texts into pre-tokens; a pre-token that is itself a token is emitted as
such, any other is encoded by the model. Decoding looks every id up in the inverse mapping.

Cases: a null text counts as empty (no ids, hash of the empty string); identical pre-tokens are encoded once per Python
worker through a cache bounded by twice ``CACHE_ENTRIES`` (results do not depend on it); ids of a text
are one byte string of little-endian unsigned 32-bit integers. Repeated rows are encoded row by row, extra columns are
never read, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from cairn.llm.frames import as_text
from cairn.llm.pretokens import Generations, chunks, splitter

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CACHE_ENTRIES = 250_000
CACHED_LENGTH = 48
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
IDS_SCHEMA = "doc_id long, ids binary"


def byte_alphabet() -> list[str]:
    """A printable character for every byte value: itself if printable Latin-1, else one from 256 upwards."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, fresh = [], 0x100
    for b in range(256):
        if b in keep:
            out.append(chr(b))
        else:
            out.append(chr(fresh))
            fresh += 1
    return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _flag(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise_model(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """A sentencepiece ModelProto for the vocabulary, and the rank of each of its pieces (-1: the unknown piece)."""
    alphabet = byte_alphabet()
    pieces = [_field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _flag(3, 2))]
    order = [-1]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        name = "".join(alphabet[b] for b in token).encode()
        pieces.append(_field(1, _field(1, name) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _flag(3, 1)))
        order.append(rank)
    trainer = _flag(3, 2) + _flag(4, len(pieces)) + _flag(40, 0) + b"".join(_varint(n << 3) + b"\xff" * 9 + b"\x01" for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _flag(3, 0) + _flag(4, 0) + _flag(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer), order


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str | None = None):
        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError(f"{vocabulary}: a byte-level vocabulary has all 256 bytes")
        model, order = serialise_model(self.ranks)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.order = np.array([0, *order[1:]], dtype="<u4")  # the unknown piece cannot come up: every byte is a piece
        self.table = dict(enumerate(byte_alphabet()))
        self.find = splitter(pattern)
        self.cache = Generations(CACHE_ENTRIES)

    def _learn(self, pieces: list[str], known: dict[str, bytes]) -> None:
        """Put the ids of pieces that are not cached into ``known``, with one call of the model for all."""
        data = [p.encode() for p in pieces]
        ranks = self.ranks.get
        hard = [i for i, d in enumerate(data) if d not in self.ranks]
        found = self.model.encode([data[i].decode("latin-1").translate(self.table) for i in hard], num_threads=1)
        ids = dict(zip(hard, found, strict=True))
        sizes = [len(x) for x in found]
        flat = self.order[np.fromiter((y for x in found for y in x), dtype=np.int64, count=sum(sizes))].tobytes()
        at = 0
        for i, (piece, d) in enumerate(zip(pieces, data, strict=True)):
            if i in ids:
                n = 4 * len(ids[i])
                known[piece] = flat[at : at + n]
                at += n
            else:
                known[piece] = ranks(d).to_bytes(4, "little")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.find(t) for t in texts]
        cache, old = self.cache, self.cache.old
        known, missing = {}, []
        for piece in set().union(*split):
            ids = cache.get(piece)
            if ids is None and (ids := old.get(piece)) is None:
                missing.append(piece)
                continue
            known[piece] = ids
        if missing:
            self._learn(missing, known)
        for piece, ids in known.items():
            if len(piece) <= CACHED_LENGTH and piece not in cache:
                cache.add(piece, ids)
        look = known.__getitem__
        return [b"".join(map(look, s)) for s in split]

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        for some in chunks(texts):
            yield from self.encode_batch(some)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(vocabulary: str = VOCABULARY, pattern: str | None = None) -> Codec:
    """One codec for each Python worker; the vocabulary file is part of every machine's installation."""
    return Codec(vocabulary, pattern)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): the ids of each text as a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            ids = list(own.encode_all([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return as_text(df, id_col, text_col).mapInArrow(run, IDS_SCHEMA)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, data): the bytes that the ids of each row stand for (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            data = [own.decode(t.as_py() or b"") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    return df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{ids_col}` as ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the bytes decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for ids in own.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return as_text(df, id_col, text_col).mapInArrow(run, SCHEMA)
