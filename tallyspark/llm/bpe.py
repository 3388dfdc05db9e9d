"""Byte-level BPE by a sentencepiece model that is written straight from a rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, raw_texts

#: Byte b is written as the letter U+0100 + b, so that no piece holds a control or white-space character.
TO_LETTERS = {b: 0x100 + b for b in range(256)}
#: Pre-tokens a task remembers before it starts afresh; encoding doesn't depend on it.
REMEMBERED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(TO_LETTERS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, payload: bytes | int) -> bytes:
    if isinstance(payload, int):
        return _varint(number << 3) + _varint(payload)
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece i is the token of rank i, scored -i; <unk> comes last.

    The normaliser is the identity and neither adds a dummy prefix nor touches
    white space, so a pre-token's letters reach the merges unchanged.
    """
    pieces = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if rank != len(pieces):
            raise ValueError("ranks must run from 0 without gaps")
        pieces.append(_field(1, _field(1, _letters(token).encode()) + b"\x15" + np.float32(-rank).tobytes()))
    pieces.append(_field(1, _field(1, b"<unk>") + b"\x15" + np.float32(0).tobytes() + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(pieces) - 1) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class ByteBPE:
    """Encodes and decodes texts by a serialised model, remembering pre-tokens."""

    def __init__(self, model: bytes, pattern: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        n = self.sp.get_piece_size() - 1
        back = {0x100 + b: b for b in range(256)}
        self.tokens = [self.sp.id_to_piece(i).translate(back).encode("latin-1") for i in range(n)]
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.known: dict[str, bytes] = {}

    def packed(self, text: str) -> list[bytes]:
        """Little-endian 32-bit ids of each pre-token."""
        parts, known = self.split(text), self.known
        out = list(map(known.get, parts))
        if None in out:
            if len(known) > REMEMBERED:
                known.clear()
                out = [None] * len(parts)
            new = list({p for p, x in zip(parts, out) if x is None})
            raw = [p.encode() for p in new]
            # a pre-token that is itself a token stays whole, whatever merges would lead to
            ask = [i for i, r in enumerate(raw) if r not in self.whole]
            ids = {i: x for i, x in zip(ask, self.sp.encode([_letters(raw[i]) for i in ask], num_threads=1))} if ask else {}
            for i, p in enumerate(new):
                known[p] = np.array(ids.get(i) or [self.whole[raw[i]]], "<u4").tobytes()
            out = list(map(known.__getitem__, parts))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def _coder(model: bytes, pattern: str) -> ByteBPE:
    return ByteBPE(model, pattern)


def encoded(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) of every row; null text counts as empty (no ids, no bytes).

    One narrow pass: rows stay in their partitions, repeated ids give repeated
    rows, an empty table gives none, and only the two named columns are read.
    """
    model = serialise_model(read_ranks(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]):
        coder = _coder(model, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.frombuffer(b"".join(coder.packed(t.decode("utf-8", "replace"))), "<u4") for t in raw_texts(part.column(1))]
                yield pa.record_batch([part.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([coder.decode(x) for x in ids], pa.binary())], names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): what ``encoded`` makes, digested where it is made.

    Null text counts as empty: no ids. Very long texts are encoded whole by one task. Bytes that aren't UTF-8 are read as
    replacement characters. Repeated rows and ids each give a row, null ids too; an empty table gives none.
    Other columns are not read and may have any name.
    """
    model = serialise_model(read_ranks(vocabulary))

    def run(batches: Iterable[pa.RecordBatch]):
        coder = _coder(model, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for t in raw_texts(batch.column(1)):
                packed = b"".join(coder.packed(t.decode("utf-8", "replace")))
                ids = np.frombuffer(packed, "<u4")
                n.append(len(ids))
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
