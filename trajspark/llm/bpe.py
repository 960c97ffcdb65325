"""Operator 4: byte-level BPE encoding and decoding through a sentencepiece model serialised from the vocabulary.

Every byte stands for one character, every vocabulary entry becomes a piece scored by its negative rank, and normalisation is
the identity; sentencepiece's BPE then merges in rank order. Pre-tokens are encoded one by one; decoding maps ids back to bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkEncoder, as_ids, read_ranks
from .common import text_or_empty

#: Byte b is written as itself if it is a visible ASCII character, else as the character FIRST_CHAR + b.
FIRST_CHAR = 0x100


#: Latin-1 reading of a byte to its character; a line feed parts pre-tokens that hold none themselves.
BYTE_CHAR = [chr(b if 0x21 <= b <= 0x7E else FIRST_CHAR + b) for b in range(256)]
TO_PIECES = {b: c for b, c in enumerate(BYTE_CHAR)} | {ord("\n"): chr(FIRST_CHAR + 256)}


def byte_text(data: bytes) -> str:
    return "".join([BYTE_CHAR[b] for b in data])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: piece 0 is the unknown piece, piece r + 1 the entry of rank r. Ranks must be 0..n-1."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0..n-1")
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, byte_text(p).encode()) + _field(2, float(-r)) for p, r in sorted(ranks.items(), key=lambda x: x[1])]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """encode(text) -> id bytes (little-endian u32); decode(ids) -> bytes.

    The pre-tokens of a text go to sentencepiece in one call, parted by a character outside the vocabulary: it becomes the
    unknown piece, and no merge spans it.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.ranks))
        self.table = [p for p, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        find, parted = regex.compile(pattern).findall, chr(FIRST_CHAR + 256)

        def encode_text(text: str) -> np.ndarray:
            mapped = "\n".join(find(text)).encode().decode("latin-1") if "\n" not in text else None
            if mapped is None:
                joined = parted.join([byte_text(p.encode()) for p in find(text)])
            else:
                joined = mapped.translate(TO_PIECES)
            ids = np.array(model.encode(joined), dtype=np.int64)
            return (ids[ids > 0] - 1).astype(np.uint32)

        self.encode = ChunkEncoder(encode_text, np.array([p[:1] == b" " for p in self.table])).encode

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ids array<int> and the decoded bytes (equal to the text's UTF-8). Null text counts as empty.

    Rows are independent (no shuffle); repeated rows give repeated results, an empty table an empty one; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, pattern)
        for batch in batches:
            ids = [as_ids(codec.encode(t)).astype("int32") for t in batch.column(1).to_pylist()]
            decoded = [codec.decode(i.tolist()) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_texts, with the ids and bytes digested in the same task: n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_bpe(path, pattern)
        names = [str(i) for i in range(len(codec.table))]
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                ids = as_ids(codec.encode(text)).tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
