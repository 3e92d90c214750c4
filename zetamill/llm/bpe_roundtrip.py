"""Byte-level BPE encoding and decoding through a sentencepiece model made from the rank file.

The vocabulary is written as a sentencepiece BPE model directly (no training): every token's bytes become a piece
of printable characters, one per byte, with score -rank; normalisation is the identity.  Merging by highest score is
then merging by lowest rank.  Every match of the pre-token pattern is encoded on its own; ids are decoded by
mapping pieces back to bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import small_batches
from .textkernel import text_blocks
from .units import UnitCache, gather, once

#: One printable character for each byte; none is white space to sentencepiece.
BYTE_CHARS = "".join(chr(0x4E00 + b) for b in range(256))
_TO_CHARS = {b: BYTE_CHARS[b] for b in range(256)}
_TO_BYTES = {ord(c): b for b, c in enumerate(BYTE_CHARS)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece ids are the ranks; the unknown piece comes after them."""
    ordered = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, t.decode("latin-1").translate(_TO_CHARS).encode()) + _field(2, -float(r)) + _field(3, normal) for r, t in enumerate(ordered)]
    pieces.append(_field(1, "∅".encode()) + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(ordered)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        self.find = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(read_ranks(ranks_path)))
        self.n = self.model.get_piece_size() - 1
        raw = [bytes(_TO_BYTES[ord(c)] for c in self.model.id_to_piece(i)) for i in range(self.n)]
        self.size = np.array([len(b) for b in raw], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(raw), np.uint8)
        decimals = [b"%d " % i for i in range(self.n)]
        self.decimal_size = np.array([len(b) for b in decimals], np.int64)
        self.decimal_begin = np.cumsum(self.decimal_size) - self.decimal_size
        self.decimal_pool = np.frombuffer(b"".join(decimals), np.uint8)
        self.cache = UnitCache(self.encode_many, "I")

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers; every match of the pattern is encoded separately."""
        parts = [self.find(t) for t in texts]
        mapped = [p.encode("utf-8").decode("latin-1").translate(_TO_CHARS) for ps in parts for p in ps]
        ids = iter(self.model.encode(mapped, out_type=int, num_threads=1) if mapped else [])
        return [array("I", [i for _ in ps for i in next(ids)]).tobytes() for ps in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.pool, self.begin[ids], self.size[ids]).tobytes()


def _roundtrip(ranks_path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe: ByteBpe = once(("bpe", ranks_path, pattern), lambda: ByteBpe(ranks_path, pattern))
        for batch in batches:
            for start, end, data, offsets in text_blocks(batch.column(1)):
                ids, at = bpe.cache.ids(data, offsets, drop_space=False)
                decimal_size, size = bpe.decimal_size[ids], bpe.size[ids]
                decimals = memoryview(gather(bpe.decimal_pool, bpe.decimal_begin[ids], decimal_size))
                decoded = memoryview(gather(bpe.pool, bpe.begin[ids], size))
                d_at = np.r_[0, np.cumsum(decimal_size)][at].tolist()
                b_at = np.r_[0, np.cumsum(size)][at].tolist()
                rows = range(end - start)
                columns = [
                    batch.column(0).slice(start, end - start),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(decimals[d_at[i] : max(d_at[i], d_at[i + 1] - 1)]).hexdigest() for i in rows]),
                    pa.array([hashlib.sha256(decoded[b_at[i] : b_at[i + 1]]).hexdigest() for i in rows]),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): doc_id, n_tokens, ids_sha256, decoded_sha256 (, ids).

    ids_sha256 is the digest of the decimal ids joined by a space, decoded_sha256 that of the bytes the ids decode to.
    A null text is an empty one: no ids, the digests of nothing.  A null doc_id stays null; repeated rows come out as
    often as they came in; other columns are ignored; an empty table gives an empty table.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.mapInArrow(_roundtrip(ranks_path, pattern, with_ids), schema)
