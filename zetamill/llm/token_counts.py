"""Token counts of whole texts by a two-tier lookup on the map side.

Tier one is a compact open-addressing hash table (a unit's bytes -> token count) of frequent units of at most TABLE_BYTES
bytes; the driver builds it from a bounded random sample of documents and broadcasts it (TABLE_SLOTS * 18 bytes).
Units it lacks go to tier two, a dictionary of the worker process; what that lacks too is encoded by the tokenizer.
Both tiers hold the units' bytes themselves, so no unit is taken for another.
The sample (at most SAMPLE_DOCS texts, together at most SAMPLE_TOTAL bytes) only decides what is fast: every text is
counted whole and exactly.  One pass over the text column, no shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import small_batches
from .textkernel import _MASKS, SHORT, distinct_spans, lanes_of, mix64, text_blocks
from .units import KEY, load_tokenizer, once, unit_spans

SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TOTAL = 2_000, 64_000, 16_000_000
TABLE_SLOTS = 1 << 18
TABLE_UNITS = 1 << 16
TABLE_BYTES = 15
PROBES = 4
CACHE_UNITS = 500_000


def unit_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units of at most TABLE_BYTES bytes as pairs of numbers: their bytes, and the length in the last byte."""
    view, length = lanes_of(data), ends - starts
    more = np.clip(length - 8, 0, 7)
    low = view[starts] & _MASKS[np.minimum(length, 8)]
    high = view[np.minimum(starts + 8, len(data))] & _MASKS[more]
    return low, high | (length.astype(np.uint64) << np.uint64(56))


class FrequentTable:
    """Counts of frequent units in three arrays; an entry lies within PROBES slots of its hash."""

    def __init__(self, low: np.ndarray, high: np.ndarray, counts: np.ndarray, slots: int = TABLE_SLOTS) -> None:
        self.low, self.high, self.counts = np.zeros(slots + PROBES, np.uint64), np.zeros(slots + PROBES, np.uint64), np.zeros(slots + PROBES, np.uint16)
        for a, b, c, at in zip(low.tolist(), high.tolist(), counts.tolist(), self._slots(low, high).tolist(), strict=True):
            for slot in range(at, at + PROBES):
                if not self.counts[slot]:
                    self.low[slot], self.high[slot], self.counts[slot] = a, b, c
                    break

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix64(mix64(low) + high) & np.uint64(len(self.low) - PROBES - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Count of each unit, 0 where the table lacks it."""
        slot = self._slots(low, high)
        out = np.where((self.low[slot] == low) & (self.high[slot] == high), self.counts[slot], 0).astype(np.int64)
        for step in range(1, PROBES):
            rest = np.flatnonzero(out == 0)
            at = slot[rest] + step
            out[rest] = np.where((self.low[at] == low[rest]) & (self.high[at] == high[rest]), self.counts[at], 0)
        return out


def _encode_counts(tokenizer, texts: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def build_table(texts: list[str], tokenizer_path: str) -> FrequentTable:
    """The table of the most frequent units of the given sample."""
    seen: Counter = Counter()
    for _, _, data, offsets in text_blocks(pa.array(texts, pa.string())):
        starts, ends, _ = unit_spans(data, offsets, drop_space=False)
        raw = data.tobytes()
        seen.update(raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a <= TABLE_BYTES)
    units = [u for u, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:TABLE_UNITS]]
    joined = np.frombuffer(b"".join(units), np.uint8)
    ends = np.cumsum([len(u) for u in units], dtype=np.int64)
    starts = ends - np.array([len(u) for u in units], np.int64)
    counts = _encode_counts(load_tokenizer(tokenizer_path), [u.decode("utf-8", "replace") for u in units])
    return FrequentTable(*unit_names(joined, starts, ends), np.array(counts, np.int64))


def _count(tokenizer_path: str, table, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = once(("counts", "tokenizer", tokenizer_path), lambda: load_tokenizer(tokenizer_path))
        cache: dict[bytes, int] = once(("counts", "cache", tokenizer_path), dict)
        frequent: FrequentTable = table.value
        for batch in batches:
            for start, end, data, offsets in text_blocks(batch.column(1)):
                starts, ends, at = unit_spans(data, offsets, drop_space=False)
                counts = np.zeros(len(starts), np.int64)
                short = np.flatnonzero(ends - starts <= TABLE_BYTES)
                counts[short] = frequent.find(*unit_names(data, starts[short], ends[short]))
                rest = np.flatnonzero(counts == 0)
                first, code = distinct_spans(data, starts[rest], ends[rest], KEY)
                raw, rows = data.tobytes(), rest[first]
                keys = [raw[a:b] for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)]
                known = list(map(cache.get, keys))
                missing = [i for i, c in enumerate(known) if c is None]
                if missing:
                    if len(cache) + len(missing) > CACHE_UNITS:
                        cache.clear()
                    for i, c in zip(missing, _encode_counts(tokenizer, [keys[i].decode("utf-8", "replace") for i in missing]), strict=True):
                        known[i] = c
                        if len(keys[i]) <= SHORT:
                            cache[keys[i]] = c
                if keys:
                    counts[rest] = np.array(known, np.int64)[code]
                total = np.r_[0, np.cumsum(counts)][at]
                n_tokens = np.diff(total)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(np.diff(offsets)), pa.array(n_tokens), pa.array(n_tokens > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): doc_id, n_bytes, n_tokens, over_limit.

    The counts are those of the tokenizer file's own library for the whole text, without added special tokens,
    truncation or padding; special strings inside a text count as the library counts them by default.
    A null text is an empty one: 0 bytes, 0 tokens, not over the limit.  A null doc_id stays null; repeated rows come
    out as often as they came in; other columns are ignored; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = max(1, docs.count())
    sample = docs.where(F.octet_length("text") <= SAMPLE_BYTES).sample(min(1.0, 1.2 * SAMPLE_DOCS / rows), seed=17).limit(SAMPLE_DOCS)
    texts, size = [], 0
    for row in sample.select("text").toLocalIterator():
        size += len(row.text)
        if size > SAMPLE_TOTAL:
            break
        texts.append(row.text)
    table = spark.sparkContext.broadcast(build_table(texts, tokenizer_path))
    return docs.mapInArrow(_count(tokenizer_path, table, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
