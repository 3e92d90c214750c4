"""Order-preserving packing of documents into training sequences by dynamic programming.

Documents are taken in the order of the table and form one token stream per input partition.  Windows of the stream
may end at document ends (free), sentence ends (small penalty) and, inside very long sentences, at every
STEP tokens (larger penalty).  The program chooses the cuts that minimise padding plus penalties:

    best[j] = penalty[j] + min( best[i] + capacity - (p[j] - p[i])   over i with p[j] - p[i] <= capacity,
                                best[i]                              over i with p[j] - p[i] a power of two )

The first minimum slides with j and is kept in a monotone queue over best[i] + p[i]; the second is looked up by
position.  So the time is linear in the number of cut positions.  A partition is solved in blocks of BLOCK
tokens; the last window of a block is not yet written but becomes the start of the next block, so that
blocks leave no seams.  Memory is that of a block and one document; there is no shuffle, and partitions
give sequence ids of their own.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import small_batches
from .textkernel import text_blocks
from .units import UnitCache, load_tokenizer, once

CAPACITY = 2048
BLOCK = 1 << 18
STEP = 256
SENTENCE_PENALTY, HARD_PENALTY = 4, 48
SMALLEST_POWER = 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def choose_cuts(positions: list[int], penalties: list[int], capacity: int, smallest_power: int = SMALLEST_POWER) -> list[int]:
    """Indices of the chosen window ends.  positions ascend from 0 with gaps of at most capacity."""
    n = len(positions)
    best, back = [0] * n, [0] * n
    at = [-1] * (positions[-1] + 1)
    at[0] = 0
    powers = [1 << k for k in range(capacity.bit_length()) if smallest_power <= 1 << k < capacity]
    queue, head = [0], 0  # indices whose best + position ascend
    value = [0] * n
    for j in range(1, n):
        p = positions[j]
        while positions[queue[head]] < p - capacity:
            head += 1
        i = queue[head]
        cost = value[i] + capacity - p
        for power in powers:
            if power > p:
                break
            k = at[p - power]
            if k >= 0 and best[k] < cost:
                cost, i = best[k], k
        cost += penalties[j]
        best[j], back[j], at[p] = cost, i, j
        value[j] = v = cost + p
        while len(queue) > head and value[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    ends = []
    j = n - 1
    while j:
        ends.append(j)
        j = back[j]
    return ends[::-1]


class _Stream:
    """The token stream of one partition."""

    def __init__(self, sentence_end: np.ndarray, capacity: int, sequence: int) -> None:
        self.sentence_end, self.capacity, self.sequence = sentence_end, capacity, sequence
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, tokens written, all tokens, rest
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, len(ids), ids))
        self.size += len(ids)

    def solve(self, last: bool) -> pa.RecordBatch:
        """Write all windows, except the last one unless it is the end of the partition."""
        stream = np.concatenate([d[3] for d in self.docs])
        doc_end = np.cumsum([len(d[3]) for d in self.docs])
        sentence = np.flatnonzero(self.sentence_end[stream]) + 1
        cuts = np.union1d(sentence, doc_end)
        gaps = np.diff(cuts, prepend=0)
        long = np.flatnonzero(gaps > STEP)
        inner = [np.arange(cuts[i] - gaps[i] + STEP, cuts[i], STEP) for i in long.tolist()]
        positions = np.union1d(cuts, np.concatenate(inner)) if inner else cuts
        penalty = np.full(len(positions), HARD_PENALTY)
        penalty[np.isin(positions, sentence, assume_unique=True)] = SENTENCE_PENALTY
        penalty[np.isin(positions, doc_end, assume_unique=True)] = 0
        ends = choose_cuts([0, *positions.tolist()], [0, *penalty.tolist()], self.capacity)
        windows = positions[np.array(ends) - 1]
        if not last:
            windows = windows[:-1]
        written = int(windows[-1]) if len(windows) else 0
        doc_begin = doc_end - [len(d[3]) for d in self.docs]
        window_begin = np.r_[0, windows[:-1]].astype(np.int64)
        begin = np.union1d(doc_begin[doc_begin < written], window_begin if len(windows) else [])
        begin = begin.astype(np.int64)
        stop = np.r_[begin[1:], written].astype(np.int64)[: len(begin)]
        doc = np.searchsorted(doc_end, begin, side="right")
        window = np.searchsorted(windows, begin, side="right")
        base = np.array([d[1] for d in self.docs], np.int64)
        raw = memoryview(stream.astype("<u4").tobytes())
        total = np.array([d[2] for d in self.docs], np.int64)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([self.docs[i][0] for i in doc.tolist()], pa.int64()),
                pa.array(base[doc] + begin - doc_begin[doc]),
                pa.array(stop - begin),
                pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)], pa.int64()),
                pa.array(total[doc]),
                pa.array(self.sequence + window),
                pa.array(begin - window_begin[window] if len(begin) else begin),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequence += len(windows)
        rest = []
        for (doc_id, before, total_, ids), a, b in zip(self.docs, doc_begin.tolist(), doc_end.tolist(), strict=True):
            if b > written:
                skip = max(0, written - a)
                rest.append((doc_id, before + skip, total_, ids[skip:]))
        self.docs, self.size = rest, sum(len(d[3]) for d in rest)
        return out


def sentence_end_table(tokenizer) -> np.ndarray:
    """For each id whether it ends a sentence: punctuation of one pre-token that ends in . ! or ?"""
    out = np.zeros(1 << 16, dtype=bool)
    for piece, i in tokenizer.get_vocab().items():
        bare = piece.removesuffix("</w>")
        if bare and bare[-1] in ".!?" and not any(c.isalnum() for c in bare):
            out[i] = True
    return out


class WordEncoder:
    """Encodes many short texts, with one call of the tokenizer for WORDS plain words together.

    For a tokenizer that drops white space and marks word ends, a word of letters makes exactly one id with the
    end mark, which shows where its ids end.  Where the number of marks isn't that of words, and for
    all other texts, each is encoded on its own.
    """

    WORDS = 256

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.word_end = np.zeros(1 << 16, dtype=bool)
        for piece, i in tokenizer.get_vocab().items():
            self.word_end[i] = piece.endswith("</w>")

    @staticmethod
    def plain(text: str) -> bool:
        return text.isalpha() and (text.isascii() or (max(text) < "\u0250" and text.lower().isalpha()))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.plain(t)]
        single = [i for i, t in enumerate(texts) if not self.plain(t)]
        chunks = [plain[i : i + self.WORDS] for i in range(0, len(plain), self.WORDS)]
        joined = self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in chunk]) for chunk in chunks], add_special_tokens=False)
        for chunk, encoding in zip(chunks, joined, strict=True):
            ids = np.array(encoding.ids, np.uint16)
            ends = (np.flatnonzero(self.word_end[ids]) + 1).tolist()
            if len(ends) != len(chunk) or ends[-1] != len(ids):
                single += chunk
                continue
            raw = ids.tobytes()
            for i, a, b in zip(chunk, [0, *ends[:-1]], ends, strict=True):
                out[i] = raw[2 * a : 2 * b]
        for i, encoding in zip(single, self.tokenizer.encode_batch_fast([texts[i] for i in single], add_special_tokens=False), strict=True):
            out[i] = array("H", encoding.ids).tobytes()
        return out


def _pack(tokenizer_path: str, end_id: int, capacity: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = once(("pack", "tokenizer", tokenizer_path), lambda: load_tokenizer(tokenizer_path))
        sentence_end = once(("pack", "sentence ends", tokenizer_path), lambda: sentence_end_table(tokenizer))
        fold_case = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str("ABZ") == "abz"
        cache = once(("pack", "cache", tokenizer_path), lambda: UnitCache(WordEncoder(tokenizer).encode, "H", fold_case))
        stream = _Stream(sentence_end, capacity, TaskContext.get().partitionId() << 40)
        end = np.array([end_id], np.uint16)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for start, stop, data, offsets in text_blocks(batch.column(1)):
                ids, at = cache.ids(data, offsets, drop_space=True)
                for row in range(stop - start):
                    stream.add(doc_ids[start + row], np.concatenate([ids[at[row] : at[row + 1]], end]))
                    if stream.size >= block:
                        yield stream.solve(last=False)
        if stream.size:
            yield stream.solve(last=True)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One row for each piece of a document of docs(doc_id, text, ...) in a sequence of at most capacity ids.

    A document is the tokenizer's ids of its whole text (no special tokens added) and then end_id.  Every id lies in
    exactly one piece; a piece is ids start .. start + length - 1 of its document and stands at offset in sequence
    sequence_id, without gaps.  A sequence of fewer than capacity ids is to be padded unless its length is a power
    of two.  A null or empty text gives end_id alone.  A null doc_id stays null; repeated rows are packed as often as
    they come; other columns are ignored; an empty table gives an empty table.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(tokenizer_path, end_id, capacity, block), SCHEMA)
