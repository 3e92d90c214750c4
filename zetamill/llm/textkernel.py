"""Vectorised text kernels: words, word hashes and word shingles of many texts at once.

All functions work on the UTF-8 bytes of a block of texts, so that no Python object is made per word.
A word is a maximal run of bytes outside {0x20, 0x09-0x0D}; A-Z is lower-cased, nothing else is changed.
"""

from __future__ import annotations

import functools
import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: Spans up to so many bytes are hashed in lanes of eight bytes, longer ones by a cryptographic digest.
LANES = 8
SHORT = 8 * LANES

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_S32, _LOW32 = np.uint64(32), np.uint64(0xFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection with full avalanche."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x = x ^ (x >> _S33)
    x = x * _M2
    return x ^ (x >> _S33)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def new_key() -> bytes:
    """A fresh secret for span_hashes().  A job draws one on the driver and sends it to all its tasks."""
    return secrets.token_bytes(32)


@functools.lru_cache(8)
def _multipliers(key: bytes) -> np.ndarray:
    """Random 64-bit multipliers: for each of two sums one for the length and two for each lane."""
    stream = hashlib.shake_256(b"multipliers" + key).digest(8 * 2 * (1 + 2 * LANES))
    return np.frombuffer(stream, np.uint64).reshape(2, 1 + 2 * LANES)


def lanes_of(data: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there on as one number; beyond the end there are zeros."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes) -> np.ndarray:
    """A 64-bit hash of the bytes of each span.

    Short spans: two multilinear sums over their 32-bit halves and length with secret multipliers, of each the upper half:
    two given different spans meet with probability 2**-64, whatever they hold, as the key isn't known to who
    wrote them.  Longer spans: a keyed BLAKE2b digest.
    """
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    length = ends - starts
    view, m = lanes_of(data), _multipliers(key)
    one, two = (length.astype(np.uint64) * m[i, 0] for i in range(2))
    some: slice | np.ndarray = slice(None)
    for j in range(LANES):
        rest = length[some] - 8 * j
        lane = view[starts[some] + 8 * j] & _MASKS[np.minimum(rest, 8)]
        low, high = lane & _LOW32, lane >> _S32
        one[some] += low * m[0, 1 + 2 * j] + high * m[0, 2 + 2 * j]
        two[some] += low * m[1, 1 + 2 * j] + high * m[1, 2 + 2 * j]
        some = np.flatnonzero((length > 8 * j + 8) & (length <= SHORT))
        if not len(some):
            break
    out[:] = (one & ~_LOW32) | (two >> _S32)
    long = np.flatnonzero(length > SHORT)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8, key=key).digest(), "little") for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(first, code): the place of one span of each kind, and each span's kind.  Kinds are byte strings, not hashes.

    Spans are grouped by hash and then compared with the first of their group; a span that differs from
    it would be given a kind by its bytes.
    """
    _, first, code = np.unique(span_hashes(data, starts, ends, key), return_index=True, return_inverse=True)
    if not len(starts):
        return first, code
    view, length, model = lanes_of(data), ends - starts, first[code]
    differs = length != length[model]
    some: slice | np.ndarray = slice(None)
    for j in range(LANES):
        lane = (view[starts[some] + 8 * j] ^ view[starts[model[some]] + 8 * j]) & _MASKS[np.minimum(length[some] - 8 * j, 8)]
        differs[some] |= lane != 0
        some = np.flatnonzero((length > 8 * j + 8) & (length <= SHORT) & ~differs)
        if not len(some):
            break
    raw = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero((length > SHORT) & ~differs).tolist():
        m = model[i]
        differs[i] = m != i and raw[starts[i] : ends[i]] != raw[starts[m] : ends[m]]
    odd = np.flatnonzero(differs)
    if len(odd):
        kinds: dict[bytes, int] = {}
        more = []
        for i in odd.tolist():
            text = bytes(raw[starts[i] : ends[i]])
            if text not in kinds:
                kinds[text] = len(first) + len(more)
                more.append(i)
            code[i] = kinds[text]
        first = np.r_[first, more]
    return first, code


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about limit bytes: (first row, end row, bytes, offsets).

    Nulls are empty texts.  A text above the limit makes a block of its own; texts are never cut.
    """
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    column = column.fill_null(b"") if column.null_count else column
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + column.offset + 1)[column.offset :]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (one more entry at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    inner = offsets[1:-1]
    starts = ~space
    starts[1:] &= space[:-1]
    ends = ~space
    ends[:-1] &= space[1:]
    cuts = inner[(inner > 0) & (inner < n)]
    starts[cuts] = ~space[cuts]
    ends[cuts - 1] = ~space[cuts - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    return mix64(span_hashes(_LOWER[data], first, last + 1, key)), np.searchsorted(first, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, key: bytes) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its k-word shingles.

    A text with 1 to k-1 words has its whole word sequence as its one shingle; one without words has none.
    """
    words, at = word_hashes(data, offsets, key)
    grams = words.copy()
    if len(words) >= k:
        grams = grams[: len(words) - k + 1]
        for j in range(1, k):
            grams = mix64(grams * np.uint64(3) + words[j : len(words) - k + 1 + j] + np.uint64(j))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            short = np.uint64(b - a) * np.uint64(0xE7037ED1A0B428DB)
            for w in words[a:b]:
                short = mix64(np.array([short], np.uint64) * np.uint64(3) + w)[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_fingerprint(items: np.ndarray) -> tuple[int, int]:
    """128 bits that tell different sets apart."""
    digest = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
