"""Cutting texts into units that a tokenizer treats independently, many texts at once.

A pre-tokenizing pattern never lets a pre-token cross certain byte positions, so a text may be encoded unit
by unit and each distinct unit only once.  The positions used here are safe for both patterns in use:

* before a single space or line feed, and after a single line feed, between two characters that aren't
  white space (a space belongs to the pre-token that follows, a line feed is one of its own);
* before one of , . ; : ! ? after an ASCII letter or digit or a letter of U+00C0 .. U+00FF;
* with drop_space, for tokenizers that drop white space, around every run of ASCII white space.

Where it is not plain from the bytes that a neighbour isn't (Unicode) white space, nothing is cut: units
get longer, never wrong.
"""

from __future__ import annotations

import numpy as np

from .textkernel import _LOWER, SHORT, distinct_spans, new_key

_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x20), 0x20]] = True
_DROPPED = np.zeros(256, dtype=bool)
_DROPPED[[*range(0x09, 0x0E), 0x20]] = True
# First bytes of characters some of which are white space: U+0085, U+00A0, U+1680, U+2000 .. U+205F, U+3000.
_MAYBE_SPACE = _ASCII_SPACE.copy()
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
# Second bytes of the letters U+00C0 .. U+00FF, all but the multiplication and division signs.
_LATIN_TAIL = np.zeros(256, dtype=bool)
_LATIN_TAIL[0x80:0xC0] = True
_LATIN_TAIL[[0x97, 0xB7]] = False
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ",.;:!?"]] = True
#: This process's secret for grouping equal units.
KEY = new_key()
_NO = np.zeros(0, np.int64)


def unit_spans(data: np.ndarray, offsets: np.ndarray, drop_space: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all units, and for each text the index of its first unit (one more entry at the end)."""
    n = len(data)
    if not n:
        return _NO, _NO, np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    mark = _MARK[data]
    cut[1:n] |= mark[1:] & _ALNUM[data[:-1]]
    cut[2:n] |= mark[2:] & (data[:-2] == 0xC3) & _LATIN_TAIL[data[1:-1]]
    if drop_space:
        inside = ~_DROPPED[data]
        cut[1:n] |= ~inside[:-1]
    else:
        inside = None
        before_ok = np.zeros(n, dtype=bool)
        before_ok[1:] = ~_ASCII_SPACE[data[:-1]]
        high = data >= 0x80
        before_ok[2:] &= ~(high[1:-1] & (data[:-2] == 0xC2))
        before_ok[3:] &= ~(high[2:-1] & (data[:-3] >= 0xE1) & (data[:-3] <= 0xE3))
        after_ok = np.zeros(n, dtype=bool)
        after_ok[:-1] = ~_MAYBE_SPACE[data[1:]]
        after_ok[offsets[1:][(offsets[1:] > 0)] - 1] = False
        plain = before_ok & after_ok
        cut[:n] |= plain & ((data == 0x20) | (data == 0x0A))
        cut[1:] |= plain & (data == 0x0A)
    cut[offsets] = True
    if drop_space:
        starts = np.flatnonzero(cut[:n] & inside)
        ends = np.flatnonzero(inside & np.r_[cut[1:n] | ~inside[1:], True]) + 1
    else:
        marks = np.flatnonzero(cut[: n + 1])
        starts, ends = marks[:-1], marks[1:]
    return starts, ends, np.searchsorted(starts, offsets)


def gather(pool: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices pool[begin[i] : begin[i] + lengths[i]], one after another."""
    if not len(begin):
        return pool[:0]
    stop = np.cumsum(lengths)
    return pool[np.repeat(begin - (stop - lengths), lengths) + np.arange(stop[-1])]


class UnitCache:
    """What a worker has already encoded: a unit's bytes -> bytes of its ids, as encode(texts) gives them.

    It lives as long as the worker process and is only a cache of two generations with at most `most` units each:
    when the younger is full it becomes the older, and units of the older that are met again move back.
    Units above SHORT bytes aren't kept.  Units are told apart by their bytes, never by a hash alone.
    """

    def __init__(self, encode, typecode: str, fold_case: bool = False, most: int = 300_000) -> None:
        self.encode, self.typecode, self.fold_case, self.most = encode, typecode, fold_case, most
        self.dtype = np.dtype(typecode)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def ids(self, data: np.ndarray, offsets: np.ndarray, drop_space: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text begins (one more entry at the end)."""
        starts, ends, at = unit_spans(data, offsets, drop_space)
        # Special strings such as <|...|> are told from others by case.
        folded = _LOWER[data] if self.fold_case and not (data[:-1][data[1:] == 0x7C] == 0x3C).any() else data
        first, code = distinct_spans(folded, starts, ends, KEY)
        blobs = self.lookup(folded, data, starts[first].tolist(), ends[first].tolist())
        size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(blobs), dtype=self.dtype)
        lengths = size[code]
        ids = gather(pool, (np.cumsum(size) - size)[code], lengths)
        return ids, np.r_[0, np.cumsum(lengths)][at]

    def lookup(self, folded, data, starts: list[int], ends: list[int]) -> list[bytes]:
        raw = folded.tobytes()
        keys = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        blobs = list(map(self.known.get, keys))
        missing = []
        for i in [i for i, blob in enumerate(blobs) if blob is None]:
            blob = self.older.pop(keys[i], None)
            if blob is None:
                missing.append(i)
            else:
                blobs[i] = self.known[keys[i]] = blob
        if missing:
            raw = raw if folded is data else data.tobytes()
            texts = [raw[starts[i] : ends[i]].decode("utf-8", "replace") for i in missing]
            for i, blob in zip(missing, self.encode(texts), strict=True):
                blobs[i] = blob
                if len(keys[i]) <= SHORT:
                    self.known[keys[i]] = blob
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        return blobs


_loaded: dict[tuple, object] = {}


def once(key: tuple, make):
    """make() the first time in this worker process, then the same object.

    key begins with the operator's name.  A worker that turns to another operator drops what it held for the one
    before, so the caches of different operators don't add up.
    """
    if _loaded and next(iter(_loaded))[0] != key[0]:
        _loaded.clear()
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


def load_tokenizer(path: str):
    """A tokenizers.Tokenizer without truncation or padding, single-threaded."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer
