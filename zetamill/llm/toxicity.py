"""Toxicity scores from a subsequence string kernel, Nystroem landmarks and a support vector machine on labelled sentences.

Kernel.  Two words are compared by the three-letter subsequences they share; an occurrence whose letters span s
positions weighs DECAY**s, spans beyond SPAN don't count, ^ and $ mark a word's ends.  So inserted letters and gaps
lower the similarity of two words but don't end it.  Values are divided by norms that depend on the words' lengths.

Model.  A labelled sentence is a bag of words, and the SVM's margin of a sentence is that of its highest word: a toxic sentence
asks for one word at +1, a clean one for all words at -1.  Such multiple-instance SVMs are trained in turns: the
word that stands for each toxic sentence (its witness) is chosen by the present decision function, then a squared-hinge SVM is
trained on witnesses against words of clean sentences, those with the largest decision values among them.
The first function is a diagonal discriminant between the mean embeddings of toxic and of clean sentences.  Words are mapped by
Nystroem's method to LANDMARKS words.  The decision function is a weighted sum over subsequences, so it is stored as one
weight for each (hashed) subsequence: scoring needs no landmark.

Score.  A text's decision value is the largest of its words', turned into a probability by a logistic curve
fitted on the training sentences.  Texts are folded (NFKC, lower case).  Words are runs of letters and digits after
removal of all other characters except white space ("i.d.i.o.t" is one word); runs of single letters are joined
("i d i o t").  The value of a word above PIECE marked letters is the largest of its windows of so many letters; only the
first window has the mark of a beginning, only the last one that of an end.

Distribution.  The model is fitted on the driver from a sample with fixed bounds: at most SAMPLE_TOXIC and SAMPLE_CLEAN
labelled texts, those with the smallest hashes of doc_id, as many as have SAMPLE_CHARS characters together.  Scoring is one pass over the whole texts of all rows without a shuffle; the broadcast weights are SLOTS * 4 bytes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, small_batches
from .textkernel import distinct_spans, mix64
from .units import KEY, gather, once

SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2_000, 5_000, 14_000_000
LANDMARKS = 256
#: Decision value of a word that shares nothing with any landmark, and the bounds of decision values.
BIAS, LEAST = -1.0, -3.0
COST = 30.0
SLOTS = 1 << 18
SPAN, DECAY = 6, 0.6
#: Turns of witnesses and training, parts of the sentences that choose witnesses for each other, share of the clean sentences
#: that may have higher words than a witness, and clean words in one training.
TURNS, FOLDS, CALM, NEGATIVE_WORDS = 3, 3, 0.08, 6_000
PIECE, PIECE_STEP = 22, 8
CACHE_WORDS = 250_000
BLOCK_CHARS = 1 << 20

_GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]


def _kind(ch: str) -> int:
    """0 dropped, 1 part of a word, 2 white space."""
    return 2 if ch.isspace() else 1 if ch.isalnum() else 0


def _classes() -> np.ndarray:
    """The kind of each code point of the basic plane."""
    return np.array([_kind(chr(c)) for c in range(1 << 16)], np.uint8)


@dataclass
class Words:
    """All words of some texts, with their marks: code points, where words begin and end, and each text's first word."""

    chars: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The place of one word of each kind, and each word's kind."""
        return distinct_spans(self.chars.view(np.uint8), 4 * self.starts, 4 * self.ends, KEY)

    def some(self, which) -> Words:
        starts, ends = self.starts[which], self.ends[which]
        return Words(self.chars, starts, ends, np.array([0, len(starts)]))

    def names(self) -> list[bytes]:
        joined = self.chars.tobytes()
        return [joined[4 * a : 4 * b] for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)]

    def texts(self) -> list[str]:
        return [n.decode("utf-32-le", "replace") for n in self.names()]


def _folded(text: str) -> str:
    return text.lower() if text.isascii() or unicodedata.is_normalized("NFKC", text) else unicodedata.normalize("NFKC", text).lower()


def cut_words(texts: list[str]) -> Words:
    """Words of the texts; of those above PIECE marked letters their windows."""
    classes = once(("toxicity", "classes"), _classes)
    lowered = [_folded(t) for t in texts]
    sizes = np.array([len(t) + 1 for t in lowered], np.int64)
    chars = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), "<u4") if texts else np.zeros(0, "<u4")
    kind = classes[np.minimum(chars, 0xFFFF)]
    beyond = np.flatnonzero(chars > 0xFFFF)
    if len(beyond):
        some, code = np.unique(chars[beyond], return_inverse=True)
        kind[beyond] = np.array([_kind(chr(c)) for c in some.tolist()], np.uint8)[code]
    keep = kind > 0
    offsets = np.r_[0, np.cumsum(keep)][np.r_[0, np.cumsum(sizes)]]
    chars, kind = chars[keep], kind[keep]

    def runs(letters):
        edge = np.diff(np.r_[0, letters.astype(np.int8), 0])
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    letters = kind == 1
    starts, ends = runs(letters)
    if len(starts) > 1:  # join single letters: the white space between two of one text goes
        single = ends - starts == 1
        text = np.searchsorted(offsets, starts, side="right")
        joined = np.flatnonzero(single[:-1] & single[1:] & (text[:-1] == text[1:]))
        if len(joined):
            gap = np.zeros(len(chars) + 1, np.int64)
            gap[ends[joined]] += 1
            gap[starts[joined + 1]] -= 1
            keep = np.cumsum(gap[:-1]) == 0
            offsets = np.r_[0, np.cumsum(keep)][offsets]
            chars, letters = chars[keep], letters[keep]
            starts, ends = runs(letters)
    at, length = np.searchsorted(starts, offsets), ends - starts
    marked = np.full(int(length.sum()) + 2 * len(starts), ord("^"), "<u4")
    begin = np.cumsum(length + 2) - length - 2
    marked[np.arange(int(length.sum())) + np.repeat(2 * np.arange(len(starts)) + 1, length)] = gather(chars, starts, length)
    marked[begin + length + 1] = ord("$")
    starts, ends = begin, begin + length + 2
    windows = 1 + np.maximum(0, -(-(length + 2 - PIECE) // PIECE_STEP))
    if len(windows) and windows.max() > 1:
        own = np.repeat(np.arange(len(starts)), windows)
        starts = starts[own] + PIECE_STEP * (np.arange(len(own)) - np.repeat(np.cumsum(windows) - windows, windows))
        ends = np.minimum(starts + PIECE, ends[own])
        at = np.r_[0, np.cumsum(windows)][at]
    return Words(marked, starts, ends, at)


def subsequences(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, slot, weight) of every counted subsequence of all words, weights already divided by the norms."""
    size = words.ends - words.starts
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(owner)) - first[owner]
    chars = gather(words.chars, words.starts, size).astype(np.uint64)
    norm = np.zeros(len(size))
    for a, b in _GAPS:
        norm += np.maximum(0, size - a - b) * DECAY ** (2 * (a + b + 1))
    norm = np.sqrt(np.maximum(norm, 1e-12))
    parts = []
    for a, b in _GAPS:
        i = np.flatnonzero(place + a + b < size[owner])
        parts.append((owner[i], subsequence_slot(chars[i], chars[i + a], chars[i + a + b]), DECAY ** (a + b + 1) / norm[owner[i]]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def subsequence_slot(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The slot of three letters."""
    code = mix64(x * np.uint64(0x100000001B3) + y * np.uint64(0x1F123BB5159A55E5) + z * np.uint64(0xC2B2AE3D27D4EB4F))
    return (code & np.uint64(SLOTS - 1)).astype(np.int64)


def decisions(words: Words, weights: list[np.ndarray]) -> list[np.ndarray]:
    """The decision values of each word under several functions."""
    out = [np.full(len(words.starts), BIAS) for _ in weights]
    for begin in range(0, len(words.starts), 2048):
        some = slice(begin, begin + 2048)
        word, slot, weight = subsequences(words.some(some))
        for values, w in zip(out, weights, strict=True):
            values[some] += np.bincount(word, w[slot] * weight, minlength=len(values[some]))
    return out


def decision(words: Words, weights: np.ndarray) -> np.ndarray:
    """The SVM's decision value of each word."""
    return decisions(words, [weights])[0]


def _kernel_matrix(words: Words, landmarks: Words) -> tuple[np.ndarray, list]:
    """Kernel values of all words with all landmarks, and the landmarks' subsequences (slots, weights)."""
    mark, slot, weight = subsequences(landmarks)
    at = np.searchsorted(mark[np.argsort(mark, kind="stable")], np.arange(len(landmarks.starts) + 1))
    order = np.argsort(mark, kind="stable")
    slot, weight = slot[order], weight[order]
    features = [(slot[a:b], weight[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    used = np.unique(slot)
    row = np.full(SLOTS, len(used))
    row[used] = np.arange(len(used))
    dense = np.zeros((len(used) + 1, len(features)), np.float32)
    for j, (s, v) in enumerate(features):
        np.add.at(dense[:, j], row[s], v)
    out = np.zeros((len(words.starts), len(features)))
    for begin in range(0, len(out), 512):
        some = slice(begin, begin + 512)
        word, s, v = subsequences(words.some(some))
        at_row = row[s]
        hit = at_row < len(used)
        counts = np.zeros((len(out[some]), len(used) + 1), np.float32)
        np.add.at(counts, (word[hit], at_row[hit]), v[hit])
        out[some] = counts @ dense
    return out, features


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Squared-hinge linear SVM with decision value x @ w + BIAS, by Newton steps on the active set."""
    ridge = np.eye(x.shape[1])
    w = np.zeros(x.shape[1])
    active = np.ones(len(x), bool)
    for _ in range(rounds):
        xa = x[active] * cost[active, None]
        w = np.linalg.solve(ridge + xa.T @ x[active], xa.T @ (y[active] - BIAS))
        now = y * (x @ w + BIAS) < 1
        if (now == active).all():
            break
        active = now
    return w


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    shift: float

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -40, 40)))


def _pairs(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (left, right), right < n, in order."""
    both = np.unique(left.astype(np.int64) * n + right)
    return both // n, both % n


def _first_of_kind(docs: np.ndarray, words: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Whether a text is no near copy of an earlier one of its label, by six triples of min-hashes over its rarer words.

    Near copies would count their words as often; this only thins out training rows.
    """
    out = np.ones(len(labels), bool)
    often = np.bincount(words) if len(words) else np.zeros(0, np.int64)
    rare = often[words] <= max(2, 0.01 * len(labels))
    some, begin = np.unique(docs[rare], return_index=True)
    if not len(some):
        return out
    rare_words = words[rare].astype(np.uint64)
    for band in range(6):
        keys = np.zeros((len(some), 4), np.uint64)
        keys[:, 0] = labels[some]
        for k in range(3):
            keys[:, k + 1] = np.minimum.reduceat(mix64(rare_words + np.uint64((3 * band + k + 1) << 40)), begin)
        _, first = np.unique(keys, axis=0, return_index=True)
        later = np.ones(len(some), bool)
        later[first] = False
        out[some[later]] = False
    return out


def _vocabulary(texts: list[str]) -> tuple[Words, np.ndarray, np.ndarray]:
    """All distinct words, and the distinct (text, word number) pairs in order."""
    number: dict[bytes, int] = {}
    docs, ids = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for begin in range(0, len(texts), 256):
        words = cut_words(texts[begin : begin + 256])
        first, code = words.distinct()
        known = np.array([number.setdefault(n, len(number)) for n in words.some(first).names()], np.int64)
        d, w = _pairs(np.repeat(np.arange(len(words.at) - 1), np.diff(words.at)), known[code], max(1, len(number)))
        docs.append((d + begin).astype(np.int32))
        ids.append(w.astype(np.int32))
    ends = np.cumsum([len(n) // 4 for n in number], dtype=np.int64)
    distinct = Words(np.frombuffer(b"".join(number), "<u4"), np.r_[0, ends[:-1]][: len(number)].astype(np.int64), ends, np.array([0, len(number)]))
    return distinct, np.concatenate(docs), np.concatenate(ids)


def mean_discriminants(words: Words, docs: np.ndarray, ids: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """For each fold the weights of the subsequences that tell the mean embedding of the other folds' toxic sentences from that
    of their clean ones.

    A sentence's embedding is the mean of its words'.  The difference of a subsequence's two means is divided by their
    pooled mean, to which the variance of a rare event is proportional.
    """
    share = 1.0 / np.bincount(docs, minlength=len(labels))[docs]
    parts = [(labels[docs] == y) & (fold != f) for f in range(FOLDS) for y in (0, 1)]
    each = [np.bincount(ids[p], share[p], minlength=len(words.starts)) / share[p].sum() for p in parts]
    mean = np.zeros((len(parts), SLOTS))
    for begin in range(0, len(words.starts), 2048):
        some = slice(begin, begin + 2048)
        word, slot, weight = subsequences(words.some(some))
        for m, e in zip(mean, each, strict=True):
            m += np.bincount(slot, weight * e[some][word], minlength=SLOTS)
    pooled = (mean[0::2] + mean[1::2]) / 2
    return [(toxic - clean) / (p + p[p > 0].mean()) for clean, toxic, p in zip(mean[0::2], mean[1::2], pooled, strict=True)]


def _train_words(distinct: Words, witness: np.ndarray, stands_for: np.ndarray, pool: np.ndarray, in_clean: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Weights of the subsequences of an SVM between witnesses and words of clean sentences.

    The clean words are the most common ones, those with the largest present values and others of pool, which is in random order.
    """
    common = pool[np.argsort(-in_clean[pool], kind="stable")][: NEGATIVE_WORDS // 4]
    hard = pool[np.argsort(-value[pool], kind="stable")][: NEGATIVE_WORDS // 2]
    negative = np.setdiff1d(np.r_[common, hard, pool[: NEGATIVE_WORDS // 4]], witness[in_clean[witness] == 0])
    half = LANDMARKS // 2
    marks = np.unique(np.r_[witness[:half], hard[: half // 2], pool[: LANDMARKS - half - half // 2]])
    k_nm, features = _kernel_matrix(distinct.some(np.r_[witness, negative]), distinct.some(marks))
    k_mm, _ = _kernel_matrix(distinct.some(marks), distinct.some(marks))
    spread, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
    ok = spread > 1e-6 * spread.max()
    root = vector[:, ok] / np.sqrt(spread[ok])
    y = np.r_[np.ones(len(witness)), -np.ones(len(negative))]
    cost = COST * np.r_[stands_for * (len(negative) / stands_for.sum()), in_clean[negative] / in_clean[negative].mean()]
    alpha = root @ _svm(k_nm @ root, y, cost)
    out = np.zeros(SLOTS)
    for a, (s, v) in zip(alpha, features, strict=True):
        np.add.at(out, s, a * v)
    return out


def _tops(docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of equal docs the largest value, and where it is met first."""
    begin = np.flatnonzero(np.diff(docs, prepend=-1))
    if not len(begin):
        return np.zeros(0), np.zeros(0, np.int64)
    top = np.maximum.reduceat(values, begin)
    hit = np.flatnonzero(values == np.repeat(top, np.diff(np.r_[begin, len(docs)])))
    return top, hit[np.searchsorted(hit, begin)]


def fit(texts: list[str], labels: list[int], weights: list[float] | None = None) -> Model | None:
    """The model of labelled sentences, or None where they don't have both labels or too few of one.

    Witnesses are chosen by a function that was trained on the other FOLDS, so a word that is rare by chance can't vouch
    for itself.  A toxic sentence whose witness isn't above the largest words of all but CALM of the clean sentences
    of its fold has no witness in that turn.
    """
    weights = weights or [1.0] * len(texts)
    y_doc = np.array(labels, np.int64)
    distinct, all_docs, all_ids = _vocabulary(texts)
    keep = _first_of_kind(all_docs, all_ids, y_doc)[all_docs]
    docs, ids = all_docs[keep], all_ids[keep]
    toxic, fold = y_doc[docs] == 1, (mix64(np.arange(len(texts), dtype=np.uint64)) % np.uint64(FOLDS)).astype(np.int64)[docs]
    if any(not (toxic[fold == f] == y).any() for f in range(FOLDS) for y in (True, False)):
        return None
    shuffled = np.argsort(mix64(np.arange(len(distinct.starts), dtype=np.uint64)))
    clean = [np.bincount(ids[~toxic & (fold == f)], minlength=len(distinct.starts)) for f in range(FOLDS)]
    everywhere = sum(clean)
    pool = shuffled[everywhere[shuffled] > 0]
    out = mean_discriminants(distinct, docs, ids, y_doc, fold)
    for _ in range(TURNS):
        values, chosen = decisions(distinct, out), []
        for f in range(FOLDS):
            bad, good = toxic & (fold == f), ~toxic & (fold == f)
            calm = np.quantile(_tops(docs[good], values[f][ids[good]])[0], 1 - CALM)
            top, at = _tops(docs[bad], values[f][ids[bad]])
            chosen.append(ids[bad][at[top > calm]])
        if not any(map(len, chosen)):
            return None

        def trained(folds: list[int], value: np.ndarray, now: list[np.ndarray] = chosen) -> np.ndarray:
            some = np.concatenate([now[f] for f in folds])
            some = some if len(some) else np.concatenate(now)
            witness, stands_for = np.unique(some, return_counts=True)
            order = np.argsort(-stands_for, kind="stable")
            in_clean = sum(clean[f] for f in folds)
            return _train_words(distinct, witness[order], stands_for[order], shuffled[in_clean[shuffled] > 0], in_clean, value)

        out = [trained([g for g in range(FOLDS) if g != f], values[f]) for f in range(FOLDS)]
    last = decision(distinct, sum(out) / FOLDS)
    for _ in range(3):
        weight = trained(list(range(FOLDS)), last)
        last = decision(distinct, weight)
    best = text_values(np.searchsorted(all_docs, np.arange(len(texts) + 1)), last[all_ids])
    slope, shift = _logistic(best, y_doc.astype(float), np.array(weights))
    return Model(weight.astype(np.float32), slope, shift)


def text_values(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The largest of each text's values, which begin at `at`; LEAST for texts without any."""
    out = np.full(len(at) - 1, LEAST)
    some = np.flatnonzero(np.diff(at) > 0)
    if len(some):
        out[some] = np.clip(np.maximum.reduceat(values, at[some]), LEAST, -LEAST)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Platt's curve: slope and shift of the log-odds, with a small ridge so that it exists for separable data."""
    z = np.c_[x, np.ones(len(x))]
    w = np.array([1.0, 0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (weight * (p - y)) + np.array([1e-2, 1e-4]) * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag([1e-2, 1e-4]) + 1e-9 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 4.0 / np.abs(step).max()) if np.abs(step).max() else 0
    return float(max(w[0], 1e-3)), float(w[1])


def held_out(doc_id: Column) -> Column:
    """Whether a row's labels are out of the training fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN, chars: int = SAMPLE_CHARS) -> Model | None:
    """Fit on a bounded sample of the labelled rows that aren't held out.

    A doc_id that has both labels counts as toxic.  Of the chosen rows, in order of their hashes, those beyond so many characters
    together (or the first alone) stay out.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for label, most in ((1, toxic), (0, clean)):
        part = labels.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    found = cut(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    sized = found.select("doc_id", F.length("text").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    small = found.join(F.broadcast(sized.where((F.col("before") + F.col("n") <= chars) | (F.col("before") == 0)).select("doc_id")), "doc_id", "left_semi")
    rows = small.select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: r.doc_id)
    scale = {1: max(1.0, sizes.get(1, 0) / toxic), 0: max(1.0, sizes.get(0, 0) / clean)}
    return fit([r.text for r in rows], [r.toxic for r in rows], [scale[r.toxic] for r in rows])


class Scorer:
    """Scores texts with a model, with a bounded cache of word values for the life of a worker."""

    def __init__(self, model: Model) -> None:
        self.model, self.cache = model, {}

    def scores(self, texts: list[str]) -> np.ndarray:
        words = cut_words(texts)
        first, code = words.distinct()
        keys = words.some(first).names()
        values = list(map(self.cache.get, keys))
        missing = [i for i, v in enumerate(values) if v is None]
        if missing:
            if len(self.cache) + len(missing) > CACHE_WORDS:
                self.cache.clear()
            for i, v in zip(missing, decision(words.some(first[missing]), self.model.weights).tolist(), strict=True):
                values[i] = self.cache[keys[i]] = v
        each = np.array(values, float)[code] if keys else np.zeros(0)
        return self.model.probability(text_values(words.at, each))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model) if model is not None else None
        for batch in batches:
            out = []
            texts: list[str] = []
            size = 0
            for text in batch.column(1):
                text = text.as_py() or ""
                texts.append(text)
                size += len(text)
                if size >= BLOCK_CHARS:
                    out.append(scorer.scores(texts) if scorer else np.zeros(len(texts)))
                    texts, size = [], 0
            if texts:
                out.append(scorer.scores(texts) if scorer else np.zeros(len(texts)))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): doc_id, held_out, score, predicted.

    labels(doc_id, toxic, ...) is used only where crc32(doc_id as text) mod 5 isn't 0; of docs only text is an input of
    a score.  held_out is that remainder being 0 (true for a null doc_id).  Null and empty texts get the score of a text
    without words.  Where the labels don't have both classes every score is 0.  Repeated rows come out as often as they
    came in; other columns are ignored; an empty table gives an empty table; predicted is 1 from a score of 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id").cast("long")).alias("held_out"))
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose text is predicted toxic; all columns stay as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return small_batches(docs).mapInArrow(_keep_clean(model, docs.columns.index("text")), docs.schema)


def _keep_clean(shared, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value) if shared.value is not None else None
        for batch in batches:
            if scorer is None:
                yield batch
                continue
            texts = [t or "" for t in batch.column(column).to_pylist()]
            keep = np.zeros(len(texts), bool)
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= BLOCK_CHARS or i + 1 == len(texts):
                    keep[start : i + 1] = scorer.scores(texts[start : i + 1]) < 0.5
                    start, size = i + 1, 0
            yield batch.filter(pa.array(keep))

    return run
