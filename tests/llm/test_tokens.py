import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from zetamill.llm import bpe_roundtrip, packing, token_counts
from zetamill.llm.units import load_tokenizer

ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n\nb", "a\nb", "don't we'll it's 's", "x  's", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>  <|startoftext|>b", "<|ENDOFTEXT|>",
    "é, è. à b c  d", "a  b  c", "　x 　 y", "a\x1c b\x85 c \x1fd", "1.5, 2,000; 3:4 v1.", "é ́x á, ́", "日本 語。 です", "🙂 🙂🙂  🙂\n🙂", "The THE the ß ẞ İ ΑΣ Σ", "tab\tsep\r\nline", "a,.;b .,c !?", "é,è. ×,÷. ñ! ÿ?x Ã¸:À;", "… a … b «é» c», d",
    "x" * 5000, "ab " * 20000, "w. " * 3000, "\u0000 a\u0000b", "'s'S 'RE", " ­ a ​ b", "﻿a ﻿ b",
]


def thue_morse(n, a="a", b="b"):
    """Two strings of n letters that collide under polynomial hashes modulo 2**64."""
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


#: Both of a pair in one text and in texts of their own, with their complements.
ADVERSE = [x for p in range(3, 14) for a, b in [thue_morse(1 << p), thue_morse(1 << p, "qz", "zq")] for x in (a, b, f"{a} {b}", f"{b} {a}.", f"{a.upper()}, {b}")]


def texts():
    rng = random.Random(5)
    alphabet = ["a", "b", "the", " ", " ", " ", "  ", "\n", "\n\n", "\t", ",", ".", "'s", "'", "é", "ß", " ", " ", "1", "23", "!", "<|endoftext|>", "🙂", "́", "Σ", "\x1d", "\u0085", "»"]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(800)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as n_tokens", "0 as start").repartition(3)


def corpus_rows(spark):
    rows = list(enumerate(texts() + ADVERSE))
    return [*rows, rows[5], (None, "null id")]


def test_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = corpus_rows(spark)
    tokenizer = load_tokenizer(path)
    want = sorted((-1 if i is None else i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False)), n > 1024) for i, t in rows)
    got = token_counts.count_tokens(frame(spark, rows), path).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.count_tokens(frame(spark, []), path).count() == 0


def test_roundtrip_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_roundtrip.read_ranks(path), special_tokens={})
    rows = corpus_rows(spark)
    want = []
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    got = bpe_roundtrip.encode_decode(frame(spark, rows), path, public_tokenizers.PATTERN, with_ids=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got) == sorted(want)


def check_pieces(rows, pieces, tokenizer, capacity):
    """Every id in exactly one piece, sequences gapless and within capacity; gives the padding."""
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[i])
            assert p.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids[i])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@pytest.mark.parametrize("capacity,block", [(2048, 1 << 18), (512, 4000)])
def test_packing(spark, capacity, block):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = list(enumerate(texts() * 3))
    pieces = packing.pack(frame(spark, rows), path, 1, capacity, block).collect()
    total = sum(p.length for p in pieces)
    assert check_pieces(rows, pieces, load_tokenizer(path), capacity) <= 0.02 * total + 3 * capacity
    assert packing.pack(frame(spark, []), path).count() == 0
    assert packing.pack(frame(spark, [(None, None)]), path).collect()[0].length == 1


def test_packing_of_units_that_break_polynomial_hashes(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = list(enumerate(ADVERSE))
    check_pieces(rows, packing.pack(frame(spark, rows), path).collect(), load_tokenizer(path), 2048)


def test_cuts_are_optimal():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([8, 16, 32])
        positions = [0]
        for _ in range(rng.randint(1, 14)):
            positions.append(positions[-1] + rng.randint(1, capacity))
        penalties = [0] + [rng.choice([0, 4, 48]) for _ in positions[1:]]
        best = [0] + [10**9] * (len(positions) - 1)
        for j in range(1, len(positions)):
            for i in range(j):
                size = positions[j] - positions[i]
                if size <= capacity:
                    best[j] = min(best[j], best[i] + penalties[j] + (0 if size & (size - 1) == 0 and size >= 4 else capacity - size))
        ends = packing.choose_cuts(positions, penalties, capacity, 4)
        cost, before = 0, 0
        for j in ends:
            size = positions[j] - positions[before]
            assert size <= capacity
            cost += penalties[j] + (0 if size & (size - 1) == 0 and size >= 4 else capacity - size)
            before = j
        assert before == len(positions) - 1 and cost == best[-1]
