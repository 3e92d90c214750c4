import random
import re

import numpy as np
import pytest

from zetamill.llm.components import connected_components
from zetamill.llm.minhash_dedup import COORDINATES, _only, _stars, drop_near_duplicates, links_between, near_duplicates, sketch
from zetamill.llm.textkernel import mix64

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def shingles(text, k):
    words = WORD.findall((text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(rows[a][0]), find(rows[b][0])
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for (i, _), s in zip(rows, sets)}


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 30, 60, 200]))))
    return texts


@pytest.mark.parametrize("k,chunk_bytes,chunk_rows,sketch_rows", [(5, 4_000_000, 512, 1024), (2, 2_000, 512, 8), (2, 4_000_000, 6, 5)])
def test_components_equal_brute_force(spark, k, chunk_bytes, chunk_rows, sketch_rows):
    rows = list(enumerate(corpus(260, k)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, 80, chunk_bytes, chunk_rows, sketch_rows).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Alone"), (5, "aLONE"), (6, "é É"), (7, "é É"), (7, "é É"), (None, "é É"), (8, "x " * 30000), (9, "alone alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as comp", "'x' as rep", "2 as bands")
    got = near_duplicates(df, 2).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, 1, 6, False), (None, 1, None, True), (8, 1, 8, True), (9, 1, 9, True)}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string"), 2).count() == 0


def test_sketch_estimates_similarity():
    items = mix64(np.arange(2000, dtype=np.uint64))
    for n in (3, 40, 1000):
        a, b = np.sort(items[:n]), np.sort(items[n // 3 : n + n // 3])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sketch(a) == sketch(b)).mean() - true) < 5 * (true * (1 - true) / COORDINATES) ** 0.5 + 0.02
        assert (sketch(a) != np.iinfo(np.uint64).max).all()


def thue_morse(n, a="a", b="b"):
    """Two strings of n letters that collide under polynomial hashes modulo 2**64."""
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


def test_words_that_break_polynomial_hashes(spark):
    rows = []
    for p in range(6, 14):
        a, b = thue_morse(1 << p)
        rows += [(10 * p, a), (10 * p + 1, b), (10 * p + 2, a + " x"), (10 * p + 3, b + " x"), (10 * p + 4, a.upper())]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2)


def test_many_short_near_copies():
    rng = np.random.default_rng(4)
    base = np.sort(mix64(np.arange(31, dtype=np.uint64)))
    sets = [np.unique(np.r_[base[: 31 - i % 2], mix64(rng.integers(1 << 40, size=1, dtype=np.uint64))]) for i in range(4000)]
    assert len(links_between(sets, len(sets), 80)) == len(sets) - 1


def test_a_large_family_in_small_chunks(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:30], f"own{i}", *words[30:]])) for i in range(1500)] + [(2000 + i, " ".join(rng.sample(words, 40))) for i in range(100)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80, chunk_rows=64, sketch_rows=64).collect()}
    assert all(got[i] == 0 for i in range(1500)) and all(got[i] == i for i in range(2000, 2100))


def test_columns_with_clashing_names(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, "other words altogether here now", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __kept string").selectExpr("*", "1 as rep", "2 as load", "'q' as kept", "3 as group")
    out = drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]
    assert drop_near_duplicates(df.limit(0)).count() == 0


def test_filter_before_dealing_loses_no_row(spark):
    loads = spark.range(-30_000, 30_000).selectExpr("id as rep", "cast(id as string) as load").unionByName(spark.createDataFrame([(None, "n"), (1 << 62, "m")], "rep long, load string"))
    wanted = {*range(-29_999, 30_000, 7), 1 << 62}
    got = _only(loads, spark.createDataFrame([(i,) for i in wanted], "rep long").repartition(5)).collect()
    assert wanted <= {r.rep for r in got} and len(got) < len(wanted) + 200 and all(r.load == ("m" if r.rep == 1 << 62 else str(r.rep)) for r in got)
    assert _only(loads, spark.createDataFrame([], "rep long")).count() == 0


def least_reachable(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(3)
    chain = list(range(1000, 1064))
    rng.shuffle(chain)
    edges = [*zip(chain, chain[1:]), *[(rng.randrange(300), rng.randrange(300)) for _ in range(170)], (-5, 400), (401, 401), *[(500, i) for i in range(501, 560)]]
    got = connected_components(spark.createDataFrame([*edges, *edges[:9], (None, 3), (4, None)], "a long, b long")).collect()
    want = least_reachable([e for e in edges if e[0] != e[1]])
    assert len(got) == len(want) and {r.node: r.component for r in got} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_join_what_pairs_join():
    rng = np.random.default_rng(5)
    reps = rng.permutation(400) * 3 - 50
    for pairs in (rng.integers(0, 400, (180, 2)), np.c_[np.arange(399), np.arange(1, 400)], np.zeros((0, 2), np.int64)):
        a, b = _stars(pairs, reps)
        assert dict(zip(a.tolist(), b.tolist())) == least_reachable(reps[pairs].tolist())
