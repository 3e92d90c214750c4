"""Properties of key, box and planning operators against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from zetamill.functions import encoding
from zetamill.operators import keys, lookup, segments, spatial


def bit_keys(n, bits, seed):
    rng = random.Random(seed)
    return sorted({format(rng.getrandbits(bits) & rng.choice([(1 << bits) - 1, 0xF0F0F0]), f"0{bits}b") for _ in range(n)})


def table(spark, ks):
    return spark.createDataFrame([(k,) for k in ks], "k string").repartition(3)


def test_disjoint_ranges_cover_the_whole(spark):
    ks = bit_keys(300, 24, 1)
    t = table(spark, ks).cache()
    edges = ["0" * 24, *[format(i << 21, "024b") for i in range(1, 8)], None]
    parts = [(i, lo, format(int(hi, 2) - 1, "024b") if hi else "1" * 24) for i, (lo, hi) in enumerate(zip(edges, edges[1:]))]
    got = lookup.lex_range_batch(t, spark.createDataFrame(parts, "qid int, lo string, hi string"), prefix=8).collect()
    assert sorted(r.k for r in got) == ks
    assert all(parts[r.qid][1] <= r.k <= parts[r.qid][2] for r in got)
    narrow = [(i, ks[i], ks[i + 3]) for i in range(0, len(ks) - 3, 17)]
    got = lookup.lex_range_batch(t, spark.createDataFrame(narrow, "qid int, lo string, hi string"), prefix=12)
    assert sorted(map(tuple, got.collect())) == sorted((q, k) for q, lo, hi in narrow for k in ks if lo <= k <= hi)


def test_box_by_key_equals_box_and_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, size=(400, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumn("k", encoding.morton_key(F.col("embedding"), 5))
    for q in range(12):
        a, b = x[q], x[q + 50]
        lo, hi = (np.minimum(a, b), np.maximum(a, b)) if q % 2 else (a - np.float32(0.4), a + np.float32(0.4))
        want = np.flatnonzero(((x >= lo) & (x <= hi)).all(axis=1)).tolist()
        for found in (spatial.box(df, lo.tolist(), hi.tolist()), spatial.box_by_key(df, lo.tolist(), hi.tolist(), 5)):
            assert sorted(r.vec_id for r in found.collect()) == want
    assert spatial.box_by_key(df, [100.0] * 5, [101.0] * 5, 5).count() == 0
    assert spatial.box_by_key(df, [-9.0] * 5, [9.0] * 5, 5).count() == 400


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    d = np.sqrt(((x - x[3]).astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)
    assert [r.vec_id for r in spatial.nearest(df, x[3].tolist(), 9).collect()] == np.lexsort((np.arange(200), d))[:9].tolist()
    assert spatial.nearest(df, x[3].tolist(), 500).count() == 0 and spatial.nearest(df.unionByName(df.withColumn("vec_id", F.col("vec_id") + 1000)), x[3].tolist(), 200).count() == 200


def test_exact_match_queries_match_exactly(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = spatial.exact_match_queries(df, 80, 2, 6, seed=1).collect()
    assert len(got) == 6
    for r in got:
        assert ((x[:80] >= np.array(r.lo, np.float32)) & (x[:80] <= np.array(r.hi, np.float32))).all(axis=1).sum() == 2


def test_exact_match_queries_search_all_rows_and_fail_aloud(spark):
    # 900 rows at one place and few others: most draws hold too many.
    x = [[0.0, 0.0]] * 900 + [[float(i), float(i % 3)] for i in range(1, 61)]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")
    got = spatial.exact_match_queries(df, None, 2, 6, seed=1).collect()
    assert len(got) == 6 and sum(r.retries + 1 for r in got) > 400
    assert all(sum(r.lo[0] <= a <= r.hi[0] and r.lo[1] <= b <= r.hi[1] for a, b in x) == 2 for r in got)
    with pytest.raises(ValueError, match="attempts"):
        spatial.exact_match_queries(df, 900, 2, 1, seed=1, attempts=100)


def features_of(ks, start, widths):
    n = len(ks)
    out = {}
    for w in widths:
        s = [k[start : start + w] for k in ks]
        kmax = n if w >= 62 else min(n, 1 << w)
        out[w] = (len(set(s)), sum(a != b for a, b in zip(s, s[1:])), len(set(s)) / kmax)
    return out


def test_features_and_greedy_plan_equal_a_model(spark):
    ks = bit_keys(150, 24, 8)
    t = table(spark, ks)
    got = {r.width: (r.cardinality, r.changes, r.rho) for r in segments.features(segments.with_previous(t), len(ks), 4, [1, 3, 8]).collect()}
    assert got == features_of(ks, 4, [1, 3, 8])
    for threshold in (0.3, 0.9):
        want, at = [], 0
        while at < 24:
            fitting = [w for w in (16, 8, 4, 2, 1) if w <= 24 - at]
            f = features_of(ks, at, fitting)
            want.append(next((w for w in fitting if f[w][2] <= threshold), fitting[-1]))
            at += want[-1]
        assert segments.greedy(t, 24, threshold, (1, 2, 4, 8, 16)) == want
    plan = segments.cost_aware(t, 24, 0.5, 2)
    assert segments.valid(plan, 24)


def test_choice_by_cost():
    class R:
        def __init__(self, width, cost, rho, adjacency_rate):
            self.width, self.cost, self.rho, self.adjacency_rate = width, cost, rho, adjacency_rate

    assert segments.choose_by_cost([R(4, 10.0, 0.9, 0.1), R(8, 5.0, 0.95, 0.1)], 0.5) == 4
    assert segments.choose_by_cost([R(4, 10.0, 0.3, 0.1), R(8, 20.0, 0.3, 0.1)], 0.5) == 4
    assert segments.choose_by_cost([R(4, 10.0, 0.3, 0.9), R(8, 10.1, 0.3, 0.9)], 0.5) == 4
    assert segments.choose_by_cost([R(4, 10.0, 0.1, 0.1), R(8, 10.1, 0.1, 0.1)], 0.5) == 8
    assert segments.choose_by_cost([R(4, 10.0, 0.2, 0.5), R(8, 10.1, 0.4, 0.5)], 0.5) == 4
    assert segments.choose_by_cost([R(8, -20.0, 0.3, 0.3), R(4, -20.5, 0.3, 0.3)], 0.5) == 4  # negative costs tie within 0.05 only
    assert segments.choose_by_cost([R(8, -20.0, 0.3, 0.9), R(4, -19.97, 0.3, 0.9)], 0.5) == 4


def test_plans():
    assert segments.uniform(24, 64) == [24, 24, 16]
    assert segments.phase_aware(100, widths=(16, 30, 7)) == [16, 4, 30, 20, 7, 7, 7, 7, 2]
    assert segments.phase_aware(0) == [] and not segments.valid([8, 0], 8) and segments.valid([3, 5], 8)


def test_target_unique_reads_on(spark):
    rows = [(i, [float(i // 2000), 0.0]) for i in range(30_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert keys.read_until_unique(df, 2, 5).count() >= 5
    assert keys.read_until_unique(df, 2, 1000).count() == 15


def test_dictionary(spark):
    e = lookup.dictionary(spark.createDataFrame([("apple", 1), ("apply", 5), ("apricot", 2), ("banana", 3), ("bandana", 4), ("", 9), ("bad", -1), ("a\0b", 1), ("apple", 0), (None, 3)], "k string, v int"), "k", "v")
    assert {r.key: r.value for r in e.collect()} == {"apple": 1, "apply": 5, "apricot": 2, "banana": 3, "bandana": 4}
    q = spark.createDataFrame([("apple",), ("app",), ("bandit",), ("zoo",)], "key string")
    assert {r.key: r.value for r in lookup.find(q, e).collect()} == {"apple": 1, "app": -1, "bandit": -1, "zoo": -1}
    assert {r.key: r.matched for r in lookup.matched_length(q, e).collect()} == {"apple": 5, "app": 3, "bandit": 4, "zoo": 0}
    ranked = lookup.complete_ranked(e, spark.createDataFrame([("ap",), ("b",)], "prefix string"), 2).collect()
    assert sorted((r.prefix, r["rank"], r.key) for r in ranked) == [("ap", 1, "apply"), ("ap", 2, "apricot"), ("b", 1, "bandana"), ("b", 2, "banana")]
    assert sorted(r.key for r in lookup.complete(e, "ban").collect()) == ["banana", "bandana"]


def test_box_batch_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    boxes = [(i, (x[i] - np.float32(0.2 * (i % 5 + 1))).tolist(), (x[i] + np.float32(0.5)).tolist()) for i in range(30)]
    boxes += [(30, [-np.inf] * 3, [np.inf] * 3), (31, [-50.0] * 3, [50.0] * 3), (32, [1.0] * 3, [0.5] * 3), (33, x[5].tolist(), x[5].tolist())]
    want = sorted((q, int(i)) for q, lo, hi in boxes for i in np.flatnonzero(((x >= np.array(lo, np.float32)) & (x <= np.array(hi, np.float32))).all(axis=1)))
    assert sorted(map(tuple, spatial.box_batch(df, spark.createDataFrame(boxes, "qid int, lo array<float>, hi array<float>")).collect())) == want


def test_cost_aware_plan_equals_a_model(spark):
    import math
    from types import SimpleNamespace

    ks = bit_keys(120, 24, 15)
    n, total, want, at = len(ks), 24, [], 0
    while at < total:
        rows = []
        for w in (2, 4, 8, 16):
            if w > total - at:
                continue
            cardinality, changes, rho = features_of(ks, at, [w])[w]
            p, a = cardinality / n, changes / (n - 1)
            clog2 = lambda v: 1 if v <= 1 else math.ceil(math.log2(v))
            cost = w / 8 + (clog2(total + 1) + clog2(w + 1) + 1) / 8 + 14 / w + (22 * rho + 12 * p + 10 * a) - (10 * (1 - rho) + 8 * (1 - p) + 8 * (1 - a))
            cost += (-0.10 if at / total < 0.20 or at / total > 0.70 else 0.15) * w
            rows.append(SimpleNamespace(width=w, cost=cost, rho=rho, adjacency_rate=a))
        want.append(segments.choose_by_cost(rows, 0.8) if rows else 1)
        at += want[-1]
    assert segments.cost_aware(table(spark, ks), total, 0.8, 2, (2, 4, 8, 16)) == want


def test_tightened_query_and_sample(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    low, high = spatial.tightened_query(df, x[0].tolist(), 1.5, 5, 30, seed=1)
    assert 5 <= spatial.box(df, low, high).count() <= 30
    one, two = (sorted(r.vec_id for r in spatial.sample_rows(df.repartition(n), 40, seed=6).collect()) for n in (1, 7))
    assert one == two and len(set(one)) == 40
