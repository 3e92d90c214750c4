import numpy as np
import pytest
from pyspark.sql import functions as F

from zetamill.llm import topk_search


def brute(rows, every, k):
    good = [(i, np.floor(1024 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in {i: q for i, q in reversed(good) if i % every == 0}.items():
        scored = sorted((-int((q * x).sum()), j) for j, x in good if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_equals_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD_ROWS", 300)
    monkeypatch.setattr(topk_search, "QUERY_ROWS", 5)
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=6) * scale * rng.choice([0.01, 1, 3])).astype(np.float32).tolist()) for i in range(900)]
    rows += [(900 + i, rows[0][1]) for i in range(60)] + [(1000, None), (1010, [None] * 6), (1020, [float("nan")] * 6), (1030, [float("inf")] * 6), (None, rows[1][1]), rows[3], (1040, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as shard").repartition(3)
    got = topk_search.top_k(df, F.col("vec_id") % 10 == 0, 10)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, 10)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (5, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.top_k(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 5, 2 * 1024 * 1024)]
    assert topk_search.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert topk_search.top_k(df, F.col("vec_id") == 77).count() == 0
