"""Exact top-k search by integer inner product with MaxScore pruning.

A vector's dimensions are the terms.  For a query, dimension d can add at most bound[d] = max over a shard's rows of
q[d] * x[d] (and never more than 0 where all its products are negative).  Sorted by bound, the dimensions whose bounds
together stay below the current k-th best score are non-essential: no row can enter the result by them
alone.  MaxScore goes through the postings of the essential dimensions for all rows, keeps rows that can still
reach the k-th score with the bounds of the rest, and probes the others dimension by dimension while
they are competitive.  The k-th score rises from block to block, and shards' lists are merged at the end.

Rows are dealt by a hash of their id to shards of about SHARD_ROWS rows and queries to blocks of about QUERY_ROWS; each
task sees one shard and one block of queries, so memory is bounded whatever the sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, QUERY_ROWS, BLOCK_ROWS = 8192, 1024, 1024
OUT = "query_id long, vec_id long, score long"


class Shard:
    """Rows of one shard in order of their ids; one contiguous posting array for each dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.postings = np.ascontiguousarray(rows[order].T)
        self.high, self.low = self.postings.max(axis=1), self.postings.min(axis=1)

    def search(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but the query's own; ties to the smaller id."""
        zero = q.dtype.type(0)
        bound = np.maximum(np.maximum(q * self.high, q * self.low), zero)
        order = np.argsort(bound, kind="stable")
        below = np.r_[zero, np.cumsum(bound[order])]  # below[i]: bound of the i least dimensions together
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, q.dtype)
        for start in range(0, len(self.ids), BLOCK_ROWS):
            ids = self.ids[start : start + BLOCK_ROWS]
            rows = np.flatnonzero(ids != query_id)
            full = len(best) == k
            least = best[-1] if full else None
            split = int(np.searchsorted(below, least, side="left")) - 1 if full else 0
            split = max(0, min(split, len(order)))
            partial = np.zeros(len(ids), q.dtype)
            for d in order[split:]:
                partial += q[d] * self.postings[d, start : start + BLOCK_ROWS]
            partial = partial[rows]
            for i in range(split - 1, -1, -1):
                if full:
                    alive = partial + below[i + 1] >= least
                    rows, partial = rows[alive], partial[alive]
                    if not len(rows):
                        break
                d = order[i]
                partial = partial + q[d] * self.postings[d, start + rows]
            if full:
                alive = partial >= least
                rows, partial = rows[alive], partial[alive]
            if len(rows):
                all_ids, scores = np.r_[best_ids, ids[rows]], np.r_[best, partial]
                top = np.lexsort((all_ids, -scores))[:k]
                best_ids, best = all_ids[top], scores[top]
        return best_ids, best


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows are filled with zeros."""
    values = column.combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    sizes = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy()
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _search(width: int, k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts: list = [[], [], []]
        if left.num_rows and right.num_rows:
            rows, queries = _matrix(left.column("v"), width), _matrix(right.column("v"), width)
            most = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0))), 1) * max(abs(int(queries.max(initial=0))), abs(int(queries.min(initial=0))), 1) * max(width, 1)
            exact = np.float64 if most < 1 << 52 else np.int64  # doubles are exact up to 2**53
            shard = Shard(left.column("vec_id").to_numpy(), rows.astype(exact))
            for query_id, q in zip(right.column("vec_id").to_pylist(), queries.astype(exact), strict=True):
                ids, scores = shard.search(query_id, q, k)
                for part, x in zip(parts, (np.full(len(ids), query_id), ids, scores.astype(np.int64)), strict=True):
                    part.append(x)
        columns = [pa.array(np.concatenate(p) if p else np.zeros(0, np.int64), pa.int64()) for p in parts]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v) of the rows that take part: floor(scale * x) of each component."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best other rows for every row where is_query holds.

    vectors(vec_id, embedding, ...); score is the inner product of the vectors' floor(scale * x), ties go to the smaller
    vec_id; fewer rows come out where there are fewer candidates.  Rows whose id or vector is null or has a null or
    non-finite component take no part.  A shorter vector is filled with zeros.  Rows with the query's own vec_id are no
    candidates; other repeated rows count as often as they come; a query that comes twice is asked once.  Other columns
    are ignored; an empty table gives an empty table.
    """
    rows = quantised(vectors, scale)
    queries = quantised(vectors.where(is_query), scale).dropDuplicates(["vec_id"])
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n_queries = queries.count()
    shards = max(1, -(-size.n // SHARD_ROWS))
    blocks = max(1, -(-n_queries // QUERY_ROWS))
    left = rows.select("*", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select("*", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(size.width or 0, k), OUT)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

