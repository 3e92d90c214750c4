"""Boxes, nearest neighbours, bounds and the making of range queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zetamill.functions.encoding import inside, morton_key, squared_distance


def array_of(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)).cast("float") for v in values])


def box(vectors: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """Vectors inside an inclusive box.

    The first components' bounds are scalar conditions of their own: cheap, and first to be evaluated.
    """
    first = [F.col("embedding")[i].between(F.lit(float(low[i])).cast("float"), F.lit(float(high[i])).cast("float")) for i in range(min(2, len(low)))]
    for condition in first:
        vectors = vectors.where(condition)
    return vectors.where(inside(F.slice("embedding", 1, len(low)), array_of(low), array_of(high)))


def box_by_key(keyed: DataFrame, low: list[float], high: list[float], dims: int) -> DataFrame:
    """Box search over keyed(k, embedding): z-order bounds prune (a pushed-down BETWEEN), the box decides.

    Keys must be made without shift.
    """
    spark = keyed.sparkSession
    bounds = spark.createDataFrame([(list(map(float, low)), list(map(float, high)))], "lo array<float>, hi array<float>")
    z = bounds.select(morton_key(F.col("lo"), dims).alias("a"), morton_key(F.col("hi"), dims).alias("b")).first()
    return box(keyed.where(F.col("k").between(F.lit(bytes(z.a)), F.lit(bytes(z.b)))), low, high)


def box_batch(vectors: DataFrame, queries: DataFrame, most_cells: int = 16) -> DataFrame:
    """(qid, vec_id) for all boxes of queries(qid, lo, hi).

    The first component's axis is cut into cells of the boxes' median width there; a box is joined by the cells that
    it touches, an equi-join, and then tested whole.  Only boxes that touch more than most_cells cells (or are
    infinite) are joined by their condition alone.
    """
    low, high, x = F.col("lo")[0].cast("double"), F.col("hi")[0].cast("double"), F.col("embedding")[0].cast("double")
    width = queries.agg(F.percentile_approx(high - low, 0.5)).first()[0]
    whole = inside(F.col("embedding"), F.col("lo"), F.col("hi"))
    if width is None or not 0 < width < float("inf"):
        return vectors.join(queries, whole).select("qid", "vec_id")
    finite = (F.abs(low) < 1e15 * width) & (F.abs(high) < 1e15 * width)
    narrow = F.coalesce(finite & (F.floor(high / width) - F.floor(low / width) < most_cells), F.lit(False))
    cells = queries.where(narrow & (low <= high)).withColumn("cell", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    placed = vectors.where(F.abs(x) < 1e15 * width).withColumn("cell", F.floor(x / width))
    by_cell = placed.join(cells, "cell").where(whole).select("qid", "vec_id")
    return by_cell.unionByName(vectors.join(queries.where(~narrow), whole).select("qid", "vec_id"))


def distinct_points(vectors: DataFrame) -> DataFrame:
    """One row, that of the least vec_id, for each distinct point.

    Points are grouped by 128 bits of their values; a hash of a float array is that of its bits but for -0.0, which is 0.0.
    """
    digest = (F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding"))
    return vectors.groupBy(digest[0].alias("h1"), digest[1].alias("h2")).agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("p")).select("p.*")


def nearest(vectors: DataFrame, point: list[float], k: int) -> DataFrame:
    """The k nearest distinct points by Euclidean distance (float), ties by vec_id: a distributed top-k.

    A point that several rows hold counts once, with its least vec_id.  Nothing comes out where there are fewer than k points.
    """
    distance = F.sqrt(squared_distance(F.col("embedding"), array_of(point))).cast("float")
    found = distinct_points(vectors).select("vec_id", distance.alias("distance")).orderBy("distance", "vec_id").limit(k)
    enough = F.count("*").over(Window.partitionBy()) >= k  # of the k rows at most that the limit left
    return found.withColumn("__enough", enough).where("__enough").drop("__enough")


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, blocks: int = 0, block_rows: int = 1024) -> DataFrame:
    """(qid, rank, vec_id, distance) of the k nearest distinct points of each of queries(qid, point).

    A stated set of queries against all rows, in blocks: queries are sent in blocks of about block_rows to the tasks that hold
    the rows, which compute a block's distances as matrices and keep the k best of each query before anything is shuffled.
    """
    n = queries.count()
    blocks = blocks or max(1, -(-n // block_rows))
    packed = queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).groupBy("block").agg(F.collect_list(F.struct("qid", "point")).alias("queries"))
    # A block has about block_rows queries, and so has a bounded size; there is one row for each block.
    near = None
    for block in packed.toLocalIterator():
        ids = np.array([q.qid for q in block.queries], np.int64)
        points = np.array([q.point for q in block.queries], np.float32)
        part = distinct_points(vectors).mapInArrow(_nearest_of(ids, points, k), "qid long, vec_id long, distance float")
        near = part if near is None else near.unionByName(part)
    if near is None:
        return vectors.sparkSession.createDataFrame([], "qid long, rank int, vec_id long, distance float")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "vec_id", "distance")


def _nearest_of(ids: np.ndarray, points: np.ndarray, k: int):
    def run(batches):
        best_d, best_v = np.full((len(ids), 0), np.inf, np.float32), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            vec = batch.column(0).to_numpy()
            strip = max(1, (1 << 22) // max(1, rows.shape[1] * len(ids)))
            for begin in range(0, len(vec), strip):
                x, v = rows[begin : begin + strip], vec[begin : begin + strip]
                square = ((x[None, :, :] - points[:, None, :]).astype(np.float64) ** 2).sum(axis=2)
                d = np.concatenate([best_d, np.sqrt(square).astype(np.float32)], axis=1)
                w = np.concatenate([best_v, np.broadcast_to(v, (len(ids), len(v)))], axis=1)
                order = np.lexsort((w, d), axis=1)[:, :k]
                best_d, best_v = np.take_along_axis(d, order, 1), np.take_along_axis(w, order, 1)
        if best_d.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_d.shape[1])), pa.array(best_v.ravel()), pa.array(best_d.ravel())], names=["qid", "vec_id", "distance"])

    return run


def bounds(vectors: DataFrame) -> DataFrame:
    """(dim, lo, hi) over all vectors."""
    flat = vectors.select(F.posexplode("embedding").alias("dim", "x"))
    return flat.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def half_range(vectors: DataFrame) -> DataFrame:
    """The largest half width of any dimension, as one row."""
    return bounds(vectors).agg(F.max((F.col("hi") - F.col("lo")) / F.lit(2.0).cast("float")).alias("radius"))


def dimension_order(limits: DataFrame) -> DataFrame:
    """limits(dim, lo, hi) with the rank of each dimension by width, ties by number."""
    width = F.col("hi") - F.col("lo")
    return limits.select("dim", width.alias("width"), F.row_number().over(Window.orderBy(width, "dim")).alias("place"))


def sample_rows(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows drawn without replacement, the same for the same seed: those with the least hashes of seed and id."""
    return vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(n)


def count_in_prefix(vectors: DataFrame, low: list[float], high: list[float], n: int, stop: int | None = None) -> DataFrame:
    """How many of the first n vectors (by vec_id) lie in a box; counting ends after stop + 1 where stop is given."""
    hits = box(vectors.where(F.col("vec_id") < n), low, high)
    return (hits if stop is None else hits.limit(stop + 1)).agg(F.count("*").alias("n_matches"))


def exact_match_queries(vectors: DataFrame, prefix: int | None, matches: int, wanted: int, seed: int, attempts: int = 50_000) -> DataFrame:
    """(qid, retries, lo, hi): boxes around `matches` random rows that hold exactly as many of the first prefix rows.

    Without a prefix all rows are searched.  Candidate boxes are drawn from a seeded generator in growing batches; each
    batch is counted by one join.  A query that isn't found within so many attempts of its own is an error.
    """
    spark, rng = vectors.sparkSession, np.random.default_rng(seed)
    if prefix is None:
        prefix = (vectors.agg(F.max("vec_id")).first()[0] or 0) + 1
    pool = vectors.where(F.col("vec_id") < prefix)
    found: list = []
    tried, last = 0, -1
    while len(found) < wanted:
        picks = [sorted(rng.choice(prefix, size=matches, replace=False).tolist()) for _ in range(min(512, max(32, tried)))]
        seeds = spark.createDataFrame([(tried + i, v) for i, ids in enumerate(picks) for v in ids], "qid long, vec_id long")
        flat = seeds.join(pool, "vec_id").select("qid", F.posexplode("embedding").alias("dim", "x"))
        limits = flat.groupBy("qid", "dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        boxes = limits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("dim", "lo", "hi"))).alias("b")).select("qid", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))
        good = box_batch(pool, boxes).groupBy("qid").count().where(F.col("count") == matches).join(boxes, "qid").select("qid", "lo", "hi").collect()
        tried += len(picks)
        for r in [*sorted(good, key=lambda r: r.qid), None]:
            if len(found) < wanted and (tried if r is None else r.qid) - last - 1 >= attempts:
                raise ValueError(f"no box with exactly {matches} rows for query {len(found)} in {attempts} attempts")
            if r is not None:
                found.append((r.qid, r.qid - last - 1, r.lo, r.hi))
                last = r.qid
    rows = [(i, int(retries), lo, hi) for i, (_, retries, lo, hi) in enumerate(found[:wanted])]
    return spark.createDataFrame(rows, "qid long, retries long, lo array<float>, hi array<float>")


def tightened_query(vectors: DataFrame, centre: list[float], radius: float, least: int, most: int, seed: int) -> tuple[list[float], list[float]]:
    """A box around centre that holds least .. most vectors if shrinking dimensions in random order gets there."""
    rng = np.random.default_rng(seed)
    low, high = [c - radius for c in centre], [c + radius for c in centre]
    n = box(vectors, low, high).count()
    for d in rng.permutation(len(centre)).tolist():
        if n <= most:
            break
        for scale in (0.9, 0.75, 0.6, 0.45, 0.3, 0.2, 0.1):
            a, b = list(low), list(high)
            a[d], b[d] = centre[d] - radius * scale, centre[d] + radius * scale
            m = box(vectors, a, b).count()
            if m >= least:
                low, high, n = a, b, m
            else:
                break
    return low, high


def same_matches(result: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, ok): whether a query's multiset of keys equals the true one, for tables (qid, k)."""
    one = result.groupBy("qid", "k").agg(F.count("*").alias("n"))
    two = truth.groupBy("qid", "k").agg(F.count("*").alias("m"))
    both = one.join(two, ["qid", "k"], "full")
    return both.groupBy("qid").agg(F.bool_and(F.coalesce("n", F.lit(0)) == F.coalesce("m", F.lit(0))).alias("ok"))
