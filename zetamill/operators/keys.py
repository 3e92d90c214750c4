"""Key sets: encoding, deduplication, and choosing keys by order or position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zetamill.functions.encoding import bit_string, morton_key
from zetamill.session import materialise


def usable(vectors: DataFrame, dims: int) -> DataFrame:
    """Rows whose vector is there and has at least dims components."""
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") >= dims))


def encode(vectors: DataFrame, dims: int, shift: float = 0.5, half: bool = False) -> DataFrame:
    """(vec_id, k) with BINARY Morton keys of the first dims components."""
    return usable(vectors, dims).select("vec_id", morton_key(F.col("embedding"), dims, shift, half).alias("k"))


def unique_keys(vectors: DataFrame, dims: int, shift: float = 0.5, half: bool = False) -> DataFrame:
    """The distinct keys as BINARY k; deduplicated packed, that is, at an eighth of the bit string's size."""
    return encode(vectors, dims, shift, half).select("k").distinct()


def unique_bits(vectors: DataFrame, dims: int, shift: float = 0.5, half: bool = False) -> DataFrame:
    """The distinct keys as bit strings."""
    return unique_keys(vectors, dims, shift, half).select(bit_string(F.col("k"), dims * (16 if half else 32)).alias("k"))


def first_keys(keys: DataFrame, n: int) -> DataFrame:
    """The n smallest keys (a top-n, no global sort)."""
    return keys.orderBy("k").limit(n)


def rows_for_unique(n_rows: int, target: int) -> int:
    """Rows of the file's beginning that are read first to get target distinct keys: 1.1 * target + 1000 at most."""
    return min(n_rows, target * 11 // 10 + 1000)


def read_until_unique(vectors: DataFrame, dims: int, target: int, shift: float = 0.5, half: bool = False) -> DataFrame:
    """Distinct keys of as long a prefix (by vec_id order) as gives target of them, grown by max(2 * deficit, 10000) rows.

    Only counts reach the driver.
    """
    total = vectors.count()
    n = rows_for_unique(total, target)
    while True:
        keys = unique_keys(vectors.where(F.col("vec_id") < n), dims, shift, half)
        have = keys.count()
        if have >= target or n >= total:
            return keys
        n = min(total, n + max(2 * (target - have), 10_000))


def numbered(keys: DataFrame) -> DataFrame:
    """keys with their index from 0 in ascending order.

    Range partitions are numbered by their sizes, so no task sees more than its own range.  The placed keys are written
    down, as two plans of one shuffle need not place them alike.
    """
    placed = materialise(keys.repartitionByRange("k").withColumn("part", F.spark_partition_id()))
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    local = placed.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("k")))
    return local.join(F.broadcast(before.select("part", "base")), "part").select("k", (F.coalesce("base", F.lit(0)) + F.col("i") - 1).alias("idx"))


def even_sample(keys: DataFrame, m: int) -> DataFrame:
    """m keys at even places of the sorted keys; all keys for m = 0 or m >= n, the first for m = 1."""
    n = keys.count()
    if m == 0 or m >= n:
        return keys
    if m == 1:
        return first_keys(keys, 1)
    last, steps = n - 1, m - 1
    places = keys.sparkSession.range(m).select(F.floor((F.col("id") * last + steps // 2) / steps).cast("long").alias("idx")).distinct()
    return numbered(keys).join(places, "idx").select("k")


def insert(keys: DataFrame, more: DataFrame) -> DataFrame:
    """Set union of two key tables."""
    return keys.unionByName(more).distinct()


def truncate(vectors: DataFrame, dims: int) -> DataFrame:
    return vectors.withColumn("embedding", F.slice("embedding", 1, dims))
