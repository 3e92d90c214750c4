"""Membership, lexicographic ranges, and the string dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def contains(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """queries(k, ...) with found: whether k is one of keys(k)."""
    return queries.join(keys.select("k").distinct().withColumn("hit", F.lit(True)), "k", "left").withColumn("found", F.coalesce("hit", F.lit(False))).drop("hit")


def members(queries: DataFrame, keys: DataFrame) -> DataFrame:
    return queries.join(keys, "k", "left_semi")


def missing(queries: DataFrame, keys: DataFrame) -> DataFrame:
    return queries.join(keys, "k", "left_anti")


def lex_range(keys: DataFrame, low: str, high: str, n_bits: int, pad_high: str = "1") -> DataFrame:
    """Keys (bit strings of n_bits) from low to high, inclusive; short bounds are filled with '0' and pad_high."""
    return keys.where(F.col("k").between(low.ljust(n_bits, "0"), high.ljust(n_bits, pad_high)))


def in_order(found: DataFrame, by: str | list[str], n: int) -> DataFrame:
    """The first n rows in ascending order with their rank from 1: a top-n, no global sort."""
    columns = [by] if isinstance(by, str) else by
    first = found.orderBy(*columns).limit(n)
    # Of n rows at most, which the limit left.
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*columns)))


def from_key(entries: DataFrame, key: str) -> DataFrame:
    """Entries from a key on, in byte order; the first of them is its lower bound."""
    return entries.where(F.col("key") >= key)


def lex_range_batch(keys: DataFrame, ranges: DataFrame, prefix: int = 12) -> DataFrame:
    """(qid, k) for every range of ranges(qid, lo, hi).

    A range is cut into the key prefixes of `prefix` bits that it touches when these are few, so that the join is an
    equi-join on prefixes; others join on the condition alone.
    """
    number = lambda c: F.conv(F.substring(c, 1, prefix), 2, 10).cast("long")
    cells = ranges.withColumn("a", number(F.col("lo"))).withColumn("b", number(F.col("hi"))).where("lo <= hi")
    narrow = cells.where(F.col("b") - F.col("a") < 64).select("qid", "lo", "hi", F.explode(F.sequence("a", "b")).alias("cell"))
    wide = cells.where(F.col("b") - F.col("a") >= 64).select("qid", "lo", "hi")
    inside = F.col("k").between(F.col("lo"), F.col("hi"))
    by_cell = keys.withColumn("cell", number(F.col("k"))).join(narrow, "cell").where(inside).select("qid", "k")
    return by_cell.unionByName(keys.join(wide, inside).select("qid", "k"))


def dictionary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) entries that a dictionary takes: not empty, no NUL, not negative; the largest value of a key."""
    entries = rows.select(F.col(key).cast("string").alias("key"), F.col(value).cast("int").alias("value"))
    valid = (F.length("key") > 0) & (F.instr("key", "\0") == 0) & (F.col("value") >= 0)
    return entries.where(valid).groupBy("key").agg(F.max("value").alias("value"))


def find(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """queries(key) with the entry's value, -1 where there is none."""
    return queries.join(entries, "key", "left").withColumn("value", F.coalesce("value", F.lit(-1)))


def prefixes(entries: DataFrame) -> DataFrame:
    """(prefix, n, max_value) of every non-empty prefix of the keys."""
    exploded = entries.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substr(F.col("key"), F.lit(1), i))))
    return exploded.groupBy("prefix").agg(F.count("*").alias("n"), F.max("value").alias("max_value"))


def matched_length(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """queries(key) with the length of the longest prefix that is a prefix of an entry."""
    own = queries.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substr(F.col("key"), F.lit(1), i))))
    known = own.join(prefixes(entries).select("prefix"), "prefix", "left_semi").groupBy("key").agg(F.max(F.length("prefix")).alias("matched"))
    return queries.join(known, "key", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))


def complete(entries: DataFrame, prefix: str) -> DataFrame:
    """Entries below a prefix; the filter is pushed to the scan."""
    return entries.where(F.col("key").startswith(prefix))


def complete_ranked(entries: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(prefix, key, value, rank): the n entries of largest value below each prefix of queries(prefix), ties by key.

    Queries are joined on their own prefix of each entry, an equi-join on a prefix length that is known beforehand.
    """
    lengths = [r[0] for r in queries.select(F.length("prefix")).distinct().collect()]
    below = None
    for size in sorted(lengths):
        part = entries.withColumn("prefix", F.substring("key", 1, size)).join(queries.where(F.length("prefix") == size), "prefix")
        below = part if below is None else below.unionByName(part)
    ranked = below.withColumn("rank", F.row_number().over(Window.partitionBy("prefix").orderBy(F.desc("value"), "key")))
    return ranked.where(F.col("rank") <= n).select("prefix", "key", "value", "rank")
