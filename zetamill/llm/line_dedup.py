"""Site-relative line deduplication in DataFrame functions only.

A line's frequency on a host is the number of the host's pages that contain it over the number of the host's pages.
Lines above the ratio (and on at least min_pages pages) are boilerplate and dropped from the host's pages.

Only hashes of (host, line) are shuffled, counted with map-side partial sums, so that neither a very large host
nor a very frequent line lands in one task.  A host has at most (mean lines of a page) / ratio boilerplate lines; the
list of all hosts is broadcast when it has at most BROADCAST_ROWS rows (about 10 MB), and otherwise joined by
host, where adaptive execution splits a host that is too large for one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, free_name

RATIO = 0.08
MIN_PAGES = 3
BROADCAST_ROWS = 200_000


def _digest(line: Column) -> Column:
    """128 bits of a line without its leading and trailing spaces."""
    return F.struct(F.xxhash64(line).alias("x"), F.xxhash64(F.lit(1), line).alias("y"))


def boilerplate_lines(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int) -> DataFrame:
    """(host, lines): for each host with boilerplate the array of its lines' digests."""
    pages = docs.select(F.col(host).alias("host"), F.col(text).alias("text")).where("host is not null")
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    lines = pages.where("text is not null").select("host", F.explode(F.array_distinct(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)))).alias("line"))
    counts = lines.where("line <> ''").select("host", _digest(F.col("line")).alias("d")).groupBy("host", "d.x", "d.y").agg(F.count("*").alias("n"))
    frequent = counts.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > F.col("pages") * ratio)
    return frequent.groupBy("host").agg(F.collect_list(F.struct("x", "y")).alias("lines"))


def dedup_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """docs with boilerplate lines taken out of text, and two further columns, the last ones: __n_lines and __n_dropped
    (with underscores added to a name that docs has already).

    Lines are separated by line feeds and compared without leading and trailing spaces.  Empty lines are never counted
    or dropped.  A page counts once for a line however often it has it; all of its copies on the page are dropped.
    Repeated rows are pages of their own.  A null text stays null (0 lines); a page whose lines all go gets an empty
    text; rows with a null host stay as they are.  A line at exactly the ratio stays.  An empty table gives an empty table.
    """
    names = docs
    own = {}
    for wanted in ("host", "lines", "n_lines", "n_dropped", "kept"):
        own[wanted] = free_name(names, f"__{wanted}")
        names = names.withColumn(own[wanted], F.lit(None))
    found = cut(boilerplate_lines(docs, host, text, ratio, min_pages)).select(F.col("host").alias(own["host"]), F.col("lines").alias(own["lines"]))
    rows = found.agg(F.sum(F.size(own["lines"]))).first()[0] or 0
    small = F.broadcast(found) if rows <= BROADCAST_ROWS else found
    joined = docs.join(small, docs[host] == F.col(own["host"]), "left")
    lines, bad = F.split(F.col(text), "\n", -1), F.col(own["lines"])
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(bad, _digest(F.trim(x))), F.lit(False)) | (F.trim(x) == ""))
    out = joined.withColumn(own["n_lines"], F.coalesce(F.size(F.filter(lines, lambda x: F.trim(x) != "")), F.lit(0)))
    out = out.withColumn(own["kept"], F.when(bad.isNull(), lines).otherwise(kept))
    out = out.withColumn(own["n_dropped"], F.coalesce(F.size(lines) - F.size(own["kept"]), F.lit(0)))
    out = out.withColumn(text, F.when(F.col(own["n_dropped"]) > 0, F.array_join(own["kept"], "\n")).otherwise(F.col(text)))
    return out.select(*docs.columns, own["n_lines"], own["n_dropped"])
