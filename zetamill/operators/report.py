"""Tables that compare measurements: filters, best schemes, pivots and deltas.

Measurements are rows (dim, dtype, n_unique_keys, group_bits, method, bytes_per_key, edges, ...); methods are named
CD-<bits> (fixed width) and PC-<bits> (path-compressed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_KEYS = ("dim", "dtype", "n_unique_keys", "group_bits", "method")


def bits_per_coordinate() -> Column:
    return F.when(F.lower(F.trim("dtype")) == "float16", 16).otherwise(32)


def with_key_metrics(runs: DataFrame) -> DataFrame:
    """bits_per_coord, key_bytes and normalized_bpk (null for keys of no bytes)."""
    out = runs.withColumn("bits_per_coord", bits_per_coordinate()).withColumn("key_bytes", F.col("dim") * F.col("bits_per_coord") / 8.0)
    return out.withColumn("normalized_bpk", F.col("bytes_per_key") / F.nullif("key_bytes", F.lit(0.0)))


def with_variant(runs: DataFrame) -> DataFrame:
    return runs.withColumn("variant", F.when(F.col("method").startswith("PC-"), "PC").otherwise("CD"))


def method_order() -> list[Column]:
    """Fixed width before path-compressed, then by bits."""
    return [F.when(F.col("method").startswith("PC-"), 1).otherwise(0), F.substring_index("method", "-", -1).cast("int")]


def latest_runs(runs: DataFrame, order: str, drop: str = "dictionary") -> DataFrame:
    """The last row of each measurement by `order` (ties to the larger values of the other columns), without rows of the method to drop.

    An aggregate that combines on the map side, so a measurement with very many rows isn't sorted in one task.
    """
    rest = [c for c in runs.columns if c not in RUN_KEYS]
    last = runs.where(F.col("method") != drop).groupBy(*RUN_KEYS).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("__last"))
    return last.select(*[F.col(c) if c in RUN_KEYS else F.col("__last")[c].alias(c) for c in runs.columns])


def chosen(runs: DataFrame, **values: list) -> DataFrame:
    """Rows whose columns have one of the given values each; an empty list leaves a column free."""
    for column, some in values.items():
        runs = runs.where(F.col(column).isin(some)) if some else runs
    return runs


def numeric_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; rows where one isn't a number are dropped.  An error names the columns that are missing."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    for c in columns:
        rows = rows.withColumn(c, F.col(c).try_cast("double"))
    return rows.dropna(subset=columns)


def relevant(runs: DataFrame, min_levels: int = 3) -> DataFrame:
    """Rows whose chunk width divides the key length and makes at least min_levels levels."""
    if min_levels <= 0:
        return runs
    bits = F.col("dim") * bits_per_coordinate()
    return runs.where((F.col("group_bits") > 0) & (F.pmod(bits, F.col("group_bits")) == 0) & (bits / F.col("group_bits") >= min_levels))


def best_scheme(runs: DataFrame, value: str) -> DataFrame:
    """One method for each dim: lowest mean, then lowest value at the method's largest n, then method order."""
    per = runs.groupBy("dim", "method").agg(F.avg(value).alias("mean_value"), F.max_by(value, "n_unique_keys").alias("value_at_max_n"), F.max("n_unique_keys").alias("max_n"), F.count_distinct("n_unique_keys").alias("n_points"))
    first = Window.partitionBy("dim").orderBy("mean_value", "value_at_max_n", *method_order())
    return per.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def common_n(runs: DataFrame, by: list[str]) -> DataFrame:
    """One row (n, common): the largest n that every group of `by` has; the largest n at all where there is none."""
    groups = runs.select(*by).distinct().agg(F.count("*").alias("groups"))
    per = runs.groupBy("n_unique_keys").agg(F.count_distinct(*[F.col(c) for c in by]).alias("has"))
    both = per.crossJoin(F.broadcast(groups))
    return both.agg(F.max(F.when(F.col("has") == F.col("groups"), F.col("n_unique_keys"))).alias("a"), F.max("n_unique_keys").alias("b")).select(F.coalesce("a", "b").alias("n"), F.col("a").isNotNull().alias("common"))


def dtype_comparison(runs: DataFrame, value: str) -> DataFrame:
    """Best float16 and float32 rows of each dim side by side, with ratio and delta."""
    first = Window.partitionBy("dtype", "dim").orderBy(value, *method_order())
    best = runs.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    half = best.where("dtype = 'float16'").select("dim", F.col("method").alias("method16"), F.col(value).alias("value16"))
    full = best.where("dtype = 'float32'").select("dim", F.col("method").alias("method32"), F.col(value).alias("value32"))
    return half.join(full, "dim").select("*", (F.col("value16") / F.nullif("value32", F.lit(0.0))).alias("ratio"), (F.col("value16") - F.col("value32")).alias("delta"))


def same_method_ratio(runs: DataFrame, value: str) -> DataFrame:
    """(dim, method, float16, float32, ratio, delta) where a method has both."""
    wide = runs.groupBy("dim", "method").pivot("dtype", ["float16", "float32"]).agg(F.first(value)).dropna()
    return wide.select("*", (F.col("float16") / F.col("float32")).alias("ratio"), (F.col("float16") - F.col("float32")).alias("delta"))


def pivot_table(runs: DataFrame, row: str, column: str, values: list, value: str) -> DataFrame:
    return runs.groupBy(row).pivot(column, values).agg(F.first(value))


def suffix_ready(runs: DataFrame) -> DataFrame:
    """Fixed-width rows with a size before sharing; savings that are missing are filled in."""
    rows = runs.where(~F.col("method").startswith("PC-") & (F.col("pre_suffix_bytes_per_key") > 0))
    return rows.withColumn("saving", F.coalesce("suffix_collapse_saving_pct", 1 - F.col("bytes_per_key") / F.col("pre_suffix_bytes_per_key")))


def depth_heatmap(depths: DataFrame, bins: int = 20) -> DataFrame:
    """(dim, bin, sharing_rate): hits over finalised nodes by place in the key; places are rounded half to even."""
    out = depths.groupBy("dim", F.bround(F.col("normalized_depth") * (bins - 1)).cast("int").alias("bin")).agg(F.sum("memo_hits").alias("h"), F.sum("finalize_calls").alias("f"))
    return out.select("dim", "bin", F.coalesce(F.col("h") / F.nullif("f", F.lit(0)), F.lit(0.0)).alias("sharing_rate"))


def at_max_n(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the largest n_keys of their group."""
    top = F.max("n_keys").over(Window.partitionBy(*by))
    return rows.withColumn("__top", top).where("n_keys = __top").drop("__top")


def best_baselines(runs: DataFrame, value: str) -> DataFrame:
    """For each variant and dim the row of least value, ties to the smaller width."""
    first = Window.partitionBy("variant", "dim").orderBy(value, "group_bits")
    return with_variant(runs).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def against_baseline(rows: DataFrame, baseline: DataFrame) -> DataFrame:
    """rows(dim, bytes_per_key, edges, ...) with the relative change and the edge reduction against baseline's row of the dim."""
    b = baseline.select("dim", F.col("group_bits").alias("best_group_bits"), F.col("bytes_per_key").alias("best_bytes_per_key"), F.col("edges").alias("best_edges"))
    delta = (F.col("bytes_per_key") - F.col("best_bytes_per_key")) / F.nullif("best_bytes_per_key", F.lit(0.0))
    fewer = 100.0 * (F.col("best_edges") - F.col("edges")) / F.nullif("best_edges", F.lit(0))
    return rows.join(F.broadcast(b), "dim", "left").select("*", F.coalesce(delta, F.lit(0.0)).alias("delta_bpk"), F.coalesce(fewer, F.lit(0.0)).alias("edge_reduction_pct"))


def best_fixed(fixed: DataFrame, bytes_column: str, edges_column: str, prefix: str) -> DataFrame:
    """One row: group bits, bytes per key and edges of the fixed width of least size, ties to the smaller width."""
    best = fixed.orderBy(bytes_column, "group_bits").limit(1)
    return best.select(F.col("group_bits").alias(f"best_{prefix}_storage_group_bits"), F.col(bytes_column).alias(f"best_{prefix}_bytes_per_key"), F.col(edges_column).alias(f"best_{prefix}_edges"))


def against_fixed(rows: DataFrame, fixed: DataFrame) -> DataFrame:
    """Variable-width rows(bytes_per_key, edges, ...) against the best fixed widths of both kinds.

    fixed has group_bits and, for path-compressed (pc) and plain (cd) automata, bytes per key and edges.
    """
    for prefix in ("pc", "cd"):
        rows = rows.crossJoin(F.broadcast(best_fixed(fixed, f"{prefix}_bytes_per_key", f"{prefix}_edges", prefix)))
        b, e = F.col(f"best_{prefix}_bytes_per_key"), F.col(f"best_{prefix}_edges")
        rows = rows.withColumn(f"delta_vs_best_{prefix}_bpk", F.coalesce((F.col("bytes_per_key") - b) / F.nullif(b, F.lit(0.0)), F.lit(0.0)))
        rows = rows.withColumn(f"edge_reduction_vs_best_{prefix}_pct", F.coalesce(100.0 * (e - F.col("edges")) / F.nullif(e, F.lit(0)), F.lit(0.0)))
    return rows


def finalize_breakdown(summary: DataFrame) -> DataFrame:
    """(cfg, kind, n): finalised nodes that were met before (shared) and those that were new (unique)."""
    kinds = F.explode(F.create_map(F.lit("shared"), F.col("memo_hits").cast("long"), F.lit("unique"), F.col("unique_nodes").cast("long"))).alias("kind", "n")
    return summary.select("cfg", kinds)


def depth_profile(depths: DataFrame) -> DataFrame:
    """Sharing rate by place in the key, of by-depth counters with the number of levels."""
    rate = F.coalesce(F.col("memo_hits") / F.nullif("finalize_calls", F.lit(0)), F.lit(0.0))
    return depths.select("cfg", "depth", (F.col("depth") / F.col("levels")).alias("normalized_depth"), rate.alias("sharing_rate"), "dawg_edges")


def capped_histogram(histogram: DataFrame, most: int = 20) -> DataFrame:
    """An in-degree histogram with all degrees above `most` in its last bar."""
    return histogram.groupBy("cfg", F.least(F.col("in_degree"), F.lit(most)).alias("in_degree")).agg(F.sum("node_count").alias("node_count"))


def size_ratio(runs: DataFrame) -> DataFrame:
    """Each row's bytes over the bytes of its keys as they are."""
    raw = F.col("n_unique_keys") * F.col("dim") * bits_per_coordinate() / 8
    return runs.withColumn("ratio", F.col("total_bytes") / F.nullif(raw, F.lit(0.0)))


def dictionary_ratio(runs: DataFrame, dictionary_bytes: DataFrame) -> DataFrame:
    """Each row's bytes over those of the byte dictionary of its keys; dictionary_bytes has dim, dtype, n_keys, dictionary_bytes."""
    both = runs.join(F.broadcast(dictionary_bytes), ["dim", "dtype", "n_keys"], "left")
    return both.withColumn("dictionary_ratio", F.col("total_bytes") / F.nullif("dictionary_bytes", F.lit(0)))


def nearest_thresholds(wanted: list[float], there: list[float], most: int = 4) -> list[float]:
    """Of the thresholds that are there, those nearest to the wanted ones, without repeats."""
    return list(dict.fromkeys(min(there, key=lambda t: (abs(t - w), t)) for w in wanted))[:most] if there else []


def truth_cell(queries: Column, mismatches: Column) -> Column:
    return F.when(queries == 0, "n/a").when(mismatches == 0, "OK").otherwise(F.concat(F.lit("FAIL "), mismatches, F.lit("/"), queries))


def size_text(n: Column) -> Column:
    """A number of bytes for display."""
    return F.when(n < 1024, F.concat(n, F.lit(" B"))).when(n < 1 << 20, F.concat(F.format_number(n / 1024.0, 2), F.lit(" KB"))).otherwise(F.concat(F.format_number(n / float(1 << 20), 2), F.lit(" MB")))


def time_text(seconds: Column) -> Column:
    """A time for display: microseconds, milliseconds or seconds."""
    return F.when(seconds < 1e-3, F.concat(F.format_number(seconds * 1e6, 1), F.lit(" us"))).when(seconds < 1, F.concat(F.format_number(seconds * 1e3, 1), F.lit(" ms"))).otherwise(F.concat(F.format_number(seconds, 2), F.lit(" s")))


def count_text(n: Column) -> Column:
    """A number with commas between thousands."""
    return F.format_number(n, 0)


def double_list(text: Column) -> Column:
    """"0.5, 0.3" as a sorted array of doubles; entries that aren't numbers go."""
    return F.sort_array(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull()))


def string_list(text: Column) -> Column:
    """"a, b" as an array of trimmed strings in their order; empty entries go."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def int_list(text: Column) -> Column:
    """"8, 4,16" as a sorted array of integers."""
    return F.sort_array(F.transform(F.split(text, ","), lambda x: F.trim(x).cast("int")))
