"""Chunk statistics and segment planning over a table of distinct keys (bit strings k)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zetamill.functions.encoding import bit_width, ceil_log2, symbol_capacity
from zetamill.session import materialise

#: Fixed values of the cost model: weights of saturation, branching and adjacency, and of the bonus for their lack.
PENALTY = (22.0, 12.0, 10.0)
BONUS = (10.0, 8.0, 8.0)
DEPTH_COST = 14.0
EDGE_BIAS, MIDDLE_BIAS = -0.10, 0.15
EDGE_PHASES = (0.20, 0.70)
DEFAULT_WIDTHS = tuple(1 << i for i in range(10, -1, -1))


def slice_of(start: Column | int, width: Column | int) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.substr(F.col("k"), as_column(start) + 1, as_column(width))


def cardinality(keys: DataFrame, n_bits: int, widths: list[int]) -> DataFrame:
    """(group_bits, chunk, start_bit, cardinality, branch_rate, rho) of all whole chunks of each width."""
    places = F.array(*[F.struct(F.lit(g).alias("group_bits"), F.lit(i).alias("chunk")) for g in widths for i in range(n_bits // g)])
    rows = keys.select("k", F.explode(places).alias("c")).select("c.group_bits", "c.chunk", slice_of(F.col("c.chunk") * F.col("c.group_bits"), F.col("c.group_bits")).alias("symbol"))
    counts = rows.groupBy("group_bits", "chunk").agg(F.count_distinct("symbol").alias("cardinality"), F.count("*").alias("n"))
    rate = F.col("cardinality") / F.col("n")
    rho = F.col("cardinality") / symbol_capacity(F.col("n"), F.col("group_bits"))
    return counts.select("group_bits", "chunk", (F.col("chunk") * F.col("group_bits")).alias("start_bit"), "cardinality", rate.alias("branch_rate"), rho.alias("rho"))


def with_previous(keys: DataFrame) -> DataFrame:
    """keys with the key before each in ascending order.

    Keys are range-partitioned and compared inside a partition; the first key of a partition gets the last key of
    the nearest partition before it that isn't empty, so nothing is sorted in one task.  The placed keys are written down, as
    two plans of one shuffle need not place them alike.
    """
    placed = materialise(keys.select("k").repartitionByRange("k").withColumn("part", F.spark_partition_id()))
    ends = placed.groupBy("part").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    seam = ends.select(F.col("first").alias("k"), F.lag("last").over(Window.orderBy("part")).alias("seam"))
    inner = placed.withColumn("before", F.lag("k").over(Window.partitionBy("part").orderBy("k")))
    return inner.join(F.broadcast(seam), "k", "left").select("k", F.coalesce("before", "seam").alias("previous"))


def features(pairs: DataFrame, n: int, start: int, widths: list[int]) -> DataFrame:
    """(start_bit, width, cardinality, changes, kmax, rho, branch_pressure, adjacency_rate) of the candidate widths.

    pairs(k, previous) comes from with_previous(); n is the number of keys.
    """
    aggregates = []
    for w in widths:
        aggregates.append(F.count_distinct(slice_of(start, w)).alias(f"c{w}"))
        aggregates.append(F.count_if(F.col("previous").isNotNull() & (slice_of(start, w) != F.substring("previous", start + 1, w))).alias(f"a{w}"))
    packed = pairs.agg(*aggregates).select(F.explode(F.array(*[F.struct(F.lit(w).alias("width"), F.col(f"c{w}").alias("cardinality"), F.col(f"a{w}").alias("changes")) for w in widths])).alias("f")).select("f.*")
    kmax = symbol_capacity(F.lit(n).cast("long"), F.col("width"))
    return packed.select(F.lit(start).alias("start_bit"), "width", "cardinality", "changes", kmax.alias("kmax"), (F.col("cardinality") / kmax).alias("rho"), (F.col("cardinality") / n).alias("branch_pressure"), (F.col("changes") / max(1, n - 1)).alias("adjacency_rate"))


def cost(f: DataFrame, n_bits: int) -> DataFrame:
    """features() with the estimated cost of a segment."""
    w, rho, p, a = F.col("width"), F.col("rho"), F.col("branch_pressure"), F.col("adjacency_rate")
    metadata = (ceil_log2(F.lit(n_bits + 1).cast("long")) + ceil_log2((w + 1).cast("long")) + 1) / 8
    penalty = PENALTY[0] * rho + PENALTY[1] * p + PENALTY[2] * a
    bonus = BONUS[0] * (1 - rho) + BONUS[1] * (1 - p) + BONUS[2] * (1 - a)
    place = F.col("start_bit") / n_bits
    bias = F.when((place < EDGE_PHASES[0]) | (place > EDGE_PHASES[1]), EDGE_BIAS * w).otherwise(MIDDLE_BIAS * w)
    return f.withColumn("cost", w / 8 + metadata + DEPTH_COST / F.greatest(F.lit(1), w) + penalty - bonus + bias)


def plan(spark, widths: list[int]) -> DataFrame:
    """(segment_idx, start_bit, width) rows of a plan."""
    starts = [sum(widths[:i]) for i in range(len(widths))]
    return spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(zip(starts, widths, strict=True))], "segment_idx int, start_bit int, width int")


def valid(widths: list[int], n_bits: int) -> bool:
    """Whether a plan covers exactly n_bits with widths of at least 1."""
    return all(w > 0 for w in widths) and sum(widths) == n_bits


def uniform(group_bits: int, n_bits: int) -> list[int]:
    """Equal widths, the last one clipped."""
    return [min(group_bits, n_bits - s) for s in range(0, n_bits, group_bits)]


def phase_aware(n_bits: int, ends: tuple[float, float] = (0.20, 0.70), widths: tuple[int, int, int] = (1024, 16, 128)) -> list[int]:
    """Three phases, each up to a share of the key and with a width of its own; a phase's last segment is clipped."""
    first, second = (min(1.0, max(0.0, e)) for e in ends)
    stops = [int(n_bits * first), int(n_bits * max(first, second)), n_bits]
    out: list[int] = []
    for start, stop, width in zip([0, *stops], stops, widths):
        out += [min(max(1, width), stop - at) for at in range(start, stop, max(1, width))]
    return out


def greedy_rows(keys: DataFrame, n_bits: int, threshold: float, widths: tuple[int, ...] = DEFAULT_WIDTHS) -> list:
    """The greedy plan with the features of each segment: the widest candidate whose rho is within the threshold, else
    the narrowest that fits.  One aggregation a position; only its few rows reach the driver."""
    pairs = with_previous(keys).cache()
    n = pairs.count()
    out, at = [], 0
    while at < n_bits:
        fitting = sorted((w for w in widths if 0 < w <= n_bits - at), reverse=True) or [1]
        rows = {r.width: r for r in features(pairs, n, at, fitting).collect()}
        width = next((w for w in fitting if rows[w].rho <= threshold), fitting[-1])
        out.append(rows[width])
        at += width
    pairs.unpersist()
    return out


def greedy(keys: DataFrame, n_bits: int, threshold: float, widths: tuple[int, ...] = DEFAULT_WIDTHS) -> list[int]:
    return [r.width for r in greedy_rows(keys, n_bits, threshold, widths)]


#: Fixed values of the tie rule: costs within this share of a positive best cost tie, or within this amount of any other;
#: saturated or restless slices, and calm ones by rho and by adjacency.
TIE, RESTLESS, CALM = 0.05, 0.75, (0.20, 0.25)


def _preference(r, rival) -> tuple:
    """A key by which of two candidates that tie the one with the larger key is taken; r decides the rule."""
    if r.rho > RESTLESS or r.adjacency_rate > RESTLESS:
        rule = lambda c: (-c.width,)
    elif r.rho < CALM[0] and r.adjacency_rate < CALM[1]:
        rule = lambda c: (c.width,)
    else:
        rule = lambda c: (-c.rho, c.width)
    return rule(r), rule(rival)


def choose_by_cost(rows: list, threshold: float) -> int:
    """The width of least cost among candidates within the threshold; near scores tie by shape.

    rows have width, cost, rho and adjacency_rate; they are met from the widest on.  Scores tie within 5 % of the best one where that is
    positive, and within 0.05 otherwise.  Of two that tie, saturated or restless slices take the narrower, calm and
    repetitive ones the wider; otherwise lower rho wins, then the wider.  Where none is within the threshold
    the narrowest is taken.
    """
    best = None
    for r in sorted((r for r in rows if r.rho <= threshold), key=lambda r: -r.width):
        margin = TIE * best.cost if best is not None and best.cost > 0 else TIE
        if best is None or r.cost + margin < best.cost:
            best = r
        elif abs(r.cost - best.cost) <= margin:
            own, other = _preference(r, best)
            best = r if own > other else best
    return best.width if best is not None else min(r.width for r in rows)


def cost_aware(keys: DataFrame, n_bits: int, threshold: float, min_width: int = 4, widths: tuple[int, ...] | None = None) -> list[int]:
    """Cost-aware greedy plan; candidates are min_width, 2 min_width, ... up to 1024 unless given."""
    widths = widths or tuple(min_width << i for i in range(11) if min_width << i <= 1024)
    pairs = with_previous(keys).cache()
    n = pairs.count()
    out, at = [], 0
    while at < n_bits:
        fitting = [w for w in widths if min_width <= w <= n_bits - at]
        out.append(choose_by_cost(cost(features(pairs, n, at, fitting), n_bits).collect(), threshold) if fitting else 1)
        at += out[-1]
    pairs.unpersist()
    return out


def width_histogram(widths: DataFrame) -> DataFrame:
    """One row: "width:count;..." in ascending widths, of a table with a column width."""
    counts = widths.groupBy("width").agg(F.count("*").alias("n"))
    return counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("width", "n"))), lambda s: F.concat_ws(":", s["width"], s["n"])), ";").alias("width_histogram"))


def plan_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Number of segments and first width of each plan in rows(*by, segment_idx, width)."""
    return rows.groupBy(*by).agg(F.count("*").alias("segments"), F.min_by("width", "segment_idx").alias("first_width"))


def with_rho(rows: DataFrame) -> DataFrame:
    """rows(cardinality, n, group_bits, rho) with rho filled in where it is null."""
    return rows.withColumn("rho", F.coalesce("rho", F.col("cardinality") / symbol_capacity(F.col("n"), F.col("group_bits"))))


def moving_mean(table: DataFrame, by: list[str], order: str, value: str, window: int) -> DataFrame:
    """Centred moving mean of an odd window, the ends repeated beyond the edges, clipped to [0, 1]."""
    half = max(1, window) // 2
    w = Window.partitionBy(*by).orderBy(order)
    frame = w.rowsBetween(-half, half)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, i = F.count(value).over(everything), F.row_number().over(w)
    before, after = F.greatest(F.lit(0), half - (i - 1)), F.greatest(F.lit(0), half - (n - i))
    total = F.sum(value).over(frame) + before * F.first(value).over(everything) + after * F.last(value).over(everything)
    return table.withColumn("smoothed", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total / (2 * half + 1))))


def plan_size_bytes(edges: Column, label_bits: Column, max_chunks: Column, n_segments: Column) -> Column:
    """Bytes of the variable-width automaton with its plan."""
    bits = label_bits + edges * (bit_width(label_bits) + bit_width(max_chunks) + bit_width(edges) + 1)
    return F.ceil(bits / 8).cast("long") + n_segments * 8 + 4
