"""Structure of the minimal automaton of a key set, computed without building it.

A trie node at depth d is a key prefix of d chunks; nodes with the same set of remaining suffixes are one
automaton node (class).  A set of suffixes is named by the XOR of two 64-bit hashes of each, which sums up on
the map side whatever a node's size (the root has every key).  So the automaton is two aggregations of (key, depth)
rows, for any number of key sets ("configurations") at once.

The rows come from one pass over the keys: hashes of all prefixes and suffixes roll along the chunks, so the work and
the rows' bytes are proportional to the keys' bytes.  A row carries hashes and its own chunk, never the key.

Keys are BINARY, packed from the most significant bit on, or strings of '0' and '1'; a configuration's chunk widths are an
array `widths`, whose sum is the key length filled up with zeros.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zetamill.functions.encoding import bit_width, compressed_bytes, fixed_bytes
from zetamill.session import materialise

_ROWS = "cfg string, k1 long, k2 long, d int, w int, p1 long, p2 long, x1 long, x2 long, y1 long, y2 long, label binary, last boolean"
_SEEDS = np.array([[0x9E3779B97F4A7C15, 0xD1342543DE82EF95], [0xBF58476D1CE4E5B9, 0x94D049BB133111EB]], np.uint64)
#: Bits of keys that are worked on at a time.
AT_ONCE = 1 << 25


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with full avalanche."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _chunk_hashes(chunk: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A hash of each row of packed bytes."""
    n, size = chunk.shape
    lanes = np.zeros((n, -(-size // 8) * 8), np.uint8)
    lanes[:, :size] = chunk
    out = np.full(n, seed, np.uint64)
    for lane in lanes.view(np.uint64).T:
        out = _mix(out * np.uint64(3) ^ _mix(lane + seed))
    return out


def _trie_of(bits: np.ndarray, widths: list[int]) -> list[np.ndarray | list]:
    """Columns k1 .. last of _ROWS but cfg, chunk by chunk, of the rows of an array of bits."""
    n, starts = len(bits), np.r_[0, np.cumsum(widths)].tolist()
    chunks = [np.packbits(bits[:, a:b], axis=1) for a, b in zip(starts, starts[1:], strict=False)]
    hashes = [[_chunk_hashes(c, _SEEDS[i, 0]) for c in chunks] for i in range(2)]
    before, after = [], []
    for i in range(2):
        now = np.full(n, _SEEDS[i, 1], np.uint64)
        forth = [now]
        for h in hashes[i]:
            now = _mix(now * np.uint64(5) + h)
            forth.append(now)
        now = np.full(n, ~_SEEDS[i, 1], np.uint64)
        back = [now]
        for h in reversed(hashes[i]):
            now = _mix(now * np.uint64(7) + h)
            back.append(now)
        before.append(np.stack(forth[:-1]))
        after.append(np.stack(back[::-1]))
    depth = len(widths)
    key = [np.broadcast_to(after[i][0], (depth, n)).ravel() for i in range(2)]
    numbers = [*key, np.repeat(np.arange(depth), n), np.repeat(widths, n), before[0].ravel(), before[1].ravel(), after[0][:-1].ravel(), after[1][:-1].ravel(), after[0][1:].ravel(), after[1][1:].ravel()]
    flat, size = [c.ravel() for c in chunks], np.repeat([c.shape[1] for c in chunks], n)
    offsets = np.r_[0, np.cumsum(size)].astype(np.int32)
    labels = pa.Array.from_buffers(pa.binary(), n * depth, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(flat))])
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 6]
    return [pa.array((x.view(np.int64) if x.dtype == np.uint64 else x), t) for x, t in zip(numbers, types, strict=True)] + [labels, pa.array(np.repeat(np.arange(depth) == depth - 1, n))]


def _explode(packed: bool):
    names = ["cfg", "k1", "k2", "d", "w", "p1", "p2", "x1", "x2", "y1", "y2", "label", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for i, (cfg, widths) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                groups.setdefault((cfg, tuple(widths)), []).append(i)
            for (cfg, widths), places in groups.items():
                total = sum(widths)
                step = max(1, AT_ONCE // max(1, total))
                for begin in range(0, len(places), step):
                    keys = batch.column(1).take(pa.array(places[begin : begin + step])).to_pylist()
                    raw = [(k if packed else k.encode()) for k in keys]
                    each = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
                    some = np.unpackbits(each, axis=1) if packed else each - ord("0")
                    bits = np.zeros((len(raw), total), np.uint8)
                    bits[:, : some.shape[1]] = some[:, :total]
                    columns = _trie_of(bits, list(widths))
                    yield pa.RecordBatch.from_arrays([pa.array([cfg] * len(columns[0]), pa.string()), *columns], names=names)

    return run


def uniform_widths(n_bits: Column, group_bits: Column) -> Column:
    """Widths of ceil(n_bits / group_bits) equal chunks."""
    return F.array_repeat(group_bits.cast("int"), F.ceil(n_bits / group_bits).cast("int"))


@dataclass
class Automaton:
    """The exploded trie of keyed(cfg, k, widths) and its classes."""

    trie: DataFrame
    nodes: DataFrame
    edges: DataFrame


def build(keyed: DataFrame, keep: bool = False) -> Automaton:
    """keyed(cfg, k, widths): distinct keys of each configuration, all keys of one having one length.

    keep writes the exploded trie, nodes and edges down, for statistics that go through them several times.
    """
    packed = isinstance(keyed.schema["k"].dataType, T.BinaryType)
    # A key's rows are many times the key in number, so small key tables are dealt to all tasks.
    placed = keyed.select("cfg", "k", "widths").repartition(F.xxhash64("k"))
    trie = placed.mapInArrow(_explode(packed), _ROWS)
    trie = materialise(trie) if keep else trie
    node = ["cfg", "d", "p1", "p2"]
    nodes = trie.groupBy(*node).agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    edges = trie.groupBy(*node, "label").agg(F.bit_xor("y1").alias("c1"), F.bit_xor("y2").alias("c2"), F.first("w").alias("w"), F.first("last").alias("last"))
    return Automaton(trie, materialise(nodes), materialise(edges)) if keep else Automaton(trie, nodes, edges)


def classes(a: Automaton) -> DataFrame:
    """(cfg, d, s1, s2, deg, m): every class with its out-degree and the number of trie nodes in it."""
    degree = a.edges.groupBy("cfg", "d", "p1", "p2").agg(F.count("*").alias("deg"))
    return a.nodes.join(degree, ["cfg", "d", "p1", "p2"]).groupBy("cfg", "d", "s1", "s2").agg(F.max("deg").alias("deg"), F.count("*").alias("m"))


def class_edges(a: Automaton) -> DataFrame:
    """(cfg, d, s1, s2, label, c1, c2, w, last): the automaton's edges; labels are packed, last marks those into the terminal."""
    return a.edges.join(a.nodes, ["cfg", "d", "p1", "p2"]).select("cfg", "d", "s1", "s2", "label", "c1", "c2", "w", "last").distinct()


def by_depth(a: Automaton) -> DataFrame:
    """(cfg, depth, finalize_calls, memo_hits, trie_edges, dawg_edges, unique_nodes)."""
    m = F.sum("m")
    return classes(a).groupBy("cfg", F.col("d").alias("depth")).agg(m.alias("finalize_calls"), (m - F.count("*")).alias("memo_hits"), F.sum(F.col("m") * F.col("deg")).alias("trie_edges"), F.sum("deg").alias("dawg_edges"), F.count("*").alias("unique_nodes"))


def summary(a: Automaton) -> DataFrame:
    """One row for each cfg: the five counters and the three ratios, which are 0, 1 and 0 for nothing."""
    total = by_depth(a).groupBy("cfg").agg(*[F.sum(c).alias(c) for c in ("finalize_calls", "memo_hits", "unique_nodes", "trie_edges", "dawg_edges")])
    return total.select(
        "*", F.coalesce(F.col("memo_hits") / F.nullif("finalize_calls", F.lit(0)), F.lit(0.0)).alias("sharing_ratio"), F.coalesce(F.col("unique_nodes") / F.nullif("finalize_calls", F.lit(0)), F.lit(1.0)).alias("node_reduction"),
        F.coalesce(1 - F.col("dawg_edges") / F.nullif("trie_edges", F.lit(0)), F.lit(0.0)).alias("edge_saving_pct"),
    )


def in_degrees(a: Automaton) -> DataFrame:
    """(cfg, d, s1, s2, in_degree) of every class but roots and the terminal."""
    inner = class_edges(a).where("not last")
    return inner.groupBy("cfg", (F.col("d") + 1).alias("d"), F.col("c1").alias("s1"), F.col("c2").alias("s2")).agg(F.count("*").alias("in_degree"))


def in_degree_histogram(a: Automaton) -> DataFrame:
    return in_degrees(a).groupBy("cfg", "in_degree").agg(F.count("*").alias("node_count"))


def shared_nodes(a: Automaton) -> DataFrame:
    return in_degrees(a).groupBy("cfg").agg(F.count_if(F.col("in_degree") > 1).alias("shared_nodes"))


def path_compression(a: Automaton) -> DataFrame:
    """(cfg, edges, compressible, pc_edges, label_bits, max_chunks).

    A class is compressible if it isn't the root and has one edge in and one out.  Chains of compressible classes lie along
    key paths, so a chain's length is a run of consecutive depths on a path; the longest label has one chunk more.
    """
    compressible = in_degrees(a).where("in_degree = 1").join(classes(a).where("deg = 1"), ["cfg", "d", "s1", "s2"]).select("cfg", "d", "s1", "s2")
    on_path = a.trie.select("cfg", "k1", "k2", "d", "p1", "p2").join(a.nodes.join(compressible, ["cfg", "d", "s1", "s2"]).select("cfg", "d", "p1", "p2"), ["cfg", "d", "p1", "p2"])
    key = ["cfg", "k1", "k2"]
    island = on_path.select(*key, (F.col("d") - F.row_number().over(Window.partitionBy(*key).orderBy("d"))).alias("island"))
    longest = island.groupBy(*key, "island").agg(F.count("*").alias("n")).groupBy("cfg").agg(F.max("n").alias("longest"))
    counts = class_edges(a).groupBy("cfg").agg(F.count("*").alias("edges"), F.sum("w").alias("label_bits"))
    merged = compressible.groupBy("cfg").agg(F.count("*").alias("compressible"))
    out = counts.join(merged, "cfg", "left").join(longest, "cfg", "left")
    c = F.coalesce("compressible", F.lit(0))
    return out.select("cfg", "edges", c.alias("compressible"), (F.col("edges") - c).alias("pc_edges"), "label_bits", (F.coalesce("longest", F.lit(0)) + 1).alias("max_chunks"))


def compressed_size(pc: DataFrame) -> DataFrame:
    """path_compression()'s rows with total_bytes of the fixed-width, path-compressed automaton."""
    return pc.withColumn("total_bytes", compressed_bytes(F.col("pc_edges"), F.col("label_bits"), F.col("max_chunks")))


def dynamic_size(pc: DataFrame, n_segments: Column, compress: bool = True) -> DataFrame:
    """Storage of the variable-width automaton: bit vectors by kind, plan bytes and derived shares."""
    edges = F.col("pc_edges") if compress else F.col("edges")
    chunks = F.col("max_chunks") if compress else F.lit(1)
    out = pc.select("cfg", edges.alias("edges"), "label_bits", (edges * bit_width(F.col("label_bits"))).alias("label_offset_bits"), (edges * bit_width(chunks)).alias("label_length_bits"), (edges * (bit_width(edges) + 1)).alias("non_label_metadata_bits"), (n_segments * 8 + 4).cast("long").alias("plan_bytes"))
    bits = F.col("label_bits") + F.col("label_offset_bits") + F.col("label_length_bits") + F.col("non_label_metadata_bits")
    return out.select(
        "*", F.ceil(bits / 8).cast("long").alias("bitvector_bytes"), (F.ceil(bits / 8).cast("long") + F.col("plan_bytes")).alias("total_bytes"), F.coalesce(F.col("label_bits") / F.nullif("edges", F.lit(0)), F.lit(0.0)).alias("avg_label_bits"),
        F.coalesce((F.col("label_offset_bits") + F.col("label_length_bits")) / F.nullif(bits, F.lit(0)), F.lit(0.0)).alias("label_metadata_share"),
    )


def suffix_collapse(s: DataFrame, group_bits: Column, n_keys: Column, n_bits: Column) -> DataFrame:
    """Sizes before and after suffixes are shared, for each row of a summary joined with its configuration."""
    key_bytes = n_bits / 8
    post, pre = fixed_bytes(F.col("dawg_edges"), group_bits), fixed_bytes(F.col("trie_edges"), group_bits)
    return s.select(
        "*", post.alias("total_bytes"), (post / n_keys).alias("bytes_per_key"), pre.alias("pre_suffix_total_bytes"), (pre / n_keys).alias("pre_suffix_bytes_per_key"), (pre / n_keys / key_bytes).alias("pre_suffix_normalized_bpk"), (post / n_keys / key_bytes).alias("post_suffix_normalized_bpk"),
        ((pre - post) / n_keys).alias("suffix_collapse_saved_bytes_per_key"), ((pre - post) / n_keys / key_bytes).alias("suffix_collapse_saved_normalized_bpk"), (1 - post / pre).alias("suffix_collapse_saving_pct"),
    )


def entry_states(entries: DataFrame) -> DataFrame:
    """(transitions, states) of the minimal automaton of a dictionary(key, value); values take part in signatures.

    Keys are strings of any length without NUL, so each key ends in a terminal symbol of its own.
    """
    ended = entries.select(F.concat("key", F.lit("\0")).alias("k"), "value")
    rows = ended.select("k", "value", F.explode(F.sequence(F.lit(0), F.length("k") - 1)).alias("d"))
    suffix = F.concat(F.substr(F.col("k"), F.col("d") + 1), F.lit("="), F.col("value"))
    prefix, label = F.substr(F.col("k"), F.lit(1), F.col("d")), F.substr(F.col("k"), F.col("d") + 1, F.lit(1))
    nodes = rows.groupBy(prefix.alias("p")).agg(F.bit_xor(F.xxhash64(suffix)).alias("s1"), F.bit_xor(F.xxhash64(F.lit(1), suffix)).alias("s2"), F.count_distinct(label).alias("deg"))
    return nodes.groupBy("s1", "s2").agg(F.first("deg").alias("deg")).agg(F.sum("deg").alias("transitions"), F.count("*").alias("states"))
