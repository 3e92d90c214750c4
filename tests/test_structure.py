"""Known answers, an incremental model on random key sets, and invariances of the relational automaton."""

import random

import pytest
from pyspark.sql import functions as F

from zetamill.operators import sharing

#: name, keys, widths: finalize, hits, trie edges, classes, edges, shared; fixed bytes (None: not uniform); PC edges and bytes.
KNOWN = [
    ("F1", ["0001001000110100", "0001001010001001", "0101011001111000"], [4] * 4, (8, 0, 10, 8, 10, 0), 12, (4, 12)),
    ("F2", ["00001010000101000001111000101000", "01100011010110000001111000101000"], [8] * 4, (7, 2, 8, 5, 6, 1), 9, (3, 11)),
    ("F2a", ["00001010000101000001111000101000", "01100011010110000001111000101000"], [8, 4, 4, 8, 8], (9, 2, 10, 7, 8, 1), None, (3, 11)),
    ("F2b", ["00001010000101000001111000101000", "01100011010110000001111000101000"], [4, 12, 8, 8], (7, 2, 8, 5, 6, 1), None, (3, 11)),
    ("F3", ["0000", "1111"], [4], (1, 0, 2, 1, 2, 0), 2, (2, 3)),
    ("F4", [f"{i * 4:016b}" for i in range(5)], [4] * 4, (5, 0, 9, 5, 9, 0), 11, (7, 15)),
    ("F4a", [f"{i * 4:016b}" for i in range(5)], [8, 4, 4], (4, 0, 8, 4, 8, 0), None, (7, 15)),
    ("F5s", ["00000000", "00000001"], [4, 4], (2, 0, 3, 2, 3, 0), 3, (3, 5)),
    ("F5l", [f"{i:016b}" for i in range(1000)], [4] * 4, (69, 63, 1068, 6, 60, 2), 83, (60, 150)),
    ("F6", ["00110100010111000011010001011100"], [8] * 4, (4, 0, 4, 4, 4, 0), 6, (1, 6)),
    ("F7", [f"{i:016b}" for i in range(4)], [4] * 4, (4, 0, 7, 4, 7, 0), 7, (5, 11)),
]


def frame(spark, sets):
    rows = [(name, k, widths) for name, keys, widths in sets for k in keys]
    return spark.createDataFrame(rows, "cfg string, k string, widths array<int>").repartition(3)


def test_known_answers(spark):
    a = sharing.build(frame(spark, [s[:3] for s in KNOWN]))
    shared = {r.cfg: r.shared_nodes for r in sharing.shared_nodes(a).collect()}
    got = {r.cfg: (r.finalize_calls, r.memo_hits, r.trie_edges, r.unique_nodes, r.dawg_edges, shared.get(r.cfg, 0)) for r in sharing.summary(a).collect()}
    assert got == {s[0]: s[3] for s in KNOWN}
    pc = {r.cfg: (r.pc_edges, r.total_bytes) for r in sharing.compressed_size(sharing.path_compression(a)).collect()}
    assert pc == {s[0]: s[5] for s in KNOWN}
    from zetamill.functions.encoding import fixed_bytes

    widths = {s[0]: s[2][0] for s in KNOWN if s[4]}
    rows = spark.createDataFrame([(n, got[n][4], w) for n, w in widths.items()], "cfg string, e long, w int").select("cfg", fixed_bytes(F.col("e"), F.col("w")).alias("b"))
    assert {r.cfg: r.b for r in rows.collect()} == {s[0]: s[4] for s in KNOWN if s[4]}
    histogram = {(r.cfg, r.in_degree): r.node_count for r in sharing.in_degree_histogram(a).collect() if r.cfg in ("F2", "F5l")}
    assert histogram == {("F2", 1): 3, ("F2", 2): 1, ("F5l", 1): 3, ("F5l", 3): 1, ("F5l", 30): 1}


def minimal(keys, widths):
    """Classes, edges and in-degrees by merging equal subtrees bottom-up, as a model."""
    starts = [sum(widths[:i]) for i in range(len(widths) + 1)]
    finalize, memo, trie = 0, {}, 0

    def node(prefix, depth):
        nonlocal finalize, trie
        if depth == len(widths):
            return "end"
        children = {}
        for k in keys:
            if k.startswith(prefix):
                children[k[starts[depth] : starts[depth + 1]]] = None
        signature = (depth, tuple((label, node(prefix + label, depth + 1)) for label in sorted(children)))
        finalize += 1
        trie += len(children)
        return memo.setdefault(signature, len(memo))

    node("", 0)
    degree = {}
    for signature in memo:
        for _, child in signature[1]:
            if child != "end":
                degree[child] = degree.get(child, 0) + 1
    number = {v: k for k, v in memo.items()}
    merged = {c for c, n in degree.items() if n == 1 and len(number[c][1]) == 1}
    edges = sum(len(s[1]) for s in memo)
    longest = 1
    for c in number:
        n = 0
        while c in merged:
            n += 1
            c = number[c][1][0][1]
        longest = max(longest, n + 1)
    return finalize, len(memo), trie, edges, sum(n > 1 for n in degree.values()), edges - len(merged), longest


def test_random_sets_equal_the_model(spark):
    rng = random.Random(12)
    sets = []
    for i in range(40):
        widths = [rng.choice([1, 2, 3, 4, 5]) for _ in range(rng.randint(1, 6))]
        n = sum(widths)
        keys = sorted({format(rng.getrandbits(n) & rng.choice([-1, 0b101101]), f"0{n}b") for _ in range(rng.randint(1, 40))})
        sets.append((f"s{i}", [k[-n:] for k in keys], widths))
    a = sharing.build(frame(spark, sets))
    shared = {r.cfg: r.shared_nodes for r in sharing.shared_nodes(a).collect()}
    pc = {r.cfg: r for r in sharing.path_compression(a).collect()}
    got = {r.cfg: (r.finalize_calls, r.unique_nodes, r.trie_edges, r.dawg_edges, shared.get(r.cfg, 0), pc[r.cfg].pc_edges, pc[r.cfg].max_chunks) for r in sharing.summary(a).collect()}
    assert got == {name: minimal(keys, widths) for name, keys, widths in sets}


@pytest.mark.parametrize("n", [0, 1, 3])
def test_padding_fills_the_last_chunk(spark, n):
    a = sharing.build(frame(spark, [("x", ["0" * 5 + format(i, "02b") for i in range(n)], [4, 4])]))
    assert [tuple(r)[1:6] for r in sharing.summary(a).collect()] == ([] if n == 0 else [(2, 0, 2, n + 1, n + 1)])


def test_test_embeddings_match_known_counters(spark):
    from zetamill.operators.keys import unique_bits

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    for dims, half, gb, want in ((2, False, 4, (4604, 805, 5103, 3799, 4298)), (4, False, 8, (5141, 306, 5640, 4835, 5334)), (2, True, 4, (1342, 724, 1841, 618, 1117))):
        k = unique_bits(rows, dims, half=half).select(F.lit("c").alias("cfg"), "k", F.array(*[F.lit(gb)] * (dims * (16 if half else 32) // gb)).alias("widths"))
        r = sharing.summary(sharing.build(k)).first()
        assert (r.finalize_calls, r.memo_hits, r.trie_edges, r.unique_nodes, r.dawg_edges) == want


def test_whole_test_embeddings_match_known_counters(spark):
    from zetamill.functions.encoding import fixed_bytes
    from zetamill.operators.keys import unique_keys

    k = unique_keys(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), 64)
    sets = [k.select(F.lit(str(gb)).alias("cfg"), "k", F.array_repeat(F.lit(gb), 2048 // gb).alias("widths")) for gb in (32, 64)]
    a = sharing.build(sets[0].unionByName(sets[1]), keep=True)
    got = {r.cfg: (r.finalize_calls, r.memo_hits, r.trie_edges, r.unique_nodes, r.dawg_edges, r.b) for r in sharing.summary(a).withColumn("b", fixed_bytes(F.col("dawg_edges"), F.col("cfg").cast("int"))).collect()}
    assert got == {"32": (24582, 0, 25081, 24582, 25081, 150486), "64": (12049, 0, 12548, 12049, 12548, 123912)}
    pc = {r.cfg: (r.pc_edges, r.total_bytes) for r in sharing.compressed_size(sharing.path_compression(a)).collect()}
    assert pc == {"32": (511, 102624), "64": (509, 102675)}


def test_keys_of_1024_components(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    raw = [rng.bytes(4096) for _ in range(20)]
    k = spark.createDataFrame([("c", bytearray(x)) for x in raw], "cfg string, k binary").select("cfg", "k", F.array_repeat(F.lit(32), 1024).alias("widths"))
    a = sharing.build(k)
    row = max(len(r.label) for r in a.trie.select("label").collect())
    assert row == 4 and a.trie.count() == 20 * 1024
    r = sharing.summary(a).first()
    assert (r.finalize_calls, r.memo_hits, r.trie_edges) == (1 + 20 * 1023, 0, 20 * 1024)
