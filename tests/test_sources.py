import numpy as np
import pytest
from pyspark.sql import functions as F

from zetamill.functions import encoding
from zetamill.operators import keys
from zetamill.sources import vector_files as vf
from zetamill.streaming.ingest import new_keys


@pytest.mark.parametrize("dtype", ["float32", "float16"])
def test_vector_files(spark, tmp_path, dtype):
    x = np.random.default_rng(1).normal(size=(50, 6)).astype(dtype)
    path = str(tmp_path / "v.bin")
    x.tofile(path)
    got = vf.read_vectors(spark, path, 6, dtype).orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == list(range(50)) and np.array_equal(np.array([r.embedding for r in got], np.float32), x.astype(np.float32))
    assert vf.read_vectors(spark, path, 6, dtype, rows=7).count() == 7
    for dims, rows in ((7, None), (6, 51)):
        with pytest.raises(ValueError):
            vf.read_vectors(spark, path, dims, dtype, rows)
    short = keys.truncate(vf.read_vectors(spark, path, 6, dtype), 2)
    vf.write_vectors(short, str(tmp_path / "short"))
    back = np.concatenate([np.fromfile(p, "<f4") for p in sorted((tmp_path / "short").glob("part-*.bin"))]).reshape(-1, 2)
    assert np.array_equal(back, x[:, :2].astype(np.float32))
    vf.write_sidecar(spark, str(tmp_path / "meta"), 2, "float32", 50, path, 6)
    meta = vf.read_sidecar(spark, str(tmp_path / "meta")).first()
    assert (meta.embed_dim, meta.total_vectors, meta.total_size_bytes, meta.truncated_from_dim) == (2, 50, 400, 6)


def test_packed_keys(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(40)
    packed = sorted(bytes(r.k) for r in keys.unique_keys(rows, 4).collect())
    (tmp_path / "k.bin").write_bytes(b"".join(packed))
    got = vf.read_packed_keys(spark, str(tmp_path / "k.bin"), 128)
    assert sorted(bytes(r.k) for r in got.collect()) == packed
    vf.write_keys(got, str(tmp_path / "keys"))
    assert sorted(bytes(r.k) for r in vf.read_keys(spark, str(tmp_path / "keys")).collect()) == packed


def test_csv_points_and_results(spark, tmp_path):
    points = [[(i * 7 + j) % 11 + (2**64 - 12) * (i == 3) for j in range(3)] for i in range(20)]
    for name, rows in (("p", points), ("lo", [[0, 0, 0], [3, 0, 2]]), ("hi", [[5, 9, 9], [2**64 - 1] * 3])):
        (tmp_path / f"{name}.csv").write_text("\n".join(",".join(map(str, r)) for r in rows))
    ranges = vf.read_ranges(spark, str(tmp_path / "lo.csv"), str(tmp_path / "hi.csv"), 3)
    got = vf.scan_ranges(vf.read_points(spark, str(tmp_path / "p.csv"), 3), ranges)
    want = {(q, i) for q, (lo, hi) in enumerate([([0, 0, 0], [5, 9, 9]), ([3, 0, 2], [2**64 - 1] * 3)]) for i, p in enumerate(points) if all(a <= x <= b for a, x, b in zip(lo, p, hi))}
    assert {tuple(r) for r in got.collect()} == want
    vf.write_truth(spark.createDataFrame([(1, [2.0, 1.0]), (1, [1.0, 5.0]), (0, [0.5, 0.5])], "qid int, embedding array<float>"), str(tmp_path / "truth"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "truth").glob("part-*.txt")))
    assert text == "[id: 0, count: 1]\n0.5,0.5\n[id: 1, count: 2]\n1.0,5.0\n2.0,1.0\n"
    vf.write_csv(spark.createDataFrame([(1, 2)], "a int, b int"), str(tmp_path / "csv"), ["b", "a"])
    assert "b,a\n2,1\n" in [p.read_text() for p in (tmp_path / "csv").glob("part-*.csv")]


def test_result_files(spark, tmp_path):
    assert {k: len(v.split(",")) for k, v in vf.RESULT_COLUMNS.items()} == {"sweep": 24, "sharing_summary": 16, "sharing_depth": 9, "in_degree": 5, "dynamic": 42, "range_queries": 20, "chunks": 9, "segments": 10}
    vf.write_result(spark.createDataFrame([(4, 1, 0.5)], "group_bits int, chunk int, rho double"), str(tmp_path / "c"), "chunks", {"group_bits": "group_width", "chunk": "chunk_idx", "rho": "cardinality_over_kmax"})
    (row,) = spark.read.csv(str(tmp_path / "c"), header=True).collect()
    assert row.asDict() == dict.fromkeys(vf.RESULT_COLUMNS["chunks"].split(",")) | {"group_width": "4", "chunk_idx": "1", "cardinality_over_kmax": "0.5"}


def test_ordered_maps():
    x = np.array([-np.inf, -3.5, -1e-40, -0.0, 0.0, 1e-40, 2.25, 65504.0, 70000.0, np.inf], np.float32)
    o = encoding.ordered_u32(x)
    assert (np.diff(o.astype(np.int64)) > 0).all() and np.array_equal(encoding.ordered_u32_to_float(o).view(np.uint32), x.view(np.uint32))
    h = encoding.half_bits(np.array([1.0, -2.0, 65504.0, 65535.0, 65536.0, np.nan, 0.0, -0.0, 2.0**-26, 2.0**-14, 1.0009, 2.0**-15], np.float32))
    assert h.tolist() == [0x3C00, 0xC000, 0x7BFF, 0x7BFF, 0x7C00, 0x7C00, 0, 0x8000, 0, 0x0400, 0x3C00, 0]
    assert encoding.half_bits(np.array([2.0**-16], np.float32)).tolist() == [0xFC00]


def test_interleave():
    key = encoding.interleave(np.array([[0x80000001, 0x40000000]], np.uint32))
    bits = "".join(f"{b:08b}" for b in key[0])
    assert bits == "10" + "01" + "00" * 29 + "10"


def test_key_stream(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    source.unionAll(source.limit(100)).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = new_keys(stream, 4).writeStream.format("memory").queryName("new_keys").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(bytes(r.k) for r in spark.table("new_keys").collect()) == sorted(bytes(r.k) for r in keys.unique_keys(source, 4).collect())


def test_numbering_and_even_sample(spark):
    rows = spark.range(103).select(F.lpad(F.bin("id"), 8, "0").alias("k")).repartition(5)
    assert [tuple(r) for r in keys.numbered(rows).orderBy("k").collect()] == [(f"{i:08b}", i) for i in range(103)]
    for m, want in ((0, range(103)), (500, range(103)), (1, [0]), (5, [(i * 102 + 2) // 4 for i in range(5)])):
        assert sorted(int(r.k, 2) for r in keys.even_sample(rows, m).collect()) == list(want)
