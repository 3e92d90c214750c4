"""Flat vector files, packed key files, CSV points, sidecar metadata and result files.

Headerless files of fixed-length records are read through Hadoop's fixed-length input format: it splits large files
and reads any store that Spark reads.  Parquet is the format to keep data in; these are for exchange.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zetamill.session import materialise

SPLIT_BYTES = 256 << 20
ITEM_BYTES = {"float32": 4, "float16": 2}
_ROW = T.StructType([T.StructField("record", T.BinaryType()), T.StructField("vec_id", T.LongType())])

# The columns of the result files, in order.
RESULT_COLUMNS = {
    "sweep": "timestamp,dim,dtype,n_keys,n_unique_keys,group_bits,method,total_bytes,bytes_per_key,edges,trie_edges_before_suffix_collapse,dawg_edges_after_suffix_collapse,pre_suffix_total_bytes,pre_suffix_bytes_per_key,pre_suffix_normalized_bpk,post_suffix_normalized_bpk,suffix_collapse_saved_bytes_per_key,suffix_collapse_saved_normalized_bpk,suffix_collapse_saving_pct,morton_encode_s,sort_dedup_s,insert_s,finish_s,total_build_s",
    "sharing_summary": "dim,n_keys,n_unique_keys,group_bits,finalize_calls,memo_hits,unique_nodes,trie_edges,dawg_edges,sharing_ratio,node_reduction,edge_saving_pct,total_bytes,bytes_per_key,node_count,shared_nodes",
    "sharing_depth": "dim,n_keys,group_bits,depth,normalized_depth,finalize_calls,memo_hits,sharing_rate,dawg_edges",
    "in_degree": "dim,n_keys,group_bits,in_degree,node_count",
    "dynamic": "timestamp,dim,dtype,n_keys,n_unique_keys,rho_threshold,segmentation_method,n_segments,total_bytes,bytes_per_key,normalized_bpk,edges,plan_s,insert_s,finish_s,total_build_s,best_pc_storage_group_bits,best_pc_bytes_per_key,best_pc_edges,best_pc_build_group_bits,best_pc_total_build_s,delta_vs_best_pc_bpk,delta_vs_best_pc_build_s,edge_reduction_vs_best_pc_pct,best_cd_storage_group_bits,best_cd_bytes_per_key,best_cd_edges,best_cd_build_group_bits,best_cd_total_build_s,delta_vs_best_cd_bpk,delta_vs_best_cd_build_s,edge_reduction_vs_best_cd_pct,label_bits,label_offset_bits,label_length_bits,plan_bytes,non_label_metadata_bits,selected_sample_method,sample_normalized_bpk,avg_label_bits,label_metadata_share,width_histogram",
    "range_queries": "timestamp,dimensions,total_points,key_step,queries_per_step,matches_per_query,encode_s,group_bits,n_keys,queries_run,sort_s,build_s,size_bytes,avg_query_ms,gt_queries,gt_mismatches,data_file,lower_file,upper_file,ground_truth_file",
    "chunks": "dim,n_keys,group_width,chunk_idx,chunk_start_bit,total_bits,cardinality,cardinality_over_n,cardinality_over_kmax",
    "segments": "dim,n_keys,total_bits,threshold,segment_idx,segment_start_bit,segment_width,cardinality,cardinality_over_n,cardinality_over_kmax",
}


def file_rows(spark: SparkSession, path: str, dims: int, dtype: str = "float32") -> int:
    """Rows of a vector file by its size; an error if the size isn't a whole number of rows."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    row = dims * ITEM_BYTES[dtype]
    if size % row:
        raise ValueError(f"{path}: {size} bytes aren't a multiple of {row}")
    return size // row


def _records(spark: SparkSession, path: str, length: int) -> DataFrame:
    """(record, vec_id) of fixed-length records, numbered over all files in the order of their names.

    Each file is cut into ranges of whole records, which are read through the file system that Spark uses.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "length").orderBy("path").collect()
    step = max(1, SPLIT_BYTES // length) * length
    ranges, before = [], 0
    for f in files:
        ranges += [(f.path, at, min(step, f.length - at), before + at // length) for at in range(0, f.length, step)]
        before += f.length // length
    if not ranges:
        return spark.createDataFrame([], _ROW)
    if all(r[1] == 0 for r in ranges):  # files of one range each are read as they are
        whole = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path).select("path", "content")
        base = spark.createDataFrame([(r[0], r[3]) for r in ranges], "path string, base long")
        return whole.join(F.broadcast(base), "path").select("content", "base").mapInArrow(_cut_records(length), _ROW)
    indexed = spark.sparkContext.binaryRecords(path, length).zipWithIndex()
    return spark.createDataFrame(indexed.map(lambda x: (bytearray(x[0]), x[1])), _ROW)


def _cut_records(length: int):
    def run(batches):
        for batch in batches:
            for content, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = content.as_buffer()
                for begin in range(0, len(raw), max(1, (8 << 20) // length) * length):
                    part = raw.slice(begin, min(max(1, (8 << 20) // length) * length, len(raw) - begin))
                    n = len(part) // length
                    offsets = np.arange(n + 1, dtype=np.int32) * length
                    records = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), part])
                    yield pa.RecordBatch.from_arrays([records, pa.array(np.arange(n) + base + begin // length)], names=["record", "vec_id"])

    return run


def read_vectors(spark: SparkSession, path: str, dims: int, dtype: str = "float32", rows: int | None = None) -> DataFrame:
    """(vec_id, embedding) of a row-major file without header, vec_id counting from 0; its first rows if `rows` is given.

    float16 values are widened exactly.  An error where the file is shorter than asked for.
    """
    there = file_rows(spark, path, dims, dtype)
    if rows is not None and rows > there:
        raise ValueError(f"{path}: {there} rows, {rows} wanted")
    kind = np.dtype("<f4" if dtype == "float32" else "<f2")

    def decode(batches):
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), kind).astype(np.float32)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["vec_id", "embedding"])

    records = _records(spark, path, dims * kind.itemsize)
    return (records if rows is None else records.where(F.col("vec_id") < rows)).mapInArrow(decode, "vec_id long, embedding array<float>")


def read_packed_keys(spark: SparkSession, path: str, n_bits: int) -> DataFrame:
    """BINARY k of a file of packed keys, most significant bit first."""
    return _records(spark, path, n_bits // 8).select(F.col("record").alias("k"))


def write_vectors(vectors: DataFrame, path: str, dtype: str = "float32") -> None:
    """Raw rows in order of vec_id as part files in a folder that all executors share; float16 rounds to nearest even.

    A part is written under another name and renamed when whole, so a task that runs twice does no harm.
    """
    kind = "<f4" if dtype == "float32" else "<f2"
    ordered = vectors.repartitionByRange("vec_id").sortWithinPartitions("vec_id").select("embedding")
    _write_parts(ordered, path, lambda column: column.flatten().to_numpy(zero_copy_only=False).astype(kind).tobytes())


def write_packed_keys(keys: DataFrame, path: str) -> None:
    """Packed BINARY keys k, all of one length, in ascending order as part files of records without header."""
    _write_parts(keys.select("k").repartitionByRange("k").sortWithinPartitions("k"), path, lambda column: b"".join(column.to_pylist()))


def _write_parts(rows: DataFrame, path: str, raw) -> None:
    folder = path.removeprefix("file://").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        name = os.path.join(folder, f"part-{context.partitionId():05d}.bin")
        temporary = os.path.join(folder, f".part-{context.partitionId():05d}.{context.taskAttemptId()}")
        n = 0
        with open(temporary, "wb") as out:
            for batch in batches:
                out.write(raw(batch.column(0)))
                n += batch.num_rows
        os.replace(temporary, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def write_dictionary(entries: DataFrame, path: str) -> None:
    """(key, value) entries as Parquet in order of their keys."""
    entries.select("key", "value").repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_numbers(table: DataFrame, column: str, path: str) -> None:
    """One number a line, ascending within range partitions."""
    table.select(F.col(column).cast("string").alias("value"), F.col(column).alias("o")).repartitionByRange("o").sortWithinPartitions("o").select("value").write.mode("overwrite").text(path)


def write_sidecar(spark: SparkSession, path: str, dims: int, dtype: str, n_vectors: int, source: str, truncated_from: int | None = None, merged: bool | None = None, truncated_at: str | None = None) -> None:
    """Metadata of a vector file as one JSON object."""
    item = ITEM_BYTES[dtype]
    fields = [(dims, dtype, item, n_vectors, n_vectors * dims * item, truncated_from, source, merged, truncated_at)]
    schema = "embed_dim int, dtype string, item_size_bytes int, total_vectors long, total_size_bytes long, truncated_from_dim int, source_file string, merged_file boolean, truncated_at string"
    spark.createDataFrame(fields, schema).coalesce(1).write.mode("overwrite").json(path)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def read_points(spark: SparkSession, path: str, dims: int = 16) -> DataFrame:
    """(line, point) of CSV files of unsigned 64-bit coordinates; line counts from 0, over files in the order of their names.

    Lines are numbered inside the blocks that tasks read, and blocks by their place, so nothing is numbered in one task.
    """
    columns = [f"c{i}" for i in range(dims)]
    rows = spark.read.schema(", ".join(f"{c} decimal(20,0)" for c in columns)).csv(path)
    block = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).alias("block")
    placed = materialise(rows.select(block, F.monotonically_increasing_id().alias("order"), F.array(*columns).alias("point")))
    sizes = placed.groupBy("block").agg(F.count("*").alias("n"), F.min("order").alias("first"))
    before = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each block of a file.
    base = sizes.select("block", "first", F.coalesce(before, F.lit(0)).alias("base"))
    # Inside a block ids ascend by one.
    return placed.join(F.broadcast(base), "block").select((F.col("base") + F.col("order") - F.col("first")).alias("line"), "point")


def read_ranges(spark: SparkSession, lower: str, upper: str, dims: int = 16) -> DataFrame:
    """(qid, lo, hi) of two CSV files whose lines belong together."""
    lo, hi = read_points(spark, lower, dims), read_points(spark, upper, dims)
    return lo.select(F.col("line").alias("qid"), F.col("point").alias("lo")).join(hi.select(F.col("line").alias("qid"), F.col("point").alias("hi")), "qid")


def scan_ranges(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(qid, line) of all points inside each range, by plain comparison."""
    inside = F.forall(F.zip_with(F.arrays_zip(F.col("point").alias("x"), F.col("lo").alias("l")), F.col("hi"), lambda p, h: (p["x"] >= p["l"]) & (p["x"] <= h)), lambda ok: ok)
    return points.join(ranges, inside).select("qid", "line")


def write_csv(table: DataFrame, path: str, columns: list[str]) -> None:
    table.select(*columns).write.mode("overwrite").csv(path, header=True)


def write_result(table: DataFrame, path: str, kind: str, names: dict[str, str] | None = None) -> None:
    """table as a result file of a kind of RESULT_COLUMNS, after renaming by names; columns it lacks (such as timings,
    which mean nothing for a distributed plan) are empty."""
    table = table.withColumnsRenamed(names or {})
    columns = RESULT_COLUMNS[kind].split(",")
    table.select(*[F.col(c) if c in table.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True)


def write_truth(matches: DataFrame, path: str) -> None:
    """Blocks "[id: q, count: n]" with a line for each match of (qid, embedding), matches in order of their values."""
    lines = matches.groupBy("qid").agg(F.array_sort(F.collect_list("embedding")).alias("rows"))
    head = F.concat(F.lit("[id: "), "qid", F.lit(", count: "), F.size("rows"), F.lit("]\n"))
    body = F.array_join(F.transform("rows", lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), ",")), "\n")
    lines.orderBy("qid").select(F.concat(head, body).alias("value")).write.mode("overwrite").text(path)


def write_keys(keys: DataFrame, path: str) -> None:
    """Keys as Parquet sorted within range partitions, so that ranges skip files and row groups."""
    keys.repartitionByRange("k").sortWithinPartitions("k").write.mode("overwrite").parquet(path)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
