"""Near-duplicate components by fast similarity sketching, banding and exact verification.

Method.  Every text becomes the set of its distinct k-word shingles (64-bit hashes).  Fast similarity
sketching fills T coordinates: in round r every element falls by a hash into one bin and leaves the value
(r, hash) there, the smallest value of a bin stays; rounds T .. 2T-1 put every element into bin r - T, so
that each coordinate is filled whatever the set's size.  Two sets agree in a coordinate with probability
equal to their Jaccard similarity J, with Chernoff-type concentration over the T coordinates.  The
coordinates are cut into BANDS bands of ROWS; sets that agree in a whole band are candidates.  At J = 0.8 a
pair misses all bands with probability (1 - 0.8**6)**53, about 1e-7.  Candidates count as links only
after an exact comparison of their full shingle sets.

Distribution.  Equal sets are one class (grouped by a 128-bit fingerprint), so copies cost nothing further, and
buckets (band, key) with the same members are looked at once.  In each bucket the members' sketches are compared: two
belong together when their sketches agree in as many coordinates as similarity 0.8 leads to but for 5.5 standard
deviations, so sets that merely share a template don't join.  Texts of the groups that arise are fetched once and compared
exactly.  Both steps work on groups in tasks of bounded size: a group that is larger is cut into random chunks, all of
which share the same random pivots; after that only members outside the group's largest part ("strays") are compared with
every chunk, which is complete, because links within one part cannot change the result.  Inside a task members
that have already joined are skipped.  No group is gathered in one task, no pair is emitted except links that join
two parts, and nothing is capped.  What grows is the strays' step: a group whose n members fall into parts that are all small
costs (n / chunk)**2 tasks; it takes very many texts of similarity 0.64 to 0.8 for that.

Identity.  Shingles are told apart by 64-bit hashes under a secret key (drawn for each job, see span_hashes()).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import cut, free_name, small_batches
from .textkernel import mix64, new_key, set_fingerprint, shingle_sets, text_blocks

ROWS, BANDS = 6, 53
COORDINATES = ROWS * BANDS
#: Most bytes and texts of a chunk without its pivots, and most sketches of one.
CHUNK_BYTES, CHUNK_ROWS = 4_000_000, 512
SKETCH_ROWS = 1024
#: Coordinates that are compared, by one byte each.
COMPARED = 192
PIVOT_SHARE = 0.25
#: Bits of the filter that goes to every executor before loads are dealt, hence at most 8 MB whatever the input.
FILTER_BITS = 1 << 26

_SEEDS = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOW32 = np.uint64(0xFFFFFFFF)


def sketch(items: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: t filled coordinates (round << 32 | value)."""
    out = np.full(t, np.iinfo(np.uint64).max, dtype=np.uint64)
    round_ = 0
    while round_ < t:
        some = min(t - round_, max(1, int(t * (np.log(t) + 3) / len(items))))
        x = mix64(items[None, :] ^ _SEEDS[round_ : round_ + some, None])
        bins = ((x >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
        rounds = np.arange(round_, round_ + some, dtype=np.uint64)[:, None]
        key = ((bins << np.uint64(42)) | (rounds << np.uint64(32)) | (x & _LOW32)).ravel()
        key.sort()
        bins = key >> np.uint64(42)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        at = bins[first].astype(np.int64)
        value = key[first] & np.uint64((1 << 42) - 1)
        out[at] = np.minimum(out[at], value)
        round_ += some
        if out.max() != np.iinfo(np.uint64).max:
            return out
    for j in np.flatnonzero(out == np.iinfo(np.uint64).max):
        out[j] = (np.uint64(t + j) << np.uint64(32)) | (mix64(items ^ _SEEDS[t + j]) & _LOW32).min()
    return out


def band_keys(short: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each row of 16-bit coordinates."""
    rows = mix64(short.astype(np.uint64) + np.uint64(1)).reshape(len(short), BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(ROWS):
        key = mix64(key * np.uint64(3) + rows[:, :, j])
    return key.view(np.int64)


def _planes(short: np.ndarray) -> bytes:
    """16-bit coordinates as all their low bytes, which are what is compared, then all their high bytes."""
    return short.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _sketches(k: int, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_blocks(batch.column(1)):
                sets = shingle_sets(data, offsets, k, key)
                prints = [set_fingerprint(s) if len(s) else (None, None) for s in sets]
                sketches = [_planes(mix64(sketch(s)).astype(np.uint16)) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.diff(offsets)), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(sketches, pa.binary())],
                    names=["doc_id", "n_shingles", "n_bytes", "fa", "fb", "sketch"],
                )

    return run


def _explode_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 2048):
            part = batch.slice(start, 2048)
            low, high = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, 2, COORDINATES).astype(np.uint16).swapaxes(0, 1)
            keys = band_keys(low | (high << 8))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), BANDS)), pa.array(keys.ravel())], names=["rep", "band"])


def forest(m: int, n_left: int, similar: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) that join into parts all of m members that similar() joins, with a member among the first n_left.

    Where all are left, a pair of different parts has a member outside the largest part, so that only those are
    looked at; parts that have joined aren't joined again.
    """
    label, done, out = np.arange(m), np.zeros(m, bool), []
    done[n_left:] = True
    while True:
        skip = label == (np.bincount(label).argmax() if n_left == m else -1)
        at = int((~done & ~skip).argmax()) if m else 0
        if not m or done[at] or skip[at]:
            return out
        done[at] = True
        near = similar(at)
        some, first = np.unique(label[near], return_index=True)
        new = some != label[at]
        if new.any():
            out += [(at, int(j)) for j in near[first[new]]]
            lut = np.arange(m)
            lut[some] = min(label[at], some.min())
            lut[label[at]] = lut[some].min()
            label = lut[label]
            if label.max() == label.min():
                return out


def links_between(sets: list[np.ndarray], n_left: int, percent: int) -> list[tuple[int, int]]:
    """Verified links that join parts: pairs with 100 * |A and B| >= percent * |A or B|, one of the first n_left in each.

    An inverted index over the sets gives exact intersection sizes.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    _, code = np.unique(flat, return_inverse=True)
    postings = np.repeat(np.arange(m, dtype=np.int32), sizes)[np.argsort(code, kind="stable")]
    counts = np.bincount(code)
    begin = np.r_[0, np.cumsum(counts)]
    at = np.r_[0, np.cumsum(sizes)]

    def similar(i: int) -> np.ndarray:
        own = code[at[i] : at[i + 1]]
        own = own[counts[own] > 1]
        if not len(own):
            return np.zeros(0, np.int64)
        lens = counts[own]
        stop = np.cumsum(lens)
        shared = np.bincount(postings[np.arange(stop[-1]) + np.repeat(begin[own] - stop + lens, lens)], minlength=m)
        return np.flatnonzero(100 * shared >= percent * (sizes[i] + sizes - shared))

    return forest(m, n_left, similar)


def likely_links(sketches: np.ndarray, n_left: int, percent: int) -> list[tuple[int, int]]:
    """Links that join the rows whose sketches agree in as many places as a pair of the least similarity may."""
    least = _least_agreement(percent)
    return forest(len(sketches), n_left, lambda i: np.flatnonzero((sketches == sketches[i]).sum(axis=1) >= least))


def _least_agreement(percent: int) -> float:
    share = percent / 100
    return COMPARED * (share - 5.5 * (share * (1 - share) / COMPARED) ** 0.5)


def _compared(rows: pa.Table, kind: str, k: int, percent: int, key: bytes) -> pa.RecordBatch:
    """The links of some whole chunks, whose rows come one chunk after another, those of side 0 first."""
    group, chunk, side, reps = (rows.column(c).to_numpy() for c in ("group", "chunk", "side", "rep"))
    begin = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (chunk[1:] != chunk[:-1])])
    end = np.r_[begin[1:], len(group)]
    n_left = np.add.reduceat(side == 0, begin, dtype=np.int64)
    some = np.flatnonzero((end - begin > 1) & (n_left > 0))
    pairs: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    if kind == "text":
        sets = [s for part in rows.column("load").chunks for _, _, data, offsets in text_blocks(part) for s in shingle_sets(data, offsets, k, key)]
        compare = lambda a, b, n: links_between(sets[a:b], n, percent)
    else:
        sketches = np.frombuffer(b"".join(rows.column("load").to_pylist()), np.uint8).reshape(len(reps), COMPARED)
        compare = lambda a, b, n: likely_links(sketches[a:b], n, percent)
        twos = begin[some][(end - begin)[some] == 2]  # most buckets
        alike = (sketches[twos] == sketches[twos + 1]).sum(axis=1) >= _least_agreement(percent)
        pairs.append(np.c_[twos, twos + 1][alike])
        some = some[(end - begin)[some] > 2]
    for i in some.tolist():
        found = compare(int(begin[i]), int(end[i]), int(n_left[i]))
        if found:
            pairs.append(np.array(found, np.int64) + begin[i])
    flat = np.concatenate(pairs)
    a, b = _stars(flat, reps)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _stars(pairs: np.ndarray, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The reps of the rows that pairs join, each with the least rep of its part: what components are made of fastest."""
    rows, at = np.unique(pairs, return_inverse=True)
    at, least = at.reshape(pairs.shape), reps[rows].copy()
    while True:
        low = np.minimum(least[at[:, 0]], least[at[:, 1]])
        before = least.copy()
        np.minimum.at(least, at[:, 0], low)
        np.minimum.at(least, at[:, 1], low)
        if (least == before).all():
            return reps[rows], least


def _compare(kind: str, k: int, percent: int, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows are in order of group and chunk; the last chunk of a batch waits for the next batch."""
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            group, chunk = rows.column("group").to_numpy(), rows.column("chunk").to_numpy()
            last = np.flatnonzero((group != group[-1]) | (chunk != chunk[-1]))
            cut_at = int(last[-1]) + 1 if len(last) else 0
            if cut_at:
                yield _compared(rows.slice(0, cut_at), kind, k, percent, key)
            held = rows.slice(cut_at)
        if held is not None:
            yield _compared(held, kind, k, percent, key)

    return run


def _only(loads: DataFrame, reps: DataFrame) -> DataFrame:
    """loads(rep, load) without most rows whose rep isn't in reps(rep), so that these aren't dealt; a join by rep must follow.

    Hashed reps set bits of a map of FILTER_BITS, built by an aggregation and held whole by every executor.  Some tens of
    millions of reps fill it; it then keeps more rows than needed, at worst all, but never loses one.
    """
    bit = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)) + 1
    maps = reps.select(bit.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    is_set = F.expr("getbit(cast(conv(hex(substring(bits, cast(bitmap_bit_position(at) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(at) % 8 as int)) = 1")
    return loads.withColumn("at", bit).join(F.broadcast(maps), (F.bitmap_bucket_number("at") == F.col("bucket")) & is_set).select("rep", "load")


def _grouped_links(members: DataFrame, loads: DataFrame, compare) -> DataFrame:
    """(a, b): links that join the members of each group of members(group, rep, n_chunks), by their loads(rep, load).

    All joins on group are made on ids alone; a load is joined to its row by rep and dealt by group and chunk.
    """

    def links(tasks: DataFrame) -> DataFrame:
        # Rows that are already dealt by group alone would not be dealt again, and one group's chunks would share a task.
        rows = tasks.join(_only(loads, tasks), "rep").select("group", "chunk", "side", "rep", "load")
        placed = rows.repartition("group", "chunk").sortWithinPartitions("group", "chunk", "side", "rep")
        return cut(placed.mapInArrow(compare, "a long, b long").where("a <> b"))

    slot = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("n_chunks").cast("long")).cast("int")
    pivot = (F.col("n_chunks") > 1) & (F.pmod(F.xxhash64("rep", F.lit(2)), F.lit(1 << 20)) < F.lit(PIVOT_SHARE * (1 << 20)) / F.col("n_chunks"))
    # A pivot goes to every chunk, any other member to its own.
    chunk = F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("n_chunks") - 1)).otherwise(F.array(slot)))
    found = links(members.select("group", "rep", chunk.alias("chunk"), F.lit(0).alias("side")))
    large = members.where("n_chunks > 1")
    if not large.limit(1).count():
        return found
    parts = connected_components(found).withColumnRenamed("node", "rep")
    known = cut(large.join(parts, "rep", "left").select("group", "rep", "n_chunks", F.coalesce("component", "rep").alias("part")))
    count = known.groupBy("group", "part").agg(F.count("*").alias("n"))
    sizes = count.groupBy("group").agg(F.max_by("part", F.struct("n", F.negative("part"))).alias("main"), F.max("n").alias("largest"), F.sum("n").alias("all"))
    split = known.join(sizes.where("largest < all"), "group").withColumn("is_stray", F.col("part") != F.col("main"))
    # As many chunks of strays as their share of the members asks for.
    split = cut(split.select("group", "rep", "n_chunks", "is_stray", F.ceil(F.col("n_chunks") * (F.col("all") - F.col("largest")) / F.col("all")).cast("int").alias("n_strays")))
    side_slot = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("n_strays").cast("long")).cast("int")
    left = split.where("is_stray").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    left = left.select("group", "rep", (side_slot * F.col("n_chunks") + F.col("other")).alias("chunk"), F.lit(0).alias("side"))
    right = split.withColumn("stray", F.explode(F.sequence(F.lit(0), F.col("n_strays") - 1)))
    right = right.select("group", "rep", (F.col("stray") * F.col("n_chunks") + slot).alias("chunk"), F.lit(1).alias("side"))
    return found.unionAll(links(left.unionAll(right)))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, chunk_bytes: int = CHUNK_BYTES, chunk_rows: int = CHUNK_ROWS, sketch_rows: int = SKETCH_ROWS) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Texts are linked when 100 * |A and B| >= percent * |A or B| over the sets of their k-word shingles;
    component_id is the smallest doc_id reachable over links, kept says whether it is the row's own.
    Null or empty texts and texts without words have no shingles and are linked with nothing.  Rows with
    a null doc_id are linked with nothing, have a null component_id and are kept.  Repeated rows come out as
    often as they came in; a doc_id that repeats with other texts has the smallest component_id of its texts.
    Other columns are ignored, whatever their names.
    An empty table gives an empty table.  Similarities equal to the threshold are links.
    """
    key = new_key()
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = cut(docs.mapInArrow(_sketches(k, key), "doc_id long, n_shingles long, n_bytes long, fa long, fb long, sketch binary"))
    linked = hashed.where("doc_id is not null and fa is not null")
    classes = linked.groupBy("fa", "fb").agg(F.min("doc_id").alias("rep"))
    members = cut(linked.select("doc_id", "fa", "fb").distinct().join(classes, ["fa", "fb"]).select("doc_id", "rep"))
    own = linked.join(classes.select("fa", "fb", F.col("rep").alias("doc_id")), ["fa", "fb", "doc_id"]).dropDuplicates(["fa", "fb", "doc_id"])
    sketches = cut(own.select(F.col("doc_id").alias("rep"), "n_bytes", F.col("sketch").alias("load")))

    bands = sketches.select("rep", "load").mapInArrow(_explode_bands, "rep long, band long")
    # First the bands that several texts share, by counts alone; all else is found out about these few.  They grow with the
    # documents, so they are never broadcast, and the plan is the same at every size.
    counts = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    shared = cut(bands.join(counts.hint("merge"), "band").select("band", "rep").distinct())
    buckets = shared.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("least"), F.max("rep").alias("last"), F.bit_xor(F.xxhash64("rep")).alias("who")).where("least < last")
    buckets = buckets.groupBy("n", "least", "last", "who").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / sketch_rows).cast("int").alias("n_chunks"))
    grouped = cut(shared.join(buckets, "band").select(F.col("band").alias("group"), "rep", "n_chunks"))
    compared = sketches.select("rep", F.substring("load", 1, COMPARED).alias("load"))
    likely = _grouped_links(grouped, compared, _compare("sketch", k, percent, key))

    groups = connected_components(likely).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    sized = cut(groups.join(sketches.groupBy("rep").agg(F.sum("n_bytes").alias("n_bytes")), "rep"))
    chunks = sized.groupBy("group").agg(F.ceil(F.greatest(F.sum("n_bytes") / chunk_bytes, F.count("*") / chunk_rows)).cast("int").alias("n_chunks"))
    sized = cut(sized.join(chunks, "group").select("group", "rep", "n_chunks"))
    texts = docs.select(F.col("doc_id").alias("rep"), F.col("text").alias("load"))
    parts = connected_components(_grouped_links(sized, texts, _compare("text", k, percent, key)))

    ids = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "rep").alias("root"))
    ids = ids.groupBy("id").agg(F.min("root").alias("root"))
    out = hashed.select("doc_id", "n_shingles").join(ids, hashed.doc_id == ids.id, "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near-duplicates, that with the smallest doc_id.

    Rows that repeat a doc_id leave one row.  Rows with a null doc_id and texts without words stay.  All columns stay as
    they are, whatever their names; an empty table gives an empty table.
    """
    name = free_name(docs, "kept")
    kept = near_duplicates(docs, k, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias(name)).distinct()
    named = docs.join(kept, F.col("doc_id").cast("long") == F.col(name), "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.where("doc_id is null"))
