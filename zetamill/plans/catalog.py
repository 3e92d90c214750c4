"""The registered queries of the vector engine, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zetamill.functions import encoding as fn
from zetamill.operators import keys as ks
from zetamill.operators import lookup, report, segments, sharing, spatial
from zetamill.plans import oracle as o
from zetamill.session import materialise, shared_folder
from zetamill.sources import vector_files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name; integers are widened and doubles rounded to 8 digits, as in the SQL."""

    def register(f: Query) -> Query:
        name = f.__name__.removeprefix("q_")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            cast = {T.IntegerType: lambda c: c.cast("long"), T.ShortType: lambda c: c.cast("long"), T.FloatType: lambda c: F.round(c.cast("double"), 8), T.DoubleType: lambda c: F.round(c, 8)}
            return df.select([cast.get(type(x.dataType), lambda c: c)(F.col(x.name)).alias(x.name) for x in df.schema])

        _QUERIES[name] = run
        if sql:
            _SQL[name] = sql
        return f

    return register


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def bits(spark: SparkSession, sf_dir: str, dims: int = 2, shift: float = 0.5, half: bool = False) -> DataFrame:
    return ks.unique_bits(vectors(spark, sf_dir), dims, shift, half)


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.dictionary(spark.read.parquet(f"{sf_dir}/pages.parquet"), "url", "page_id")


ENTRIES = "(select url as key, max(page_id) as value from pages where length(url) > 0 and page_id >= 0 group by 1)"
NAMES = "(select p_name as key, max(p_size) as value from part where length(p_name) > 0 and p_size >= 0 group by 1)"


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.dictionary(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_name", "p_size")


def values_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def centre(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = vectors(spark, sf_dir).where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else [0.0] * 64


def f32(x: str) -> str:
    return f"{x}::FLOAT"


# ---------------------------------------------------------------- encoding


@query(f"select vec_id, i - 1 as dim, cast('0b' || {o.ordered_bits('embedding[i] + 0.5::FLOAT')} as bigint) ordered from embeddings, range(1, 9) r(i)")
def q_ordered_u32(spark, d):
    rows = vectors(spark, d).select("vec_id", F.posexplode(fn.ordered_values(F.slice("embedding", 1, 8), 0.5)).alias("dim", "ordered"))
    return rows


@query("select vec_id, i - 1 as dim, round(embedding[i]::double, 8) as x from embeddings, range(1, 9) r(i)")
def q_ordered_inverse(spark, d):
    return vectors(spark, d).select("vec_id", F.posexplode(fn.floats_of(fn.ordered_values(F.slice("embedding", 1, 8)))).alias("dim", "x"))


@query(f"select vec_id, i - 1 as dim, cast('0b' || {o.ordered_half_bits('embedding[i] + 0.5::FLOAT')} as bigint) ordered from embeddings, range(1, 9) r(i)")
def q_ordered_u16(spark, d):
    return vectors(spark, d).select("vec_id", F.posexplode(fn.ordered_values(F.slice("embedding", 1, 8), 0.5, half=True)).alias("dim", "ordered"))


@query("""select h, round(case when (h >> 15) & 1 = 1 then -1.0 else 1.0 end * case when (h >> 10) & 31 = 0 then (h & 1023) * pow(2.0, -24) else (1 + (h & 1023) / 1024.0) * pow(2.0, ((h >> 10) & 31) - 15) end, 8) as x
from (select range as h from range(0, 65536, 7)) where (h >> 10) & 31 < 31 and h <> 32768""")
def q_half_to_float(spark, d):
    h = spark.range(0, 65536, 7).select(F.col("id").alias("h")).where((F.shiftright("h", 10).bitwiseAND(F.lit(31)) < 31) & (F.col("h") != 32768))
    return h.select("h", fn.half_to_float(F.col("h")).alias("x"))


@query(f"select vec_id, {o.morton(64)} k from embeddings")
def q_morton_f32(spark, d):
    return ks.encode(vectors(spark, d), 64).select("vec_id", fn.bit_string(F.col("k"), 2048).alias("k"))


@query(f"select vec_id, {o.morton(64, half=True)} k from embeddings")
def q_morton_f16(spark, d):
    return ks.encode(vectors(spark, d), 64, half=True).select("vec_id", fn.bit_string(F.col("k"), 1024).alias("k"))


@query(f"select vec_id, level, substr(k, level * 8 + 1, 8) as symbol from (select vec_id, {o.morton(8, '0.0')} k from embeddings), range(0, 4) r(level)")
def q_level_symbol(spark, d):
    k = ks.encode(vectors(spark, d), 8, 0.0).select("vec_id", fn.bit_string(F.col("k"), 256).alias("k"))
    return k.select("vec_id", F.posexplode(F.array(*[fn.level_symbol(F.col("k"), 8, i) for i in range(4)])).alias("level", "symbol"))


@query(f"""with v as (select vec_id, cast('0b' || {o.ordered_bits('embedding[1]')} as bigint) a, cast('0b' || {o.ordered_bits('embedding[2]')} as bigint) b from embeddings)
select vec_id, level, 1 as bit, case when 1 = 1 then greatest(least(a, b), (least(a, b) // (2 ** (32 - level))::bigint) * (2 ** (32 - level))::bigint + (2 ** (31 - level))::bigint) end as lo, greatest(a, b) as hi from v, range(0, 3) r(level)
union all select vec_id, level, 0, least(a, b), least(greatest(a, b), (least(a, b) // (2 ** (32 - level))::bigint) * (2 ** (32 - level))::bigint + (2 ** (31 - level))::bigint - 1) from v, range(0, 3) r(level)""")
def q_clip_bounds(spark, d):
    v = vectors(spark, d).select("vec_id", fn.ordered_values(F.slice("embedding", 1, 2)).alias("o"))
    v = v.select("vec_id", F.array_min("o").alias("a"), F.array_max("o").alias("b"))
    cases = v.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn("bit", F.explode(F.array(F.lit(1), F.lit(0))))
    lo, hi = fn.clip_to_half(F.col("a"), F.col("b"), F.col("level"), F.col("bit"))
    return cases.select("vec_id", "level", "bit", lo.alias("lo"), hi.alias("hi"))


@query(f"""with v as (select vec_id, cast('0b' || {o.ordered_bits('embedding[1]')} as bigint) a, cast('0b' || {o.ordered_bits('embedding[2]')} as bigint) b from embeddings)
select vec_id, xor(a, b) as differs, 4294967295 - xor(a, b) as decided, a & b as both, a | b as either, 4294967295 - a as inverted, (a << 3) & 4294967295 as up, a >> 5 as down, bit_count(a) as ones, a < b as less, (xor(a, b) & 4278190080) <> 0 as top_differs, (a >> 31) & 1 as top_bit from v""")
def q_bit_ops(spark, d):
    v = vectors(spark, d).select("vec_id", fn.ordered_values(F.slice("embedding", 1, 2)).alias("o")).select("vec_id", F.col("o")[0].alias("a"), F.col("o")[1].alias("b"))
    a, b, full = F.col("a"), F.col("b"), F.lit(4294967295)
    x = a.bitwiseXOR(b)
    return v.select(
        "vec_id", x.alias("differs"), (full - x).alias("decided"), a.bitwiseAND(b).alias("both"), a.bitwiseOR(b).alias("either"), (full - a).alias("inverted"), F.shiftleft(a, 3).bitwiseAND(full).alias("up"), F.shiftright(a, 5).alias("down"),
        F.bit_count(a).alias("ones"), (a < b).alias("less"), (x.bitwiseAND(F.lit(4278190080)) != 0).alias("top_differs"), F.getbit(a, F.lit(31)).cast("long").alias("top_bit"),
    )


_WIDE = f"with w as (select vec_id, {o.morton(64, '0.0')} a, (select {o.morton(64, '0.0')} from embeddings where vec_id = 0) b from embeddings)"


@query(f"""{_WIDE} select vec_id, array_to_string(list_transform(range(1, 2049), lambda i: case when a[i] = b[i] then '0' else '1' end), '') as differs, array_to_string(list_transform(range(1, 2049), lambda i: case when a[i] = b[i] then '1' else '0' end), '') as decided,
  array_to_string(list_transform(range(1, 2049), lambda i: case when a[i] = '1' and b[i] = '1' then '1' else '0' end), '') as both_set, substr(a, 12) || '00000000000' as up, '00000' || substr(a, 1, 2043) as down,
  length(replace(a, '0', '')) as ones, a < b as less, a = b as same, a[100] = '1' as bit_99, substr(a, 101, 30) as field, substr(a, 1, 64) <> substr(b, 1, 64) as top_differs from w""")
def q_wide_bit_ops(spark, d):
    w = ks.encode(vectors(spark, d), 64, 0.0).select("vec_id", F.col("k").alias("a"))
    w = w.crossJoin(F.broadcast(w.where("vec_id = 0").select(F.col("a").alias("b"))))
    a, b = F.col("a"), F.col("b")
    text = lambda c: fn.bit_string(c, 2048)
    return w.select(
        "vec_id", text(fn.wide("xor", a, b)).alias("differs"), text(fn.wide("xnor", a, b)).alias("decided"), text(fn.wide("and", a, b)).alias("both_set"), text(fn.wide_shift(a, -11)).alias("up"), text(fn.wide_shift(a, 5)).alias("down"),
        fn.wide_ones(a).alias("ones"), (a < b).alias("less"), (a == b).alias("same"), (fn.wide_field(a, 99, 1) == "1").alias("bit_99"), fn.wide_field(a, 100, 30).alias("field"), fn.masked_not_equal(a, b, 64).alias("top_differs"),
    )


@query(f"select vec_id, i - 1 as chunk, rpad(substr(k, (i - 1) * 24 + 1, 24), 24, '0') as symbol from (select vec_id, {o.morton(2)} k from embeddings), range(1, 4) r(i)")
def q_chunk_fixed(spark, d):
    k = ks.encode(vectors(spark, d), 2).select("vec_id", fn.bit_string(F.col("k"), 64).alias("k"))
    return k.select("vec_id", F.posexplode(fn.chunks(F.col("k"), 24)).alias("chunk", "symbol"))


PLAN = [4, 12, 8, 8, 16, 16]
STARTS = [sum(PLAN[:i]) for i in range(len(PLAN))]


@query(f"select vec_id, i - 1 as segment, substr(k, {STARTS}[i] + 1, {PLAN}[i]) as symbol from (select vec_id, {o.morton(2)} k from embeddings), range(1, {len(PLAN) + 1}) r(i)")
def q_chunk_plan(spark, d):
    k = ks.encode(vectors(spark, d), 2).select("vec_id", fn.bit_string(F.col("k"), 64).alias("k"))
    return k.select("vec_id", F.posexplode(fn.plan_chunks(F.col("k"), PLAN)).alias("segment", "symbol"))


@query(f"select v, cast({o.width('v')} as bigint) as bits, cast({o.clog2('v')} as bigint) as clog2, least(v, 256) as capacity8, v as capacity64, {o.fixed_bytes('v', '32')} as bytes32 from (select range * 37 as v from range(0, 300))")
def q_bit_widths(spark, d):
    v = spark.range(300).select((F.col("id") * 37).alias("v"))
    return v.select("v", fn.bit_width(F.col("v")).alias("bits"), fn.ceil_log2(F.col("v")).alias("clog2"), fn.symbol_capacity(F.col("v"), F.lit(8)).alias("capacity8"), fn.symbol_capacity(F.col("v"), F.lit(64)).alias("capacity64"), fn.fixed_bytes(F.col("v"), F.lit(32)).alias("bytes32"))


# ---------------------------------------------------------------- key sets


@query(f"select k from {o.keys(4)}")
def q_key_dedup(spark, d):
    return bits(spark, d, 4)


@query(f"select k from {o.keys(4)} order by k limit 100")
def q_prefix_n(spark, d):
    return ks.first_keys(ks.unique_keys(vectors(spark, d), 4), 100).select(fn.bit_string(F.col("k"), 128).alias("k"))


@query(f"select distinct {o.morton(2)} k from embeddings where vec_id < (select least(count(*), 1440) from embeddings)")
def q_target_unique(spark, d):
    return ks.read_until_unique(vectors(spark, d), 2, 400).select(fn.bit_string(F.col("k"), 64).alias("k"))


@query(f"""with s as (select k, row_number() over (order by k) - 1 idx, count(*) over () n from {o.keys(2)})
select k from s where idx in (select (i * (n - 1) + 24) // 49 from (select distinct n from s), range(0, 50) r(i))""")
def q_even_sample(spark, d):
    return ks.even_sample(bits(spark, d), 50)


@query(f"select count(*) as n_rows, count(distinct {o.morton(2, half=True)}) as n_keys from embeddings")
def q_point_count(spark, d):
    return ks.encode(vectors(spark, d), 2, half=True).agg(F.count("*").alias("n_rows"), F.count_distinct("k").alias("n_keys"))


@query("select vec_id, len(list_slice(embedding, 1, 16)) as dims, round(list_slice(embedding, 1, 16)[16]::double, 8) as last from embeddings")
def q_truncate_dims(spark, d):
    return ks.truncate(vectors(spark, d), 16).select("vec_id", F.size("embedding").alias("dims"), F.element_at("embedding", -1).alias("last"))


@query(f"select k from (select distinct {o.morton(2)} k from embeddings where vec_id % 2 = 0 union select {o.morton(2)} from embeddings where vec_id % 3 = 0)")
def q_key_insert(spark, d):
    v = vectors(spark, d)
    two, three = ks.unique_bits(v.where("vec_id % 2 = 0"), 2), ks.unique_bits(v.where("vec_id % 3 = 0"), 2)
    return ks.insert(two, three)


# ---------------------------------------------------------------- lookups

HALVES = f"h as (select vec_id, {o.morton(4)} k from embeddings)"


@query(f"with {HALVES} select vec_id, exists (select 1 from h i where i.k = h.k and i.vec_id % 2 = 0) as found from h")
def q_contains(spark, d):
    k = ks.encode(vectors(spark, d), 4)
    return lookup.contains(k, k.where("vec_id % 2 = 0")).select("vec_id", "found")


@query(f"with {HALVES} select vec_id from h where k in (select k from h where vec_id % 2 = 0)")
def q_contains_semi(spark, d):
    k = ks.encode(vectors(spark, d), 4)
    return lookup.members(k, k.where("vec_id % 2 = 0").select("k")).select("vec_id")


@query(f"with {HALVES} select vec_id from h where k not in (select k from h where vec_id % 2 = 0)")
def q_not_contains(spark, d):
    k = ks.encode(vectors(spark, d), 4)
    return lookup.missing(k, k.where("vec_id % 2 = 0").select("k")).select("vec_id")


@query(f"select k from {o.keys(2)} where k between rpad('11', 64, '0') and rpad('1101', 64, '1')")
def q_lex_range(spark, d):
    return lookup.lex_range(bits(spark, d), "11", "1101", 64)


@query(f"select k, row_number() over (order by k) as rank from {o.keys(64)} where k between rpad('1', 2048, '0') and rpad('1', 2048, '1') order by k limit 40")
def q_lex_range_ordered(spark, d):
    return lookup.in_order(lookup.lex_range(bits(spark, d, 64), "1", "1", 2048), "k", 40)


@query(f"select k from {o.keys(2)} where k between rpad('11', 64, '0') and rpad('1101', 64, '0')")
def q_lex_range_zero_padded(spark, d):
    return lookup.lex_range(bits(spark, d), "11", "1101", 64, pad_high="0")


@query(f"""with k as (select k, row_number() over (order by k) - 1 i from {o.keys(2)}), r as (select a.i as qid, a.k lo, b.k hi from k a join k b on b.i = a.i + 1 + a.i % 40 where a.i % 10 = 0)
select qid, k.k from r join k on k.k between lo and hi""")
def q_lex_range_batch(spark, d):
    from pyspark.sql import Window

    k = bits(spark, d)
    numbered = ks.numbered(k)
    ranges = numbered.where("idx % 10 = 0").select(F.col("idx").alias("qid"), F.col("k").alias("lo"), (F.col("idx") + 1 + F.col("idx") % 40).alias("j"))
    ranges = ranges.join(numbered.select(F.col("idx").alias("j"), F.col("k").alias("hi")), "j").select("qid", "lo", "hi")
    return lookup.lex_range_batch(k, ranges)


DICT_QUERIES = "select url as key from pages where page_id % 2 = 0 union select url || '/none' from pages where page_id % 3 = 0"


def dict_queries(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.where("page_id % 2 = 0").select(F.col("url").alias("key")).union(p.where("page_id % 3 = 0").select(F.concat("url", F.lit("/none")))).distinct()


@query(f"select q.key, e.key is not null as found from ({DICT_QUERIES}) q left join {ENTRIES} e on e.key = q.key")
def q_dict_contains(spark, d):
    found = lookup.contains(dict_queries(spark, d).withColumnRenamed("key", "k"), entries(spark, d).withColumnRenamed("key", "k"))
    return found.select(F.col("k").alias("key"), "found")


@query(f"select q.key, coalesce(e.value, -1) as value from ({DICT_QUERIES}) q left join {ENTRIES} e on e.key = q.key")
def q_dict_find(spark, d):
    return lookup.find(dict_queries(spark, d), entries(spark, d))


@query(f"""with q as ({DICT_QUERIES}), p as (select distinct substr(key, 1, i) prefix from (select key, unnest(range(1, length(key) + 1)) i from {ENTRIES}))
select q.key, coalesce(max(length(p.prefix)), 0) as matched from (select key, unnest(range(1, length(key) + 1)) i from q) q left join p on p.prefix = substr(q.key, 1, q.i) group by 1""")
def q_dict_prefix_len(spark, d):
    return lookup.matched_length(dict_queries(spark, d), entries(spark, d))


@query(f"select key, value from {ENTRIES} where key between 'http://a' and 'http://t'")
def q_dict_range(spark, d):
    return entries(spark, d).where(F.col("key").between("http://a", "http://t"))


@query(f"select key, value from {ENTRIES} where starts_with(key, 'https://t')")
def q_complete(spark, d):
    return lookup.complete(entries(spark, d), "https://t")


@query(f"select key, value, row_number() over (order by key) as rank from {ENTRIES} where starts_with(key, 'https://') order by key limit 25")
def q_complete_ordered(spark, d):
    return lookup.in_order(lookup.complete(entries(spark, d), "https://"), "key", 25)


@query(f"select key, value, row_number() over (order by key) as rank from {ENTRIES} where key >= 'http://m' order by key limit 10")
def q_dict_lower_bound(spark, d):
    return lookup.in_order(lookup.from_key(entries(spark, d), "http://m"), "key", 10)


@query(f"""with q(prefix) as (values ('http'), ('http://t'), ('https://'), ('x'))
select prefix, key, value, rank from (select prefix, key, value, row_number() over (partition by prefix order by value desc, key) as rank from {ENTRIES} e join q on starts_with(e.key, q.prefix)) where rank <= 5""")
def q_complete_ranked(spark, d):
    return lookup.complete_ranked(entries(spark, d), values_table(spark, [("http",), ("http://t",), ("https://",), ("x",)], "prefix string"), 5)


@query(f"select substr(key, 1, i) as prefix, count(*) as n, max(value) as max_value from (select key, value, unnest(range(1, length(key) + 1)) i from {NAMES}) group by 1")
def q_prefix_max(spark, d):
    return lookup.prefixes(names(spark, d))


@query(f"""with k as (select key || chr(1) as k, value from {NAMES}), t as (select k, value, unnest(range(0, length(k))) d from k),
n as (select substr(k, 1, d) p, md5(string_agg(substr(k, d + 1) || '=' || value, ',' order by substr(k, d + 1))) sig, count(distinct substr(k, d + 1, 1)) deg from t group by 1),
c as (select sig, min(deg) deg from n group by 1) select cast(sum(deg) as bigint) as transitions, count(*) as states from c""")
def q_dict_states(spark, d):
    return sharing.entry_states(names(spark, d))


# ---------------------------------------------------------------- boxes and neighbours

R = 0.45


def around(spark, d, r=R):
    c = centre(spark, d)
    import numpy as np

    x = np.array(c, np.float32)
    return (x - np.float32(r)).tolist(), (x + np.float32(r)).tolist()


BOX = f"list_bool_and(list_transform(range(1, 65), lambda i: e.embedding[i] >= q.c[i] - {R}::FLOAT and e.embedding[i] <= q.c[i] + {R}::FLOAT))"
CENTRE = "(select embedding c from embeddings where vec_id = 0) q"


@query(f"select e.vec_id, e.label from embeddings e, {CENTRE} where {BOX}")
def q_box_search(spark, d):
    return spatial.box(vectors(spark, d), *around(spark, d)).select("vec_id", "label")


@query(f"select e.vec_id, {o.morton(64, '0.0', vector='e.embedding')} as k from embeddings e, {CENTRE} where {BOX}")
def q_box_by_key(spark, d):
    keyed = vectors(spark, d).withColumn("k", fn.morton_key(F.col("embedding"), 64))
    return spatial.box_by_key(keyed, *around(spark, d), 64).select("vec_id", fn.bit_string(F.col("k")).alias("k"))


@query(f"select e.vec_id, i - 1 as dim, cast('0b' || {o.ordered_bits('e.embedding[i]')} as bigint) as ordered from embeddings e, {CENTRE}, range(1, 5) r(i) where {BOX}")
def q_box_points(spark, d):
    hits = spatial.box(vectors(spark, d), *around(spark, d))
    return hits.select("vec_id", F.posexplode(fn.ordered_values(F.slice("embedding", 1, 4))).alias("dim", "ordered"))


@query(f"select e.vec_id, row_number() over (order by {o.morton(64, '0.0', vector='e.embedding')}, e.vec_id) as rank from embeddings e, {CENTRE} where {BOX} order by rank limit 60")
def q_box_ordered(spark, d):
    keyed = vectors(spark, d).withColumn("k", fn.morton_key(F.col("embedding"), 64))
    return lookup.in_order(spatial.box_by_key(keyed, *around(spark, d), 64).select("k", "vec_id"), ["k", "vec_id"], 60).select("vec_id", "rank")


def box_queries(spark, d, dims=4, r=0.1):
    v = vectors(spark, d).where("vec_id % 50 = 0")
    x = F.slice("embedding", 1, dims)
    step = F.lit(r).cast("float")
    return v.select(F.col("vec_id").alias("qid"), F.transform(x, lambda a: a - step).alias("lo"), F.transform(x, lambda a: a + step).alias("hi"))


BOX_BATCH = "from embeddings q, embeddings e where q.vec_id % 50 = 0 and list_bool_and(list_transform(range(1, 5), lambda i: e.embedding[i] >= q.embedding[i] - 0.1::FLOAT and e.embedding[i] <= q.embedding[i] + 0.1::FLOAT))"


@query(f"select q.vec_id as qid, e.vec_id {BOX_BATCH}")
def q_box_batch(spark, d):
    v = vectors(spark, d).select("vec_id", F.slice("embedding", 1, 4).alias("embedding"))
    return spatial.box_batch(v, box_queries(spark, d))


@query(f"select count(*) as n_matches from embeddings e, {CENTRE} where e.vec_id < 300 and {BOX}")
def q_box_count_prefix(spark, d):
    return spatial.count_in_prefix(vectors(spark, d), *around(spark, d), 300)


@query(f"select least(count(*), 21) as n_matches from embeddings e, {CENTRE} where e.vec_id < 300 and {BOX}")
def q_box_count_stop(spark, d):
    return spatial.count_in_prefix(vectors(spark, d), *around(spark, d), 300, stop=20)


DISTANCE = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i] - {c}[i])::double * (e.embedding[i] - {c}[i])::double)))"


@query(f"select e.vec_id, round({DISTANCE.format(c='q.c')}, 4) as distance from embeddings e, {CENTRE} order by {DISTANCE.format(c='q.c')}, vec_id limit 10")
def q_knn(spark, d):
    return spatial.nearest(vectors(spark, d), centre(spark, d), 10).select("vec_id", F.round(F.col("distance").cast("double"), 4).alias("distance"))


@query(f"""select qid, rank, vec_id, round(distance, 4) as distance from (
  select q.vec_id as qid, e.vec_id, {DISTANCE.format(c='q.embedding')} as distance, row_number() over (partition by q.vec_id order by {DISTANCE.format(c='q.embedding')}, e.vec_id) as rank
  from embeddings q, embeddings e where q.vec_id % 100 = 0) where rank <= 5""")
def q_knn_batch(spark, d):
    v = vectors(spark, d)
    queries = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("point"))
    return spatial.nearest_batch(v, queries, 5).select("qid", "rank", "vec_id", F.round(F.col("distance").cast("double"), 4).alias("distance"))


BOUNDS = "(select i - 1 as dim, min(embedding[i]) lo, max(embedding[i]) hi from embeddings, range(1, 65) r(i) {where} group by 1)"


@query(f"select dim, round(lo::double, 8) as lo, round(hi::double, 8) as hi from {BOUNDS.format(where='')}")
def q_train_bounds(spark, d):
    return spatial.bounds(vectors(spark, d))


@query(f"select round(max((hi - lo) / 2::FLOAT)::double, 8) as radius from {BOUNDS.format(where='')}")
def q_train_radius(spark, d):
    return spatial.half_range(vectors(spark, d))


SEEDS = "where vec_id in (3, 14, 15, 92, 65, 35)"


@query(f"select dim, round(lo::double, 8) as lo, round(hi::double, 8) as hi from {BOUNDS.format(where=SEEDS)}")
def q_seed_bounds(spark, d):
    return spatial.bounds(vectors(spark, d).where("vec_id in (3, 14, 15, 92, 65, 35)"))


@query(f"select dim, round((hi - lo)::double, 8) as width, row_number() over (order by hi - lo, dim) as place from {BOUNDS.format(where=SEEDS)}")
def q_dim_order(spark, d):
    return spatial.dimension_order(spatial.bounds(vectors(spark, d).where("vec_id in (3, 14, 15, 92, 65, 35)")))


@query(f"select q.vec_id as qid, count(*) filter (e.vec_id % 97 <> 5) = count(*) as ok {BOX_BATCH} group by 1")
def q_truth_check(spark, d):
    v = vectors(spark, d).select("vec_id", F.slice("embedding", 1, 4).alias("embedding"))
    truth = spatial.box_batch(v, box_queries(spark, d)).select("qid", F.col("vec_id").alias("k"))
    return spatial.same_matches(truth.where("k % 97 <> 5"), truth)


@query()
def q_exact_match_queries(spark, d):
    return spatial.exact_match_queries(vectors(spark, d).select("vec_id", F.slice("embedding", 1, 4).alias("embedding")), None, 2, 10, seed=7)


@query()
def q_tightened_query(spark, d):
    v = vectors(spark, d).select("vec_id", F.slice("embedding", 1, 4).alias("embedding"))
    low, high = spatial.tightened_query(v, centre(spark, d)[:4], 0.3, 10, 60, seed=3)
    return spatial.box(v, low, high).select("vec_id")


# ---------------------------------------------------------------- structure

SETS = [("2/float32/4", 2, False, [4] * 16), ("2/float32/8", 2, False, [8] * 8), ("2/float16/4", 2, True, [4] * 8), ("4/float16/8", 4, True, [8] * 8), ("2/float32/plan", 2, False, PLAN), ("64/float32/32", 64, False, [32] * 64), ("64/float32/64", 64, False, [64] * 32), ("64/float16/64", 64, True, [64] * 16)]

FIXED_SETS = [s for s in SETS if not s[0].endswith("plan")]


def keyed(spark, d, sets=SETS):
    out = None
    for cfg, dims, half, widths in sets:
        part = ks.unique_keys(vectors(spark, d), dims, 0.5, half).select(F.lit(cfg).alias("cfg"), "k", F.array(*[F.lit(w) for w in widths]).alias("widths"))
        out = part if out is None else out.unionByName(part)
    return out


def keyed_sql(sets=SETS):
    return " union all ".join(f"select '{cfg}' cfg, k, {[sum(w[:i]) for i in range(len(w))]} starts, {w} widths from {o.keys(dims, half=half)}" for cfg, dims, half, w in sets)


STRUCTURE = f"with {o.structure(keyed_sql())}"
BY_DEPTH = "select cfg, d as depth, cast(sum(m) as bigint) as finalize_calls, cast(sum(m) - count(*) as bigint) as memo_hits, cast(sum(m * deg) as bigint) as trie_edges, cast(sum(deg) as bigint) as dawg_edges, count(*) as unique_nodes from c group by 1, 2"
SUMMARY = f"select cfg, cast(sum(finalize_calls) as bigint) as finalize_calls, cast(sum(memo_hits) as bigint) as memo_hits, cast(sum(unique_nodes) as bigint) as unique_nodes, cast(sum(trie_edges) as bigint) as trie_edges, cast(sum(dawg_edges) as bigint) as dawg_edges from ({BY_DEPTH}) group by 1"


@query(f"{STRUCTURE} select *, round(memo_hits / finalize_calls, 8) as sharing_ratio, round(unique_nodes / finalize_calls, 8) as node_reduction, round(1 - dawg_edges / trie_edges, 8) as edge_saving_pct from ({SUMMARY})")
def q_sharing_summary(spark, d):
    return sharing.summary(sharing.build(keyed(spark, d)))


@query(f"{STRUCTURE} {BY_DEPTH}")
def q_sharing_depth(spark, d):
    return sharing.by_depth(sharing.build(keyed(spark, d)))


@query(f"{STRUCTURE} select cfg, count(*) as nodes from c group by 1")
def q_node_count(spark, d):
    return sharing.classes(sharing.build(keyed(spark, d))).groupBy("cfg").agg(F.count("*").alias("nodes"))


@query(f"{STRUCTURE} select cfg, d, l as label, count(*) as n from e group by 1, 2, 3")
def q_edge_labels(spark, d):
    edges = sharing.class_edges(sharing.build(keyed(spark, d)))
    return edges.groupBy("cfg", "d", F.substr(fn.bit_string(F.col("label")), F.lit(1), F.col("w")).alias("label")).agg(F.count("*").alias("n"))


@query(f"{STRUCTURE} select cfg, d, count(distinct p) as nodes from t group by 1, 2")
def q_level_nodes(spark, d):
    return sharing.build(keyed(spark, d)).nodes.groupBy("cfg", "d").agg(F.count("*").alias("nodes"))


@query(f"{STRUCTURE} select cfg, in_degree, count(*) as node_count from i group by 1, 2")
def q_indegree_hist(spark, d):
    return sharing.in_degree_histogram(sharing.build(keyed(spark, d)))


@query(f"{STRUCTURE} select cfg, count(*) filter (in_degree > 1) as shared_nodes from i group by 1")
def q_shared_nodes(spark, d):
    return sharing.shared_nodes(sharing.build(keyed(spark, d)))


@query(f"{STRUCTURE}, {o.PATHS} select *, {o.compressed_bytes()} as total_bytes from pc")
def q_pc_stats(spark, d):
    return sharing.compressed_size(sharing.path_compression(sharing.build(keyed(spark, d), keep=True)))


SEGMENT_COUNTS = {cfg: len(w) for cfg, _, _, w in SETS}


@query(f"""{STRUCTURE}, {o.PATHS}, b as (select cfg, pc_edges as edges, label_bits, pc_edges * {o.width('label_bits')} as label_offset_bits, pc_edges * {o.width('max_chunks')} as label_length_bits, pc_edges * ({o.width('pc_edges')} + 1) as non_label_metadata_bits,
  case cfg {' '.join(f"when '{c}' then {n}" for c, n in SEGMENT_COUNTS.items())} end * 8 + 4 as plan_bytes from pc), s as (select *, label_bits + label_offset_bits + label_length_bits + non_label_metadata_bits as bits from b)
select * exclude (bits, plan_bytes), cast(plan_bytes as bigint) as plan_bytes, cast(ceil(bits / 8.0) as bigint) as bitvector_bytes, cast(ceil(bits / 8.0) + plan_bytes as bigint) as total_bytes, round(label_bits / edges, 8) as avg_label_bits, round((label_offset_bits + label_length_bits) / bits, 8) as label_metadata_share from s""")
def q_dynamic_size(spark, d):
    pc = sharing.path_compression(sharing.build(keyed(spark, d), keep=True))
    n = F.create_map(*[F.lit(x) for pair in SEGMENT_COUNTS.items() for x in pair])[F.col("cfg")]
    return sharing.dynamic_size(pc, n)


# ---------------------------------------------------------------- sweep and reports

#: Components with the chunk widths of each, key sets cut off after so many smallest keys, and those that aren't.
SWEEP_DIMS = {2: (4, 8, 16), 4: (4, 8, 16), 64: (16, 32, 64)}
SWEEP_N = (100, 200)
ALL = "all"
TIMES = ("morton_encode_s", "sort_dedup_s", "insert_s", "finish_s", "total_build_s")
COLLAPSE = ("pre_suffix_total_bytes", "pre_suffix_bytes_per_key", "pre_suffix_normalized_bpk", "post_suffix_normalized_bpk", "suffix_collapse_saved_bytes_per_key", "suffix_collapse_saved_normalized_bpk", "suffix_collapse_saving_pct")


def sweep(spark, d):
    """Measurements of all key sets and widths in one pass: fixed-width (CD) and path-compressed (PC) rows.

    A key set is the N smallest keys, or all of them; n_keys is the number asked for, and for all keys their number.
    """
    rows = None
    for dims, widths in SWEEP_DIMS.items():
        for half in (False, True):
            n_bits = dims * (16 if half else 32)
            k = materialise(ks.unique_keys(vectors(spark, d), dims, 0.5, half))
            own = [ks.first_keys(k, n).select(F.lit(str(n)).alias("n"), "k") for n in SWEEP_N] + [k.select(F.lit(ALL).alias("n"), "k")]
            for part in own:
                gb = F.explode(F.array(*[F.lit(g) for g in widths])).alias("gb")
                part = part.select(F.lit(dims).alias("dim"), F.lit("float16" if half else "float32").alias("dtype"), F.lit(n_bits).alias("n_bits"), "k", "n", gb)
                rows = part if rows is None else rows.unionByName(part)
    cfg = F.concat_ws("/", "dim", "dtype", "n", "gb")
    a = sharing.build(rows.select(cfg.alias("cfg"), "k", sharing.uniform_widths(F.col("n_bits"), F.col("gb")).alias("widths")), keep=True)
    sizes = materialise(rows.groupBy(cfg.alias("cfg"), "dim", "dtype", "n_bits", "n", "gb").agg(F.count("*").alias("n_unique_keys")))
    asked = F.when(F.col("n") == ALL, F.col("n_unique_keys")).otherwise(F.col("n").cast("long"))
    s = sharing.suffix_collapse(sharing.summary(a).join(sizes, "cfg"), F.col("gb"), F.col("n_unique_keys"), F.col("n_bits"))
    common = [F.col("n").alias("key_set"), "dim", "dtype", asked.alias("n_keys"), "n_unique_keys", F.col("gb").alias("group_bits")]
    times = [F.lit(None).cast("double").alias(t) for t in TIMES]
    collapse = [F.col("pre_suffix_total_bytes").cast("long"), *COLLAPSE[1:]]
    cd = s.select(*common, F.concat(F.lit("CD-"), "gb").alias("method"), "total_bytes", "bytes_per_key", F.col("dawg_edges").alias("edges"), F.col("trie_edges").alias("trie_edges_before_suffix_collapse"), F.col("dawg_edges").alias("dawg_edges_after_suffix_collapse"), *collapse, *times)
    pc = sharing.compressed_size(sharing.path_compression(a)).join(sizes, "cfg")
    none = [F.lit(0).cast(dict(cd.dtypes)[c]).alias(c) for c in ("trie_edges_before_suffix_collapse", "dawg_edges_after_suffix_collapse", *COLLAPSE)]
    pc = pc.select(*common, F.concat(F.lit("PC-"), "gb").alias("method"), "total_bytes", (F.col("total_bytes") / F.col("n_unique_keys")).alias("bytes_per_key"), F.col("pc_edges").alias("edges"), *none, *times)
    return cd.unionByName(pc)


_MEASURED: dict[tuple[str, str], DataFrame] = {}


def runs(spark, d):
    """The table of measurements that the reports read: sweep()'s, written once for each session and folder of tables."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MEASURED:
        _MEASURED[key] = materialise(sweep(spark, d))
    return _MEASURED[key]


def _sweep_sql() -> str:
    parts = " union all ".join(
        f"select {dims} as dim, '{'float16' if half else 'float32'}' as dtype, {dims * (16 if half else 32)} as n_bits, k, {list(widths)} as gbs from {o.keys(dims, half=half)}" for dims, widths in SWEEP_DIMS.items() for half in (False, True)
    )
    rows = f"""select dim, dtype, n_bits, k, n, gb, dim || '/' || dtype || '/' || n || '/' || gb as cfg from (
      select *, unnest(gbs) gb from (select *, row_number() over (partition by dim, dtype order by k) r from ({parts})), (values {", ".join(f"('{n}', {n})" for n in SWEEP_N)}, ('{ALL}', 9223372036854775807)) a(n, most) where r <= most)"""
    structure = o.structure("select cfg, k, list_transform(range(0, n_bits // gb), lambda i: i * gb) starts, list_transform(range(0, n_bits // gb), lambda i: gb) widths from grid_rows")
    pre, post = o.fixed_bytes("trie_edges", "gb"), o.fixed_bytes("dawg_edges", "gb")
    asked = f"n as key_set, dim, dtype, case n when '{ALL}' then n_unique_keys else try_cast(n as bigint) end as n_keys, n_unique_keys, gb as group_bits"
    key_bytes = "(n_bits / 8)"
    return f"""grid_rows as ({rows}), {structure}, {o.PATHS},
sizes as (select cfg, dim, dtype, n_bits, n, gb, count(*) n_unique_keys from grid_rows group by all),
summ as (select s.*, z.dim, z.dtype, z.n_bits, z.n, z.gb, z.n_unique_keys, {pre} pre, {post} post from ({SUMMARY}) s join sizes z on z.cfg = s.cfg),
runs as (
  select {asked}, 'CD-' || gb as method, post as total_bytes, post / n_unique_keys as bytes_per_key, dawg_edges as edges, trie_edges as trie_edges_before_suffix_collapse, dawg_edges as dawg_edges_after_suffix_collapse,
    pre as pre_suffix_total_bytes, pre / n_unique_keys as pre_suffix_bytes_per_key, pre / n_unique_keys / {key_bytes} as pre_suffix_normalized_bpk, post / n_unique_keys / {key_bytes} as post_suffix_normalized_bpk,
    (pre - post) / n_unique_keys as suffix_collapse_saved_bytes_per_key, (pre - post) / n_unique_keys / {key_bytes} as suffix_collapse_saved_normalized_bpk, 1 - post / pre as suffix_collapse_saving_pct from summ
  union all
  select {asked}, 'PC-' || gb, {o.compressed_bytes()}, {o.compressed_bytes()} / n_unique_keys, pc_edges, 0, 0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0 from pc join sizes on sizes.cfg = pc.cfg)"""


RUNS = f"with {_sweep_sql()}"
ORDER = "case when method like 'PC-%' then 1 else 0 end, cast(substr(method, 4) as integer)"


_ROUNDED = ", ".join(f"round({c}, 8) as {c}" for c in COLLAPSE[1:])


@query(f"{RUNS} select key_set, dim, dtype, n_keys, n_unique_keys, group_bits, method, total_bytes, round(bytes_per_key, 8) as bytes_per_key, edges, trie_edges_before_suffix_collapse, dawg_edges_after_suffix_collapse, pre_suffix_total_bytes, {_ROUNDED}, {', '.join(f'null::double as {t}' for t in TIMES)} from runs")
def q_runs(spark, d):
    return runs(spark, d)


@query(f"""{STRUCTURE}, s as (select s.*, case s.cfg {' '.join(f"when '{c}' then {w[0]}" for c, _, _, w in FIXED_SETS)} end gb, {' case s.cfg ' + ' '.join(f"when '{c}' then {sum(w)}" for c, _, _, w in FIXED_SETS)} end n_bits, (select count(distinct k) from keyed k where k.cfg = s.cfg) n from ({SUMMARY}) s where s.cfg not like '%plan'),
b as (select *, {o.fixed_bytes('trie_edges', 'gb')} pre, {o.fixed_bytes('dawg_edges', 'gb')} post from s)
select cfg, post as total_bytes, round(post / n, 8) as bytes_per_key, pre as pre_suffix_total_bytes, round(pre / n, 8) as pre_suffix_bytes_per_key, round(pre / n / (n_bits / 8), 8) as pre_suffix_normalized_bpk, round(post / n / (n_bits / 8), 8) as post_suffix_normalized_bpk,
round((pre - post) / n, 8) as suffix_collapse_saved_bytes_per_key, round((pre - post) / n / (n_bits / 8), 8) as suffix_collapse_saved_normalized_bpk, round(1 - post / pre, 8) as suffix_collapse_saving_pct from b""")
def q_suffix_collapse(spark, d):
    k = keyed(spark, d, FIXED_SETS)
    sizes = k.groupBy("cfg", F.col("widths")[0].alias("gb"), (F.size("widths") * F.col("widths")[0]).alias("n_bits")).agg(F.count("*").alias("n"))
    s = sharing.summary(sharing.build(k)).join(sizes, "cfg")
    out = sharing.suffix_collapse(s, F.col("gb"), F.col("n"), F.col("n_bits"))
    return out.select("cfg", "total_bytes", "bytes_per_key", "pre_suffix_total_bytes", "pre_suffix_bytes_per_key", "pre_suffix_normalized_bpk", "post_suffix_normalized_bpk", "suffix_collapse_saved_bytes_per_key", "suffix_collapse_saved_normalized_bpk", "suffix_collapse_saving_pct")


@query(f"{RUNS} select key_set, dim, dtype, n_unique_keys, group_bits, method, case when method like 'PC-%' then 'PC' else 'CD' end as variant, dim * case dtype when 'float16' then 16 else 32 end / 8 as key_bytes, round(bytes_per_key / (dim * case dtype when 'float16' then 16 else 32 end / 8), 8) as normalized_bpk from runs where (dim * case dtype when 'float16' then 16 else 32 end) % group_bits = 0 and dim * case dtype when 'float16' then 16 else 32 end / group_bits >= 3")
def q_key_metrics(spark, d):
    out = report.with_variant(report.with_key_metrics(report.relevant(runs(spark, d))))
    return out.select("key_set", "dim", "dtype", "n_unique_keys", "group_bits", "method", "variant", "key_bytes", "normalized_bpk")


@query(f"""{RUNS}, p as (select dim, method, avg(bytes_per_key) mean_value, max_by(bytes_per_key, n_unique_keys) value_at_max_n, max(n_unique_keys) max_n, count(distinct n_unique_keys) n_points from runs where dtype = 'float32' group by 1, 2)
select dim, method, round(mean_value, 8) as mean_value, round(value_at_max_n, 8) as value_at_max_n, max_n, n_points from (select *, row_number() over (partition by dim order by mean_value, value_at_max_n, {ORDER}) r from p) where r = 1""")
def q_best_scheme(spark, d):
    return report.best_scheme(runs(spark, d).where("dtype = 'float32'"), "bytes_per_key")


@query(f"""{RUNS}, g as (select n_unique_keys, count(distinct (dim, dtype)) has from runs group by 1)
select coalesce(max(case when has = 6 then n_unique_keys end), max(n_unique_keys)) as n, max(case when has = 6 then n_unique_keys end) is not null as common from g""")
def q_common_n(spark, d):
    return report.common_n(runs(spark, d), ["dim", "dtype"])


@query(f"""{RUNS}, b as (select * from (select *, row_number() over (partition by dtype, dim order by bytes_per_key, {ORDER}) r from runs where key_set = 'all') where r = 1)
select h.dim, h.method as method16, round(h.bytes_per_key, 8) as value16, f.method as method32, round(f.bytes_per_key, 8) as value32, round(h.bytes_per_key / f.bytes_per_key, 8) as ratio, round(h.bytes_per_key - f.bytes_per_key, 8) as delta
from b h join b f on f.dim = h.dim and h.dtype = 'float16' and f.dtype = 'float32'""")
def q_dtype_compare(spark, d):
    return report.dtype_comparison(runs(spark, d).where("key_set = 'all'"), "bytes_per_key")


@query(f"""{RUNS} select h.dim, h.method, round(h.bytes_per_key, 8) as float16, round(f.bytes_per_key, 8) as float32, round(h.bytes_per_key / f.bytes_per_key, 8) as ratio, round(h.bytes_per_key - f.bytes_per_key, 8) as delta
from runs h join runs f on f.dim = h.dim and f.method = h.method and h.dtype = 'float16' and f.dtype = 'float32' and h.key_set = 'all' and f.key_set = 'all'""")
def q_same_method_ratio(spark, d):
    return report.same_method_ratio(runs(spark, d).where("key_set = 'all'"), "bytes_per_key")


@query(f"{RUNS} select method, " + ", ".join(f'round(max(case when key_set = \'{n}\' then bytes_per_key end), 8) as "{n}"' for n in (100, 200, ALL)) + " from runs where dim = 4 and dtype = 'float32' group by 1")
def q_method_pivot(spark, d):
    return report.pivot_table(runs(spark, d).where("dim = 4 and dtype = 'float32'"), "method", "key_set", ["100", "200", ALL], "bytes_per_key")


@query(f"{RUNS} select key_set, dim, dtype, n_keys, group_bits, round(suffix_collapse_saving_pct, 8) as saving from runs where method like 'CD-%' and pre_suffix_bytes_per_key > 0")
def q_suffix_ready(spark, d):
    return report.suffix_ready(runs(spark, d)).select("key_set", "dim", "dtype", "n_keys", "group_bits", "saving")


@query(f"{RUNS}, b as (select * from (select *, case when method like 'PC-%' then 'PC' else 'CD' end variant, row_number() over (partition by case when method like 'PC-%' then 'PC' else 'CD' end, dim order by bytes_per_key, group_bits) r from runs where key_set = 'all' and dtype = 'float32') where r = 1) select variant, dim, group_bits, edges, round(bytes_per_key, 8) as bytes_per_key from b")
def q_best_baselines(spark, d):
    return report.best_baselines(runs(spark, d).where("key_set = 'all' and dtype = 'float32'"), "bytes_per_key").select("variant", "dim", "group_bits", "edges", "bytes_per_key")


@query(f"""{RUNS}, b as (select * from (select *, row_number() over (partition by dim order by bytes_per_key, group_bits) r from runs where key_set = 'all' and dtype = 'float32' and method like 'CD-%') where r = 1)
select r.dim, r.method, b.group_bits as best_group_bits, round((r.bytes_per_key - b.bytes_per_key) / b.bytes_per_key, 8) as delta_bpk, round(100.0 * (b.edges - r.edges) / b.edges, 8) as edge_reduction_pct from runs r join b on b.dim = r.dim where r.key_set = 'all' and r.dtype = 'float32'""")
def q_baseline_deltas(spark, d):
    rows = runs(spark, d).where("key_set = 'all' and dtype = 'float32'")
    base = report.best_baselines(rows, "bytes_per_key").where("variant = 'CD'")
    return report.against_baseline(rows, base).select("dim", "method", "best_group_bits", "delta_bpk", "edge_reduction_pct")


@query(f"{RUNS} select key_set, dim, dtype, method, n_keys, total_bytes from (select *, max(n_keys) over (partition by group_bits) top from runs) where n_keys = top")
def q_max_n_rows(spark, d):
    return report.at_max_n(runs(spark, d), ["group_bits"]).select("key_set", "dim", "dtype", "method", "n_keys", "total_bytes")


@query(f"""{STRUCTURE}, dep as (select *, depth * 4.0 / 64 as place from ({BY_DEPTH}) where cfg = '2/float32/4')
select 2 as dim, cast(round_even(place * 19, 0) as bigint) as bin, round(sum(memo_hits) / sum(finalize_calls), 8) as sharing_rate from dep group by 2""")
def q_depth_heatmap(spark, d):
    depths = sharing.by_depth(sharing.build(keyed(spark, d, SETS[:1]))).select(F.lit(2).alias("dim"), (F.col("depth") * 4 / 64).alias("normalized_depth"), "memo_hits", "finalize_calls")
    return report.depth_heatmap(depths)


@query(f"{STRUCTURE}, s as ({SUMMARY}) select cfg, 'shared' as kind, memo_hits as n from s union all select cfg, 'unique', unique_nodes from s")
def q_finalize_breakdown(spark, d):
    return report.finalize_breakdown(sharing.summary(sharing.build(keyed(spark, d))))


@query(f"{RUNS} select key_set, dim, dtype, group_bits, method, edges from runs where dim in (4, 64) and group_bits in (8, 32) and dtype = 'float32'")
def q_chosen_runs(spark, d):
    return report.chosen(runs(spark, d), dim=[4, 64], group_bits=[8, 32], dtype=["float32"], method=[]).select("key_set", "dim", "dtype", "group_bits", "method", "edges")


@query(f"{RUNS} select dim, " + ", ".join(f"round(max(case when method = 'CD-{g}' then suffix_collapse_saving_pct end), 8) as \"CD-{g}\"" for g in (4, 8, 16, 32)) + " from runs where key_set = 'all' and dtype = 'float32' group by 1")
def q_saving_pivot(spark, d):
    rows = runs(spark, d).where("key_set = 'all' and dtype = 'float32'")
    return report.pivot_table(rows, "dim", "method", [f"CD-{g}" for g in (4, 8, 16, 32)], "suffix_collapse_saving_pct")


@query(f"{RUNS} select group_bits, " + ", ".join(f"round(max(case when key_set = '{n}' then bytes_per_key end), 8) as \"{n}\"" for n in (100, 200, ALL)) + " from runs where dim = 64 and dtype = 'float32' and method like 'PC-%' group by 1")
def q_width_pivot(spark, d):
    return report.pivot_table(runs(spark, d).where("dim = 64 and dtype = 'float32' and method like 'PC-%'"), "group_bits", "key_set", ["100", "200", ALL], "bytes_per_key")


@query(f"""{STRUCTURE}, s as (select cfg, count(*) filter (in_degree > 1) as shared from i group by 1), m as (select cfg, count(*) nodes from c group by 1)
select m.cfg, round(coalesce(shared, 0) / nodes, 8) as shared_pct from m left join s on s.cfg = m.cfg""")
def q_shared_pct(spark, d):
    a = sharing.build(keyed(spark, d))
    nodes = sharing.classes(a).groupBy("cfg").agg(F.count("*").alias("nodes"))
    return nodes.join(sharing.shared_nodes(a), "cfg", "left").select("cfg", (F.coalesce("shared_nodes", F.lit(0)) / F.col("nodes")).alias("shared_pct"))


@query(f"select n_matches, count(*) as queries from (select q.vec_id, count(*) n_matches {BOX_BATCH} group by 1) group by 1")
def q_match_histogram(spark, d):
    v = vectors(spark, d).select("vec_id", F.slice("embedding", 1, 4).alias("embedding"))
    return spatial.box_batch(v, box_queries(spark, d)).groupBy("qid").agg(F.count("*").alias("n_matches")).groupBy("n_matches").agg(F.count("*").alias("queries"))


@query(f"""with m as (select q.vec_id as qid, count(*) filter (e.vec_id % 97 <> 5) = count(*) as ok, count(*) n {BOX_BATCH} group by 1), s as (select count(*) queries, count(*) filter (not ok) bad, round(avg(n), 8) avg_results from m)
select queries, bad as mismatches, avg_results, case when queries = 0 then 'n/a' when bad = 0 then 'OK' else 'FAIL ' || bad || '/' || queries end as truth from s""")
def q_rq_summary(spark, d):
    v = vectors(spark, d).select("vec_id", F.slice("embedding", 1, 4).alias("embedding"))
    found = spatial.box_batch(v, box_queries(spark, d)).select("qid", F.col("vec_id").alias("k"))
    ok = spatial.same_matches(found.where("k % 97 <> 5"), found)
    total = found.agg((F.count("*") / F.count_distinct("qid")).alias("avg_results"))
    s = ok.agg(F.count("*").alias("queries"), F.count_if(~F.col("ok")).alias("mismatches")).crossJoin(total)
    return s.select("queries", "mismatches", "avg_results", report.truth_cell(F.col("queries"), F.col("mismatches")).alias("truth"))


@query("""with r as (select l_orderkey % 3 as dim, 'float32' as dtype, l_linenumber as n_unique_keys, 8 as group_bits, case l_orderkey % 5 when 0 then 'dictionary' else 'CD-8' end as method, l_orderkey * 10 + l_linenumber as seq, l_quantity as v from lineitem)
select dim, dtype, n_unique_keys, group_bits, method, max(seq) as seq, round(max_by(v, {'seq': seq, 'v': v})::double, 8) as v from r where method <> 'dictionary' group by 1, 2, 3, 4, 5""")
def q_latest_runs(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    rows = li.select((F.col("l_orderkey") % 3).alias("dim"), F.lit("float32").alias("dtype"), F.col("l_linenumber").alias("n_unique_keys"), F.lit(8).alias("group_bits"), F.when(F.col("l_orderkey") % 5 == 0, "dictionary").otherwise("CD-8").alias("method"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_quantity").cast("double").alias("v"))
    return report.latest_runs(rows, "seq")


@query("select p_partkey, try_cast(substr(p_name, 1, 1) as double) as x from part where try_cast(substr(p_name, 1, 1) as double) is not null union all select p_partkey, round(p_size::double, 8) from part where p_partkey % 2 = 0")
def q_numeric_rows(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    both = p.select("p_partkey", F.substring("p_name", 1, 1).alias("x")).unionByName(p.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_size").cast("string").alias("x")))
    return report.numeric_rows(both, ["x"])


@query("""select n, case when n < 1024 then n || ' B' when n < 1048576 then format('{:,.2f} KB', n / 1024.0::double) else format('{:,.2f} MB', n / 1048576.0::double) end as size, case when n % 3 = 0 then 'n/a' when n % 5 = 0 then 'OK' else 'FAIL ' || (n % 5) || '/' || (n % 3) end as cell, n % 100 as first_number
from (select range * 7919 as n from range(0, 400))""")
def q_formatting(spark, d):
    n = spark.range(400).select((F.col("id") * 7919).alias("n"))
    numbers = report.int_list(F.concat(F.lit("200, "), F.col("n") % 100, F.lit(",300")))
    return n.select("n", report.size_text(F.col("n")).alias("size"), report.truth_cell(F.col("n") % 3, F.col("n") % 5).alias("cell"), numbers[0].alias("first_number"))


# ---------------------------------------------------------------- chunks and plans

CHUNK_SQL = f"""k as (select k from {o.keys(2)}), s as (select (select count(*) from k) n),
ch as (select g as group_bits, i as chunk, i * g as start_bit, count(distinct substr(k, i * g + 1, g)) as cardinality from k, (values (4), (8), (16), (24)) w(g), range(0, 16) r(i) where (i + 1) * g <= 64 group by 1, 2, 3),
card as (select ch.*, cardinality / n as branch_rate, cardinality / least(n, (2 ** group_bits)::bigint) as rho from ch, s)"""


@query(f"with {CHUNK_SQL} select group_bits, chunk, start_bit, cardinality, round(branch_rate, 8) as branch_rate, round(rho, 8) as rho from card")
def q_chunk_cardinality(spark, d):
    return segments.cardinality(bits(spark, d), 64, [4, 8, 16, 24])


@query(f"""with {CHUNK_SQL}, sp as (select c.group_bits, c.chunk, n.o, coalesce(x.rho, case when c.chunk + n.o < 0 then f.rho else l.rho end) v
  from card c cross join (values (-2), (-1), (0), (1), (2)) n(o)
  left join card x on x.group_bits = c.group_bits and x.chunk = c.chunk + n.o
  join (select group_bits, min_by(rho, chunk) rho from card group by 1) f on f.group_bits = c.group_bits join (select group_bits, max_by(rho, chunk) rho from card group by 1) l on l.group_bits = c.group_bits)
select group_bits, chunk, round(least(1.0, greatest(0.0, sum(v) / 5)), 6) as smoothed from sp group by 1, 2""")
def q_moving_mean(spark, d):
    out = segments.moving_mean(segments.cardinality(bits(spark, d), 64, [4, 8, 16, 24]), ["group_bits"], "chunk", "rho", 5)
    return out.select("group_bits", "chunk", F.round("smoothed", 6).alias("smoothed"))


FEATURES = f"""k as (select k, lag(k) over (order by k) prev, count(*) over () n from {o.keys(2)}),
f as (select start_bit, w as width, count(distinct substr(k, start_bit + 1, w)) as cardinality, count(*) filter (prev is not null and substr(k, start_bit + 1, w) <> substr(prev, start_bit + 1, w)) as changes, least(max(n), (2 ** w)::bigint) as kmax, max(n) as n
  from k, (values (1), (2), (4), (8), (16)) c(w), (values (0), (24), (48)) p(start_bit) group by 1, 2),
g as (select *, cardinality / kmax as rho, cardinality / n as branch_pressure, changes / greatest(1, n - 1) as adjacency_rate from f)"""


def feature_rows(spark, d):
    pairs = segments.with_previous(bits(spark, d))
    n = pairs.count()
    out = None
    for start in (0, 24, 48):
        f = segments.features(pairs, n, start, [1, 2, 4, 8, 16])
        out = f if out is None else out.unionByName(f)
    return out


@query(f"with {FEATURES} select start_bit, width, cardinality, changes, kmax, round(rho, 8) as rho, round(branch_pressure, 8) as branch_pressure, round(adjacency_rate, 8) as adjacency_rate from g")
def q_segment_features(spark, d):
    return feature_rows(spark, d)


@query(f"with {FEATURES} select start_bit, width, changes from g")
def q_adjacent_changes(spark, d):
    return feature_rows(spark, d).select("start_bit", "width", "changes")


@query(f"""with {FEATURES} select start_bit, width, round(width / 8 + (7 + {o.clog2('(width + 1)')} + 1) / 8 + 14 / greatest(1, width) + 22 * rho + 12 * branch_pressure + 10 * adjacency_rate - (10 * (1 - rho) + 8 * (1 - branch_pressure) + 8 * (1 - adjacency_rate))
  + case when start_bit / 64 < 0.2::double or start_bit / 64 > 0.7::double then -0.10::double * width else 0.15::double * width end, 6) as cost from g""")
def q_segment_cost(spark, d):
    return segments.cost(feature_rows(spark, d), 64).select("start_bit", "width", F.round("cost", 6).alias("cost"))


def _greedy_sql(threshold: float = 0.5) -> str:
    """The greedy plan walk as a recursive query over features of all places (64 bits)."""
    return f"""with recursive k as (select k from {o.keys(2)}), s as (select count(*) n from k),
f as (select p as start_bit, w, count(distinct substr(k, p + 1, w)) as cardinality from k, range(0, 64) r(p), (values (1), (2), (4), (8), (16), (32), (64)) c(w) where p + w <= 64 group by 1, 2),
best as (select start_bit, coalesce(max(w) filter (cardinality / least(n, (2.0 ** w)) <= {threshold}), min(w)) as width from f, s group by 1),
walk(segment_idx, start_bit, width) as (
  select 0, start_bit, width from best where start_bit = 0
  union all select w.segment_idx + 1, b.start_bit, b.width from walk w join best b on b.start_bit = w.start_bit + w.width)"""


@query(_greedy_sql() + " select cast(segment_idx as bigint) as segment_idx, cast(start_bit as bigint) as start_bit, cast(width as bigint) as width from walk")
def q_plan_greedy(spark, d):
    return segments.plan(spark, segments.greedy(bits(spark, d), 64, 0.5))


def _cost_aware_sql(source: str, threshold: float) -> str:
    """CTEs up to walk(segment_idx, start_bit, width) of the cost-aware plan of 64-bit keys of a subquery.

    The candidates of a place, from the widest on, are folded with the tie rule.
    """
    cost = f"""w / 8 + (7 + {o.clog2('(w + 1)')} + 1) / 8 + 14 / greatest(1, w) + 22 * rho + 12 * p + 10 * a - (10 * (1 - rho) + 8 * (1 - p) + 8 * (1 - a))
      + case when start_bit / 64 < 0.2::double or start_bit / 64 > 0.7::double then -0.10::double * w else 0.15::double * w end"""
    margin = "(case when b.cost > 0 then 0.05::double * b.cost else 0.05::double end)"
    tie = "(case when x.rho > 0.75 or x.a > 0.75 then x.w < b.w when x.rho < 0.2 and x.a < 0.25 then x.w > b.w else x.rho < b.rho or (x.rho = b.rho and x.w > b.w) end)"
    return f"""ck as (select k, lag(k) over (order by k) prev, count(*) over () n from {source}),
cf as (select start_bit * 4 as start_bit, w, count(distinct substr(k, start_bit * 4 + 1, w)) as c, count(*) filter (prev is not null and substr(k, start_bit * 4 + 1, w) <> substr(prev, start_bit * 4 + 1, w)) as ch, max(n) as n
  from ck, range(0, 16) r(start_bit), (values (4), (8), (16), (32), (64)) v(w) where start_bit * 4 + w <= 64 group by 1, 2),
cr as (select start_bit, w, c / least(n, (2.0::double ** w)) as rho, c / n as p, ch / greatest(1, n - 1) as a from cf),
cc as (select start_bit, w, rho, a, {cost} as cost from cr),
cb as (select start_bit, min(w) as narrowest, list({{'w': w, 'cost': cost, 'rho': rho, 'a': a}} order by w desc) filter (rho <= {threshold}) as l from cc group by 1),
chosen as (select start_bit, case when l is null or len(l) = 0 then narrowest else list_reduce(l, lambda b, x: case when x.cost + {margin} < b.cost then x when abs(x.cost - b.cost) <= {margin} and {tie} then x else b end).w end as width from cb),
walk(segment_idx, start_bit, width) as (
  select 0, start_bit, width from chosen where start_bit = 0
  union all select w.segment_idx + 1, b.start_bit, b.width from walk w join chosen b on b.start_bit = w.start_bit + w.width)"""


@query(f"with recursive {_cost_aware_sql(o.keys(2), 0.5)} select cast(segment_idx as bigint) as segment_idx, cast(start_bit as bigint) as start_bit, cast(width as bigint) as width from walk")
def q_plan_cost_aware(spark, d):
    return segments.plan(spark, segments.cost_aware(bits(spark, d), 64, 0.5))


@query(_greedy_sql(0.7) + ", joined as (select w.segment_idx, w.start_bit, w.width, f.cardinality, f.cardinality / least(n, (2.0 ** f.w)) as rho from walk w join f on f.start_bit = w.start_bit and f.w = w.width, s)"
       " select cast(segment_idx as bigint) as segment_idx, cast(start_bit as bigint) as start_bit, cast(width as bigint) as width, cardinality, round(rho::double, 8) as rho from joined")
def q_greedy_segments(spark, d):
    rows = segments.greedy_rows(bits(spark, d), 64, 0.7)
    return spark.createDataFrame([(i, r.start_bit, r.width, r.cardinality, r.rho) for i, r in enumerate(rows)], "segment_idx int, start_bit int, width int, cardinality long, rho double")


@query("with s as (select 0 as segment_idx, 0 as start_bit, 12 as width union all select 1 + range, 12 + 8 * range, case when range = 3 then 8 else 8 end from range(0, 4) union all select 5, 44, 20) select cast(segment_idx as bigint) as segment_idx, cast(start_bit as bigint) as start_bit, cast(width as bigint) as width from s")
def q_plan_phase(spark, d):
    return segments.plan(spark, segments.phase_aware(64, widths=(1024, 8, 128)))


@query("select range as segment_idx, range * 24 as start_bit, least(24, 64 - range * 24) as width from range(0, 3)")
def q_plan_uniform(spark, d):
    return segments.plan(spark, segments.uniform(24, 64))


@query("select '4:1;8:2;12:1;16:2' as width_histogram")
def q_width_histogram(spark, d):
    return segments.width_histogram(segments.plan(spark, PLAN))


@query("select * from (values ('exact', true), ('short', false), ('zero', false)) t(plan, valid)")
def q_plan_valid(spark, d):
    return values_table(spark, [("exact", segments.valid(PLAN, 64)), ("short", segments.valid(PLAN[:-1], 64)), ("zero", segments.valid([0, 64], 64))], "plan string, valid boolean")


def plan_candidates(spark, d):
    """Sizes of candidate plans on an even sample of keys; the best plan is the smallest."""
    sample = materialise(ks.even_sample(bits(spark, d), 200))
    n_sample = sample.count()
    plans = {"greedy": segments.greedy(sample, 64, 0.5), "cost_aware": segments.cost_aware(sample, 64, 0.5), "phase_aware": segments.phase_aware(64)} | {f"uniform-{g}": segments.uniform(g, 64) for g in (8, 16, 32)}
    rows = None
    for name, widths in plans.items():
        part = sample.select(F.lit(name).alias("cfg"), "k", F.array(*[F.lit(w) for w in widths]).alias("widths"))
        rows = part if rows is None else rows.unionByName(part)
    pc = sharing.path_compression(sharing.build(rows, keep=True))
    n = F.create_map(*[F.lit(x) for name, widths in plans.items() for x in (name, len(widths))])[F.col("cfg")]
    return sharing.dynamic_size(pc, n).select("cfg", (F.col("total_bytes") / n_sample / 8).alias("sample_normalized_bpk"))


@query()
def q_sampled_best(spark, d):
    """The plan that is smallest on an even sample of the keys; its parts are registered with SQL of their own."""
    return plan_candidates(spark, d).orderBy("sample_normalized_bpk", "cfg").limit(1)


@query(f"{STRUCTURE}, dep as ({BY_DEPTH}) select cfg, depth, round(depth / (select max(len(widths)) from keyed k where k.cfg = dep.cfg), 8) as normalized_depth, round(memo_hits / finalize_calls, 8) as sharing_rate, dawg_edges from dep")
def q_depth_profile(spark, d):
    k = keyed(spark, d)
    levels = k.groupBy("cfg").agg(F.max(F.size("widths")).alias("levels"))
    return report.depth_profile(sharing.by_depth(sharing.build(k)).join(F.broadcast(levels), "cfg"))


@query(f"{STRUCTURE}, h as (select cfg, in_degree, count(*) n from i group by 1, 2) select cfg, least(in_degree, 5) as in_degree, cast(sum(n) as bigint) as node_count from h group by 1, 2")
def q_indegree_capped(spark, d):
    return report.capped_histogram(sharing.in_degree_histogram(sharing.build(keyed(spark, d))), 5)


@query(f"{RUNS}, b as (select dim, dtype, key_set, n_unique_keys * dim * case dtype when 'float16' then 16 else 32 end / 8 as raw from runs group by all) select r.key_set, r.dim, r.dtype, r.n_keys, r.method, round(r.total_bytes / b.raw, 8) as ratio from runs r join b on b.dim = r.dim and b.dtype = r.dtype and b.key_set = r.key_set")
def q_size_ratio(spark, d):
    return report.size_ratio(runs(spark, d)).select("key_set", "dim", "dtype", "n_keys", "method", "ratio")


@query(f"with {CHUNK_SQL} select start_bit, round(max(case when group_bits = 4 then rho end), 8) as w4, round(max(case when group_bits = 8 then rho end), 8) as w8, round(max(case when group_bits = 16 then rho end), 8) as w16 from card where group_bits < 24 group by 1")
def q_saturation_curves(spark, d):
    rho = segments.cardinality(bits(spark, d), 64, [4, 8, 16])
    return report.pivot_table(rho, "start_bit", "group_bits", [4, 8, 16], "rho").select("start_bit", F.col("4").alias("w4"), F.col("8").alias("w8"), F.col("16").alias("w16"))


@query("select * from (values ('phase', 6, 12), ('uniform', 3, 24)) t(plan, segments, first_width)")
def q_segment_summary(spark, d):
    both = segments.plan(spark, segments.phase_aware(64, widths=(1024, 8, 128))).withColumn("plan", F.lit("phase")).unionByName(segments.plan(spark, segments.uniform(24, 64)).withColumn("plan", F.lit("uniform")))
    return segments.plan_summary(both, ["plan"])


@query()
def q_retry_histogram(spark, d):
    found = spatial.exact_match_queries(vectors(spark, d).select("vec_id", F.slice("embedding", 1, 4).alias("embedding")), None, 2, 20, seed=9)
    return found.groupBy("retries").agg(F.count("*").alias("queries"))


@query()
def q_sample_rows(spark, d):
    return spatial.sample_rows(vectors(spark, d), 25, seed=4).select("vec_id")


DYNAMIC = [("uniform-8", 2, False, [8] * 8), ("uniform-16", 2, False, [16] * 4), ("phase_aware", 2, False, segments.phase_aware(64, widths=(1024, 8, 128))), ("manual", 2, False, PLAN)]
FIXED = [(f"fixed-{g}", 2, False, [g] * (64 // g)) for g in (4, 8, 16, 32)]
PLAN_TEXT = {name: (len(w), ";".join(f"{x}:{w.count(x)}" for x in sorted(set(w)))) for name, _, _, w in DYNAMIC}


def _best(prefix: str) -> str:
    return f"(select group_bits as best_{prefix}_storage_group_bits, {prefix}_bytes_per_key as best_{prefix}_bytes_per_key, {prefix}_edges as best_{prefix}_edges from fixed order by {prefix}_bytes_per_key, group_bits limit 1)"


@query(f"""with {o.structure(keyed_sql(DYNAMIC + FIXED))}, {o.PATHS}, total as (select count(*) n_keys from {o.keys(2)}),
fixed as (select cast(substr(cfg, 7) as bigint) as group_bits, {o.compressed_bytes()} / n_keys as pc_bytes_per_key, pc_edges, {o.fixed_bytes('edges', "cast(substr(cfg, 7) as bigint)")} / n_keys as cd_bytes_per_key, edges as cd_edges from pc, total where cfg like 'fixed-%'),
dyn as (select cfg as segmentation_method, n_keys, cast(case cfg {' '.join(f"when '{k}' then {v[0]}" for k, v in PLAN_TEXT.items())} end as bigint) as n_segments, case cfg {' '.join(f"when '{k}' then '{v[1]}'" for k, v in PLAN_TEXT.items())} end as width_histogram,
  pc_edges as edges, label_bits, cast({o.compressed_bytes()} + 8 * case cfg {' '.join(f"when '{k}' then {v[0]}" for k, v in PLAN_TEXT.items())} end + 4 as bigint) as total_bytes from pc, total where cfg not like 'fixed-%')
select segmentation_method, n_keys, n_segments, width_histogram, edges, label_bits, total_bytes, round(total_bytes / n_keys, 8) as bytes_per_key, round(total_bytes / n_keys / 8, 8) as normalized_bpk,
  best_pc_storage_group_bits, round(best_pc_bytes_per_key, 8) as best_pc_bytes_per_key, best_pc_edges, round((total_bytes / n_keys - best_pc_bytes_per_key) / best_pc_bytes_per_key, 8) as delta_vs_best_pc_bpk, round(100.0::double * (best_pc_edges - edges) / best_pc_edges, 8) as edge_reduction_vs_best_pc_pct,
  best_cd_storage_group_bits, round(best_cd_bytes_per_key, 8) as best_cd_bytes_per_key, best_cd_edges, round((total_bytes / n_keys - best_cd_bytes_per_key) / best_cd_bytes_per_key, 8) as delta_vs_best_cd_bpk, round(100.0::double * (best_cd_edges - edges) / best_cd_edges, 8) as edge_reduction_vs_best_cd_pct
from dyn, {_best('pc')}, {_best('cd')}""")
def q_dynamic_sweep(spark, d):
    n = bits(spark, d).count()
    pc = sharing.path_compression(sharing.build(keyed(spark, d, DYNAMIC + FIXED), keep=True))
    gb = F.substring_index("cfg", "-", -1).cast("int")
    fixed = sharing.compressed_size(pc.where(F.col("cfg").startswith("fixed-"))).select(gb.alias("group_bits"), (F.col("total_bytes") / n).alias("pc_bytes_per_key"), "pc_edges", (fn.fixed_bytes(F.col("edges"), gb) / n).alias("cd_bytes_per_key"), F.col("edges").alias("cd_edges"))
    texts = spark.createDataFrame([(k, *v) for k, v in PLAN_TEXT.items()], "cfg string, n_segments int, width_histogram string")
    own = pc.where(~F.col("cfg").startswith("fixed-")).join(F.broadcast(texts), "cfg")
    sizes = sharing.dynamic_size(own, F.element_at(F.create_map(*[F.lit(x) for k, v in PLAN_TEXT.items() for x in (k, v[0])]), F.col("cfg")))
    rows = sizes.join(F.broadcast(texts), "cfg").select(F.col("cfg").alias("segmentation_method"), F.lit(n).cast("long").alias("n_keys"), "n_segments", "width_histogram", "edges", "label_bits", "total_bytes", (F.col("total_bytes") / n).alias("bytes_per_key"), (F.col("total_bytes") / n / 8).alias("normalized_bpk"))
    return report.against_fixed(rows, fixed)


# ---------------------------------------------------------------- files


def _file(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("select vec_id - (select min(vec_id) from embeddings) as vec_id, i - 1 as dim, round(embedding[i]::double, 8) as x from embeddings, range(1, 65, 9) r(i)")
def q_vector_file(spark, d):
    """Vectors written as raw float32 rows and read back; vec_id counts from 0 as the table's does."""
    path = _file(spark, "vectors")
    vector_files.write_vectors(vectors(spark, d), path)
    back = vector_files.read_vectors(spark, path, 64)
    dims = F.array(*[F.struct(F.lit(i - 1).alias("dim"), F.col("embedding")[i - 1].alias("x")) for i in range(1, 65, 9)])
    return back.select("vec_id", F.inline(dims))


@query(f"select distinct {o.morton(64)} k from embeddings")
def q_packed_key_file(spark, d):
    """Keys written as packed records and read back."""
    path = _file(spark, "keys")
    vector_files.write_packed_keys(ks.unique_keys(vectors(spark, d), 64), path)
    return vector_files.read_packed_keys(spark, path, 2048).select(fn.bit_string(F.col("k"), 2048).alias("k"))


@query(f"select key, value from {ENTRIES}")
def q_dictionary_file(spark, d):
    path = _file(spark, "dictionary")
    vector_files.write_dictionary(entries(spark, d), path)
    return vector_files.read_dictionary(spark, path)


@query("select 64 as embed_dim, 'float32' as dtype, 4 as item_size_bytes, count(*) as total_vectors, count(*) * 256 as total_size_bytes, 1024 as truncated_from_dim, 'embeddings' as source_file, true as merged_file, '2024-01-01T00:00:00' as truncated_at from embeddings")
def q_sidecar(spark, d):
    path = _file(spark, "sidecar")
    vector_files.write_sidecar(spark, path, 64, "float32", vectors(spark, d).count(), "embeddings", 1024, merged=True, truncated_at="2024-01-01T00:00:00")
    return vector_files.read_sidecar(spark, path)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
