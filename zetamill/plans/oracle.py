"""SQL fragments for the oracle: float bits, Morton keys and automaton structure, over the registered tables."""

from __future__ import annotations


def ordered_bits(x: str) -> str:
    """Bits of a float expression's ordered 32-bit integer, as a string."""
    return f"list_transform([({x})::FLOAT::BIT::VARCHAR], lambda s: case when s[1] = '1' then translate(s, '01', '10') else '1' || s[2:] end)[1]"


def ordered_half_bits(x: str) -> str:
    """Bits of a float expression's ordered 16-bit integer (half precision by truncation), as a string."""
    size, exponent = "(u & 2147483647)", "((((u & 2147483647) >> 23) + 65424) & 63)"
    sign = "((u >> 16) & 32768)"
    half = f"case when {size} >= 1199570944 then {sign} | 31744 when {size} < 855638016 then {sign} else {sign} | ({exponent} << 10) | (({size} & 8388607) >> 13) end"
    flip = f"list_transform([{half}], lambda h: case when h >= 32768 then 65535 - h else h + 32768 end)[1]"
    return f"list_transform([cast('0b' || (({x})::FLOAT::BIT::VARCHAR) as bigint)], lambda u: lpad(bin({flip}), 16, '0'))[1]"


def morton(dims: int, shift: str = "0.5", half: bool = False, vector: str = "embedding") -> str:
    """Morton key of the first dims components of a vector column, as a string."""
    width = 16 if half else 32
    bits = (ordered_half_bits if half else ordered_bits)(f"x + {shift}::FLOAT")
    rows = f"list_transform(list_slice({vector}, 1, {dims}), lambda x: {bits})"
    level = "array_to_string(list_transform(b, lambda s: s[l]), '')"
    return f"list_transform([{rows}], lambda b: array_to_string(list_transform(range(1, {width + 1}), lambda l: {level}), ''))[1]"


def keys(dims: int, shift: str = "0.5", half: bool = False) -> str:
    """Subquery of the distinct keys."""
    return f"(select distinct {morton(dims, shift, half)} k from embeddings)"


def width(v: str) -> str:
    return f"greatest(1, length(bin({v})))"


def clog2(v: str) -> str:
    return f"case when {v} <= 1 then 1 else length(bin(({v}) - 1)) end"


def structure(keyed: str) -> str:
    """CTEs t (trie), n (nodes), c (classes), e (edges), i (in-degrees), z (compressible) of keyed(cfg, k, starts, widths).

    starts and widths are lists of equal length with the place and width of each chunk.
    """
    return f"""
keyed as ({keyed}),
t as (
  select cfg, k, d, w, len(widths) l_max, substr(k, 1, s) p, substr(k, s + 1, w) l, substr(k, s + 1) x, substr(k, s + w + 1) y
  from (select cfg, k, widths, d, widths[d + 1] w, starts[d + 1] s from (select *, unnest(range(0, len(widths))) d from keyed))),
n as (select cfg, d, p, md5(string_agg(x, ',' order by x)) sig, count(distinct l) deg from t group by 1, 2, 3),
c as (select cfg, d, sig, min(deg) deg, count(*) m from n group by 1, 2, 3),
en as (select cfg, d, p, l, min(w) w, min(l_max) l_max, md5(string_agg(y, ',' order by y)) csig from t group by 1, 2, 3, 4),
e as (select distinct en.cfg, en.d, n.sig, en.l, en.csig, en.w, en.l_max from en join n on n.cfg = en.cfg and n.d = en.d and n.p = en.p),
i as (select cfg, d + 1 d, csig sig, count(*) in_degree from e where d + 1 < l_max group by 1, 2, 3),
z as (select i.cfg, i.d, i.sig from i join c on c.cfg = i.cfg and c.d = i.d and c.sig = i.sig where in_degree = 1 and deg = 1)"""


#: Path compression: (cfg, edges, compressible, pc_edges, label_bits, max_chunks) from the CTEs of structure().
PATHS = """
path as (select distinct t.cfg, t.k, t.d from t join n on n.cfg = t.cfg and n.d = t.d and n.p = t.p join z on z.cfg = n.cfg and z.d = n.d and z.sig = n.sig),
island as (select cfg, k, d - row_number() over (partition by cfg, k order by d) g from path),
longest as (select cfg, max(r) longest from (select cfg, k, g, count(*) r from island group by 1, 2, 3) group by 1),
pc as (
  select a.cfg, a.edges, coalesce(b.n, 0) compressible, a.edges - coalesce(b.n, 0) pc_edges, a.label_bits, coalesce(longest, 0) + 1 max_chunks
  from (select cfg, count(*) edges, cast(sum(w) as bigint) label_bits from e group by 1) a
  left join (select cfg, count(*) n from z group by 1) b on b.cfg = a.cfg left join longest on longest.cfg = a.cfg)"""


def compressed_bytes(edges: str = "pc_edges", labels: str = "label_bits", chunks: str = "max_chunks") -> str:
    return f"cast(ceil(({labels} + {edges} * ({width(labels)} + {width(chunks)} + {width(edges)} + 1)) / 8.0) as bigint)"


def fixed_bytes(edges: str, group_bits: str) -> str:
    return f"cast(ceil({edges} * ({group_bits} + {width(edges)} + 1) / 8.0) as bigint)"
