"""Order-preserving float maps and Morton keys.

Arithmetic on float bits runs in Arrow UDFs over whole batches; everything else here is a built-in expression.
A Morton key holds, level by level from the most significant bit, one bit of every dimension; dimension 0 comes
first.  Keys are BINARY, packed most significant bit first, or strings of '0' and '1'.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_u32(x: np.ndarray) -> np.ndarray:
    """float32 -> uint32 whose unsigned order is the total order of floats (-0.0 below +0.0)."""
    u = np.ascontiguousarray(x, np.float32).view(np.uint32)
    return np.where(u >> np.uint32(31), ~u, u ^ np.uint32(0x80000000))


def ordered_u32_to_float(o: np.ndarray) -> np.ndarray:
    """The inverse of ordered_u32."""
    o = np.ascontiguousarray(o, np.uint32)
    return np.where(o >> np.uint32(31), o ^ np.uint32(0x80000000), ~o).view(np.float32)


def half_bits(x: np.ndarray) -> np.ndarray:
    """float32 -> half-precision bits by truncation.

    From 65536 on (and for NaN) infinity; below 2**-25 signed zero; below 2**-14 the exponent wraps in 16 bits, so
    that the low 16 bits of (exponent << 10) count, the sign bit included.
    """
    u = np.ascontiguousarray(x, np.float32).view(np.uint32)
    sign, size = (u >> np.uint32(16)) & np.uint32(0x8000), u & np.uint32(0x7FFFFFFF)
    exponent = ((size >> np.uint32(23)) + np.uint32(0x10000 - 112)) & np.uint32(0x3F)
    finite = sign | (exponent << np.uint32(10)) | ((size & np.uint32(0x7FFFFF)) >> np.uint32(13))
    out = np.where(size >= 0x47800000, sign | np.uint32(0x7C00), np.where(size < 0x33000000, sign, finite))
    return out.astype(np.uint16)


def ordered_u16(x: np.ndarray) -> np.ndarray:
    h = half_bits(x)
    return np.where(h >> np.uint16(15), ~h, h ^ np.uint16(0x8000))


def _vectors(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all of one length, as a matrix."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def interleave(ordered: np.ndarray) -> np.ndarray:
    """Morton keys (packed bytes) of rows of ordered unsigned integers."""
    n, dims = ordered.shape
    width = ordered.dtype.itemsize * 8
    bits = np.unpackbits(ordered.astype(ordered.dtype.newbyteorder(">")).view(np.uint8).reshape(n, dims, width // 8), axis=2)
    return np.packbits(bits.reshape(n, dims, width).transpose(0, 2, 1).reshape(n, dims * width), axis=1)


def morton_key(vector: Column, dims: int, shift: float = 0.0, half: bool = False) -> Column:
    """BINARY Morton key of the first dims components, each plus shift in float32."""
    step, order = np.float32(shift), ordered_u16 if half else ordered_u32

    @F.arrow_udf("binary")
    def encode(column: pa.Array) -> pa.Array:
        return _binary(interleave(order(_vectors(column) + step)) if len(column) else np.zeros((0, 1), np.uint8))

    return encode(F.slice(vector, 1, dims))


def ordered_values(vector: Column, shift: float = 0.0, half: bool = False) -> Column:
    """Array of the components' ordered unsigned integers, each component plus shift in float32."""
    step, order = np.float32(shift), ordered_u16 if half else ordered_u32

    @F.arrow_udf("array<long>")
    def encode(column: pa.Array) -> pa.Array:
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
        offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(order(values + step).astype(np.int64)))

    return encode(vector)


def floats_of(ordered: Column) -> Column:
    """Array of the floats whose ordered 32-bit integers are given."""

    @F.arrow_udf("array<float>")
    def decode(column: pa.Array) -> pa.Array:
        offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ordered_u32_to_float(column.flatten().to_numpy(zero_copy_only=False).astype(np.uint32))))

    return decode(ordered)


def half_to_float(bits: Column) -> Column:
    """float32 of half-precision bits given as an integer."""

    @F.arrow_udf("float")
    def widen(column: pa.Array) -> pa.Array:
        return pa.array(column.to_numpy(zero_copy_only=False).astype(np.uint16).view(np.float16).astype(np.float32))

    return widen(bits)


def bit_string(key: Column, n_bits: int | Column | None = None) -> Column:
    """A BINARY key as a string of '0' and '1'."""
    digits = F.translate(F.hex(key), "0123456789ABCDEF", "abcdefghijklmnop")
    for i, letter in enumerate("abcdefghijklmnop"):
        digits = F.replace(digits, F.lit(letter), F.lit(f"{i:04b}"))
    return digits if n_bits is None else F.substring(digits, 1, n_bits)


def level_symbol(bits: Column, dims: int, level: int) -> Column:
    """The dims bits of one level of a key given as a bit string."""
    return F.substring(bits, level * dims + 1, dims)


def wide(operation: str, a: Column, b: Column) -> Column:
    """Bitwise xor, xnor, and, or of two BINARY keys of one length."""
    base = {"xor": np.bitwise_xor, "xnor": np.bitwise_xor, "and": np.bitwise_and, "or": np.bitwise_or}[operation]

    @F.arrow_udf("binary")
    def combine(x: pa.Array, y: pa.Array) -> pa.Array:
        out = base(_bytes_of(x), _bytes_of(y))
        return _binary(~out if operation == "xnor" else out)

    return combine(a, b)


def wide_shift(a: Column, by: int) -> Column:
    """A BINARY key shifted towards its end by so many bits, towards its beginning where by is negative; zeros come in."""

    @F.arrow_udf("binary")
    def shift(x: pa.Array) -> pa.Array:
        bits = np.unpackbits(_bytes_of(x), axis=1)
        out = np.zeros_like(bits)
        if by >= 0:
            out[:, by:] = bits[:, : bits.shape[1] - by]
        else:
            out[:, :by] = bits[:, -by:]
        return _binary(np.packbits(out, axis=1))

    return shift(a)


def wide_ones(a: Column) -> Column:
    """How many bits of a BINARY key are set."""

    @F.arrow_udf("long")
    def ones(x: pa.Array) -> pa.Array:
        return pa.array(np.bitwise_count(_bytes_of(x)).sum(axis=1, dtype=np.int64))

    return ones(a)


def wide_field(a: Column, start: int, width: int) -> Column:
    """width bits of a BINARY key from bit `start` on, as a string."""
    first = start // 8
    some = F.substring(a, first + 1, (start + width - 1) // 8 - first + 1)
    return F.substring(bit_string(some), start - 8 * first + 1, width)


def masked_not_equal(a: Column, b: Column, first_bits: int) -> Column:
    """Whether two BINARY keys differ in their first bits (whole bytes)."""
    return F.substring(a, 1, first_bits // 8) != F.substring(b, 1, first_bits // 8)


def _bytes_of(column: pa.Array) -> np.ndarray:
    """A binary column, all of one length, as a matrix of bytes."""
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(n, -1) if n else np.zeros((0, 1), np.uint8)


def bit_width(value: Column) -> Column:
    """Bits needed for a non-negative integer, at least 1."""
    return F.greatest(F.lit(1), F.length(F.bin(value)))


def ceil_log2(value: Column) -> Column:
    """1 up to 1, above that the bit width of value - 1."""
    return F.when(value <= 1, F.lit(1)).otherwise(F.length(F.bin(value - 1)))


def symbol_capacity(n: Column, width: Column) -> Column:
    """min(n, 2**width)."""
    return F.when(width >= 62, n).otherwise(F.least(n, F.expr("1L") * F.pow(F.lit(2.0), width).cast("long")))


def fixed_bytes(edges: Column, group_bits: Column) -> Column:
    """Bytes of a packed fixed-width automaton of so many edges."""
    return F.ceil(edges * (group_bits + bit_width(edges) + 1) / 8).cast("long")


def compressed_bytes(edges: Column, label_bits: Column, max_chunks: Column) -> Column:
    """Bytes of a packed automaton with labels of several chunks."""
    return F.ceil((label_bits + edges * (bit_width(label_bits) + bit_width(max_chunks) + bit_width(edges) + 1)) / 8).cast("long")


def chunks(bits: Column, width: int, pad: str = "0") -> Column:
    """Array of fixed-width chunks of a bit string; the last is filled with pad."""
    n = F.ceil(F.length(bits) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.rpad(F.substr(bits, i * width + 1, F.lit(width)), width, pad))


def plan_chunks(bits: Column, widths: list[int]) -> Column:
    """Array of the chunks of a bit string under a segment plan, filled with '0'."""
    starts = [sum(widths[:i]) for i in range(len(widths))]
    return F.array(*[F.rpad(F.substring(bits, s + 1, w), w, "0") for s, w in zip(starts, widths, strict=True)])


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance: float32 differences, summed in double."""
    terms = F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def inside(vector: Column, low: Column, high: Column) -> Column:
    """Whether low <= vector <= high in every component, by float comparison."""
    return F.forall(F.zip_with(F.arrays_zip(vector.alias("x"), low.alias("l")), high, lambda p, h: (p["x"] >= p["l"]) & (p["x"] <= h)), lambda ok: ok)


def clip_to_half(low: Column, high: Column, level: Column, bit: Column) -> tuple[Column, Column]:
    """Bounds of an ordered 32-bit coordinate clipped to the half-space with the given bit at a level (0 is the highest)."""
    unit = F.pow(F.lit(2.0), F.lit(31) - level).cast("long")
    base = F.floor(low / (unit * 2)).cast("long") * (unit * 2)
    clipped_low = F.when(bit == 1, F.greatest(low, base + unit)).otherwise(low)
    clipped_high = F.when(bit == 0, F.least(high, base + unit - 1)).otherwise(high)
    return clipped_low, clipped_high
