"""Keys of a stream of vectors: encoding is stateless, deduplication keeps one row a key in the state store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from zetamill.operators.keys import encode


def key_stream(vectors: DataFrame, dims: int, shift: float = 0.5, half: bool = False) -> DataFrame:
    """(vec_id, k) of a streaming (or batch) table of vectors."""
    return encode(vectors, dims, shift, half)


def new_keys(vectors: DataFrame, dims: int, shift: float = 0.5, half: bool = False) -> DataFrame:
    """Each distinct key of the stream once, when it first comes."""
    return key_stream(vectors, dims, shift, half).select("k").dropDuplicates(["k"])
