"""The corpus pipeline: toxic documents go, boilerplate lines go, one document of each near-duplicate group stays,
and what is left is packed into training sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zetamill.llm import line_dedup, minhash_dedup, packing, toxicity
from zetamill.llm.runtime import scratch, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the toxicity model, trained on this stage's labelled documents, doesn't predict toxic.

    Null and empty texts count as texts without words; repeated rows are judged alike; without labels of both kinds, and for an
    empty table, all rows stay.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that are boilerplate of their source; n_chars follows the text.

    Null texts stay null, rows without a source stay as they are, repeated rows are pages of their own, an empty table stays
    empty.
    """
    out = line_dedup.dedup_lines(docs, host="source")
    return out.withColumn("n_chars", F.when(F.col(out.columns[-1]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the document with the smallest id.

    Texts without words and rows without an id stay; rows that repeat an id leave one; an empty table stays empty.
    """
    return minhash_dedup.drop_near_duplicates(docs, k=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens.

    Null and empty texts are one piece of the end token alone, repeated rows are packed as often as they come, an empty table gives
    an empty table.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("minhash_near_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: Scores of a trained model and tokenizers are beyond SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
