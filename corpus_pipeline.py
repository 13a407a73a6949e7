"""From raw documents to token digests: the stages of the training-data pipeline.

Each stage takes what its predecessor kept and returns the columns of documents; the last one returns a digest of each
document's tokens. ORACLE_SQL is None: a learned score, alignment and byte-pair merges have no SQL; the stages are tested
against brute force instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from tidewire.llm.common import table
from tidewire.operators.shuffles import drop, kept, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7, by a model fitted on the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(~toxicity.in_fold("doc_id"))
    return toxicity.drop_toxic(docs, toxicity.train_on(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has. A document of which nothing is left goes."""
    cut = line_dedup.dedup_lines(docs).where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by five-word shingles at 0.8 or more."""
    return minhash.keep_one(docs, minhash.near_duplicates(docs, words=5, percent=80))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, whatever its numbers, names and units."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level BPE", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are a table in the shared folder, which goes when the next one is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):  # what a stage saves on its way goes when its rows are written
            after = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if name != STAGES[0][0]:
            drop(docs)
        docs = after
    return docs
