"""The registered queries of this folder, and their DuckDB SQL where there is one."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import bpe, chat, decontaminate, licenses, line_dedup, merkle, minhash, pii, repair, sharding, suffixes, toxicity, vptree
from tidewire.llm.common import table
from tidewire.operators.shuffles import shared_folder

RANKS = "byte_bpe_50k.tiktoken"


def op1_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(pii.find_spans(docs, pii.train_on(docs)))


def op4_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train_on(docs, labels.where(~toxicity.in_fold("doc_id")))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.in_fold("doc_id").alias("held_out"), "score", toxicity.rejected().cast("int").alias("predicted")
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op6_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.size(F.split("text", "\n")).cast("long")
    kept = F.coalesce("text", F.lit(""))
    return line_dedup.dedup_lines(docs).select("doc_id", "n_removed", lines.alias("n_lines_left"), F.sha2(kept, 256).alias("kept_sha256"))


def op7_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = chat.reply_order(table(spark, sf_dir, "conversations"))
    return ordered.select(
        "conv_id", "thread", "turn", "position", "role", "parent_turn", "n_quotes", "n_linked", "deepest",
        F.md5("body").alias("body_md5"), F.md5("chat").alias("chat_md5"),
    )


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(suffixes.without_repeats(table(spark, sf_dir, "documents"), length=400))


def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.count("*").alias("n_places"), F.max("n_matched").alias("n_matched"), F.max("n_windows").alias("n_windows"), F.max("exact").alias("exact")
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(table(spark, sf_dir, "documents"), arity=8)


def op12_min_cost_flow_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 32 shards by a hash of the id, of unequal sizes, to 40 of equal bytes."""
    folder = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    before = F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)), F.lit(32))
    placed = sharding.lay_out(table(spark, sf_dir, "documents"), folder, shards=40, old=before)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_glr_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(rows), rows)


QUERIES = {
    f.__name__: f
    for f in (
        op1_vantage_point_trees, op2_byte_bpe, op3_pii_semi_markov, op4_toxicity_fm, op5_license_scan, op6_line_alignment,
        op7_quote_linking, op8_suffix_repeats, op9_minmax_near_dedup, op10_template_leaks, op11_merkle_manifest, op12_min_cost_flow_sharding,
        op13_glr_repair,
    )
}
SQL = {"op5_license_scan": licenses.report_sql(), "op7_quote_linking": chat.reply_sql(), "op11_merkle_manifest": merkle.audit_sql()}
