"""Streaming queries: the given tables replayed as files, each with the result of its batch twin."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import ladder
from tidewire.operators.shuffles import shared_folder
from tidewire.plans import readers
from tidewire.sources.landed import table
from tidewire.streaming import jobs, live

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def replayed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", 64).parquet(f"{path}*")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The stream's rows in a table of the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    jobs.run_to_table(stream, f"{base}/out", f"{base}/state", mode)
    schema = stream.schema if mode == "append" else stream.withColumn("batch", F.lit(0).cast("long")).schema
    return spark.read.schema(schema).parquet(f"{base}/out")


@query("SELECT min(page_id) IS NOT NULL AS kept, substr(sha1(url), 1, 16) AS url_hash FROM pages GROUP BY url")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = replayed(spark, sf_dir, "pages").withColumns({"fetched_at": F.timestamp_micros(F.lit(1704067200000000) + F.col("page_id")), "url_hash": T.stable_hash(F.col("url"), 16)})
    kept = drained(jobs.fresh(pages.select("page_id", "url_hash", "fetched_at"), keys=("url_hash",)))
    return kept.select(F.col("page_id").isNotNull().alias("kept"), "url_hash")


@query("SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') AS views, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch's counters of a user and day; the last ones are the counts."""
    events = replayed(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = drained(jobs.page_counters(events), "update")
    last = out.groupBy("user_id", "day").agg(F.max(F.struct("batch", "n", "views")).alias("b"))
    return last.select("user_id", F.col("b.n").alias("n"), F.col("b.views").alias("views"), "day")


@query(readers.SQL["user_profile"])
def stream_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    category = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (k % 4 + 1).cast("int"))
    views = replayed(spark, sf_dir, "events").where("event_type in ('view', 'click')").select("user_id", "ts", "event_id", category.alias("category"))
    out = drained(jobs.profiles(views), "update")
    last = out.groupBy("user_id", "category").agg(F.max(F.struct("batch", "views", "streaks", "score")).alias("b"))
    return last.select("user_id", "category", "b.views", "b.streaks", "b.score")


@query("SELECT 'k' || CAST(l_orderkey % 500 AS VARCHAR) AS cluster_key, count(DISTINCT l_suppkey) AS source_count FROM lineitem GROUP BY 1")
def stream_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by a key of their order as signals; the sources that each cluster has gained."""
    li = replayed(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("k"), F.col("l_orderkey") % 500).alias("cluster_key"), F.col("l_suppkey").alias("source_id"), F.lit("2024-01-30 00:00:00").cast("timestamp").alias("at")
    )
    out = drained(jobs.live_clusters(li))
    return out.where("event_type <> 'expired'").groupBy("cluster_key").agg(F.max("source_count").alias("source_count"))


def as_signals(docs: DataFrame) -> DataFrame:
    """Documents as local signals: the language is the city, the source's last digit the topic and what kind of source it is;
    entities are long capitalised words of the first two sentences."""
    head = F.regexp_replace(F.regexp_extract("text", "^[ \t\r\n]*((?:[^ \t\r\n]+[ \t\r\n]+){0,11}[^ \t\r\n]+)", 1), "[ \t\r\n]+", " ")
    digit = F.substring("source", -1, 1)
    kinds = F.when(digit == "1", F.array(F.lit("official"))).when(digit.isin("2", "3"), F.array(F.lit("established"))).when(digit == "4", F.array(F.lit("community"))).when(digit != "9", F.array().cast("array<string>"))
    # columns of their own: what two others are drawn from is worked out once
    drawn = docs.select("doc_id", "lang", "source", F.lower("text").alias("low"), head.alias("head"), T.summary(F.col("text")).alias("summary"))
    said = ("developing", "ongoing", "preliminary")
    holds = functools.reduce(lambda x, y: x | y, [F.contains("low", F.lit(w)) for w in said])  # far cheaper than the pattern
    return drawn.select(
        F.col("doc_id").alias("signal_id"), F.col("lang").alias("city"), digit.alias("topic"), T.stable_hash(F.concat_ws("/", "source", T.alnum_key(F.col("head"))), 16).alias("url_hash"),
        T.stable_hash(F.regexp_replace("low", "[^a-z0-9]+", ""), 16).alias("content_hash"), T.title_tokens(F.col("head")).alias("title_tokens"), ladder.references(F.col("summary")).alias("refs"),
        F.array_distinct(F.transform(F.regexp_extract_all("summary", F.lit("\\b([A-Z][a-z]{6,})"), F.lit(1)), lambda x: F.lower(x))).alias("entities"),
        F.abs(F.xxhash64("source")).alias("source_id"), kinds.alias("source_kinds"), (holds & F.col("low").rlike(f"\\b({'|'.join(said)})\\b")).alias("developing"),
        F.timestamp_micros((F.lit(1704067200) + F.pmod(F.col("doc_id") * 7919, F.lit(2592000))) * 1000000).alias("at"),
    )


@query()
def match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every signal's events by url, content, title, incident and shared entities, in order of time."""
    return ladder.match_ladder(as_signals(table(spark, sf_dir, "documents")))


@query()
def stream_match_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on a stream, city by city, with the expiry of stories; late rows have all the time there is."""
    had = spark.conf.get(live.ROCKSDB[0], None)
    spark.conf.set(*live.ROCKSDB)
    try:
        base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
        live.run_events(live.live_stories(as_signals(replayed(spark, sf_dir, "documents")), late="60 days"), f"{base}/out", f"{base}/state")
    finally:
        spark.conf.set(live.ROCKSDB[0], had) if had else spark.conf.unset(live.ROCKSDB[0])
    return live.read_events(spark, f"{base}/out").drop("batch")
