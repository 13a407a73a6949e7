"""The landed tables as items, metrics, places, clusters and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T

NOW = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str, now: str = NOW, max_hours: float = 720.0, brief: bool = False) -> DataFrame:
    """Feed items from documents: the title is the first twelve words, the link is one per source and title. Brief ones have their
    summary in place of the text, and all that is drawn from a text is drawn before a row is shuffled."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    quality = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    head = F.regexp_extract("text", "^[ \t\r\n]*((?:[^ \t\r\n]+[ \t\r\n]+){0,11}[^ \t\r\n]+)", 1)
    said = T.summary(F.col("text")).alias("summary") if brief else F.col("text")
    docs = docs.select("doc_id", "source", "lang", F.regexp_replace(head, "[ \t\r\n]+", " ").alias("title"), said)
    named = docs.join(quality, "doc_id", "left").select(
        F.col("doc_id").alias("id"), "title",
        F.col("source").alias("source_name"), F.col("lang").alias("category"),
        F.timestamp_micros((F.lit(1704067200) + F.pmod(F.col("doc_id") * 7919, F.lit(2592000))) * 1000000).alias("published_at"),
        (F.lit(0.9) + F.coalesce("quality", F.lit(1)) * 0.2).alias("source_weight"), F.coalesce("toxic", F.lit(0)).alias("sensitive"), "summary" if brief else "text",
    )
    link = F.concat(F.lit("https://www."), "source_name", F.lit(".example.com/"), F.substring(F.md5(T.alnum_key(F.col("title"))), 1, 12))
    return named.withColumns({"link": link, "hours_old": T.age_hours(F.col("published_at"), now)}).withColumn(
        "base_score", T.base_score(F.col("source_weight"), F.col("hours_old"), max_hours)
    )


#: The same for DuckDB, as the body of a CTE named items.
ITEMS_SQL = """items AS (
  SELECT *, 'https://www.' || source_name || '.example.com/' || substr(md5(regexp_replace(lower(title), '[^a-z0-9]', '', 'g')), 1, 12) AS link,
    CAST(floor(70 + 24 * least(1.0, greatest(0.0, 0.6 * greatest(0.0, 1 - greatest(0.0, hours_old) / 720.0)
      + 0.25 * least(1.0, greatest(0.0, (source_weight - 0.85) / 0.45))
      + 0.15 * CASE WHEN hours_old <= 2 THEN 1.0 WHEN hours_old <= 6 THEN 0.7 WHEN hours_old <= 12 THEN 0.35 ELSE 0.1 END)) + 0.5) AS BIGINT) AS base_score
  FROM (SELECT *, (1706659200000000 - epoch_us(published_at)) / 3.6e9::DOUBLE AS hours_old FROM (
    SELECT d.doc_id AS id, regexp_replace(regexp_extract(text, '^[ \\t\\r\\n]*((?:[^ \\t\\r\\n]+[ \\t\\r\\n]+){0,11}[^ \\t\\r\\n]+)', 1), '[ \\t\\r\\n]+', ' ', 'g') AS title,
      source AS source_name, lang AS category, make_timestamp((1704067200 + (d.doc_id * 7919) % 2592000) * 1000000) AS published_at,
      0.9::DOUBLE + coalesce(quality, 1) * 0.2::DOUBLE AS source_weight, coalesce(toxic, 0) AS sensitive, text
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id)))"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places with made-up coordinates; their nation is the state."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(  # 25 nations at any scale
        F.col("c_custkey").alias("place_id"), F.col("c_name").alias("name"), F.col("n_name").alias("state"),
        (F.pmod(F.col("c_custkey") * 37, F.lit(18000)) / 100 - 90).alias("lat"), (F.pmod(F.col("c_custkey") * 91, F.lit(36000)) / 100 - 180).alias("lon"),
        F.col("c_mktsegment").alias("kind"),
    )


PLACES_SQL = """places AS (SELECT c_custkey AS place_id, c_name AS name, n_name AS state, ((c_custkey * 37) % 18000) / 100.0::DOUBLE - 90 AS lat,
  ((c_custkey * 91) % 36000) / 100.0::DOUBLE - 180 AS lon, c_mktsegment AS kind FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def story_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engagement of events by story key (0 to 99): view, click, purchase as save, signup as follow, error as report."""
    e = table(spark, sf_dir, "events")
    count = lambda kind, name: F.count_if(F.col("event_type") == kind).alias(name)
    return e.groupBy(F.get_json_object("props", "$.k").cast("long").alias("story_key")).agg(
        count("view", "views"), count("click", "clicks"), count("purchase", "saves"), count("signup", "follows"), count("error", "reports"),
        F.count_distinct(F.to_date("ts")).alias("active_days"), F.sum("value").alias("value"),
    )


METRICS_SQL = """metrics AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS story_key, count(*) FILTER (event_type = 'view') AS views,
  count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS saves, count(*) FILTER (event_type = 'signup') AS follows,
  count(*) FILTER (event_type = 'error') AS reports, count(DISTINCT CAST(ts AS DATE)) AS active_days, sum(value) AS value FROM events GROUP BY 1)"""


def clusters(spark: SparkSession, sf_dir: str, now: str = NOW) -> DataFrame:
    """Orders as story clusters of the last fourteen days; a few start in the future, have no start or are hidden."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    start = F.timestamp_micros((F.lit(1706659200) - F.pmod(key * 9973, F.lit(1209600)) + F.when(key % 97 == 0, 90000).otherwise(0)) * 1000000)
    started = F.when(key % 53 == 0, F.lit(None).cast("timestamp")).otherwise(start)
    return o.select(
        key.alias("cluster_id"), F.col("o_custkey").alias("place_id"), F.col("o_orderpriority").alias("topic"),
        F.when(key % 41 == 0, "hidden").when(key % 43 == 0, "expired").otherwise("live").alias("public_status"), started.alias("started_at"),
        F.timestamp_micros(F.unix_micros(started) + F.lit(604800000000)).alias("expires_at"), F.col("o_totalprice").alias("weight"),
        F.when(key % 5 == 0, "noindex").otherwise("index").alias("index_status"),
    )


CLUSTERS_SQL = """clusters AS (SELECT cluster_id, place_id, topic, public_status, started_at, started_at + INTERVAL 7 DAY AS expires_at, weight, index_status FROM (
  SELECT o_orderkey AS cluster_id, o_custkey AS place_id, o_orderpriority AS topic,
    CASE WHEN o_orderkey % 41 = 0 THEN 'hidden' WHEN o_orderkey % 43 = 0 THEN 'expired' ELSE 'live' END AS public_status,
    CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE make_timestamp((1706659200 - (o_orderkey * 9973) % 1209600 + CASE WHEN o_orderkey % 97 = 0 THEN 90000 ELSE 0 END) * 1000000) END AS started_at,
    o_totalprice AS weight, CASE WHEN o_orderkey % 5 = 0 THEN 'noindex' ELSE 'index' END AS index_status FROM orders))"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources; their nation says what kind they are."""
    kind = F.when(F.col("s_nationkey") < 3, "official").when(F.col("s_nationkey") < 10, "publisher").when(F.col("s_nationkey") < 18, "community").otherwise("other")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"), kind.alias("source_type"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the signals of a cluster; the supplier is the source."""
    li, s = table(spark, sf_dir, "lineitem"), sources(spark, sf_dir)
    return li.join(s, F.col("l_suppkey") == F.col("source_id")).select(
        F.col("l_orderkey").alias("cluster_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("signal_id"), F.col("l_suppkey").alias("source_id"),
        "source_name", "source_type", F.col("l_linenumber").alias("ord"), F.col("l_shipdate").alias("seen_at"),
        F.col("l_extendedprice").alias("score"), F.col("l_returnflag").alias("flag"),
    )


SIGNALS_SQL = """signals AS (SELECT l_orderkey AS cluster_id, l_orderkey * 8 + l_linenumber AS signal_id, l_suppkey AS source_id, s_name AS source_name,
  CASE WHEN s_nationkey < 3 THEN 'official' WHEN s_nationkey < 10 THEN 'publisher' WHEN s_nationkey < 18 THEN 'community' ELSE 'other' END AS source_type,
  l_linenumber AS ord, l_shipdate AS seen_at, l_extendedprice AS score, l_returnflag AS flag FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
