"""Signal and card queries: normalised trend signals, query variants, confidence, evidence, gates, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import classify
from tidewire.plans.feed import SUMMARY_SQL, tokens_sql
from tidewire.plans.rules import SQL as RULES
from tidewire.plans.rules import audience_match, entertainment_classify, topic_classify
from tidewire.sources.landed import ITEMS_SQL, items, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TS = tokens_sql("text").removesuffix("[1:12]")


@query(f"""WITH b AS (SELECT item_id, ['internal', 'relative_search', 'manual', 'odd'][item_id % 4 + 1] AS provider, ['24h', '7d', 'ever'][item_id % 3 + 1] AS timeframe, (item_id * 53) % 160 - 20 AS interest, {TS} AS k FROM benchmark)
SELECT item_id, CASE WHEN provider = 'odd' THEN 'manual' ELSE provider END AS provider, CASE WHEN timeframe = 'ever' THEN '7d' ELSE timeframe END AS timeframe, CAST(greatest(0, least(100, interest)) AS INT) AS interest,
  CASE WHEN provider IN ('relative_search', 'manual', 'odd') THEN NULL ELSE item_id * 10 END AS volume, array_to_string(list_filter(k, lambda w, i: list_position(k, w) = i)[1:12], ' ') AS keywords, substr(sha1(provider || ':' || item_id), 1, 12) AS id FROM b""")
def trend_signal_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers and timeframes outside the known ones fall back; relative providers have no volume; twelve keywords at most."""
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("item_id") % len(xs) + 1).cast("int"))
    rows = table(spark, sf_dir, "benchmark").withColumns({"raw": pick(("internal", "relative_search", "manual", "odd")), "frame": pick(("24h", "7d", "ever"))})
    provider = F.when(F.col("raw").isin("internal", "relative_search", "manual"), F.col("raw")).otherwise("manual")
    return rows.select(
        "item_id", provider.alias("provider"), F.when(F.col("frame").isin("24h", "48h", "72h", "7d", "30d"), F.col("frame")).otherwise("7d").alias("timeframe"),
        F.greatest(F.lit(0), F.least(F.lit(100), F.col("item_id") * 53 % 160 - 20)).cast("int").alias("interest"),
        F.when(~provider.isin("relative_search", "manual"), F.col("item_id") * 10).alias("volume"),
        F.array_join(F.slice(F.array_distinct(T.title_tokens(F.col("text"), 10_000)), 1, 12), " ").alias("keywords"),
        T.stable_hash(F.concat_ws(":", "raw", F.col("item_id").cast("string")), 12).alias("id"),
    )


@query(f"""WITH t AS ({RULES['topic_classify']}), x AS (SELECT d.doc_id, round(0.35::DOUBLE * CASE WHEN lang = 'en' THEN 86 ELSE 40 END + 0.35::DOUBLE * confidence + 0.2::DOUBLE * CASE WHEN quality = 1 THEN 90 WHEN quality = 0 THEN 30 ELSE 60 END + 0.1::DOUBLE * CASE WHEN length(text) > 200 THEN 100 ELSE 50 END, 4) AS confidence
  FROM documents d JOIN t USING (doc_id) LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id) SELECT doc_id, confidence, CASE WHEN confidence >= 45 THEN 'classified' ELSE 'needs_review' END AS signal_status FROM x""")
def signal_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.35 place + 0.35 topic + 0.2 trust + 0.1 completeness; 45 classifies."""
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = table(spark, sf_dir, "documents").join(topic_classify(spark, sf_dir), "doc_id").join(quality, "doc_id", "left")
    trust = F.when(F.col("quality") == 1, 90).when(F.col("quality") == 0, 30).otherwise(60)
    total = F.when(F.col("lang") == "en", 86).otherwise(40) * 0.35 + F.col("confidence") * 0.35 + trust * 0.2 + F.when(F.length("text") > 200, 100).otherwise(50) * 0.1
    out = rows.select("doc_id", F.round(total, 4).alias("confidence"))
    return out.withColumn("signal_status", F.when(F.col("confidence") >= 45, "classified").otherwise("needs_review"))


@query(f"""WITH {ITEMS_SQL}, x AS (SELECT id, list_distinct({tokens_sql('title')}) AS a, list_distinct({tokens_sql(SUMMARY_SQL).removesuffix('[1:12]')}) AS b FROM items)
SELECT id, len(a) - len(list_intersect(a, b)) AS unsupported, CASE WHEN len(a) + len(b) > 0 THEN round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) ELSE 0 END AS focus FROM x""")
def evidence_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title words that the summary doesn't have, and how alike the two are."""
    a, b = T.title_tokens(F.col("title")), T.title_tokens(T.summary(F.col("text")), 10_000)
    return items(spark, sf_dir).select("id", F.size(F.array_except(a, b)).cast("long").alias("unsupported"), F.round(T.jaccard(a, b), 6).alias("focus"))


@query(f"""WITH {ITEMS_SQL}, x AS (SELECT id, {SUMMARY_SQL} AS s, sensitive, base_score, source_weight FROM items)
SELECT id, array_to_string(list_filter([CASE WHEN NOT (length(s) >= 60) THEN 'summary_length' END, CASE WHEN NOT (sensitive = 0) THEN 'not_sensitive' END, CASE WHEN NOT (base_score >= 74) THEN 'score' END, CASE WHEN NOT (source_weight >= 1.0) THEN 'source' END], lambda r: r IS NOT NULL), ',') AS failures FROM x""")
def approval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"summary_length": F.length(T.summary(F.col("text"))) >= 60, "not_sensitive": F.col("sensitive") == 0, "score": F.col("base_score") >= 74, "source": F.col("source_weight") >= 1.0}
    return items(spark, sf_dir).select("id", F.array_join(classify.failures(rules), ",").alias("failures"))


@query(f"""WITH m AS ({RULES['audience_match']}), d AS (SELECT doc_id, lang FROM documents), f AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id)
SELECT lang, count(*) AS n_documents, count(n) AS patterned, round(count(n) / count(*), 3) AS rate, count(*) FILTER (n = 1) AS thin FROM d LEFT JOIN f USING (doc_id) GROUP BY lang""")
def audience_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_doc = audience_match(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(per_doc, "doc_id", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("n_documents"), F.count("n").alias("patterned"), F.round(F.count("n") / F.count("*"), 3).alias("rate"), F.count_if(F.col("n") == 1).alias("thin"))


@query(f"""WITH e AS ({RULES['entertainment_classify']}), j AS (SELECT beat, lang, confidence, contains(lower(text), 'the') AS said FROM e JOIN documents USING (doc_id))
SELECT coalesce(beat, 'all') AS beat, count(*) AS n, count(*) FILTER (said) AS n_said, max(confidence) AS best FROM j GROUP BY ROLLUP(beat)""")
def beat_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entertainment beats with what of each a text filter leaves, and all."""
    rows = entertainment_classify(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", F.contains(F.lower("text"), F.lit("the")).alias("said")), "doc_id")
    out = rows.rollup("beat").agg(F.count("*").alias("n"), F.count_if("said").alias("n_said"), F.max("confidence").alias("best"))
    return out.select(F.coalesce("beat", F.lit("all")).alias("beat"), "n", "n_said", "best")


@query("""WITH u AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS visits, count(*) FILTER (event_type = 'signup') AS signups, max(ts) FILTER (event_type = 'error') AS dismissed_at FROM events GROUP BY user_id)
SELECT user_id, visits, CASE WHEN signups >= 14 THEN 'accepted' WHEN dismissed_at >= TIMESTAMP '2024-01-30' THEN 'dismissed' WHEN visits >= 20 THEN 'follow_topic' WHEN visits >= 3 THEN 'save_city' ELSE 'none' END AS prompt FROM u""")
def reader_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to ask a reader: nothing once accepted or lately dismissed, then by the days they came."""
    e = table(spark, sf_dir, "events")
    u = e.groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("visits"), F.count_if(F.col("event_type") == "signup").alias("signups"), F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("dismissed_at"))
    late = F.col("dismissed_at") >= F.lit("2024-01-30 00:00:00").cast("timestamp")
    prompt = F.when(F.col("signups") >= 14, "accepted").when(late, "dismissed").when(F.col("visits") >= 20, "follow_topic").when(F.col("visits") >= 3, "save_city").otherwise("none")
    return u.select("user_id", "visits", prompt.alias("prompt"))
