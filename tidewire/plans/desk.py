"""Desk queries: review reasons, selections, research targets, gates, lessons, request health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import ranking
from tidewire.operators.shuffles import saved
from tidewire.plans.feed import SPOT, STORIES_SQL, SUMMARY_SQL, stories
from tidewire.plans.readers import POSTS_SQL, posts
from tidewire.plans.writing import SQL as STORY_QUERIES
from tidewire.plans.writing import summary_gates as gates
from tidewire.sources.landed import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Our own texts for failure codes.
REASONS = (
    ("empty_summary", "Write a summary"), ("too_short", "Add detail"), ("too_long", "Cut it down"), ("no_sentence_end", "End the sentence"), ("lower_case_start", "Start with a capital"), ("repeats_words", "Vary the words"),
    ("robotic_opener", "Open plainly"), ("vague_filler", "Drop the filler"), ("database_language", "Take out codes"), ("doubled_word", "Take out the doubled word"), ("dangling_punctuation", "Finish the thought"),
    ("dangling_end", "Finish the sentence"), ("too_close_to_source", "Use own words"), ("repeats_title", "Say more than the title"), ("missing_detail", "Use a detail of the source"),
)
REASON_SQL = ", ".join(f"('{c}', '{t}')" for c, t in REASONS)


@query(f"""WITH g AS ({STORY_QUERIES['summary_gates']}), c AS (SELECT doc_id, unnest(string_split(failures, ',')) AS code FROM g WHERE failures <> '')
SELECT doc_id, string_agg(t, '; ' ORDER BY t) AS reasons, count(*) AS n FROM c JOIN (VALUES {REASON_SQL}) r(code, t) USING (code) GROUP BY doc_id""")
def review_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.broadcast(spark.createDataFrame(list(REASONS), "code string, t string"))  # a given list of fifteen
    # saved, or the filter and the explode would put conditions before the gates that work them out again
    rows = saved(gates(spark, sf_dir).select("doc_id", "failures"), "gates").where("failures <> ''").select("doc_id", F.explode(F.split("failures", ",")).alias("code"))
    return rows.join(codes, "code").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("t")), "; ").alias("reasons"), F.count("*").alias("n"))


@query("""WITH g AS (""" + STORY_QUERIES["summary_gates"] + """) SELECT coalesce(code, 'passed') AS code, count(*) AS n FROM (SELECT doc_id, CASE WHEN failures = '' THEN NULL ELSE failures END AS f FROM g) LEFT JOIN LATERAL (SELECT unnest(string_split(f, ',')) AS code) ON true GROUP BY 1""")
def failure_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.explode(F.split(F.when(F.col("failures") == "", "passed").otherwise(F.col("failures")), ","))
    return saved(gates(spark, sf_dir).select("failures"), "gates").select(codes.alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query(f"""WITH {STORIES_SQL}, o AS (SELECT id, link, row_number() OVER (ORDER BY {SPOT}) - 1 AS i FROM stories QUALIFY i < 40), p AS (SELECT id, link, CASE WHEN i = 0 THEN 100 WHEN i = 1 THEN 95 WHEN i < 12 THEN 90 - i WHEN i < 30 THEN 70 - i ELSE 2 END AS priority FROM o)
SELECT id, priority, row_number() OVER (ORDER BY priority DESC, id) AS rank FROM p ORDER BY rank LIMIT 12""")
def social_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities by place on the front page (100, 95, 90 less the place, 70 less the place, 2); the best twelve."""
    placed = ranking.top(stories(spark, sf_dir), ranking.spotlight_order(), 40).withColumn("i", F.col("rank") - 1).drop("rank")
    i = F.col("i")
    priority = F.when(i == 0, 100).when(i == 1, 95).when(i < 12, 90 - i).when(i < 30, 70 - i).otherwise(2)
    return ranking.top(placed.withColumn("priority", priority), [F.desc("priority"), F.asc("id")], 12).select("id", "priority", "rank")


W = "len(list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))"


@query(f"""WITH {STORIES_SQL}, t AS (SELECT id, link, CASE WHEN source_count > 1 THEN 0 ELSE 1 END AS tier, score FROM stories WHERE {W.format(x=SUMMARY_SQL)} < 18)
SELECT id, tier, row_number() OVER (ORDER BY tier, score DESC, id) AS rank FROM t ORDER BY rank LIMIT 24""")
def research_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories whose summary has fewer than 18 words: those that several sources carry first."""
    thin = stories(spark, sf_dir).where(F.size(T.words(T.summary(F.col("text")))) < 18).withColumn("tier", F.when(F.col("source_count") > 1, 0).otherwise(1))
    return ranking.top(thin, [F.asc("tier"), F.desc("score"), F.asc("id")], 24).select("id", "tier", "rank")


@query("""SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'error') AS empty_responses, arg_max(event_type, (ts, event_id)) AS last_result, max(ts) AS last_at FROM events GROUP BY user_id""")
def request_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("empty_responses"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_result"), F.max("ts").alias("last_at"))


@query(f"""WITH {POSTS_SQL}, l AS (SELECT story_key, category, shape, score, CASE WHEN reports >= 2 THEN 'avoid' WHEN score >= 200 THEN 'repeat' WHEN score >= 100 THEN 'keep' ELSE 'watch' END AS lesson FROM posts)
SELECT category, lesson, count(*) AS n, round(avg(score), 4) AS mean_score, min(story_key) AS example FROM l GROUP BY ALL""")
def owned_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What posts teach by thresholds, rolled up by category."""
    lesson = F.when(F.col("reports") >= 2, "avoid").when(F.col("score") >= 200, "repeat").when(F.col("score") >= 100, "keep").otherwise("watch")
    return posts(spark, sf_dir).withColumn("lesson", lesson).groupBy("category", "lesson").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.min("story_key").alias("example"))


@query(f"""WITH {POSTS_SQL}, l AS (SELECT story_key, category, shape, score, row_number() OVER (PARTITION BY category ORDER BY score DESC, story_key) AS a, row_number() OVER (PARTITION BY shape ORDER BY score DESC, story_key) AS b FROM posts)
SELECT story_key, category, shape, score FROM l WHERE a <= 8 OR b <= 8""")
def lesson_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best eight of each category and the best eight of each shape, each post once."""
    rows = posts(spark, sf_dir).select("story_key", "category", "shape", "score")
    best = lambda key: ranking.top_per_group(rows, [key], [F.desc("score"), F.asc("story_key")], 8).drop("rank")
    return best("category").unionByName(best("shape")).dropDuplicates(["story_key"])


@query(f"""WITH {STORIES_SQL}, m AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, substr(md5(event_type || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR)), 1, 6) AS topic, value FROM events),
t AS (SELECT id, id % 100 AS k FROM stories) SELECT t.id, count(*) AS n_metrics, count(DISTINCT topic) AS n_topics, round(sum(value), 4) AS value FROM t JOIN m ON m.k = t.k GROUP BY t.id""")
def metric_topic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each story's key: summed by key first, so a story takes one row."""
    k = F.get_json_object("props", "$.k").cast("long")
    topic = F.substring(F.md5(F.concat("event_type", (k % 10).cast("string"))), 1, 6)
    per_key = table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n_metrics"), F.count_distinct(topic).alias("n_topics"), F.round(F.sum("value"), 4).alias("value"))
    return stories(spark, sf_dir).select("id", (F.col("id") % 100).alias("k")).join(per_key, "k").drop("k")
