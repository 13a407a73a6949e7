"""Rule and text queries: topics, urgency, audiences, sensitivity, facts, gates, choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import text as T
from tidewire.operators import classify, dedupe, ranking
from tidewire.plans.feed import STORIES_SQL, SUMMARY_SQL, stories
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


REDACT_SQL = "text"
SEEN_SQL = []
for _name, _pattern in classify.REDACTIONS:
    SEEN_SQL.append(f"CASE WHEN regexp_matches({REDACT_SQL}, '{_pattern}') THEN '{_name}' END")
    REDACT_SQL = f"regexp_replace({REDACT_SQL}, '{_pattern}', '[{_name}]', 'g')"


@query(f"SELECT doc_id, md5({REDACT_SQL}) AS redacted_md5, array_to_string(list_filter([{', '.join(SEEN_SQL)}], lambda x: x IS NOT NULL), ',') AS kinds FROM documents")
def redact_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify.redacted(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.md5("text").alias("redacted_md5"), F.array_join("kinds", ",").alias("kinds"))


@query("""SELECT event_id, len(json_keys(props)) AS n_keys, len(list_filter(json_keys(props), lambda k: k IN ('email', 'phone', 'user_name', 'handle', 'password', 'token'))) > 0 OR regexp_matches(props, '@[A-Za-z]') AS private FROM events""")
def private_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.json_object_keys("props")
    bad = F.arrays_overlap(keys, F.array(*map(F.lit, classify.FORBIDDEN_KEYS))) | F.col("props").rlike("@[A-Za-z]")
    return table(spark, sf_dir, "events").select("event_id", F.size(keys).cast("long").alias("n_keys"), bad.alias("private"))


@query(f"""WITH {STORIES_SQL}, ap AS (SELECT l.doc_id AS story_id, lower(substr(md5(s.key), 1, 10)) AS slug, s.link FROM labels l JOIN stories s ON s.id = l.doc_id WHERE quality = 1 AND l.doc_id % 3 <> 0),
k AS (SELECT s.id, 0 AS prio, ap.story_id FROM stories s JOIN ap ON ap.story_id = s.id UNION ALL SELECT s.id, 1, ap.story_id FROM stories s JOIN ap ON ap.slug = substr(md5(s.key), 1, 10) UNION ALL SELECT s.id, 2, ap.story_id FROM stories s JOIN ap ON ap.link = s.link)
SELECT id, story_id, prio FROM k QUALIFY row_number() OVER (PARTITION BY id ORDER BY prio, story_id) = 1""")
def approved_story_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to approved stories: by id, else by slug, else by link; the keys are unioned and joined once."""
    pool = stories(spark, sf_dir).select("id", F.substring(F.md5("key"), 1, 10).alias("slug"), "link")
    good = table(spark, sf_dir, "labels").where("quality = 1 and doc_id % 3 <> 0").select(F.col("doc_id").alias("id"))
    keys = lambda df, name: df.select(F.col("id").alias(name), F.posexplode(F.array(F.col("id").cast("string"), F.concat(F.lit("s:"), "slug"), F.concat(F.lit("l:"), "link"))).alias("prio", "k"))
    approved = keys(pool.join(good, "id"), "story_id")
    met = keys(pool, "id").join(approved, ["prio", "k"]).groupBy("id").agg(F.min(F.struct("prio", "story_id")).alias("b"))
    return met.select("id", F.col("b.story_id").alias("story_id"), F.col("b.prio").alias("prio"))


TITLE = "<title>([^<]*)</title>"


@query(f"""SELECT page_id, trim(regexp_extract(html, '{TITLE}', 1)) AS title, regexp_extract(html, '<html[^>]*lang="([a-z]+)"', 1) AS lang, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS heading,
  regexp_extract(html, '<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) AS canonical, len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n_links FROM pages""")
def html_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = lambda p: F.regexp_extract("html", p, 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", F.trim(get(TITLE)).alias("title"), get('<html[^>]*lang="([a-z]+)"').alias("lang"), F.trim(get("<h1>([^<]*)</h1>")).alias("heading"),
        get('<link[^>]*rel="canonical"[^>]*href="([^"]*)"').alias("canonical"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"),
    )
