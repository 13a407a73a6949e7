"""Feed queries: items, dedupe, orders, front page, search, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import dedupe, ranking
from tidewire.operators.shuffles import saved
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


def stories(spark: SparkSession, sf_dir: str, brief: bool = False) -> DataFrame:
    """Items by link, with the number of sources that carry the title; the first id of each link stays."""
    rows = items(spark, sf_dir, brief=brief).withColumn("key", T.alnum_key(F.col("title")))
    carried = rows.groupBy("key").agg(F.count_distinct("source_name").alias("source_count"))
    first = dedupe.keep_latest(rows.withColumn("rev", -F.col("id")), ["link"], "rev", "id").drop("rev")
    return first.join(carried, "key").withColumn("score", F.least(F.lit(100), F.col("base_score") + F.least(F.lit(6), 2 * (F.col("source_count") - 1))))


STORIES_SQL = ITEMS_SQL + """, keyed AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS key FROM items),
stories AS (SELECT k.*, source_count, least(100, base_score + least(6, 2 * (source_count - 1))) AS score
  FROM (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY link ORDER BY id) = 1) k
  JOIN (SELECT key, count(DISTINCT source_name) AS source_count FROM keyed GROUP BY key) c ON k.key = c.key)"""
SUMMARY_SQL = (
    "trim(substr(array_to_string(list_filter(string_split(regexp_replace(trim(regexp_replace(regexp_replace(coalesce(text, ''), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')), "
    "'([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')[1:2], ' '), 1, 260))"
)


def _stop_sql() -> str:
    return "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def tokens_sql(title: str) -> str:
    words = f"list_filter(string_split(trim(regexp_replace(lower(regexp_replace({title}, '&amp;', ' and ', 'g')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 2 AND NOT list_contains({_stop_sql()}, w))"
    return f"{words}[1:12]"


@query(f"""WITH {ITEMS_SQL} SELECT id, sha1(link) AS link_id, title, link, source_name, category, published_at, base_score, {SUMMARY_SQL} AS summary,
  array_to_string({tokens_sql('title')}, ' ') AS title_tokens, regexp_replace(regexp_extract(lower(link), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') AS domain FROM items""")
def item_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    return rows.select(
        "id", F.sha1("link").alias("link_id"), "title", "link", "source_name", "category", "published_at", "base_score", T.summary(F.col("text")).alias("summary"),
        F.array_join(T.title_tokens(F.col("title")), " ").alias("title_tokens"), T.domain(F.col("link")).alias("domain"),
    )


@query(f"""WITH {ITEMS_SQL} SELECT id, hours_old <= 48 AS in_48h, hours_old <= 168 AS in_7d, hours_old BETWEEN 0 AND 168 AS is_public, hours_old BETWEEN 0 AND 48 AS is_news FROM items WHERE hours_old <= 168""")
def item_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("hours_old")
    return items(spark, sf_dir).where(h <= 168).select(
        "id", (h <= 48).alias("in_48h"), (h <= 168).alias("in_7d"), h.between(0, 168).alias("is_public"), h.between(0, 48).alias("is_news")
    )


@query(f"WITH {ITEMS_SQL} SELECT link, min(id) AS id, count(*) AS n FROM items GROUP BY link")
def item_dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("link").agg(F.min("id").alias("id"), F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {ITEMS_SQL}, o AS (SELECT link, published_at, base_score, id, row_number() OVER (PARTITION BY link ORDER BY id) AS n FROM items),
f AS (SELECT link, n, id, published_at, base_score FROM o WHERE n = 1 UNION ALL
  SELECT o.link, o.n, CASE WHEN o.base_score > f.base_score OR o.published_at > f.published_at THEN o.id ELSE f.id END,
    CASE WHEN o.base_score > f.base_score OR o.published_at > f.published_at THEN o.published_at ELSE f.published_at END,
    CASE WHEN o.base_score > f.base_score OR o.published_at > f.published_at THEN o.base_score ELSE f.base_score END
  FROM f JOIN o ON o.link = f.link AND o.n = f.n + 1)
SELECT link, max_by(id, n) AS id FROM f GROUP BY link""")
def item_dedupe_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.fold_duplicates(items(spark, sf_dir))


SPOT = "source_count DESC, score DESC, published_at DESC, id"


@query(f"WITH {STORIES_SQL} SELECT id, row_number() OVER (ORDER BY {SPOT}) AS rank, source_count, score FROM stories ORDER BY {SPOT} LIMIT 50")
def spotlight_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(stories(spark, sf_dir), ranking.spotlight_order(), 50).select("id", "rank", "source_count", "score")


@query(f"WITH {STORIES_SQL} SELECT id, row_number() OVER (ORDER BY published_at DESC, source_count DESC, score DESC, id) AS rank, published_at FROM stories ORDER BY rank LIMIT 50")
def recency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top(stories(spark, sf_dir), ranking.recency_order(), 50).select("id", "rank", "published_at")


def diversified_sql(source: str, cap: int, limit: int, name: str) -> str:
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY {SPOT}) AS round FROM {source}),
{name}_h AS (SELECT source_name, row_number() OVER (ORDER BY {SPOT}) AS source_rank FROM {name}_r WHERE round = 1),
{name}_d AS (SELECT count(DISTINCT source_name) AS deep FROM {name}_r WHERE round > {cap}),
{name} AS (SELECT r.*, row_number() OVER (ORDER BY CASE WHEN round > {cap} THEN 1 ELSE 0 END, round, source_rank) AS position
  FROM {name}_r r JOIN {name}_h USING (source_name), {name}_d WHERE round <= {cap} OR deep = 1 QUALIFY position <= {limit})"""


@query(f"WITH {STORIES_SQL}, {diversified_sql('stories', 2, 40, 'v')} SELECT id, source_name, round, position FROM v")
def diversified_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.diversify(stories(spark, sf_dir), 2, 40, ranking.spotlight_order()).select("id", "source_name", "round", "position")


@query(f"""WITH {STORIES_SQL}, {diversified_sql('stories', 2, 8, 't')},
rest AS (SELECT * FROM stories WHERE id NOT IN (SELECT id FROM t)), {diversified_sql('rest', 29, 170, 'f')}
SELECT 'top' AS section, id, title, source_name, category, score, position FROM t UNION ALL SELECT 'feed', id, title, source_name, category, score, position FROM f""")
def front_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight top stories (two per source), then the feed of 170 without them (29 per source). The stories are worked out once,
    without their texts, and no source can place more than 178 of them: what is saved is that many of each."""
    every = stories(spark, sf_dir).drop("text")
    pool = saved(ranking.top_per_group(every, ["source_name"], ranking.spotlight_order(), 178).drop("rank"), "stories")
    cols = ["id", "title", "source_name", "category", "score", "position"]
    first = ranking.diversify(pool, 2, 8, ranking.spotlight_order()).select(*cols)
    rest = pool.join(F.broadcast(first.select("id")), "id", "left_anti")  # eight ids
    feed = ranking.diversify(rest, max(12, -(-170 // 6)), 170, ranking.spotlight_order()).select(*cols)
    return first.select(F.lit("top").alias("section"), *cols).unionByName(feed.select(F.lit("feed").alias("section"), *cols))


@query(f"""WITH {STORIES_SQL}, first AS (SELECT id, link FROM stories ORDER BY {SPOT} LIMIT 1)
SELECT id, title, score FROM stories WHERE hours_old <= 168 AND link NOT IN (SELECT link FROM first) ORDER BY {SPOT} LIMIT 1""")
def spotlight_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = stories(spark, sf_dir)
    first = pool.orderBy(*ranking.spotlight_order()).limit(1).select("link")
    left = pool.where("hours_old <= 168").join(F.broadcast(first), "link", "left_anti")
    return left.orderBy(*ranking.spotlight_order()).limit(1).select("id", "title", "score")


SEARCHES = [(1, "the eaen"), (2, "hath onea"), (3, "src0 en"), (4, "ciónes tion de"), (5, "die schaft"), (6, "zzz nothing"), (7, "thatea reou ing")]
SEARCH_SQL = ", ".join(f"({i}, '{q}')" for i, q in SEARCHES)


@query(f"""WITH {STORIES_SQL}, q AS (SELECT query_id, list_filter(string_split(trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND NOT list_contains({_stop_sql()}, w)) AS tokens
  FROM (VALUES {SEARCH_SQL}) v(query_id, query)),
low AS (SELECT id, score, published_at, lower(title) AS t, lower(source_name) AS s, lower(category) AS c, lower(concat_ws(' ', title, {SUMMARY_SQL}, source_name, category)) AS h FROM stories),
x AS (SELECT query_id, id, score, published_at, CAST(coalesce(list_sum(list_transform(tokens, lambda w: (CASE WHEN contains(t, w) THEN 8 ELSE 0 END) + (CASE WHEN contains(s, w) THEN 4 ELSE 0 END) + (CASE WHEN contains(c, w) THEN 4 ELSE 0 END) + (CASE WHEN contains(h, w) THEN 2 ELSE 0 END))), 0) AS INT) AS relevance FROM low, q)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, score DESC, published_at DESC, id) AS rank, id, relevance, count(*) OVER (PARTITION BY query_id) AS n_hits
FROM x WHERE relevance > 0 QUALIFY rank <= 30""")
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(SEARCHES, "query_id int, query string")
    return ranking.search(stories(spark, sf_dir).withColumn("summary", T.summary(F.col("text"))), asked, 30)


@query(f"WITH {STORIES_SQL} SELECT category, row_number() OVER (PARTITION BY category ORDER BY published_at DESC, score DESC, source_count DESC, id) AS rank, id, count(*) OVER (PARTITION BY category) AS total FROM stories QUALIFY rank <= 60")
def category_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = stories(spark, sf_dir)
    order = [F.desc("published_at"), F.desc("score"), F.desc("source_count"), F.asc("id")]
    total = pool.groupBy("category").agg(F.count("*").alias("total"))
    return ranking.top_per_group(pool, ["category"], order, 60).join(total, "category").select("category", "rank", "id", "total")


@query(f"WITH {STORIES_SQL} SELECT coalesce(category, 'all') AS category, count(*) AS n, count(DISTINCT source_name) AS n_sources FROM stories GROUP BY ROLLUP(category)")
def category_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stories(spark, sf_dir).rollup("category").agg(F.count("*").alias("n"), F.count_distinct("source_name").alias("n_sources")).select(
        F.coalesce("category", F.lit("all")).alias("category"), "n", "n_sources"
    )


@query(f"WITH {ITEMS_SQL} SELECT source_name, count(*) AS n FROM items GROUP BY source_name")
def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("source_name").agg(F.count("*").alias("n"))


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT source_name, category, count(*) AS n, min(id) AS f FROM items GROUP BY ALL)
SELECT source_name, category, n FROM c QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY n DESC, f) = 1""")
def dominant_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.mode(items(spark, sf_dir), "source_name", "category", "id")


@query(f"""WITH {ITEMS_SQL} SELECT CASE WHEN hours_old IS NULL THEN 'undated' WHEN hours_old < 3 THEN '0-3h' WHEN hours_old < 12 THEN '3-12h' WHEN hours_old < 24 THEN '12-24h'
  WHEN hours_old < 48 THEN '24-48h' WHEN hours_old < 168 THEN '48-168h' ELSE 'older' END AS bucket, count(*) AS n, max(published_at) AS newest FROM items GROUP BY 1""")
def age_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy(ranking.age_bucket(F.col("hours_old")).alias("bucket")).agg(F.count("*").alias("n"), F.max("published_at").alias("newest"))


@query(f"""WITH {STORIES_SQL}, o AS (SELECT id, published_at, count(*) OVER () AS total, row_number() OVER (ORDER BY published_at DESC, source_count DESC, score DESC, id) AS n FROM stories)
SELECT id, published_at, total, total > 80 AS has_more, CASE WHEN total > 80 THEN 80 END AS next_offset FROM o WHERE n > 40 AND n <= 80""")
def paged_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.page(stories(spark, sf_dir), ranking.recency_order(), 40, 40).select("id", "published_at", "total", "has_more", "next_offset")


@query(f"""WITH {ITEMS_SQL}, w AS (SELECT id, unnest({tokens_sql(SUMMARY_SQL).removesuffix('[1:12]')}) AS token FROM items), c AS (SELECT id, token, count(*) AS n FROM w GROUP BY ALL)
SELECT id, token, n, row_number() OVER (PARTITION BY id ORDER BY n DESC, token) AS rank FROM c QUALIFY rank <= 5""")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent words of each item's summary."""
    words = items(spark, sf_dir).select("id", F.explode(T.title_tokens(T.summary(F.col("text")), 10_000)).alias("token"))
    counted = words.groupBy("id", "token").agg(F.count("*").alias("n"))
    return ranking.top_per_group(counted, ["id"], [F.desc("n"), F.asc("token")], 5).select("id", "token", "n", "rank")


@query("""WITH b AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
p AS (SELECT page_id, lower(regexp_extract(u, '^([a-zA-Z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract(u, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(u, '^[a-zA-Z]+://[^/?]+([^?]*)', 1), '/+$', '') AS head,
  list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(regexp_extract(x, '^([^=]*)', 1), '^(utm_[a-z]+|fbclid|gclid|mc_cid|mc_eid|ref)$'))) AS kept FROM b)
SELECT page_id, head || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical, substr(sha1(head || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END), 1, 16) AS url_hash FROM p""")
def url_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))
    return rows.withColumn("url_hash", T.stable_hash(F.col("canonical"), 16))
