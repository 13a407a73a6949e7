"""Reader and performance queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import dedupe, engagement, ranking
from tidewire.plans.feed import STORIES_SQL, stories
from tidewire.sources.landed import ITEMS_SQL, METRICS_SQL, items, story_metrics, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SCORE = "greatest(0, CAST(floor(clicks * 5 + saves * 3 + follows * 2 + views * 0.01::DOUBLE - {r} + 0.5) AS BIGINT))"
#: Reports weigh 18; here errors are a fifth of all events, so a tenth of them counts as reports.
POSTS_SQL = f"""{METRICS_SQL}, posts AS (SELECT story_key, views, clicks, saves, follows, CAST(floor(reports / 10) AS BIGINT) AS reports, {SCORE.format(r="CAST(floor(reports / 10) AS BIGINT) * 18")} AS score,
  CASE WHEN views > 0 THEN round(clicks / views, 4) ELSE 0 END AS ctr, CASE WHEN views > 0 THEN round((saves + follows + clicks) / views, 4) ELSE 0 END AS usefulness,
  ['instagram', 'facebook'][story_key % 2 + 1] AS platform, ['top', 'local', 'sports'][story_key % 3 + 1] AS category, ['question', 'list', 'quote', 'plain'][(story_key // 6) % 4 + 1] AS shape FROM metrics)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("story_key")
    m = story_metrics(spark, sf_dir).withColumn("reports", F.floor(F.col("reports") / 10))
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    rate = lambda x: F.when(F.col("views") > 0, F.round(x / F.col("views"), 4)).otherwise(0.0)
    return m.select(
        k, "views", "clicks", "saves", "follows", "reports",
        engagement.post_score(F.col("clicks"), F.col("saves"), F.col("follows"), F.col("views"), F.col("reports")).alias("score"),
        rate(F.col("clicks")).alias("ctr"), rate(F.col("saves") + F.col("follows") + F.col("clicks")).alias("usefulness"),
        pick(("instagram", "facebook"), k % 2).alias("platform"), pick(("top", "local", "sports"), k % 3).alias("category"), pick(("question", "list", "quote", "plain"), F.floor(k / 6) % 4).alias("shape"),
    )


@query(f"WITH {POSTS_SQL} SELECT story_key, score, ctr, usefulness, platform, category, shape FROM posts")
def post_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).select("story_key", "score", "ctr", "usefulness", "platform", "category", "shape")


@query(f"WITH {POSTS_SQL} SELECT coalesce(platform, 'all') AS platform, coalesce(category, 'all') AS category, count(*) AS n_posts, sum(views)::BIGINT AS views, sum(clicks)::BIGINT AS clicks, sum(saves)::BIGINT AS saves, sum(reports)::BIGINT AS reports, sum(score)::BIGINT AS score FROM posts GROUP BY ROLLUP(platform, category)")
def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = posts(spark, sf_dir).rollup("platform", "category").agg(F.count("*").alias("n_posts"), *[F.sum(c).alias(c) for c in ("views", "clicks", "saves", "reports", "score")])
    return out.select(F.coalesce("platform", F.lit("all")).alias("platform"), F.coalesce("category", F.lit("all")).alias("category"), "n_posts", "views", "clicks", "saves", "reports", "score")


@query(f"""WITH {POSTS_SQL}, s AS (SELECT platform, category, shape, avg(score) AS m, count(*) AS n FROM posts GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY platform, category ORDER BY m DESC, shape) AS k FROM s),
t AS (SELECT platform, category, max(shape) FILTER (k = 1) AS best, max(shape) FILTER (k = 2) AS second, max(m) FILTER (k = 1) AS best_score, max(m) FILTER (k = 2) AS second_score, sum(n)::BIGINT AS n FROM r WHERE k <= 2 GROUP BY ALL)
SELECT platform, category, best, second, round(best_score, 4) AS best_score, round(second_score, 4) AS second_score, n FROM t WHERE best_score > 0 AND best_score >= greatest(8.0, second_score * 1.15::DOUBLE)""")
def shape_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engagement.best_shapes(posts(spark, sf_dir), ["platform", "category"])
    return found.select("platform", "category", "best", "second", F.round("best_score", 4).alias("best_score"), F.round("second_score", 4).alias("second_score"), "n")


@query(f"""WITH {POSTS_SQL}, g AS (SELECT item_id AS signal_id, ['top', 'local', 'sports'][item_id % 3 + 1] AS category, (item_id * 37) % 101 AS interest FROM benchmark),
r AS (SELECT story_key, signal_id, interest, row_number() OVER (PARTITION BY story_key ORDER BY interest DESC, signal_id) AS rank FROM posts JOIN g USING (category) WHERE score > 0)
SELECT story_key, signal_id, interest, rank, CASE WHEN interest >= 70 THEN 'strong' ELSE 'tentative' END AS lesson FROM r WHERE rank <= 2""")
def combined_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with the two public signals of most interest in their category: signals are cut to two of a category before
    the join, so a large category makes no pairs."""
    b = table(spark, sf_dir, "benchmark")
    pick = F.element_at(F.array(*map(F.lit, ("top", "local", "sports"))), (F.col("item_id") % 3 + 1).cast("int"))
    signals = b.select(F.col("item_id").alias("signal_id"), pick.alias("category"), (F.col("item_id") * 37 % 101).alias("interest"))
    top = ranking.top_per_group(signals, ["category"], [F.desc("interest"), F.asc("signal_id")], 2)
    met = posts(spark, sf_dir).where("score > 0").join(F.broadcast(top), "category")  # two rows for each of three categories
    return met.select("story_key", "signal_id", "interest", "rank", F.when(F.col("interest") >= 70, "strong").otherwise("tentative").alias("lesson"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.keep_latest(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], "ts", "event_id").select("user_id", "event_type", "ts", "event_id")


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def capped_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.capped_log(table(spark, sf_dir, "events"), "ts", "event_id", 500).select("event_id", "ts", "event_type")


VIEWS_SQL = "v AS (SELECT event_id, ts, user_id, ['en', 'fr', 'de', 'es'][CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 + 1] AS category FROM events WHERE event_type IN ('view', 'click'))"


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    category = F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").where("event_type in ('view', 'click')").select("event_id", "ts", "user_id", category.alias("category"))


PROFILE_SQL = f"""{VIEWS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, category ORDER BY ts, event_id) AS island,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, lag(ts) OVER (PARTITION BY user_id, category ORDER BY ts, event_id) AS last FROM v),
b AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, category, island ORDER BY n) = 3 THEN 1 ELSE 0 END AS third, CASE WHEN epoch_us(ts) - epoch_us(last) > 604800000000 THEN 1 ELSE 0 END AS gap FROM a),
c AS (SELECT *, coalesce(sum(gap) OVER (PARTITION BY user_id, category ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gaps FROM b),
profile AS (SELECT user_id, category, count(*) AS views, sum(third)::BIGINT AS streaks, round(sum((1 + 5 * third) * pow(0.7::DOUBLE, gaps)), 6) AS score FROM c GROUP BY user_id, category)"""


@query(f"WITH {PROFILE_SQL} SELECT * FROM profile")
def user_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engagement.profiles(views(spark, sf_dir))


@query(f"""WITH {STORIES_SQL}, {PROFILE_SQL}, best AS (SELECT user_id, category FROM profile QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, category) = 1),
top AS (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY published_at DESC, id) AS rank FROM stories QUALIFY rank <= 5)
SELECT user_id, category, id, rank FROM best JOIN top USING (category)""")
def personalized_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reader's five newest stories of the category they like best; stories are cut to five of a category first."""
    liked = engagement.profiles(views(spark, sf_dir)).groupBy("user_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "category")).alias("b")).select("user_id", F.col("b.category").alias("category"))
    newest = ranking.top_per_group(stories(spark, sf_dir), ["category"], [F.desc("published_at"), F.asc("id")], 5).select("category", "id", "rank")
    return liked.join(F.broadcast(newest), "category").select("user_id", "category", "id", "rank")  # five rows of each language


@query(f"""WITH {VIEWS_SQL}, s AS (SELECT user_id, category, max(ts) AS seen_at FROM v GROUP BY ALL) SELECT user_id, count(*) FILTER (seen_at >= TIMESTAMP '2024-01-24') AS kept, count(*) AS ever,
  count(*) FILTER (seen_at >= TIMESTAMP '2024-01-24') = 4 AS all_seen, min(seen_at) AS oldest FROM s GROUP BY user_id""")
def seen_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader has seen within seven days of the last day, and whether that is everything."""
    seen = views(spark, sf_dir).groupBy("user_id", "category").agg(F.max("ts").alias("seen_at"))
    fresh = F.count_if(F.col("seen_at") >= F.lit("2024-01-24 00:00:00").cast("timestamp"))
    return seen.groupBy("user_id").agg(fresh.alias("kept"), F.count("*").alias("ever"), (fresh == 4).alias("all_seen"), F.min("seen_at").alias("oldest"))


@query(f"""WITH {ITEMS_SQL}, {VIEWS_SQL}, l AS (SELECT user_id, arg_max(category, (ts, event_id)) AS category, max(ts) AS last_visit FROM v GROUP BY user_id),
h AS (SELECT category, date_trunc('hour', published_at) AS hour, count(*) AS n FROM items GROUP BY ALL), c AS (SELECT category, hour, sum(n) OVER (PARTITION BY category ORDER BY hour DESC) AS later FROM h)
SELECT user_id, l.category, last_visit, CAST(coalesce((SELECT max(later) FROM c WHERE c.category = l.category AND hour > last_visit), 0) AS BIGINT) AS n_new FROM l""")
def new_since_visit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a reader's last category that came in hours begun after the visit: the hours' counts are summed from the
    end once, and a visit looks up the hour after it, so readers and items make no pairs."""
    from pyspark.sql.window import Window

    last = views(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "category")).alias("b")).select("user_id", F.col("b.category").alias("category"), F.col("b.ts").alias("last_visit"))
    hours = items(spark, sf_dir).groupBy("category", F.date_trunc("hour", "published_at").alias("hour")).agg(F.count("*").alias("n"))
    span = hours.groupBy("category").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    grid = span.select("category", F.explode(F.sequence(F.col("a"), F.col("b"), F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    later = grid.join(hours, ["category", "hour"], "left").withColumn("later", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("category").orderBy(F.desc("hour")))).select("category", "hour", "later")
    after = F.date_trunc("hour", "last_visit") + F.expr("INTERVAL 1 HOUR")
    found = last.join(span, "category", "left").withColumn("hour", F.greatest(after, "a"))
    return found.join(later, ["category", "hour"], "left").select("user_id", "category", "last_visit", F.coalesce("later", F.lit(0)).alias("n_new"))


@query("""WITH w AS (SELECT event_type, value, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 5 HOUR, time_bucket(INTERVAL 1 HOUR, ts), INTERVAL 1 HOUR)) AS start FROM events)
SELECT start AS window_start, start + INTERVAL 6 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS value FROM w GROUP BY ALL""")
def engagement_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "events").groupBy(F.window("ts", "6 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "value")


@query("""WITH a AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 43200000000 THEN 0 ELSE 1 END AS starts FROM events),
b AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_events, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM b GROUP BY user_id, s""")
def session_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engagement.sessions(table(spark, sf_dir, "events"), "12 hours")
