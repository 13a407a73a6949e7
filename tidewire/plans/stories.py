"""Story queries: similar titles, clusters, trend topics, attention, day and week, copy risk, text checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import cluster, ranking, similarity, trends
from tidewire.operators.shuffles import saved
from tidewire.plans.feed import STORIES_SQL, SUMMARY_SQL, _stop_sql, stories, tokens_sql
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


def with_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).withColumn("title_tokens", T.title_tokens(F.col("title")))


PAIRS_SQL = f"""tk AS (SELECT id, published_at, source_name, category, base_score, list_distinct({tokens_sql('title')}) AS k FROM items),
px AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.k, b.k)) AS shared, len(a.k) AS na, len(b.k) AS nb FROM tk a JOIN tk b ON a.id < b.id AND abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 108000000000 AND list_has_any(a.k, b.k)),
pairs AS (SELECT a, b, shared, greatest(shared / (na + nb - shared), 0.65::DOUBLE * shared / least(na, nb) + 0.35::DOUBLE * shared / (na + nb - shared)) AS score, shared / least(na, nb) AS containment FROM px)"""
GOOD = "shared >= 5 OR (shared >= 4 AND containment >= 0.62) OR (shared >= 3 AND score >= 0.72)"


@query(f"WITH {ITEMS_SQL}, {PAIRS_SQL} SELECT a, b, shared, score FROM pairs WHERE {GOOD}")
def title_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.title_pairs(with_tokens(spark, sf_dir)).select("a", "b", "shared", "score")


@query()
def story_clusters_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their lead (score, weight, recency), sources, dominant category and score."""
    rows = with_tokens(spark, sf_dir)
    found = saved(cluster.story_clusters(rows), "story-clusters").join(rows, "id")
    lead = F.max(F.struct("base_score", "source_weight", "published_at", (-F.col("id")).alias("rev"), "title")).alias("lead")
    out = found.groupBy("cluster").agg(lead, F.count("*").alias("n_items"), F.count_distinct("source_name").alias("source_count"))
    category = ranking.mode(found, "cluster", "category", "id").select("cluster", "category")
    score = F.least(F.lit(100), F.greatest(F.lit(70), F.col("lead.base_score") + F.least(F.lit(6), 2 * (F.col("source_count") - 1))))
    return out.join(category, "cluster").select("cluster", (-F.col("lead.rev")).alias("lead_id"), F.col("lead.title").alias("title"), "n_items", "source_count", "category", score.alias("score"))


@query(f"""WITH {ITEMS_SQL}, t AS (SELECT *, category || ':' || array_to_string(list_sort({tokens_sql('title')})[1:7], '-') AS key FROM items)
SELECT key, count(*) AS n, count(DISTINCT source_name) AS n_sources, arg_max(id, (published_at, -id)) AS lead_id, max(base_score) AS best, max(published_at) + INTERVAL 7 DAY AS expires_at FROM t GROUP BY key""")
def local_key_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(":", "category", F.array_join(F.slice(F.array_sort("title_tokens"), 1, 7), "-"))
    rows = with_tokens(spark, sf_dir).withColumn("key", key)
    return rows.groupBy("key").agg(
        F.count("*").alias("n"), F.count_distinct("source_name").alias("n_sources"), (-F.max(F.struct("published_at", (-F.col("id")).alias("rev")))["rev"]).alias("lead_id"),
        F.max("base_score").alias("best"), (F.max("published_at") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
    )


def metrics_sql(weekly: bool) -> str:
    c, v, b = ("2.05", 7, "least(28.0, active_days / 10.0 * 8)") if weekly else ("2.35", 10, "least(12.0, active_days / 10.0 * 4)")
    return f"least(100.0, greatest(0.0, coalesce(clicks, 0) / 10.0::DOUBLE * {c}::DOUBLE + coalesce(views, 0) / 10.0::DOUBLE * 0.08::DOUBLE + coalesce(follows, 0) / 50.0::DOUBLE * {v} + coalesce(saves, 0) / 10.0::DOUBLE * 0.45::DOUBLE + coalesce({b}, 0)))"


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories with the metrics of their key (id modulo 100), in units that leave room below the cap of 100."""
    return measured(stories(spark, sf_dir, brief=True), spark, sf_dir)


def measured(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    m = story_metrics(spark, sf_dir)
    rows = rows.join(m, F.col("id") % 100 == F.col("story_key"), "left")
    part = lambda c, n: F.coalesce(F.col(c), F.lit(0)) / float(n)
    return rows.withColumns({
        "raw_days": F.coalesce("active_days", F.lit(0)), "clicks": part("clicks", 10), "views": part("views", 10), "velocity": part("follows", 50),
        "social_score": part("saves", 10), "sustained_days": part("active_days", 10),
    })


@query(f"WITH {METRICS_SQL} SELECT story_key, views, clicks, saves, follows, reports, active_days FROM metrics")
def story_engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return story_metrics(spark, sf_dir).drop("value")


@query(f"WITH {STORIES_SQL}, {METRICS_SQL} SELECT id, round({metrics_sql(False)}, 6) AS daily, round({metrics_sql(True)}, 6) AS weekly FROM stories LEFT JOIN metrics ON story_key = id % 100")
def attention_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled(spark, sf_dir).select("id", F.round(trends.attention(), 6).alias("daily"), F.round(trends.attention(True), 6).alias("weekly"))


WORDS_SQL = "len(list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))"
QUALITY_SQL = f"(CASE WHEN {WORDS_SQL.format(x='summary')} >= 18 THEN 28 ELSE 12 END + CASE WHEN length(source_name) > 0 THEN 18 ELSE 6 END + CASE WHEN length(title) > 20 THEN 22 ELSE 10 END)"
SIGNIFICANCE_SQL = "least(100.0, greatest(0.0, greatest(1, source_count) * 14 + greatest(1.0, source_weight) * 12 + score * 0.55::DOUBLE))"
FRESH_SQL = "CASE WHEN hours_old > {h} THEN 0.0 ELSE least(100.0, greatest(0.0, 100 - greatest(0.0, hours_old) / {h} * 100)) END"
def trend_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts stand in for outside trend signals."""
    words = F.array_distinct(T.title_tokens(F.col("text"), 8))
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("signal_id"), F.array_join(F.slice(words, 1, 2), " ").alias("topic"), words.alias("keywords"), F.lit("top").alias("category"),
        (F.col("item_id") * 37 % 101).cast("double").alias("interest"), (0.4 + F.col("item_id") % 6 / 10).alias("confidence"), F.element_at(F.array(*map(F.lit, ("24h", "48h", "72h", "7d", "30d"))), (F.col("item_id") % 5 + 1).cast("int")).alias("timeframe"),
        (F.col("item_id") % 7).cast("double").alias("signal_days"), (F.col("item_id") % 50).cast("double").alias("baseline_delta"), (F.col("item_id") % 30).cast("double").alias("growth_rate"),
    )


TS = tokens_sql("text").replace("[1:12]", "[1:8]")
MATCH_SQL = f"""sg AS (SELECT item_id AS signal_id, list_distinct({TS}) AS kw0, {TS} AS ordered FROM benchmark),
sg2 AS (SELECT signal_id, list_filter(ordered, lambda w, i: list_position(ordered, w) = i) AS kw FROM sg),
sx AS (SELECT id, category, list_distinct({tokens_sql('title')}) AS kw, lower(concat_ws(' ', title, {SUMMARY_SQL})) AS said FROM stories),
mt AS (SELECT id, signal_id, CASE WHEN len(sx.kw) = 0 OR len(sg2.kw) = 0 THEN 0 ELSE len(list_intersect(sx.kw, sg2.kw)) / least(len(sx.kw), len(sg2.kw)) END AS overlap, said, array_to_string(sg2.kw[1:2], ' ') AS topic FROM sx, sg2),
m AS (SELECT id, signal_id, overlap FROM mt WHERE (topic <> '' AND contains(' ' || trim(regexp_replace(said, '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || topic || ' ')) OR overlap >= 0.22)"""


@query(f"WITH {STORIES_SQL}, {MATCH_SQL} SELECT id, signal_id, round(overlap, 6) AS overlap FROM m")
def trend_signal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stories(spark, sf_dir, brief=True).withColumn("keywords", T.title_tokens(F.col("title")))
    return trends.matches(rows, trend_signals(spark, sf_dir)).select("id", "signal_id", F.round("overlap", 6).alias("overlap"))


def strength_sql(daily: bool) -> str:
    preferred = "('24h','48h','72h')" if daily else "('72h','7d','30d')"
    sustained = "1.0" if daily else "least(1.4, greatest(0.35, (signal_id % 7) / 3.0::DOUBLE))"
    return f"""((signal_id * 37) % 101) * (0.4::DOUBLE + (signal_id % 6) / 10.0::DOUBLE) * CASE WHEN ['24h','48h','72h','7d','30d'][signal_id % 5 + 1] IN {preferred} THEN 1.0::DOUBLE ELSE 0.65::DOUBLE END * {sustained}
    * (0.8::DOUBLE + least(100.0, greatest(0.0, 50 + (signal_id % 50) * 0.3::DOUBLE + (signal_id % 30) * 0.25::DOUBLE)) / 100 * 0.4::DOUBLE)"""


TOPICS_SQL = f"""{MATCH_SQL}, b AS (SELECT id, arg_max(signal_id, (((signal_id * 37) % 101) * (0.4::DOUBLE + (signal_id % 6) / 10.0::DOUBLE), -signal_id)) AS strongest FROM m GROUP BY id),
tp AS (SELECT s.id, CASE WHEN b.id IS NULL THEN s.category || ':' || array_to_string({tokens_sql('title')}[1:3], '-') ELSE s.category || ':s' || strongest END AS topic FROM stories s LEFT JOIN b ON b.id = s.id),
ts AS (SELECT topic, count(DISTINCT tp.id) AS n_stories, count(DISTINCT signal_id) AS n_signals, coalesce(max(CASE WHEN signal_id IS NULL THEN 0 ELSE least(100.0, {strength_sql(True)}) END), 0) AS daily, coalesce(max(CASE WHEN signal_id IS NULL THEN 0 ELSE least(100.0, {strength_sql(False)}) END), 0) AS weekly,
  coalesce(max(signal_id % 7), 0)::DOUBLE AS signal_days, coalesce(max(0.4::DOUBLE + signal_id % 6 / 10), 0.45::DOUBLE) AS topic_confidence FROM tp LEFT JOIN m ON m.id = tp.id GROUP BY topic)"""


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stories as a saved table without their texts, for what reads them several times."""
    return saved(stories(spark, sf_dir, brief=True), "told-stories")


def topics(spark: SparkSession, sf_dir: str, every: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, topic) of each story: its strongest signal, else its first three keywords; and (topic, n_stories, n_signals, daily,
    weekly, signal_days, topic_confidence): the most that a topic's signals say."""
    every = told(spark, sf_dir) if every is None else every
    rows = every.withColumn("keywords", T.title_tokens(F.col("title")))
    met = trends.matches(rows, trend_signals(spark, sf_dir)).select("id", "signal_id").join(trend_signals(spark, sf_dir).drop("category", "keywords", "topic"), "signal_id")
    met = met.select("id", "signal_id", "confidence", "signal_days", (F.col("interest") * F.col("confidence")).alias("weight"), trends.strength(True).alias("daily"), trends.strength(False).alias("weekly"))
    strongest = met.groupBy("id").agg(F.max(F.struct("weight", (-F.col("signal_id")).alias("rev"))).alias("b")).select("id", (-F.col("b.rev")).alias("strongest"))
    topic = F.when(F.col("strongest").isNull(), F.concat_ws(":", "category", F.array_join(F.slice("keywords", 1, 3), "-"))).otherwise(F.concat("category", F.lit(":s"), "strongest"))
    of = saved(rows.select("id", "category", "keywords").join(strongest, "id", "left").select("id", topic.alias("topic")), "topics")
    top = lambda c: F.max(F.least(F.lit(100.0), F.coalesce(F.col(c), F.lit(0.0)))).alias(c)
    said = of.join(met, "id", "left").groupBy("topic").agg(
        F.count_distinct("id").alias("n_stories"), F.count_distinct("signal_id").alias("n_signals"), top("daily"), top("weekly"),
        F.max(F.coalesce("signal_days", F.lit(0.0))).alias("signal_days"), F.coalesce(F.max("confidence"), F.lit(0.45)).alias("topic_confidence"),
    )
    return of, said


@query(f"WITH {STORIES_SQL}, {TOPICS_SQL} SELECT topic, n_stories, n_signals, round(daily, 6) AS daily, round(weekly, 6) AS weekly FROM ts")
def trend_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories by their strongest signal, else by their first three keywords; with the strength of all their signals."""
    _, said = topics(spark, sf_dir)
    return said.select("topic", "n_stories", "n_signals", F.round("daily", 6).alias("daily"), F.round("weekly", 6).alias("weekly"))


#: An editor's boost of a story; here it follows from the id.
BOOST = 20
DAY_SQL = f"""st AS (SELECT stories.*, metrics.*, {SUMMARY_SQL} AS summary, tp.topic, daily, weekly, signal_days, topic_confidence, (stories.id * 13) % {BOOST} AS boost FROM stories LEFT JOIN metrics ON story_key = stories.id % 100 JOIN tp ON tp.id = stories.id JOIN ts ON ts.topic = tp.topic),
ds AS (SELECT *, {metrics_sql(False)} AS attention FROM st),
dd AS (SELECT *, least(100.0::DOUBLE, greatest(0.0::DOUBLE, attention * 0.62::DOUBLE + daily * 0.38::DOUBLE)) * 0.5 + {FRESH_SQL.format(h='24.0')} * 0.18::DOUBLE + {SIGNIFICANCE_SQL} * 0.12::DOUBLE + {QUALITY_SQL} * 0.08::DOUBLE + daily * 0.08::DOUBLE + boost * 0.05::DOUBLE AS day_score FROM ds)"""


def day_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half traction (.62 attention, .38 trend of the topic), freshness, significance, quality, trend and the editor's boost."""
    every = told(spark, sf_dir)
    of, said = topics(spark, sf_dir, every)
    rows = measured(every, spark, sf_dir).join(of, "id").join(said, "topic").withColumn("boost", F.col("id") * 13 % BOOST)
    traction = T.clamp(trends.attention() * 0.62 + F.col("daily") * 0.38, 0.0, 100.0)
    score = traction * 0.5 + trends.freshness(F.col("hours_old"), 24.0) * 0.18 + trends.significance() * 0.12 + trends.quality() * 0.08 + F.col("daily") * 0.08 + F.col("boost") * 0.05
    return rows.withColumn("day_score", score)


@query(f"""WITH {STORIES_SQL}, {METRICS_SQL}, {TOPICS_SQL}, {DAY_SQL}, p AS (SELECT *, CASE WHEN hours_old <= 24 THEN 0 ELSE 1 END AS tier FROM dd)
SELECT id, title, topic, round(day_score, 4) AS score, round(least(1.0, greatest(0.0, topic_confidence * 0.55::DOUBLE + least(day_score, 100.0) / 100 * 0.45::DOUBLE)), 4) AS confidence FROM p ORDER BY tier, day_score DESC, published_at DESC, id LIMIT 1""")
def day_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the last 24 hours, else of all."""
    best = first_of_day(day_scores(spark, sf_dir))
    confidence = T.clamp(F.col("topic_confidence") * 0.55 + F.least(F.col("day_score"), F.lit(100.0)) / 100 * 0.45, 0.0, 1.0)
    return best.select("id", "title", "topic", F.round("day_score", 4).alias("score"), F.round(confidence, 4).alias("confidence"))


def first_of_day(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.when(F.col("hours_old") <= 24, 0).otherwise(1), F.desc("day_score"), F.desc("published_at"), "id").limit(1)


WEEKLY = metrics_sql(True)
TOPIC_WEEKLY = WEEKLY.replace("coalesce(clicks, 0)", "sum_clicks").replace("coalesce(views, 0)", "sum_views").replace("coalesce(follows, 0)", "sum_follows").replace("coalesce(saves, 0)", "sum_saves").replace("active_days", "max_days")
FRESH_WEEK = FRESH_SQL.format(h="168.0")


@query(f"""WITH {STORIES_SQL}, {METRICS_SQL}, {TOPICS_SQL}, {DAY_SQL}, d AS (SELECT id AS day_id, topic AS day_topic FROM dd ORDER BY CASE WHEN hours_old <= 24 THEN 0 ELSE 1 END, day_score DESC, published_at DESC, id LIMIT 1),
c AS (SELECT dd.*, id = day_id AS same, {WEEKLY} AS story_attention, {WEEKLY} * 0.5 + {QUALITY_SQL} * 0.2::DOUBLE + {SIGNIFICANCE_SQL} * 0.2::DOUBLE + {FRESH_WEEK} * 0.1::DOUBLE AS composite, day_topic FROM dd, d),
g AS (SELECT topic, sum(coalesce(clicks, 0)) AS sum_clicks, sum(coalesce(views, 0)) AS sum_views, sum(coalesce(follows, 0)) AS sum_follows, sum(coalesce(saves, 0)) AS sum_saves, max(coalesce(active_days, 0)) AS max_days, CASE WHEN count(*) > 1 THEN greatest(1, ceil((max(epoch_us(published_at)) - min(epoch_us(published_at))) / 8.64e10) + 1) ELSE 0 END AS span, max(signal_days) AS sd FROM c GROUP BY topic),
ga AS (SELECT topic, {TOPIC_WEEKLY} AS topic_attention, greatest(sd, max_days, span) AS days, (SELECT count(*) FROM g) AS n_topics FROM g),
b2 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY topic ORDER BY same, composite DESC, published_at DESC, id) = 1),
s AS (SELECT *, least(100.0::DOUBLE, greatest(topic_attention, story_attention) * 0.62::DOUBLE + weekly * 0.38::DOUBLE) * 0.44::DOUBLE + least(100.0::DOUBLE, days * 20) * 0.18::DOUBLE + {SIGNIFICANCE_SQL} * 0.12::DOUBLE + {QUALITY_SQL} * 0.08::DOUBLE + {FRESH_WEEK} * 0.06::DOUBLE + weekly * 0.07::DOUBLE + boost * 0.05::DOUBLE
  - CASE WHEN same THEN CASE WHEN n_topics > 1 THEN 45 ELSE 18 END WHEN topic = day_topic THEN 8 ELSE 0 END - CASE WHEN days >= 2 THEN 0 ELSE 55 END - CASE WHEN daily > 70 AND days < 2 THEN 35 ELSE 0 END AS week_score FROM b2 JOIN ga USING (topic))
SELECT id, title, topic, round(week_score, 4) AS score, CAST(days AS BIGINT) AS sustained_days, CASE WHEN same THEN 'same_article_as_day' ELSE 'unique' END AS duplicate_status FROM s ORDER BY same, days < 2, week_score DESC, days DESC, id LIMIT 1""")
def week_story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each topic's best story (another than the day's if it has one), scored with the topic's attention, sustained days and
    trend, less what repeats the day's choice, lacks two days of interest or is a spike of one day; the best of all."""
    rows = saved(day_scores(spark, sf_dir), "day-scores")
    day = first_of_day(rows).select(F.col("id").alias("day_id"), F.col("topic").alias("day_topic"))
    composite = trends.attention(True) * 0.5 + trends.quality() * 0.2 + trends.significance() * 0.2 + trends.freshness(F.col("hours_old"), 168.0) * 0.1
    rows = rows.crossJoin(F.broadcast(day)).withColumns({"same": F.col("id") == F.col("day_id"), "story_attention": trends.attention(True), "composite": composite})  # one row
    total = lambda c: F.sum(c).alias(c)
    span = F.when(F.count("*") > 1, F.greatest(F.lit(1), F.ceil((F.max(F.unix_micros("published_at")) - F.min(F.unix_micros("published_at"))) / 8.64e10) + 1)).otherwise(0)
    groups = rows.groupBy("topic").agg(total("clicks"), total("views"), total("velocity"), total("social_score"), F.max("sustained_days").alias("sustained_days"), F.max("raw_days").alias("raw"), span.alias("span"), F.max("signal_days").alias("sd"))
    sums = groups.select("topic", trends.attention(True).alias("topic_attention"), F.greatest("sd", "raw", "span").alias("days"))
    best = rows.groupBy("topic").agg(F.min_by(F.struct(*rows.columns), F.struct("same", -F.col("composite"), -F.unix_micros("published_at"), "id")).alias("r")).select("r.*")
    n = sums.agg(F.count("*").alias("n_topics"))
    found = best.join(sums, "topic").crossJoin(F.broadcast(n))  # one row
    repeats = F.when(F.col("same"), F.when(F.col("n_topics") > 1, 45).otherwise(18)).when(F.col("topic") == F.col("day_topic"), 8).otherwise(0)
    score = (
        F.least(F.lit(100.0), F.greatest("topic_attention", "story_attention") * 0.62 + F.col("weekly") * 0.38) * 0.44 + F.least(F.lit(100.0), F.col("days") * 20) * 0.18 + trends.significance() * 0.12 + trends.quality() * 0.08
        + trends.freshness(F.col("hours_old"), 168.0) * 0.06 + F.col("weekly") * 0.07 + F.col("boost") * 0.05 - repeats - F.when(F.col("days") >= 2, 0).otherwise(55) - F.when((F.col("daily") > 70) & (F.col("days") < 2), 35).otherwise(0)
    )
    pick = found.withColumn("week_score", score).orderBy("same", F.col("days") < 2, F.desc("week_score"), F.desc("days"), "id").limit(1)
    return pick.select("id", "title", "topic", F.round("week_score", 4).alias("score"), F.col("days").cast("long").alias("sustained_days"), F.when(F.col("same"), "same_article_as_day").otherwise("unique").alias("duplicate_status"))


@query(f"""WITH {ITEMS_SQL}, t AS (SELECT id, {tokens_sql('text').removesuffix('[1:12]')} AS k FROM items), c AS (SELECT id, token, count(*) AS n, max(total) AS total FROM (SELECT id, len(k) AS total, unnest(k) AS token FROM t) GROUP BY id, token), m AS (SELECT id, max(n) AS most, max(total) AS total FROM c GROUP BY id)
SELECT t.id, CAST(CASE WHEN most >= 4 OR (total >= 6 AND most >= 0.28 * total) THEN most ELSE 0 END AS INT) AS stuffed FROM t LEFT JOIN m ON m.id = t.id""")
def keyword_stuffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest count of one token in the whole text, where it is too great."""
    return items(spark, sf_dir).select("id", similarity.stuffing(T.title_tokens(F.col("text"), (1 << 31) - 1)).alias("stuffed"))


@query("""WITH t AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '') AS k FROM conversations),
g AS (SELECT conv_id, turn, array_to_string(k[1:4], ' ') AS opening, CASE WHEN len(k) >= 4 THEN list_distinct(list_transform(range(1, len(k) - 2), lambda p: array_to_string(k[p:p + 3], ' '))) ELSE [] END AS grams FROM t)
SELECT conv_id, turn, coalesce(list_contains(list(opening) OVER w, opening), false) AS same_opening, coalesce(len(list_intersect(grams, flatten(list(grams) OVER w))), 0) AS shared_grams FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""")
def repetition_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("tokens"))
    return similarity.repeats_recent(rows, "conv_id", "turn").select("conv_id", "turn", "same_opening", "shared_grams")
