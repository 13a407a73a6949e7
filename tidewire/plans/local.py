"""Local queries: places, clusters and their signals, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import local, lookup, ranking
from tidewire.sources.landed import CLUSTERS_SQL, METRICS_SQL, NOW, PLACES_SQL, SIGNALS_SQL, clusters, places, signals, sources, story_metrics, table

QUERIES: dict = {}
SQL: dict = {}
AT = f"TIMESTAMP '{NOW}'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("point_id"), (F.pmod(k * 53, F.lit(18000)) / 100 - 90).alias("lat"), (F.pmod(k * 71, F.lit(36000)) / 100 - 180).alias("lon"))


POINTS_SQL = "points AS (SELECT s_suppkey AS point_id, ((s_suppkey * 53) % 18000) / 100.0::DOUBLE - 90 AS lat, ((s_suppkey * 71) % 36000) / 100.0::DOUBLE - 180 AS lon FROM supplier)"
KM = "6371.0 * 2 * atan2(sqrt(h), sqrt(greatest(0.0, 1 - h)))"
PAIRS_SQL = f"""pairs AS (SELECT point_id, place_id, {KM} AS km FROM (SELECT point_id, place_id, pow(sin(radians(q.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(q.lat)) * pow(sin(radians(q.lon - p.lon) / 2), 2) AS h FROM points p, places q))"""


@query(f"WITH {PLACES_SQL}, {POINTS_SQL}, {PAIRS_SQL} SELECT point_id, arg_min(place_id, (km, place_id)) AS place_id, floor(min(km) * 10 + 0.5) / 10 AS distance_km FROM pairs GROUP BY point_id")
def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local.nearest_place(points(spark, sf_dir), places(spark, sf_dir))


@query(f"""WITH {PLACES_SQL}, {POINTS_SQL}, {PAIRS_SQL} SELECT point_id, place_id, round(km * 0.621371, 3) AS miles,
  CASE WHEN km * 0.621371 <= 25 THEN 86 WHEN km * 0.621371 <= 50 THEN 72 ELSE 55 END AS score FROM pairs WHERE km * 0.621371 <= 100""")
def distance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local.in_bands(points(spark, sf_dir), places(spark, sf_dir))


@query(f"""WITH {PLACES_SQL}, q AS (SELECT * FROM (VALUES (1, 'customer#00000001'), (2, '#000000123'), (3, 'customer#000000042')) v(query_id, q)),
s AS (SELECT query_id, place_id, name, CASE WHEN lower(name) = q THEN 50000 ELSE 0 END + CASE WHEN starts_with(lower(name), q) THEN 8000 ELSE 0 END + CASE WHEN starts_with(lower(name || ', ' || state), q) THEN 12000 ELSE 0 END AS score
  FROM places, q WHERE contains(lower(name || ', ' || state), q))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name, place_id) AS rank, place_id, name, score FROM s QUALIFY rank <= 8""")
def place_autocomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "customer#00000001"), (2, "#000000123"), (3, "customer#000000042")], "query_id int, q string")
    known = places(spark, sf_dir).withColumn("display", F.lower(F.concat_ws(", ", "name", "state")))
    found = lookup.containing(known.select(F.col("place_id").alias("id"), F.col("display").alias("text")), asked).withColumnRenamed("id", "place_id")
    name, display = F.lower("name"), F.col("display")
    hits = found.join(asked, "query_id").join(known, "place_id")
    score = F.when(name == F.col("q"), 50000).otherwise(0) + F.when(F.startswith(name, F.col("q")), 8000).otherwise(0) + F.when(F.startswith(display, F.col("q")), 12000).otherwise(0)
    return ranking.top_per_group(hits.withColumn("score", score), ["query_id"], [F.desc("score"), F.asc("name"), F.asc("place_id")], 8).select("query_id", "rank", "place_id", "name", "score")


@query("""WITH q AS (SELECT o_orderkey AS request_id, CASE o_orderkey % 3 WHEN 0 THEN c_name || ', ' || n_name WHEN 1 THEN c_name ELSE c_name || ' of nowhere' END AS place FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT c_custkey AS place_id, c_name AS name, c_name || ', ' || n_name AS display FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT request_id, coalesce(d.place_id, n.place_id) AS place_id, CASE WHEN d.place_id IS NOT NULL THEN 'display' WHEN n.place_id IS NOT NULL THEN 'name' ELSE 'unknown' END AS how
FROM q LEFT JOIN p d ON lower(q.place) = lower(d.display) LEFT JOIN (SELECT lower(name) AS name, min(place_id) AS place_id FROM p GROUP BY 1) n ON lower(q.place) = n.name""")
def place_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests by exact display, else by name, else unknown."""
    known = places(spark, sf_dir).select("place_id", F.lower("name").alias("name"), F.lower(F.concat_ws(", ", "name", "state")).alias("display"), F.col("name").alias("said"), "state")
    asked = table(spark, sf_dir, "orders").join(known.select(F.col("place_id").alias("o_custkey"), "said", "state"), "o_custkey")
    k = F.col("o_orderkey") % 3
    place = F.when(k == 0, F.concat_ws(", ", "said", "state")).when(k == 1, F.col("said")).otherwise(F.concat("said", F.lit(" of nowhere")))
    asked = asked.select(F.col("o_orderkey").alias("request_id"), F.lower(place).alias("place"))
    by_display = known.select(F.col("display").alias("place"), F.col("place_id").alias("d"))
    by_name = known.groupBy(F.col("name").alias("place")).agg(F.min("place_id").alias("n"))
    how = F.when(F.col("d").isNotNull(), "display").when(F.col("n").isNotNull(), "name").otherwise("unknown")
    return asked.join(by_display, "place", "left").join(by_name, "place", "left").select("request_id", F.coalesce("d", "n").alias("place_id"), how.alias("how"))


@query(f"""WITH {CLUSTERS_SQL}, {SIGNALS_SQL} SELECT c.cluster_id, topic, signal_id, source_id, coalesce(source_name, 'unknown') AS source_name FROM clusters c LEFT JOIN signals s ON c.cluster_id = s.cluster_id WHERE c.public_status = 'live'""")
def cluster_signal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = clusters(spark, sf_dir).where("public_status = 'live'").select("cluster_id", "topic")
    return live.join(signals(spark, sf_dir), "cluster_id", "left").select("cluster_id", "topic", "signal_id", "source_id", F.coalesce("source_name", F.lit("unknown")).alias("source_name"))


@query(f"""WITH {CLUSTERS_SQL}, {SIGNALS_SQL}, {PLACES_SQL} SELECT state AS city, source_id, source_type, count(DISTINCT c.cluster_id) AS n_clusters, rank() OVER (PARTITION BY state ORDER BY CASE WHEN source_type = 'official' THEN 0 ELSE 1 END, count(DISTINCT c.cluster_id) DESC, source_id) AS place_in_city
FROM clusters c JOIN places USING (place_id) JOIN signals s ON s.cluster_id = c.cluster_id GROUP BY state, source_id, source_type""")
def city_source_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster_id"), F.col("l_suppkey").alias("source_id"))
    where = clusters(spark, sf_dir).select("cluster_id", "place_id").join(places(spark, sf_dir).select("place_id", F.col("state").alias("city")), "place_id")
    return local.source_directory(cited, where.select("cluster_id", "city"), sources(spark, sf_dir).select("source_id", "source_type"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, lead(s_suppkey, 1) OVER w AS a, lead(s_suppkey, 2) OVER w AS b FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey))
SELECT s_suppkey AS place_id, unnest([a, b]) AS neighbour FROM s""")
def nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next two of the same state by name; a window instead of a self join, so a large state makes no pairs."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.lead("s_suppkey", 1).over(w).alias("a"), F.lead("s_suppkey", 2).over(w).alias("b")).select(
        F.col("s_suppkey").alias("place_id"), F.explode(F.array("a", "b")).alias("neighbour")
    )


CONFIDENCE_SQL = """conf AS (SELECT *, CASE WHEN official_source_count > 0 THEN 'official' WHEN source_count >= 2 AND established_count >= 1 THEN 'confirmed_multiple_sources'
    WHEN established_count = 1 THEN 'reported_one_source' WHEN community_count >= 1 THEN 'community_source' ELSE 'low_confidence' END AS confidence_label FROM (
  SELECT cluster_id, count(DISTINCT source_id) AS source_count, count(DISTINCT source_id) FILTER (source_type = 'official') AS official_source_count,
    count(DISTINCT source_id) FILTER (source_type = 'publisher') AS established_count, count(DISTINCT source_id) FILTER (source_type = 'community') AS community_count FROM signals GROUP BY cluster_id))"""


@query(f"WITH {SIGNALS_SQL}, {CONFIDENCE_SQL} SELECT cluster_id, source_count, official_source_count, established_count, community_count, confidence_label FROM conf")
def confidence_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local.confidence(signals(spark, sf_dir))


ELIGIBLE = f"public_status = 'live' AND started_at >= {AT} - INTERVAL 7 DAY AND expires_at > {AT}"


@query(f"""WITH {CLUSTERS_SQL}, {SIGNALS_SQL}, {PLACES_SQL}, r AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT grouping_id(r_name, state, topic) AS level, r_name AS region, state, topic, count(DISTINCT c.cluster_id) AS n_stories, count(DISTINCT source_name) AS n_sources, count(DISTINCT c.cluster_id) >= 3 AND count(DISTINCT source_name) >= 2 AS indexable
FROM clusters c JOIN places USING (place_id) JOIN r ON r.n_name = state JOIN signals s ON s.cluster_id = c.cluster_id WHERE {ELIGIBLE} GROUP BY GROUPING SETS ((r_name), (r_name, state), (r_name, state, topic))""")
def index_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct stories and source names by region, state and topic: distinct counts of a level are no sums of a finer one."""
    regions = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("state"), F.col("r_name").alias("region"))
    rows = clusters(spark, sf_dir).where(local.live(NOW)).join(places(spark, sf_dir), "place_id").join(F.broadcast(regions), "state").join(signals(spark, sf_dir), "cluster_id")
    sets = rows.groupingSets([["region"], ["region", "state"], ["region", "state", "topic"]], "region", "state", "topic")
    out = sets.agg(F.grouping_id().alias("level"), F.count_distinct("cluster_id").alias("n_stories"), F.count_distinct("source_name").alias("n_sources"))
    return out.select("level", "region", "state", "topic", "n_stories", "n_sources", ((F.col("n_stories") >= 3) & (F.col("n_sources") >= 2)).alias("indexable"))


@query(f"""WITH {CLUSTERS_SQL}, {SIGNALS_SQL}, {PLACES_SQL} SELECT state, topic, count(DISTINCT c.cluster_id) FILTER (started_at > {AT} - INTERVAL 24 HOUR AND started_at <= {AT}) AS fresh_24h,
  count(DISTINCT c.cluster_id) FILTER (started_at > {AT} - INTERVAL 7 DAY AND started_at <= {AT}) AS fresh_7d, count(DISTINCT source_id) FILTER (started_at > {AT} - INTERVAL 7 DAY) AS sources_7d,
  count(DISTINCT source_id) FILTER (started_at > {AT} - INTERVAL 7 DAY AND source_type = 'official') AS official_7d, max(started_at) AS last_fresh_at
FROM clusters c JOIN places USING (place_id) JOIN signals s ON s.cluster_id = c.cluster_id GROUP BY state, topic""")
def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit(NOW).cast("timestamp")
    age = F.col("started_at")
    week = age > at - F.expr("INTERVAL 7 DAYS")
    rows = clusters(spark, sf_dir).join(places(spark, sf_dir), "place_id").join(signals(spark, sf_dir), "cluster_id")
    return rows.groupBy("state", "topic").agg(
        F.count_distinct(F.when((age > at - F.expr("INTERVAL 24 HOURS")) & (age <= at), F.col("cluster_id"))).alias("fresh_24h"),
        F.count_distinct(F.when(week & (age <= at), F.col("cluster_id"))).alias("fresh_7d"),
        F.count_distinct(F.when(week, F.col("source_id"))).alias("sources_7d"),
        F.count_distinct(F.when(week & (F.col("source_type") == "official"), F.col("source_id"))).alias("official_7d"), F.max("started_at").alias("last_fresh_at"),
    )


@query(f"""WITH {SIGNALS_SQL} SELECT source_id, count(*) AS n_runs, count(*) FILTER (flag = 'R') AS failures, count(*) FILTER (flag <> 'R') AS successes, max(seen_at) AS last_run_at,
  CASE WHEN count(*) FILTER (flag = 'R') * 2 > count(*) THEN 'failing' WHEN count(*) FILTER (flag = 'R') > 0 THEN 'mixed' ELSE 'healthy' END AS health FROM signals GROUP BY source_id""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.count_if(F.col("flag") == "R")
    rows = signals(spark, sf_dir).groupBy("source_id").agg(F.count("*").alias("n_runs"), bad.alias("failures"), F.count_if(F.col("flag") != "R").alias("successes"), F.max("seen_at").alias("last_run_at"))
    return rows.withColumn("health", F.when(F.col("failures") * 2 > F.col("n_runs"), "failing").when(F.col("failures") > 0, "mixed").otherwise("healthy"))


@query(f"""WITH f AS (SELECT o_orderkey AS feed_id, (o_custkey % (SELECT max(s_suppkey) FROM supplier)) + 1 AS source_id, o_orderstatus <> 'P' AS active, make_timestamp((1706659200 - (o_orderkey * 37) % 7200) * 1000000) AS last_fetched_at, 15 + (o_orderkey % 6) * 15 AS every_minutes FROM orders),
s AS (SELECT s_suppkey AS source_id, CASE WHEN s_acctbal < 0 THEN 'paused' ELSE 'approved' END AS crawl_status FROM supplier)
SELECT feed_id, f.source_id, CASE WHEN s.source_id IS NULL THEN 'unknown_source' WHEN crawl_status <> 'approved' THEN 'source_' || crawl_status WHEN NOT active THEN 'feed_inactive' WHEN last_fetched_at + to_minutes(every_minutes) > {AT} THEN 'not_due' END AS skip_reason FROM f LEFT JOIN s ON s.source_id = f.source_id""")
def due_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.when(F.col("s_acctbal") < 0, "paused").otherwise("approved").alias("crawl_status"))
    k = F.col("o_orderkey")
    f = table(spark, sf_dir, "orders").crossJoin(F.broadcast(s.agg(F.max("source_id").alias("m")))).select(  # one row
        k.alias("feed_id"), (F.col("o_custkey") % F.col("m") + 1).alias("source_id"), (F.col("o_orderstatus") != "P").alias("active"),
        F.timestamp_micros((F.lit(1706659200) - k * 37 % 7200) * 1000000).alias("last_fetched_at"), (F.lit(15) + k % 6 * 15).alias("every_minutes"),
    )
    late = F.unix_micros("last_fetched_at") + F.col("every_minutes") * 60000000 > F.unix_micros(F.lit(NOW).cast("timestamp"))
    reason = F.when(F.col("crawl_status").isNull(), "unknown_source").when(F.col("crawl_status") != "approved", F.concat(F.lit("source_"), "crawl_status")).when(~F.col("active"), "feed_inactive").when(late, "not_due")
    return f.join(s, "source_id", "left").select("feed_id", "source_id", reason.alias("skip_reason"))


@query(f"WITH {CLUSTERS_SQL} SELECT cluster_id, place_id, topic, started_at FROM clusters WHERE {ELIGIBLE}")
def live_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, sf_dir).where(local.live(NOW)).select("cluster_id", "place_id", "topic", "started_at")


@query(f"""WITH {CLUSTERS_SQL}, a AS (SELECT *, coalesce({ELIGIBLE}, false) AS is_live, (1706659200000000 - epoch_us(started_at)) / 3.6e9::DOUBLE AS age FROM clusters)
SELECT cluster_id, CASE WHEN is_live AND age >= 0 AND age <= 48 THEN '0-48h' WHEN is_live THEN 'day-3-7' ELSE 'expired' END AS state,
  CASE WHEN is_live THEN 200 WHEN public_status = 'expired' OR started_at IS NULL OR started_at < {AT} - INTERVAL 7 DAY OR expires_at <= {AT} THEN 410 ELSE 404 END AS code FROM a""")
def window_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark, sf_dir).select("cluster_id", local.window_state(NOW).alias("state"), local.response_code(NOW).alias("code"))


@query(f"""WITH {CLUSTERS_SQL}, a AS (SELECT *, public_status = 'live' AND (started_at IS NULL OR started_at < {AT} - INTERVAL 7 DAY OR coalesce(expires_at <= {AT}, false)) AS over FROM clusters)
SELECT cluster_id, CASE WHEN over THEN 'expired' ELSE public_status END AS public_status, CASE WHEN over THEN 'noindex' ELSE index_status END AS index_status, over AND cluster_id % 7 <> 0 AS new_event FROM a""")
def expire_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh cluster has its event already."""
    rows = clusters(spark, sf_dir)
    had = rows.where("cluster_id % 7 = 0").select("cluster_id", F.lit("expired").alias("event_type"))
    after, events = local.expire(rows, had, NOW)
    return after.join(events, "cluster_id", "left").select("cluster_id", "public_status", "index_status", F.col("event_type").isNotNull().alias("new_event"))


TOPIC_URGENCY = {"1-URGENT": "breaking", "2-HIGH": "high", "3-MEDIUM": "normal", "5-LOW": "low"}


@query(f"""WITH {CLUSTERS_SQL}, {SIGNALS_SQL}, {PLACES_SQL}, {METRICS_SQL}, {CONFIDENCE_SQL},
s AS (SELECT c.cluster_id, state AS city, started_at, CASE topic WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 75 WHEN '3-MEDIUM' THEN 40 WHEN '5-LOW' THEN 15 ELSE 40 END * 0.45::DOUBLE
  + least(120, greatest(0, floor(coalesce(views * 0.03::DOUBLE + clicks * 0.65::DOUBLE + saves * 0.7::DOUBLE - reports * 2.5::DOUBLE, 0) + 0.5))) + source_count * 8 + official_source_count * 15
  + greatest(0, floor(35 - greatest(0.0, (1706659200000000 - epoch_us(started_at)) / 3.6e9::DOUBLE) / 168 * 35 + 0.5))
  + CASE confidence_label WHEN 'official' THEN 30 WHEN 'confirmed_multiple_sources' THEN 25 WHEN 'reported_one_source' THEN 15 WHEN 'community_source' THEN 8 ELSE 0 END AS top_score,
  CASE WHEN CAST(started_at AS DATE) = DATE '2024-01-31' THEN 0 WHEN started_at >= {AT} - INTERVAL 24 HOUR THEN 1 ELSE 2 END AS tier
  FROM clusters c JOIN places USING (place_id) JOIN conf USING (cluster_id) LEFT JOIN metrics ON story_key = c.cluster_id % 100 WHERE {ELIGIBLE} AND confidence_label <> 'low_confidence'),
d AS (SELECT city, cluster_id AS day_id, tier FROM s QUALIFY row_number() OVER (PARTITION BY city ORDER BY tier, top_score DESC, started_at DESC, cluster_id) = 1),
w AS (SELECT s.city, s.cluster_id FROM s JOIN d USING (city) WHERE s.cluster_id <> day_id QUALIFY row_number() OVER (PARTITION BY s.city ORDER BY top_score DESC, started_at DESC, s.cluster_id) = 1)
SELECT d.city, day_id, CASE WHEN tier < 2 THEN 'Top Story of the Day' ELSE 'Latest Local Story' END AS day_label, coalesce(w.cluster_id, day_id) AS week_id FROM d LEFT JOIN w USING (city)""")
def local_top_day_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgency = F.lit("normal")
    for k, v in TOPIC_URGENCY.items():
        urgency = F.when(F.col("topic") == k, v).otherwise(urgency)
    rows = clusters(spark, sf_dir).where(local.live(NOW)).join(places(spark, sf_dir).select("place_id", F.col("state").alias("city")), "place_id")
    rows = rows.join(local.confidence(signals(spark, sf_dir)), "cluster_id").where("confidence_label <> 'low_confidence'")
    metrics = story_metrics(spark, sf_dir)
    rows = rows.join(metrics, F.col("cluster_id") % 100 == F.col("story_key"), "left").withColumn("urgency", urgency)
    return local.top_day_and_week(rows.withColumn("top_score", local.top_story_score(NOW)), NOW)


@query(f"""WITH {CLUSTERS_SQL}, {PLACES_SQL}, l AS (SELECT c.*, state FROM clusters c JOIN places USING (place_id) WHERE {ELIGIBLE} AND index_status = 'index')
SELECT 'story' AS kind, '/story/' || cluster_id AS path, started_at AS last_updated, 1 AS n FROM l UNION ALL SELECT 'state', '/' || lower(state), max(started_at), count(*) FROM l GROUP BY state
UNION ALL SELECT 'topic', '/' || lower(state) || '/' || lower(topic), max(started_at), count(*) FROM l GROUP BY state, topic UNION ALL SELECT 'news', '/story/' || cluster_id, started_at, 1 FROM l WHERE started_at <= {AT} AND started_at >= {AT} - INTERVAL 48 HOUR""")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clusters(spark, sf_dir).where(local.live(NOW) & (F.col("index_status") == "index")).join(places(spark, sf_dir), "place_id")
    one = lambda kind, df: df.select(F.lit(kind).alias("kind"), F.concat(F.lit("/story/"), "cluster_id").alias("path"), F.col("started_at").alias("last_updated"), F.lit(1).cast("long").alias("n"))
    grouped = lambda kind, path, *keys: rows.groupBy(*keys).agg(F.max("started_at").alias("last_updated"), F.count("*").alias("n")).select(F.lit(kind).alias("kind"), path.alias("path"), "last_updated", "n")
    state = F.concat(F.lit("/"), F.lower("state"))
    news = rows.where(local.window_state(NOW) == "0-48h")
    return one("story", rows).unionByName(grouped("state", state, "state")).unionByName(grouped("topic", F.concat(state, F.lit("/"), F.lower("topic")), "state", "topic")).unionByName(one("news", news))
