"""Records by schema, validation with warnings, cities by evidence of six kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import candidates, records
from tidewire.plans.feed import SUMMARY_SQL
from tidewire.plans.local import KM
from tidewire.plans.readers import POSTS_SQL, posts
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


SPACED = "trim(regexp_replace(coalesce({x}, ''), '[ \\t\\r\\n]+', ' ', 'g'))"
MADE = f"'{records.MADE}'"
ISO_SQL = "strftime({x}, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_ms({x}) % 1000 AS VARCHAR), 3, '0') || 'Z'"
STATUSES = ["new", "classified", "odd", "rejected", None]


@query(f"""WITH {ITEMS_SQL}, r AS (SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE link END AS url, title, CASE WHEN id % 7 = 0 THEN NULL ELSE source_name END AS source, {SUMMARY_SQL} AS summary, CASE WHEN id % 6 = 0 THEN 'yesterday' ELSE {ISO_SQL.format(x='published_at')} END AS told,
  CASE id % 3 WHEN 0 THEN '["x"]' WHEN 1 THEN 'x]' ELSE NULL END AS cities, ['new', 'classified', 'odd', 'rejected', NULL][id % 5 + 1] AS status, category FROM items),
n AS (SELECT id AS item_id, coalesce(url, '') AS canonical_url, {SPACED.format(x='title')} AS title, coalesce(source, '') AS source_id, CASE WHEN source IS NULL THEN '' ELSE source || '-rss' END AS source_feed_id, {SPACED.format(x='summary')} AS excerpt,
  CASE WHEN told = 'yesterday' THEN NULL ELSE told END AS published_at, CASE WHEN cities = '["x"]' THEN cities ELSE '[]' END AS city_candidates_json, CASE WHEN status IN ('new', 'classified', 'rejected') THEN status ELSE 'new' END AS signal_status, category AS language FROM r)
SELECT 'signal-' || substr(sha1(canonical_url || ':' || title), 1, 16) AS id, canonical_url, canonical_url AS original_url, title, source_id, excerpt, published_at, {MADE} AS created_at, city_candidates_json, signal_status, language,
  array_to_string(list_filter([CASE WHEN canonical_url = '' THEN 'canonical_url is required' END, CASE WHEN title = '' THEN 'title is required' END, CASE WHEN source_id = '' THEN 'source_id is required' END, CASE WHEN source_feed_id = '' THEN 'source_feed_id is required' END], lambda x: x IS NOT NULL), ',') AS failures FROM n""")
def signal_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as landed signals (other names, odd times, statuses and lists) -> records, and what they lack."""
    i = F.col("id")
    iso = F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))
    landed = items(spark, sf_dir).select(
        F.when(i % 9 != 0, F.col("link")).alias("canonicalUrl"), "title", F.when(i % 7 != 0, F.col("source_name")).alias("sourceId"), F.when(i % 7 != 0, F.concat("source_name", F.lit("-rss"))).alias("source_feed_id"),
        T.summary(F.col("text")).alias("summary"), F.when(i % 6 == 0, "yesterday").otherwise(iso).alias("publishedAt"), F.when(i % 3 == 0, '["x"]').when(i % 3 == 1, "x]").alias("cityCandidates"),
        F.element_at(F.array(*map(F.lit, STATUSES)), (i % 5 + 1).cast("int")).alias("signal_status"), F.col("category").alias("language"),
    )
    schema = records.SCHEMAS["input_signal"]
    found = records.normalised(landed, schema)
    return found.select("id", "canonical_url", "original_url", "title", "source_id", "excerpt", "published_at", "created_at", "city_candidates_json", "signal_status", "language", F.array_join(records.failures_of(found, schema), ",").alias("failures"))


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS headline, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS city, CASE o_orderstatus WHEN 'F' THEN 'live' WHEN 'O' THEN 'expired' ELSE 'gone' END AS status, o_totalprice / 1000 - 50 AS n FROM orders),
n AS (SELECT *, trim(regexp_replace(lower(headline), '[^a-z0-9]+', '-', 'g'), '-') AS slug, coalesce(city, '') AS city_id FROM r)
SELECT 'cluster-' || substr(sha1(city_id || ':' || slug), 1, 16) AS id, headline, slug, city_id, CASE WHEN status = 'gone' THEN 'live' ELSE status END AS public_status, greatest(0.0, n)::DOUBLE AS source_count,
  array_to_string(list_filter([CASE WHEN headline = '' THEN 'headline is required' END, CASE WHEN city_id = '' THEN 'city_id is required' END, CASE WHEN slug = '' THEN 'slug is required' END], lambda x: x IS NOT NULL), ',') AS failures,
  array_to_string(list_filter([CASE WHEN headline = '' THEN 'headline is required' END, CASE WHEN city_id = '' THEN 'city_id is required' END, 'slug is required', 'id is required', 'confidence_label is invalid', 'urgency is invalid', CASE WHEN status = 'gone' THEN 'public_status is invalid' END, 'index_status is invalid', CASE WHEN n < 0 THEN 'source_count is out of bounds' END], lambda x: x IS NOT NULL), ',') AS raw_failures FROM n""")
def cluster_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as landed clusters -> records; what they lack after and before they are normalised."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "live").when(F.col("o_orderstatus") == "O", "expired").otherwise("gone")
    landed = table(spark, sf_dir, "orders").select(
        F.when(k % 11 == 0, "").otherwise(F.col("o_orderpriority")).alias("headline"), F.when(k % 13 != 0, F.col("o_custkey").cast("string")).alias("city_id"), status.alias("public_status"), (F.col("o_totalprice") / 1000 - 50).alias("source_count"),
    )
    schema = records.SCHEMAS["story_cluster"]
    raw = records.failures_of(landed, schema)
    whole = landed.select("*", F.array_join(raw, ",").alias("raw_failures"))
    found = records.normalised(whole, (*schema, records.Field("raw_failures")))
    return found.select("id", "headline", "slug", "city_id", "public_status", "source_count", F.array_join(records.failures_of(found, schema), ",").alias("failures"), "raw_failures")


@query(f"""WITH {POSTS_SQL}, p AS (SELECT *, CASE WHEN story_key % 10 = 3 THEN 'pigeon' ELSE platform END AS on_platform, CASE WHEN story_key % 8 = 5 THEN '/about' ELSE '/stories/' || story_key END AS page, CASE WHEN story_key % 6 = 1 THEN '' ELSE '2024-01-01' END AS posted, views // 2 AS reach FROM posts)
SELECT story_key, array_to_string(list_filter([CASE WHEN on_platform NOT IN ('instagram', 'facebook') THEN 'platform' END, CASE WHEN page NOT LIKE '/stories/%' THEN 'exact_article' END], lambda x: x IS NOT NULL), ',') AS failures,
  array_to_string(list_filter([CASE WHEN posted = '' THEN 'no_posting_time' END, CASE WHEN clicks > reach AND reach > 0 THEN 'clicks_above_reach' END, CASE WHEN reports > 0 THEN 'reported' END], lambda x: x IS NOT NULL), ',') AS warnings FROM p""")
def post_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as they are reported: failures, which keep one out, and warnings, which don't."""
    k = F.col("story_key")
    rows = posts(spark, sf_dir).withColumns({
        "on": F.when(k % 10 == 3, "pigeon").otherwise(F.col("platform")), "page": F.when(k % 8 == 5, "/about").otherwise(F.concat(F.lit("/stories/"), k.cast("string"))), "posted": F.when(k % 6 == 1, "").otherwise("2024-01-01"), "reach": F.floor(F.col("views") / 2),
    })
    failed = {"platform": ~F.col("on").isin("instagram", "facebook"), "exact_article": ~F.startswith("page", F.lit("/stories/"))}
    warned = {"no_posting_time": F.col("posted") == "", "clicks_above_reach": (F.col("clicks") > F.col("reach")) & (F.col("reach") > 0), "reported": F.col("reports") > 0}
    return rows.select("story_key", F.array_join(records.named(failed), ",").alias("failures"), F.array_join(records.named(warned), ",").alias("warnings"))


W = "list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
SAID = "' ' || trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9+.-]+', ' ', 'g')) || ' '"
P = candidates.POINTS
BOOSTS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in candidates.COVERAGE_BOOSTS.items())
KINDS_SQL = "['official_city', 'tv', 'official_school', 'blog'][source_id % 4 + 1]"


@query(f"""WITH {ITEMS_SQL}, b AS (SELECT item_id AS city_id, {W.format(x='text')} AS k FROM benchmark), c AS (SELECT city_id, k[2] || ' ' || k[3] AS name, k[5] AS abbr, k[6] AS state, k[7] || ' ' || k[8] AS county, [k[1] || ' ' || k[2]] AS areas, (city_id * 37 % 18000) / 100.0::DOUBLE - 90 AS lat, (city_id * 91 % 36000) / 100.0::DOUBLE - 180 AS lon FROM b WHERE len(k) >= 8),
s AS (SELECT id AS signal_id, CAST(regexp_extract(source_name, '([0-9]+)$', 1) AS BIGINT) AS source_id, {SAID.format(x="title || ' ' || " + SUMMARY_SQL)} AS said, CASE WHEN id % 4 = 0 THEN (id * 53 % 18000) / 100.0::DOUBLE - 90 END AS lat, CASE WHEN id % 4 = 0 THEN (id * 71 % 36000) / 100.0::DOUBLE - 180 END AS lon FROM items),
src AS (SELECT DISTINCT source_id, {KINDS_SQL} AS kind FROM s), cov AS (SELECT city_id, city_id % 10 AS source_id, ['primary', 'nearby', 'statewide', 'regional', 'other'][city_id % 5 + 1] AS coverage_type, (city_id * 7 % 100)::DOUBLE AS confidence FROM c),
st AS (SELECT src.*, {SAID.format(x="'desk of ' || name")} AS said FROM src LEFT JOIN c ON c.city_id = src.source_id),
e AS (SELECT signal_id, cov.city_id, 1 AS nr, 0 AS part, 'max' AS kind, confidence AS points FROM s JOIN cov ON cov.source_id = s.source_id WHERE confidence > 0
 UNION ALL SELECT signal_id, cov.city_id, 1, 1, 'boost', CASE coverage_type {BOOSTS} ELSE {candidates.OTHER_COVERAGE} END FROM s JOIN cov ON cov.source_id = s.source_id JOIN src ON src.source_id = s.source_id WHERE src.kind IN ('official_city', 'official_county')
 UNION ALL SELECT signal_id, city_id, 2, 0, 'max', {P['named']} FROM s JOIN c ON contains(said, ' ' || name || ' ') UNION ALL SELECT signal_id, city_id, 2, 1, 'boost', 7 FROM s JOIN c ON contains(said, ' ' || name || ' ') AND contains(said, ' ' || abbr || ' ') UNION ALL SELECT signal_id, city_id, 2, 2, 'boost', 7 FROM s JOIN c ON contains(said, ' ' || name || ' ') AND contains(said, ' ' || state || ' ')
 UNION ALL SELECT signal_id, city_id, 3, 0, 'max', {P['county']} FROM s JOIN c ON contains(said, ' ' || county || ' ') UNION ALL SELECT signal_id, city_id, 4, 0, 'max', {P['neighbourhood']} FROM s JOIN c ON contains(said, ' ' || areas[1] || ' ')
 UNION ALL SELECT signal_id, city_id, 5, 0, 'max', CASE WHEN starts_with(st.kind, 'official') THEN {P['official_source']} ELSE {P['other_source']} END FROM s JOIN st ON st.source_id = s.source_id JOIN c ON contains(st.said, ' ' || name || ' ')
 UNION ALL SELECT signal_id, city_id, 6, 0, 'max', CASE WHEN mi <= 25 THEN 86 WHEN mi <= 50 THEN 72 ELSE 55 END FROM (SELECT signal_id, city_id, {KM} * 0.621371 AS mi FROM (SELECT signal_id, city_id, pow(sin(radians(c.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lon - s.lon) / 2), 2) AS h FROM s, c WHERE s.lat IS NOT NULL)) WHERE mi <= 100),
g AS (SELECT signal_id, city_id, list({{'kind': kind, 'points': points::DOUBLE}} ORDER BY nr, part) AS l FROM e GROUP BY signal_id, city_id),
f AS (SELECT signal_id, city_id, list_reduce(list_prepend({{'kind': '', 'points': 0.0::DOUBLE}}, l), lambda a, x: {{'kind': '', 'points': CASE WHEN x.kind = 'max' THEN greatest(a.points, x.points) WHEN a.points > 0 THEN least(100.0, a.points + x.points) ELSE a.points END}}).points AS confidence FROM g)
SELECT signal_id, city_id, round(confidence, 4) AS confidence FROM f WHERE confidence >= {candidates.LEAST}""")
def city_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cities (phrases of the benchmark) that items may be about: coverage, names, states, counties, neighbourhoods, sources, distance."""
    i, k = F.col("id"), T.words(F.col("text"))
    pair = lambda a: F.concat_ws(" ", F.get("k", F.lit(a)), F.get("k", F.lit(a + 1)))
    at = lambda c, m, n: F.pmod(c * m, F.lit(n)) / 100
    b, city = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("city_id"), k.alias("k")).where(F.size("k") >= 8), F.col("city_id")
    cities = b.select("city_id", pair(1).alias("name"), F.get("k", F.lit(4)).alias("state_abbr"), F.get("k", F.lit(5)).alias("state_name"), pair(6).alias("county_name"), F.array(pair(0)).alias("neighbourhoods"), (at(city, 37, 18000) - 90).alias("lat"), (at(city, 91, 36000) - 180).alias("lon"))
    source = F.regexp_extract("source_name", "([0-9]+)$", 1).cast("long")
    here = lambda x: F.when(i % 4 == 0, x)
    none = F.lit(None).cast("array<struct<city_id:long,confidence:double>>")
    rows = items(spark, sf_dir)
    signals = rows.select(i.alias("signal_id"), F.concat_ws(" ", "title", T.summary(F.col("text"))).alias("text"), source.alias("source_id"), here(at(i, 53, 18000) - 90).alias("lat"), here(at(i, 71, 36000) - 180).alias("lon"), none.alias("existing"))
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (n + 1).cast("int"))
    coverage = cities.select(city.alias("ord"), (city % 10).alias("source_id"), "city_id", pick((*candidates.COVERAGE_BOOSTS, "other"), city % 5).alias("coverage_type"), (city * 7 % 100).cast("double").alias("confidence"))
    desks = rows.select(source.alias("source_id")).distinct()
    sources = desks.join(cities.select(city.alias("source_id"), "name"), "source_id", "left").select("source_id", pick(("official_city", "tv", "official_school", "blog"), F.col("source_id") % 4).alias("source_type"), F.concat(F.lit("desk of "), "name").alias("text"))
    return candidates.city_candidates(signals, cities, coverage, sources).select("signal_id", "city_id", F.round("confidence", 4).alias("confidence"))
