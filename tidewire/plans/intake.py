"""Landed files and exports: each query writes the given tables as the files of a kind of feed, in the shared folder, and reads
them back as signals; and what learning records, posts and public signals must hold."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import classify
from tidewire.operators.shuffles import shared_folder
from tidewire.plans.feed import SUMMARY_SQL, tokens_sql
from tidewire.plans.readers import POSTS_SQL, posts
from tidewire.plans.rules import hits, rules_sql
from tidewire.plans.writing import CLOSE, DRAFTS_SQL, drafts, summary_gates
from tidewire.plans.writing import SQL as WRITING
from tidewire.sources import feeds
from tidewire.sources.landed import ITEMS_SQL, items, story_metrics, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def landed(rows: DataFrame, kind: str, root: str = "", page: int = 500) -> str:
    """A folder with files of the rows (id, value): with a root, documents of at most `page` rows inside it."""
    path = f"{shared_folder(rows.sparkSession)}/landed-{kind}-{uuid.uuid4().hex}"
    if not root:
        rows.select("value").write.text(path)
        return path
    pages = rows.groupBy(F.floor(F.col("id") / page).alias("page")).agg(F.concat(F.lit(f"<{root}>"), F.array_join(F.collect_list("value"), ""), F.lit(f"</{root}>")).alias("value"))
    pages.repartition("page").write.partitionBy("page").text(path)
    return path


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tag(name: str, c: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), escaped(c), F.lit(f"</{name}>"))


def feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and excerpts of plain letters, so that every format carries them unchanged."""
    plain = lambda c: F.trim(F.regexp_replace(c, "[^A-Za-z0-9 .,&<>-]+", " "))
    rows = items(spark, sf_dir).select("id", plain(F.col("title")).alias("title"), "link", plain(T.summary(F.col("text"))).alias("excerpt"), "published_at", F.col("source_name").alias("author"))
    return rows.where("title <> ''")


PLAIN = "trim(regexp_replace({x}, '[^A-Za-z0-9 .,&<>-]+', ' ', 'g'))"
SQUEEZE = "trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


def feed_sql(kind: str, title: str = "title", excerpt: str = "excerpt", author: str = "author") -> str:
    url = "'https://' || regexp_replace(regexp_extract(lower(link), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') || regexp_extract(link, '^[a-zA-Z]+://[^/?]+([^?]*)', 1)"
    return f"""WITH {ITEMS_SQL}, fr AS (SELECT id, {PLAIN.format(x='title')} AS title, link, {PLAIN.format(x=SUMMARY_SQL)} AS excerpt, published_at, source_name AS author FROM items),
fs AS (SELECT trim({title}) AS title, {url} AS canonical_url, {excerpt} AS raw, published_at, {author} AS author FROM fr WHERE title <> '')
SELECT title, canonical_url, {SQUEEZE.format(x='raw')} AS excerpt, published_at, author, '{kind}' AS kind, substr(sha1(canonical_url), 1, 16) AS url_hash, substr(sha1(regexp_replace(lower(title || ' ' || raw), '[^a-z0-9]+', ' ', 'g')), 1, 16) AS content_hash FROM fs"""


MAIL = "EEE, dd MMM yyyy HH:mm:ss"


@query(feed_sql("rss"))
def rss_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS files -> signals; every third item has its link in guid only."""
    link = F.when(F.col("id") % 3 == 0, tag("guid", F.col("link"))).otherwise(tag("link", F.col("link")))
    when = F.concat(F.date_format("published_at", MAIL), F.lit(" GMT"))
    line = F.concat(F.lit("<item>"), tag("title", F.col("title")), link, tag("description", F.col("excerpt")), tag("pubDate", when), tag("author", F.col("author")), F.lit("</item>"))
    return feeds.rss(spark, landed(feed_rows(spark, sf_dir).select("id", line.alias("value")), "rss", "channel"))


@query(feed_sql("atom"))
def atom_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom files -> signals; the update time stands in for a missing time of publication."""
    when = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    time = F.when(F.col("id") % 2 == 0, tag("published", when)).otherwise(tag("updated", when))
    link = F.concat(F.lit('<link href="'), escaped(F.col("link")), F.lit('"/>'))
    line = F.concat(F.lit("<entry>"), tag("title", F.col("title")), link, tag("summary", F.col("excerpt")), time, F.lit("<author>"), tag("name", F.col("author")), F.lit("</author></entry>"))
    return feeds.atom(spark, landed(feed_rows(spark, sf_dir).select("id", line.alias("value")), "atom", "feed"))


@query(feed_sql("sitemap", "link", "''", "''"))
def sitemap_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sitemap files -> signals titled by their address."""
    line = F.concat(F.lit("<url>"), tag("loc", F.col("link")), tag("lastmod", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("</url>"))
    return feeds.sitemap(spark, landed(feed_rows(spark, sf_dir).select("id", line.alias("value")), "sitemap", "urlset"))


@query(feed_sql("api"))
def api_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON pages of at most 50 items, under several names of lists and fields -> signals."""
    when = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    short = F.struct(F.col("title"), F.col("link").alias("url"), F.col("excerpt").alias("summary"), when.alias("published_at"), F.col("author"))
    other = F.struct(F.col("title").alias("headline"), F.col("link"), F.col("excerpt").alias("description"), when.alias("date"), F.col("author").alias("byline"))
    rows = feed_rows(spark, sf_dir).withColumn("page", F.floor(F.col("id") / 50))
    pages = rows.groupBy("page").agg(F.collect_list(short).alias("a"), F.collect_list(other).alias("b"))
    body = F.when(F.col("page") % 2 == 0, F.to_json(F.struct(F.col("a").alias("items")))).otherwise(F.to_json(F.struct(F.col("b").alias("articles"))))
    return feeds.api(pages.select(body.alias("body")))


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source AS id, upper(source) AS name, 'https://' || source || '.example.com/feed' AS feedUrl, CASE WHEN n % 2 = 0 THEN round(n / 100.0, 2)::DOUBLE ELSE 1.0 END AS weight, NULL::VARCHAR AS access FROM s""")
def registry_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry document -> its sources; a weight that is missing is 1."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    one = F.struct(F.col("source").alias("id"), F.upper("source").alias("name"), F.concat(F.lit("https://"), "source", F.lit(".example.com/feed")).alias("feedUrl"), F.when(F.col("n") % 2 == 0, F.round(F.col("n") / 100.0, 2)).alias("weight"))
    doc = n.agg(F.to_json(F.struct(F.collect_list(one).alias("sources"))).alias("value"))  # a registry is one document of a bounded list
    return feeds.registry(spark, landed(doc, "registry")).select("id", "name", "feedUrl", "weight", "access")


TREND_ROWS = "SELECT item_id, 'topic ' || {t}[1:1][1] AS topic, (item_id * 37) % 140 - 20 AS interest, item_id * 10 AS volume FROM benchmark".format(t=tokens_sql("text"))
PROVIDER_SQL = " UNION ALL ".join(
    f"SELECT '{p}' AS provider, topic, least(100.0, greatest(0.0, interest))::DOUBLE AS interest, {'NULL::BIGINT' if relative else 'volume'} AS volume, {c}::DOUBLE AS confidence FROM t WHERE item_id % {len(feeds.PROVIDERS)} = {k}"
    for k, (p, (c, relative)) in enumerate(feeds.PROVIDERS.items())
)


@query(f"WITH t AS ({TREND_ROWS}), u AS ({PROVIDER_SQL}) SELECT *, substr(sha1(provider || ':' || lower(topic)), 1, 12) AS id FROM u WHERE topic IS NOT NULL")
def trend_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports of ten providers -> one schema, each with its confidence; relative ones without a volume."""
    i = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("topic "), F.get(T.title_tokens(F.col("text"), 1), F.lit(0))).alias("topic"), (i * 37 % 140 - 20).alias("interest"), (i * 10).alias("volume")).where("topic is not null")
    return feeds.trends({p: rows.where(i % len(feeds.PROVIDERS) == k) for k, p in enumerate(feeds.PROVIDERS)})


@query("""WITH e AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) FILTER (event_type = 'view') - 50 AS i, count(*) FILTER (event_type = 'click') AS c FROM events GROUP BY 1)
SELECT '/s/' || k AS url, greatest(0, i)::DOUBLE AS views, c::DOUBLE AS link_clicks FROM e""")
def metric_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports that say impressions and clicks; negative numbers count as 0."""
    m = story_metrics(spark, sf_dir)
    return feeds.metrics(m.select(F.concat(F.lit("/s/"), F.col("story_key").cast("string")).alias("url"), (F.col("views") - 50).alias("impressions"), "clicks"))


@query("SELECT doc_id AS id, 'fallback' AS origin FROM documents WHERE lang = 'en' AND NOT EXISTS (SELECT 1 FROM documents WHERE lang = 'none') ")
def fallback_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a source that brought nothing: those of the fallback take their place."""
    docs = table(spark, sf_dir, "documents")
    pick = lambda lang, origin: docs.where(F.col("lang") == lang).select(F.col("doc_id").alias("id"), F.lit(origin).alias("origin"))
    return feeds.or_fallback(pick("none", "live"), pick("en", "fallback"))


@query(f"""WITH {ITEMS_SQL}, fr AS (SELECT {PLAIN.format(x='title')} AS title, link, published_at FROM items)
SELECT sha1(lower(title)) AS title_hash, substr(sha1('https://' || regexp_replace(regexp_extract(lower(link), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') || regexp_extract(link, '^[a-zA-Z]+://[^/?]+([^?]*)', 1)), 1, 16) AS url_hash, published_at, 'rss' AS kind FROM fr WHERE title <> ''""")
def private_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may be kept of signals for good: hashes and times."""
    return feeds.private_metadata(rss_signals(spark, sf_dir))


#: Entities: name -> (type, default, allowed values), after the tables they come from.
ENTITIES = {
    "cluster": {"public_status": ("string", "hidden", ("live", "expired", "hidden")), "urgency": ("string", "normal", ("breaking", "high", "normal", "low")), "confidence": ("double", "0", None), "source_count": ("long", "0", None), "index_status": ("string", "noindex", ("index", "noindex"))},
    "source": {"source_type": ("string", "other", ("official", "publisher", "community", "other")), "crawl_status": ("string", "pending", ("approved", "pending", "paused", "rejected")), "trust": ("double", "50", None)},
}


@query("""SELECT 'cluster-' || substr(sha1('cluster:' || o_orderkey), 1, 12) AS id, CASE o_orderstatus WHEN 'F' THEN 'live' WHEN 'O' THEN 'expired' ELSE 'hidden' END AS public_status, CASE left(o_orderpriority, 1) WHEN '1' THEN 'breaking' WHEN '2' THEN 'high' ELSE 'normal' END AS urgency,
  least(100.0, greatest(0.0, o_totalprice / 1000.0)) AS confidence, 0::BIGINT AS source_count, 'noindex' AS index_status FROM orders""")
def entity_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cluster rows as entities: known values or their default, numbers within bounds, an id by hash."""
    pick = lambda c, names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[c]
    o = table(spark, sf_dir, "orders")
    raw = o.select(
        F.concat(F.lit("cluster-"), T.stable_hash(F.concat(F.lit("cluster:"), F.col("o_orderkey").cast("string")), 12)).alias("id"), pick(F.col("o_orderstatus"), {"F": "live", "O": "expired", "P": "unheard"}).alias("status"),
        pick(F.substring("o_orderpriority", 1, 1), {"1": "breaking", "2": "high", "3": "urgent"}).alias("urgency"), (F.col("o_totalprice") / 1000.0).alias("score"),
    )
    fields = {"id": ("string", None, None)} | ENTITIES["cluster"]
    out = classify.conform(raw, fields, {"public_status": ("status",), "confidence": ("score", "rating")})
    return out.withColumn("confidence", T.clamp(F.col("confidence"), 0.0, 100.0))


# --- learning records, posts and public signals

UNSAFE = (("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+"), ("secret", "(password|token|secret|key)=[A-Za-z0-9]+"), ("handle", "(^| )@[A-Za-z0-9_]{2,}"), ("card", "[0-9]{13,}"))
FIELDS = ("weak", "approved")
UNSAFE_SQL = ", ".join(f"CASE WHEN regexp_matches({f}, '{p}') THEN '{f}:{n}' END" for f in FIELDS for n, p in UNSAFE)


@query(f"""WITH {DRAFTS_SQL}, lr AS (SELECT id, summary AS weak, CASE WHEN id % 7 = 0 THEN '' ELSE description END AS approved, CASE WHEN id % 11 = 0 THEN '' ELSE 's' || id END AS story, k, dk, n, summary, description, text AS source_text FROM dr JOIN documents ON doc_id = id),
rj AS (SELECT id, list_filter([{UNSAFE_SQL}, CASE WHEN length(source_text) >= 2000 AND id % 5 = 0 THEN 'source:full_text' END, CASE WHEN approved <> '' AND ({CLOSE}) THEN 'approved:too_close' END, CASE WHEN story = '' THEN 'story:missing' END, CASE WHEN approved = '' THEN 'approved:missing' END, CASE WHEN weak = '' THEN 'weak:missing' END], lambda x: x IS NOT NULL) AS reasons FROM lr)
SELECT id, len(reasons) > 0 AS rejected, array_to_string(reasons, ',') AS reasons FROM rj""")
def memory_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts as learning records (a weak text, an approved one, sometimes the whole source): why each may not be kept."""
    rows = drafts(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("source_text")), "id")
    i = F.col("id")
    rows = rows.withColumns({"weak": F.col("summary"), "approved": F.when(i % 7 == 0, "").otherwise(F.col("description"))})
    run = lambda x: T.ngrams(F.col(x), 13)
    close = (
        ((F.col("summary") != "") & (F.lower("summary") == F.lower("description"))) | F.arrays_overlap(run("k"), run("dk"))
        | ((T.jaccard(F.col("k"), F.col("dk")) >= 0.9) & (F.slice("k", 1, 4) == F.slice("dk", 1, 4)) & (F.col("n") >= 0.75 * F.size("dk")))
    )
    checks = {f"{f}:{n}": ~F.col(f).rlike(p) for f in FIELDS for n, p in UNSAFE}
    checks |= {"source:full_text": ~((F.length("source_text") >= 2000) & (i % 5 == 0)), "approved:too_close": ~((F.col("approved") != "") & F.coalesce(close, F.lit(False))), "story:missing": i % 11 != 0, "approved:missing": F.col("approved") != "", "weak:missing": F.col("weak") != ""}
    # a text that is not there breaks no rule but its own
    checks["source:full_text"] = F.coalesce(checks["source:full_text"], F.lit(True))
    reasons = classify.failures(checks)
    return rows.select("id", (F.size(reasons) > 0).alias("rejected"), F.array_join(reasons, ",").alias("reasons"))


HARD = ("empty_summary", "too_close_to_source", "missing_detail")


@query(f"""WITH g AS ({WRITING['summary_gates']}), {rules_sql('filler', texts='SELECT doc_id AS id, text FROM documents')}, w AS (SELECT DISTINCT id FROM hits)
SELECT doc_id, NOT list_has_any(string_split(failures, ','), {list(HARD)!r}) AS selectable, id IS NOT NULL AS weak_local FROM g LEFT JOIN w ON id = doc_id""")
def selectable_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries that an editor may pick (no hard failure), and whether the article's text is filler."""
    weak = hits(spark, sf_dir, "filler").select(F.col("id").alias("doc_id")).distinct().withColumn("weak", F.lit(True))
    hard = F.arrays_overlap(F.split("failures", ","), F.array(*map(F.lit, HARD)))
    return summary_gates(spark, sf_dir).join(weak, "doc_id", "left").select("doc_id", (~hard).alias("selectable"), F.coalesce("weak", F.lit(False)).alias("weak_local"))


@query(f"""WITH {POSTS_SQL} SELECT 'post-' || substr(sha1(platform || ':/stories/' || story_key), 1, 14) AS post_id, story_key AS story_id, '/stories/' || story_key AS exact_url, platform, category, shape AS caption_shape, CAST(floor(greatest(0, views) + 0.5) AS BIGINT) AS views,
  CAST(clicks AS BIGINT) AS link_clicks, CAST(saves AS BIGINT) AS saves, reports, score, CASE WHEN score >= 60 THEN 'strong' WHEN score >= 20 THEN 'moderate' ELSE 'weak' END AS lesson, true AS aggregate_only FROM posts""")
def social_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts as records: whole non-negative numbers, an id by hash of platform and page, the score and the lesson it gives."""
    whole = lambda c: T.half_up(F.greatest(F.lit(0), F.col(c))).cast("long")
    url = F.concat(F.lit("/stories/"), F.col("story_key").cast("string"))
    level = F.when(F.col("score") >= 60, "strong").when(F.col("score") >= 20, "moderate").otherwise("weak")
    return posts(spark, sf_dir).select(
        F.concat(F.lit("post-"), T.stable_hash(F.concat("platform", F.lit(":"), url), 14)).alias("post_id"), F.col("story_key").alias("story_id"), url.alias("exact_url"), "platform", "category", F.col("shape").alias("caption_shape"),
        whole("views").alias("views"), whole("clicks").alias("link_clicks"), whole("saves").alias("saves"), "reports", "score", level.alias("lesson"), F.lit(True).alias("aggregate_only"),
    )


INTEREST_SQL = f"""pi AS (SELECT item_id, {tokens_sql('text')} AS k, least(100, (item_id * 37) % 130) AS interest, ['trending_search', 'manual', 'forum'][item_id % 3 + 1] AS source_type FROM benchmark),
pk AS (SELECT *, array_to_string(k[1:2], ' ') AS topic FROM pi WHERE len(k) > 0)"""


def public_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.title_tokens(F.col("text")).alias("k"), F.least(F.lit(100), i * 37 % 130).alias("interest"), F.element_at(F.array(*map(F.lit, ("trending_search", "manual", "forum"))), (i % 3 + 1).cast("int")).alias("source_type"))
    return rows.where(F.size("k") > 0).withColumn("topic", F.array_join(F.slice("k", 1, 2), " "))


@query(f"""WITH {INTEREST_SQL}, l AS (SELECT *, CASE WHEN interest >= 80 THEN 'high' WHEN interest >= 50 THEN 'moderate' ELSE 'early' END AS level FROM pk)
SELECT 'signal-' || substr(sha1(source_type || ':' || topic || ':' || item_id), 1, 14) AS signal_id, source_type, topic, interest, array_to_string(k[1:12], ',') AS related, level, CASE WHEN level = 'high' THEN 'medium' ELSE 'early_signal' END AS confidence, topic || ' shows ' || level || ' interest.' AS lesson FROM l""")
def public_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public-interest signals as records, with the lesson each gives."""
    level = F.when(F.col("interest") >= 80, "high").when(F.col("interest") >= 50, "moderate").otherwise("early")
    rows = public_interest(spark, sf_dir).withColumn("level", level)
    return rows.select(
        F.concat(F.lit("signal-"), T.stable_hash(F.concat_ws(":", "source_type", "topic", F.col("item_id").cast("string")), 14)).alias("signal_id"), "source_type", "topic", F.col("interest"), F.array_join(F.slice("k", 1, 12), ",").alias("related"), "level",
        F.when(F.col("level") == "high", "medium").otherwise("early_signal").alias("confidence"), F.concat("topic", F.lit(" shows "), "level", F.lit(" interest.")).alias("lesson"),
    )


@query(f"""WITH {POSTS_SQL}, {INTEREST_SQL}, u AS (SELECT 'signal' AS kind, CASE WHEN source_type = 'trending_search' THEN 'manual' ELSE source_type END AS source, topic, interest::DOUBLE AS interest, 0::DOUBLE AS velocity, CASE WHEN interest >= 70 THEN 2 ELSE 1 END AS sustained_days, 0.66::DOUBLE AS confidence FROM pk
UNION ALL SELECT 'metric', 'social_memory', category || ' ' || shape, 0, score / 12.0::DOUBLE, 1, 1.0 FROM posts WHERE reports < 1000000)
SELECT substr(sha1(kind || ':' || source || ':' || topic), 1, 12) AS id, kind, source, topic, max(interest) AS interest, round(max(velocity), 6) AS velocity, max(sustained_days) AS sustained_days, max(confidence) AS confidence FROM u GROUP BY kind, source, topic""")
def social_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend signals of public interest and site metrics of posts as one input of trends, one row for each id."""
    p = public_interest(spark, sf_dir)
    signals = p.select(
        F.lit("signal").alias("kind"), F.when(F.col("source_type") == "trending_search", "manual").otherwise(F.col("source_type")).alias("source"), "topic", F.col("interest").cast("double").alias("interest"), F.lit(0.0).alias("velocity"),
        F.when(F.col("interest") >= 70, 2).otherwise(1).alias("sustained_days"), F.lit(0.66).alias("confidence"),
    )
    metrics = posts(spark, sf_dir).select(F.lit("metric").alias("kind"), F.lit("social_memory").alias("source"), F.concat_ws(" ", "category", "shape").alias("topic"), F.lit(0.0).alias("interest"), (F.col("score") / 12.0).alias("velocity"), F.lit(1).alias("sustained_days"), F.lit(1.0).alias("confidence"))
    out = signals.unionByName(metrics).groupBy("kind", "source", "topic").agg(F.max("interest").alias("interest"), F.round(F.max("velocity"), 6).alias("velocity"), F.max("sustained_days").alias("sustained_days"), F.max("confidence").alias("confidence"))
    return out.select(T.stable_hash(F.concat_ws(":", "kind", "source", "topic"), 12).alias("id"), "kind", "source", "topic", "interest", "velocity", "sustained_days", "confidence")
