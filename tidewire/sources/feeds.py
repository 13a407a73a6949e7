"""Landed feed files as signals: registries, JSON tables, RSS and Atom, sitemaps, JSON API pages, trend and metric exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators.classify import conform

SOURCE_SCHEMA = "id string, name string, attribution string, feedUrl string, homepage string, category string, weight double, access string"
#: Signals: name -> (type, default, allowed values).
SIGNAL = {
    "title": ("string", "", None), "link": ("string", None, None), "excerpt": ("string", "", None), "published": ("string", None, None),
    "author": ("string", "", None), "kind": ("string", "html", ("rss", "atom", "sitemap", "api", "html")),
}


def registry(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document {sources: [...]} -> a row for each source, weight 1 where it has none."""
    doc = spark.read.schema(f"sources array<struct<{', '.join(c.replace(' ', ':', 1) for c in SOURCE_SCHEMA.split(', '))}>>").option("multiLine", True).json(path)
    return doc.select(F.inline("sources")).withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def json_table(spark: SparkSession, path: str, rows: str, columns: dict, aliases: dict | None = None) -> DataFrame:
    """One JSON document {rows: [...]}, conformed: aliases, defaults, allowed values. Unknown fields are ignored."""
    names = sorted({*columns, *(a for xs in (aliases or {}).values() for a in xs)})
    doc = spark.read.schema(f"{rows} array<struct<{', '.join(f'{n}:string' for n in names)}>>").option("multiLine", True).json(path)
    return conform(doc.select(F.inline(rows)), columns, aliases)


def signal(rows: DataFrame, kind: str) -> DataFrame:
    """Conformed signals with canonical url, hashes and time; rows without a link are dropped."""
    out = conform(rows.withColumn("kind", F.lit(kind)), SIGNAL).where("link is not null")
    url = T.canonical_url(F.col("link"))
    plain = F.regexp_replace(F.lower(F.concat_ws(" ", "title", "excerpt")), "[^a-z0-9]+", " ")
    return out.select(
        F.trim("title").alias("title"), url.alias("canonical_url"), T.clean(F.col("excerpt")).alias("excerpt"), parsed_time(F.col("published")).alias("published_at"), "author", "kind",
        T.stable_hash(url, 16).alias("url_hash"), T.stable_hash(plain, 16).alias("content_hash"),
    )


def parsed_time(text: Column) -> Column:
    """ISO 8601 or the date of mail headers; null if neither."""
    mail = F.regexp_extract(text, "([0-9]{1,2} [A-Za-z]{3} [0-9]{4} [0-9:]{8})", 1)
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss")))


def rss(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, guid string, description string, pubDate string, author string").load(path)
    return signal(rows.select("title", F.coalesce("link", "guid").alias("link"), F.col("description").alias("excerpt"), F.col("pubDate").alias("published"), "author"), "rss")


def atom(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "entry").schema("title string, link struct<_href:string>, summary string, updated string, published string, author struct<name:string>").load(path)
    return signal(rows.select("title", F.col("link._href").alias("link"), F.col("summary").alias("excerpt"), F.coalesce("published", "updated").alias("published"), F.col("author.name").alias("author")), "atom")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """The title of a sitemap's entry is its address."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    return signal(rows.select(F.trim("loc").alias("title"), F.trim("loc").alias("link"), F.col("lastmod").alias("published")), "sitemap")


def api(pages: DataFrame, body: str = "body") -> DataFrame:
    """Rows of JSON text -> signals; the list stands under items, results, articles or data, fields go by several names."""
    doc = F.try_parse_json(F.col(body))
    lists = [F.try_variant_get(doc, f"$.{k}", "array<variant>") for k in ("items", "results", "articles", "data")]
    entries = pages.select(F.explode(F.coalesce(*lists)).alias("v"))
    field = lambda *names: F.coalesce(*[F.try_variant_get("v", f"$.{n}", "string") for n in names])
    return signal(entries.select(
        field("title", "headline", "name").alias("title"), field("url", "link", "web_url").alias("link"), field("summary", "description", "excerpt").alias("excerpt"),
        field("published_at", "publishedAt", "date").alias("published"), field("author", "byline").alias("author"),
    ), "api")


def next_cursor(body: Column) -> Column:
    doc = F.try_parse_json(body)
    return F.coalesce(*[F.try_variant_get(doc, f"$.{k}", "string") for k in ("next_cursor", "nextCursor", "nextPageToken", "next_page_token", "next", "cursor")])


#: Providers of trend exports: name -> (confidence, only relative). Relative ones have no volume.
PROVIDERS = {
    "search_console": (0.9, False), "internal": (0.85, False), "relative_search": (0.6, True), "keyword_tool": (0.55, False), "manual": (0.45, True),
    "backlink_tool": (0.55, False), "rising_topics": (0.6, True), "topic_growth": (0.58, True), "pin_board": (0.5, True), "question_tool": (0.5, False),
}


def trends(exports: dict[str, DataFrame]) -> DataFrame:
    """Exports by provider (topic, interest, volume) -> one schema: interest within 0 to 100, the provider's confidence, no
    volume from relative providers, an id of provider and topic."""
    parts = []
    for name, df in exports.items():
        confidence, relative = PROVIDERS[name]
        volume = F.lit(None).cast("long") if relative else F.col("volume").cast("long")
        parts.append(df.select(
            F.lit(name).alias("provider"), T.clean(F.col("topic")).alias("topic"), T.clamp(F.col("interest").cast("double"), 0.0, 100.0).alias("interest"), volume.alias("volume"),
            F.lit(confidence).alias("confidence"), T.stable_hash(F.concat_ws(":", F.lit(name), F.lower(T.clean(F.col("topic")))), 12).alias("id"),
        ))
    return reduce(DataFrame.unionByName, parts)


def metrics(rows: DataFrame) -> DataFrame:
    """Metric exports: impressions count as views, clicks as link clicks; missing and negative numbers as 0."""
    number = lambda *names: F.greatest(F.lit(0.0), F.coalesce(*[F.col(n).cast("double") for n in names if n in rows.columns], F.lit(0.0)))
    return rows.select("url", number("views", "impressions").alias("views"), number("link_clicks", "clicks").alias("link_clicks"))


def or_fallback(live: DataFrame, fallback: DataFrame) -> DataFrame:
    """live, or fallback if live has no row. The test is a one-row join, not an action."""
    none = live.limit(1).agg((F.count("*") == 0).alias("__none"))
    return live.unionByName(fallback.crossJoin(F.broadcast(none)).where("__none").drop("__none"))


def replace_table(df: DataFrame, base: str, version: str) -> str:
    """Writes a version beside the old ones; readers switch when it is whole."""
    path = f"{base}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def private_metadata(signals: DataFrame) -> DataFrame:
    """What may be kept for good: hashes and times, no text."""
    return signals.select(F.sha1(F.lower("title")).alias("title_hash"), "url_hash", "published_at", "kind")
