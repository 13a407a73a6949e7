"""Page and media queries: images, first images of items, evidence.

The given pages have no image tags, so each page and item gets some that follow from its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import media
from tidewire.plans.feed import SUMMARY_SQL
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


#: What a page gets by its id: (modulus, remainder, HTML with {i} for the id).
EXTRAS = (
    (2, 0, '<meta property="og:image" content="//cdn.example.com/{i}.jpg?x=1&amp;y=2">'), (3, 1, '<meta content="/img/{i}.png" property="og:image:url">'),
    (5, 2, '<meta name="twitter:image" content="https://t.example.com/{i}.webp">'), (7, 3, '<link rel="image_src" href="/logo-{i}.png">'),
    (4, 1, '<script type="application/ld+json">{"@type":"NewsArticle","image":{"url":"https://ld.example.com/{i}.jpg"},"description":"A report on matter {i} with some more words to read."}</script>'),
    (9, 4, '<script type="application/ld+json">{"@graph":[{"image":"/graph/{i}.jpeg"}]}</script>'), (8, 5, '<script type="application/ld+json">{broken</script>'),
    (3, 2, '<img alt="" src="pics/{i}.jpg"><img src="/icon.png"><img src="/small.jpg?w=40">'), (4, 3, '<source srcset="/s/{i}-1.webp 1x, /s/{i}-2.webp 2x">'),
    (6, 5, '<img class="l" data-src="https://lazy.example.com/{i}.png">'), (5, 0, '<meta name="description" content="What page {i} says in a sentence of some length, for readers.">'),
    (7, 1, "<meta content='https://q.example.com/{i}.jpg' name='twitter:image:src'>"), (6, 2, "<link href='/l/{i}.png' rel='preload image_src'>"), (8, 3, "<img class='l' data-hero-original='/o/{i}.webp' alt='5 > 4'>"),
    (9, 7, "<script type='application/ld+json'>[{'@type':'x','thumbnailUrl':['/th/{i}.jpg',{'contentUrl':'/c/{i}.png'}],'description':'Listed data on page {i}, which has more than six words in all.'}]</script>".replace("'", '"').replace('type="application/ld+json"', "type='application/ld+json'")),
    (10, 3, "<meta property='og:description' content='What page {i} says of itself when it is shared among friends.'>"),
)


def rich(html: Column, i: Column) -> Column:
    return F.concat(html, *[F.when(i % n == r, F.replace(F.lit(x), F.lit("{i}"), i.cast("string"))).otherwise("") for n, r, x in EXTRAS])


def rich_sql(html: str, i: str) -> str:
    return " || ".join([html, *(f"CASE WHEN {i} % {n} = {r} THEN replace('{x.replace(chr(39), chr(39) * 2)}', '{{i}}', CAST({i} AS VARCHAR)) ELSE '' END" for n, r, x in EXTRAS)])


PAGES_SQL = f"pg AS (SELECT page_id, url, {rich_sql('html', 'page_id')} AS html FROM pages)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", rich(F.col("html"), F.col("page_id")).alias("html"))


@query(f"""WITH {PAGES_SQL}, l AS (SELECT page_id, list_transform({media.image_links_sql('html')}, lambda u: {media.resolved_sql('u', 'url')}) AS a FROM pg),
f AS (SELECT page_id, list_filter(a, lambda u: u IS NOT NULL AND {media.REASON_SQL.format(u='u')} = 'ok') AS a FROM l), d AS (SELECT page_id, list_filter(a, lambda u, k: list_position(a, u) = k)[1:12] AS a FROM f)
SELECT page_id, unnest(range(1, len(a) + 1)) AS place, unnest(a) AS image FROM d""")
def page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to twelve different article images of each page, in order."""
    rows = pages(spark, sf_dir).select("page_id", F.posexplode(media.images(F.col("html"), F.col("url"))).alias("p", "image"))
    return rows.select("page_id", (F.col("p") + 1).cast("long").alias("place"), "image")


@query(f"""WITH {PAGES_SQL}, u AS (SELECT page_id, unnest(list_transform({media.image_links_sql('html')}, lambda u: {media.resolved_sql('u', 'url')})) AS u FROM pg)
SELECT {media.REASON_SQL.format(u='u')} AS reason, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM u WHERE u IS NOT NULL GROUP BY 1""")
def image_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why images that pages name are no article images, as a histogram."""
    rows = pages(spark, sf_dir).select("page_id", F.explode(F.transform(media.image_links(F.col("html")), lambda u: media.resolved(u, F.col("url")))).alias("u")).where("u is not null")
    return rows.groupBy(media.image_reason(F.col("u")).alias("reason")).agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("n_pages"))


MEDIA_SQL = f"""im AS (SELECT doc_id, 'https://' || source || '.example.com/' AS base, {rich_sql("'<p>' || coalesce(text, '') || '</p>'", 'doc_id')} AS html,
  list_concat(CASE WHEN doc_id % 4 = 0 THEN ['https://e.example.com/' || doc_id || CASE WHEN doc_id % 8 = 0 THEN '.mp3' ELSE '.jpg' END] ELSE [] END, CASE WHEN doc_id % 5 = 1 THEN ['https://m.example.com/' || doc_id || '.png', 'https://m.example.com/logo.png'] ELSE [] END, CASE WHEN doc_id % 6 = 2 THEN ['https://th.example.com/' || doc_id || '.webp'] ELSE [] END) AS fields FROM documents),
ii AS (SELECT doc_id, list_filter(fields, lambda u: {media.REASON_SQL.format(u='u')} = 'ok') AS a, list_filter(list_transform({media.image_links_sql('html')}, lambda u: {media.resolved_sql('u', 'base')}), lambda u: u IS NOT NULL AND {media.REASON_SQL.format(u='u')} = 'ok') AS b FROM im),
ig AS (SELECT doc_id, coalesce(a[1], b[1], '') AS image FROM ii)"""


def item_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, image) of documents as feed items with an enclosure, media contents and a thumbnail."""
    i = F.col("doc_id")
    link = lambda host, end: F.concat(F.lit(f"https://{host}.example.com/"), i.cast("string"), end)
    none = F.array().cast("array<string>")
    enclosure = F.when(i % 4 == 0, F.array(link("e", F.when(i % 8 == 0, ".mp3").otherwise(".jpg")))).otherwise(none)
    contents = F.when(i % 5 == 1, F.array(link("m", F.lit(".png")), F.lit("https://m.example.com/logo.png"))).otherwise(none)
    thumbnail = F.when(i % 6 == 2, F.array(link("th", F.lit(".webp")))).otherwise(none)
    html = rich(F.concat(F.lit("<p>"), F.coalesce("text", F.lit("")), F.lit("</p>")), i)
    base = F.concat(F.lit("https://"), "source", F.lit(".example.com/"))
    return table(spark, sf_dir, "documents").select("doc_id", media.first_image([enclosure, contents, thumbnail], html, base).alias("image"))


@query(f"WITH {MEDIA_SQL} SELECT doc_id, image FROM ig")
def item_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first article image of each item: its media fields, then its HTML."""
    return item_image(spark, sf_dir)


#: The public names of a page's description.
DESCRIPTIONS = ("description", "og:description")
DESCRIPTION_SQL = f"""(list_transform(list_filter(regexp_extract_all(html, '(?i)<meta[\\s/](?:[^<>"'']|"[^"]*"|''[^'']*'')*>'), lambda t: lower({media.attribute_sql('t', 'property', 'name')}) IN {DESCRIPTIONS}), lambda t: {media.attribute_sql('t', 'content')}))[1]"""
SPACES = "[ \t\r\n]+"
BLOCKS = "<(?:p|h1|h2)>([^<]*)"


def plain_sql(x: str) -> str:
    return f"trim(regexp_replace(replace(replace({x}, '&amp;', '&'), '&quot;', '\"'), '[ \\t\\r\\n]+', ' ', 'g'))"


@query(f"""WITH {PAGES_SQL}, e AS (SELECT page_id, {plain_sql("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, {plain_sql("regexp_extract(html, '<h1>([^<]*)', 1)")} AS heading, {plain_sql(f"coalesce({DESCRIPTION_SQL}, '')")} AS description,
  list_filter(list_transform({media.linked_data_sql('html')}, lambda j: coalesce(j->>'$.description', '')), lambda x: x <> '') AS ld, regexp_extract_all(html, '{BLOCKS}', 1) AS blocks FROM pg),
f AS (SELECT page_id, CASE WHEN title <> '' THEN title WHEN heading <> '' THEN heading ELSE '' END AS title, description, list_filter(list_transform(list_concat([description], ld, blocks), lambda x: {plain_sql('x')}), lambda x: length(x) >= 40 AND len(string_split(x, ' ')) >= 6) AS a FROM e),
d AS (SELECT page_id, title, description, list_filter(a, lambda x, k: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = k)[1:8] AS a FROM f)
SELECT page_id, title, CASE WHEN description <> '' THEN description WHEN len(a) > 0 THEN a[1] ELSE title END AS description, len(a) AS n_facts, md5(array_to_string(a, '|')) AS facts_md5 FROM d""")
def html_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and description with fallbacks; up to eight useful facts from meta, JSON-LD, paragraphs and headings."""
    plain = lambda c: F.trim(F.regexp_replace(F.replace(F.replace(c, F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"')), SPACES, " "))
    get = lambda p: plain(F.regexp_extract("html", p, 1))
    every = lambda p: F.regexp_extract_all("html", F.lit(p), F.lit(1))
    ld = F.filter(F.transform(media.linked_data(F.col("html")), lambda j: F.try_variant_get(j, "$.description", "string")), lambda x: F.coalesce(x, F.lit("")) != "")
    said = plain(F.coalesce(F.get(media.meta_values(media.tags(F.col("html")), DESCRIPTIONS, ("property", "name")), F.lit(0)), F.lit("")))
    rows = pages(spark, sf_dir).select("page_id", get("<title>([^<]*)</title>").alias("t"), get("<h1>([^<]*)").alias("h"), said.alias("d"), F.concat(ld, every(BLOCKS)).alias("blocks"))
    useful = F.filter(F.transform(F.concat(F.array("d"), "blocks"), plain), lambda x: (F.length(x) >= 40) & (F.size(F.split(x, " ")) >= 6))
    facts = F.slice(T.distinct_names(useful), 1, 8)
    title = F.when(F.col("t") != "", F.col("t")).otherwise(F.col("h"))
    rows = rows.select("page_id", title.alias("title"), "d", facts.alias("a"))
    description = F.when(F.col("d") != "", F.col("d")).when(F.size("a") > 0, F.get("a", F.lit(0))).otherwise(F.col("title"))
    return rows.select("page_id", "title", description.alias("description"), F.size("a").cast("long").alias("n_facts"), F.md5(F.array_join("a", "|")).alias("facts_md5"))


@query(f"""WITH {ITEMS_SQL}, {MEDIA_SQL} SELECT id, title, {SUMMARY_SQL} AS summary, category, source_name, regexp_replace(regexp_extract(lower(link), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') AS source_domain, published_at, link, image,
  CASE WHEN id % 3 = 0 THEN '/stories/' || id ELSE '' END AS story_url, id % 3 = 0 AS has_story, CASE WHEN id % 3 = 0 AND {SUMMARY_SQL} <> '' THEN 'full' WHEN {SUMMARY_SQL} <> '' THEN 'link_only' ELSE 'title_only' END AS writing_status
FROM items JOIN ig ON ig.doc_id = id""")
def news_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search and category cards of items: every field that a list shows, with the first image and the state of its text."""
    summary, own = T.summary(F.col("text")), F.col("id") % 3 == 0
    status = F.when(own & (summary != ""), "full").when(summary != "", "link_only").otherwise("title_only")
    rows = items(spark, sf_dir).join(item_image(spark, sf_dir).withColumnRenamed("doc_id", "id"), "id")
    return rows.select(
        "id", "title", summary.alias("summary"), "category", "source_name", T.domain(F.col("link")).alias("source_domain"), "published_at", "link", "image",
        F.when(own, F.concat(F.lit("/stories/"), F.col("id").cast("string"))).otherwise("").alias("story_url"), own.alias("has_story"), status.alias("writing_status"),
    )
