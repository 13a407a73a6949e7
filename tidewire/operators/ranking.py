"""Orders, diversification by source, listings, search and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import text as T
from tidewire.operators import lookup
from tidewire.operators.shuffles import saved


def spotlight_order(tie: str = "id") -> list[Column]:
    return [F.desc("source_count"), F.desc("score"), F.desc("published_at"), F.asc(tie)]


def recency_order(tie: str = "id") -> list[Column]:
    return [F.desc("published_at"), F.desc("source_count"), F.desc("score"), F.asc(tie)]


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their rank; a top-k first, so the window only ranks k rows."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def diversify(stories: DataFrame, cap: int, limit: int, order: list[Column], source: str = "source_name") -> DataFrame:
    """Round-robin over sources, sources in order of their best story, at most `cap` from each (0: no cap). If exactly
    one source has more, its rest follows; if several do, they stop at the cap.

    Closed form: a story's round is its rank within its source. Only the first `limit` of a source can be taken, so the
    window per source keeps that many (ranking filters limit groups before the shuffle)."""
    per = Window.partitionBy(source).orderBy(*order)
    ranked = stories.withColumn("round", F.row_number().over(per)).where(F.col("round") <= limit)
    # the first `limit` sources fill the first round, so no other has a turn
    best = ranked.where("round = 1").orderBy(*order).limit(limit)
    heads = best.withColumn("source_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).select(source, "source_rank")
    placed = ranked.join(heads, source)
    if cap > 0:
        deep = ranked.where(F.col("round") > cap).agg(F.count_distinct(source).alias("deep_sources"))
        placed = placed.crossJoin(F.broadcast(deep)).where((F.col("round") <= cap) | (F.col("deep_sources") == 1))  # deep is one row
        placed = placed.withColumn("late", (F.col("round") > cap).cast("int"))
    else:
        placed = placed.withColumn("late", F.lit(0))
    by = [F.asc("late"), F.asc("round"), F.asc("source_rank")]
    picked = placed.orderBy(*by).limit(limit)
    return picked.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*by))).select(*stories.columns, "round", "position")


#: Up to so many queries are scored in one pass over the stories; more are looked up in an index.
FEW_QUERIES = 50


def _tokens(query: Column) -> Column:
    stop = F.array(*map(F.lit, T.STOPWORDS))
    return F.filter(T.words(query), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))


def search(stories: DataFrame, queries: DataFrame, limit: int = 30, few: int = FEW_QUERIES) -> DataFrame:
    """queries (query_id, query) against stories: +8 for a token in the title, +4 in the source, +4 in the category, +2
    anywhere; the best `limit` of each query, and how many there are. `few` queries are sent to every task; of more, the
    tokens are looked up in the stories' vocabulary, with the same result."""
    asked = queries.select("query_id", _tokens(F.col("query")).alias("tokens"))
    low = stories.select(
        "id", "score", "published_at", F.lower("title").alias("t"), F.lower("source_name").alias("s"), F.lower("category").alias("c"),
        F.lower(F.concat_ws(" ", "title", "summary", "source_name", "category")).alias("h"),
    )

    def points(token: Column) -> Column:
        one = lambda where, n: F.when(F.contains(F.col(where), token), n).otherwise(0)
        return one("t", 8) + one("s", 4) + one("c", 4) + one("h", 2)

    if asked.count() <= few:
        hits = low.crossJoin(F.broadcast(asked)).withColumn("relevance", F.aggregate("tokens", F.lit(0), lambda n, w: n + points(w))).where("relevance > 0")
    else:
        low = saved(low, "search-stories")
        found = lookup.token_hits(low.select("id", F.col("h").alias("text")), asked).join(low.select("id", "t", "s", "c", "h"), "id")
        scored = found.groupBy("query_id", "id").agg(F.sum(F.col("n") * points(F.col("token"))).cast("int").alias("relevance"))
        hits = scored.join(low.select("id", "score", "published_at"), "id")
    count = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    order = [F.desc("relevance"), F.desc("score"), F.desc("published_at"), F.asc("id")]
    return top_per_group(hits, ["query_id"], order, limit).join(count, "query_id").select("query_id", "rank", "id", "relevance", "n_hits")


def preview(stories: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """queries (query_id, query in lower case) against titles: +40 for a title that starts with the query, +20 for one that
    contains it, +6 for each of its words that the title contains; the best `limit` of each query."""
    titles = saved(stories.select("id", "score", "published_at", F.lower("title").alias("title")), "preview-titles")
    asked = saved(queries.select("query_id", "query", F.split("query", " ").alias("parts")), "preview-queries")
    # whoever starts with a query or contains it contains its words as well
    parts = asked.select(F.explode("parts").alias("q")).where("q <> ''").distinct()
    met = lookup.containing(titles.select("id", F.col("title").alias("text")), parts.select(F.col("q").alias("query_id"), "q")).withColumnRenamed("query_id", "q")
    pairs = met.join(asked.select("query_id", F.explode(F.array_distinct("parts")).alias("q")), "q").select("query_id", "id").distinct()
    points = F.when(F.startswith("title", F.col("query")), 40).otherwise(0) + F.when(F.contains("title", F.col("query")), 20).otherwise(0) + F.aggregate("parts", F.lit(0), lambda n, t: n + F.when(F.contains(F.col("title"), t), 6).otherwise(0))
    hits = pairs.join(asked, "query_id").join(titles, "id").withColumn("points", points)
    return top_per_group(hits, ["query_id"], [F.desc("points"), F.desc("score"), F.desc("published_at"), F.asc("id")], limit).select("query_id", "id", "points", "rank")


def age_bucket(hours: Column) -> Column:
    return (
        F.when(hours.isNull(), "undated").when(hours < 3, "0-3h").when(hours < 12, "3-12h").when(hours < 24, "12-24h")
        .when(hours < 48, "24-48h").when(hours < 168, "48-168h").otherwise("older")
    )


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with its total, next offset (null at the end) and has_more."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    more = F.col("total") > offset + limit
    return rows.crossJoin(F.broadcast(total)).withColumns({"has_more": more, "next_offset": F.when(more, F.lit(offset + limit))})


def mode(df: DataFrame, group: str, value: str, seen: str) -> DataFrame:
    """The most frequent value of each group; of equals the one seen first."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"), F.min(seen).alias("first_seen"))
    best = counts.groupBy(group).agg(F.min(F.struct((-F.col("n")).alias("n"), "first_seen", F.col(value).alias("v"))).alias("b"))
    return best.select(group, F.col("b.v").alias(value), (-F.col("b.n")).alias("n"))
