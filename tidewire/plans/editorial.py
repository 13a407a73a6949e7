"""Editing-room queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import dedupe, editorial, ranking
from tidewire.plans.feed import SPOT, STORIES_SQL, stories
from tidewire.sources.landed import ITEMS_SQL, SIGNALS_SQL, items, signals, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


W = "list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"


@query(f"""WITH d AS (SELECT doc_id AS id, lang, ' ' || array_to_string({W.format(x='text')}, ' ') || ' ' AS said FROM documents), b AS (SELECT item_id AS place_id, array_to_string({W.format(x='text')}[1:3], ' ') AS phrase FROM benchmark),
h AS (SELECT id, place_id, lang FROM d JOIN b ON contains(said, ' ' || phrase || ' '))
SELECT id, place_id, least(100.0, 72 + CASE WHEN lang = 'en' THEN 8 ELSE 0 END) AS score FROM h""")
def city_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's first three words stand for names of places: 72 for a name in the text, 8 more for the language."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    phrases = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("place_id"), F.array_join(F.slice(T.words(F.col("text")), 1, 3), " ").alias("phrase"))
    met = editorial.phrase_hits(docs, phrases).join(docs.select("id", "lang"), "id")
    named = met.select("id", "place_id", F.lit(0).alias("ord"), F.lit("max").alias("kind"), F.lit(72).alias("points"))
    boost = met.where("lang = 'en'").select("id", "place_id", F.lit(1).alias("ord"), F.lit("boost").alias("kind"), F.lit(8).alias("points"))
    return editorial.evidence_score(named.unionByName(boost), ["id", "place_id"])


@query(f"""WITH {STORIES_SQL}, q AS (SELECT * FROM (VALUES (1, 'the'), (2, 'un'), (3, 'die en')) v(query_id, query)),
x AS (SELECT query_id, id, score, published_at, CASE WHEN starts_with(lower(title), query) THEN 40 ELSE 0 END + CASE WHEN contains(lower(title), query) THEN 20 ELSE 0 END + CAST(coalesce(list_sum(list_transform(string_split(query, ' '), lambda t: CASE WHEN contains(lower(title), t) THEN 6 ELSE 0 END)), 0) AS INT) AS points FROM stories, q)
SELECT query_id, id, points, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, score DESC, published_at DESC, id) AS rank FROM x WHERE points > 0 QUALIFY rank <= 5""")
def search_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "the"), (2, "un"), (3, "die en")], "query_id int, query string")
    return ranking.preview(stories(spark, sf_dir), asked, 5)


@query(f"""WITH {STORIES_SQL}, m AS (SELECT *, unnest(list_filter(['all', CASE WHEN hours_old <= 48 THEN 'fresh' END, CASE WHEN source_count > 1 THEN 'covered' END, CASE WHEN category = 'en' THEN 'english' END, CASE WHEN length(title) < 60 THEN 'short' END], lambda x: x IS NOT NULL)) AS section FROM stories)
SELECT section, id, row_number() OVER (PARTITION BY section ORDER BY {SPOT}) AS rank FROM m QUALIFY rank <= 9""")
def hub_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = F.array_compact(F.array(F.lit("all"), F.when(F.col("hours_old") <= 48, "fresh"), F.when(F.col("source_count") > 1, "covered"), F.when(F.col("category") == "en", "english"), F.when(F.length("title") < 60, "short")))
    rows = stories(spark, sf_dir).withColumn("section", F.explode(sections))
    return ranking.top_per_group(rows, ["section"], ranking.spotlight_order(), 9).select("section", "id", "rank")


@query(f"""WITH {ITEMS_SQL}, k AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS key FROM items), g AS (SELECT key, list_sort(list_distinct(list(source_name))) AS s, min(id) AS id, arg_min(source_name, id) AS own, max(base_score) AS best FROM k GROUP BY key),
o AS (SELECT *, list_filter(s, lambda x: lower(x) <> lower(own)) AS others FROM g)
SELECT id, CASE WHEN len(others) = 0 THEN '' ELSE 'Also covered by ' || array_to_string(others[1:3], ', ') || CASE WHEN len(others) > 3 THEN ' and ' || (len(others) - 3) || ' more' ELSE '' END || '.' END AS coverage,
  CASE WHEN best >= 95 THEN 'high' WHEN best >= 88 THEN 'watch' ELSE 'normal' END AS urgency, CAST(greatest(20, least(100, least(len(s), 5) * 20)) AS INT) AS diversity FROM o""")
def story_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each story with its other outlets in a line, its urgency and its source diversity."""
    rows = items(spark, sf_dir).withColumn("key", T.alnum_key(F.col("title")))
    g = rows.groupBy("key").agg(F.collect_set("source_name").alias("s"), F.min("id").alias("id"), F.min_by("source_name", "id").alias("own"), F.max("base_score").alias("best"))
    return g.select("id", editorial.coverage_line(F.col("s"), F.col("own")).alias("coverage"), editorial.urgency_of(F.col("best")).alias("urgency"), editorial.diversity(F.size("s")).alias("diversity"))


@query("""WITH a AS (SELECT n_name AS city, c_mktsegment AS kind, true AS a, false AS b, 'census' AS source, 0 AS ord, c_acctbal AS v FROM customer JOIN nation ON c_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_name, c_mktsegment ORDER BY c_custkey) = 1),
b AS (SELECT n_name, 'BUILDING', false, true, 'editors', 1, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) = 1), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT city, kind, arg_max(v, ord) AS v, bool_or(a) AS a, bool_or(b) AS b, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM u GROUP BY city, kind""")
def directory_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows at any scale
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("city"), F.col("c_mktsegment").alias("kind")).agg(F.min_by("c_acctbal", "c_custkey").alias("v"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("city")).agg(F.min_by("s_acctbal", "s_suppkey").alias("v")).withColumn("kind", F.lit("BUILDING"))
    mark = lambda df, a, b, source: df.select("city", "kind", "v", F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(source).alias("source"))
    return editorial.merged_directory([mark(c, True, False, "census"), mark(s, False, True, "editors")], ["city", "kind"], ["a", "b"], ["v"])


@query(f"""WITH {SIGNALS_SQL} SELECT CAST(date_trunc('month', seen_at) AS TIMESTAMP) AS month, count(*) AS n_signals, count(DISTINCT source_id) AS n_sources, count(*) FILTER (source_type = 'official') AS n_official, count(*) FILTER (flag = 'R') AS n_rejected, round(count(*) FILTER (flag <> 'R') / count(*), 3) AS rate FROM signals GROUP BY 1""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = signals(spark, sf_dir).groupBy(F.date_trunc("month", "seen_at").cast("timestamp").alias("month"))
    return rows.agg(F.count("*").alias("n_signals"), F.count_distinct("source_id").alias("n_sources"), F.count_if(F.col("source_type") == "official").alias("n_official"), F.count_if(F.col("flag") == "R").alias("n_rejected"), F.round(F.count_if(F.col("flag") != "R") / F.count("*"), 3).alias("rate"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'pending' WHEN doc_id % 4 = 1 THEN 'approved' ELSE 'draft' END AS status FROM documents), c AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'rejected' ELSE 'approved' END AS t FROM labels)
SELECT d.doc_id, CASE WHEN t IS NOT NULL AND status || '>' || t IN ('pending>approved', 'pending>rejected', 'draft>rejected') THEN t ELSE status END AS status FROM d LEFT JOIN c ON d.doc_id = c.doc_id""")
def review_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    store = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, "pending").when(k == 1, "approved").otherwise("draft").alias("status"))
    changes = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "rejected").otherwise("approved").alias("to"))
    return editorial.transition(store, changes, "doc_id", (("pending", "approved"), ("pending", "rejected"), ("draft", "rejected")))


@query(f"WITH {ITEMS_SQL}, f AS (SELECT id, array_to_string({W.format(x='title')}[1:6], ' ') AS signature FROM items) SELECT signature, min(id) AS kept, count(*) - 1 AS dropped FROM f GROUP BY signature")
def draft_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("id", F.array_join(F.slice(T.words(F.col("title")), 1, 6), " ").alias("signature"))
    return rows.groupBy("signature").agg(F.min("id").alias("kept"), (F.count("*") - 1).alias("dropped"))


@query("SELECT 'gone' AS change, count(*) AS n FROM (SELECT doc_id FROM documents WHERE doc_id % 5 <> 0 EXCEPT SELECT doc_id FROM documents WHERE doc_id % 7 <> 0) UNION ALL SELECT 'new', count(*) FROM (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0 EXCEPT SELECT doc_id FROM documents WHERE doc_id % 5 <> 0)")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of a feed: the rows without every fifth id, then without every seventh."""
    ids = table(spark, sf_dir, "documents").select("doc_id")
    return dedupe.changed_keys(ids.where("doc_id % 5 <> 0"), ids.where("doc_id % 7 <> 0"), "doc_id").groupBy("change").agg(F.count("*").alias("n"))


@query()
def incremental_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as signals: the language is the city, the source's last digit the topic."""
    rows = items(spark, sf_dir)
    return editorial.incremental_clusters(rows.select(
        F.col("id").alias("signal_id"), F.col("category").alias("city"), F.substring("source_name", -1, 1).alias("topic"), T.stable_hash(F.col("link"), 16).alias("url_hash"),
        T.title_tokens(F.col("title")).alias("title_tokens"), F.col("published_at").alias("at"),
    ))
