"""Entities and facts of texts, blocklists and relevance, what is asked for places, safe cards, validation, captions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewire.functions import text as T
from tidewire.operators import classify, editorial, ranking
from tidewire.operators.shuffles import shared_folder
from tidewire.plans.feed import SUMMARY_SQL
from tidewire.plans.rules import hits, rules_sql
from tidewire.plans.writing import DRAFTS_SQL, GATES, SENTENCES, drafts, gates
from tidewire.sources import store
from tidewire.sources.landed import CLUSTERS_SQL, ITEMS_SQL, PLACES_SQL, SIGNALS_SQL, clusters, items, places, signals, table
from tidewire.streaming import refresh

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PHRASE = "(?:^|[^A-Za-z0-9])([A-Z][A-Za-z0-9&'-]*(?: [A-Z][A-Za-z0-9&'-]*){0,5})"
ROAD = "(?:^|[^A-Za-z0-9])((?:I|US|SR|Route|Highway|Interstate)[ -]?[0-9]{1,4})"
POINT = "(-?[0-9]{1,2}\\.[0-9]+), (-?[0-9]{1,3}\\.[0-9]+)"
DATE = "([0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4})"
KINDS = (("schools", "School|College|University|Campus|District"), ("agencies", "Police|Fire|Transit|Council|County|City|Department|Authority"), ("organizations", "Hospital|Library|Foundation|Center|Association|District"))


TEXT_SQL = "coalesce(text, '')"
ONCE = "list_filter({a}, lambda x, i: list_position({a}, x) = i)"


@query(f"""WITH t AS (SELECT doc_id, {TEXT_SQL} AS text FROM documents), e AS (SELECT doc_id, text, regexp_extract_all(text, '{PHRASE.replace("'", "''")}', 1) AS p, regexp_extract_all(text, '{ROAD}', 1) AS r, regexp_extract_all(text, '[a-z,] ([A-Z][a-z]+)', 1) AS n FROM t)
SELECT doc_id, array_to_string({ONCE.format(a='n')}[1:12], ' ') AS names, len(list_distinct(n)) AS n_names, array_to_string({ONCE.format(a='r')}, ',') AS roads, {", ".join(f"array_to_string({ONCE.format(a=f'list_filter(p, lambda x: regexp_matches(x, {chr(39)}{w}{chr(39)}))')}, ',') AS {k}" for k, w in KINDS)},
  regexp_extract(text, '{POINT}', 1) AS lat, regexp_extract(text, '{POINT}', 2) AS lon FROM e""")
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, roads, schools, agencies, organisations and the first coordinates of each text."""
    return entity_rows(table(spark, sf_dir, "documents"))


def entity_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("p", F.regexp_extract_all("text", F.lit(PHRASE), F.lit(1)))
    kind = lambda w: F.array_join(F.array_distinct(F.filter("p", lambda x: x.rlike(w))), ",")
    names = classify.entities(F.col("text"))
    return rows.select(
        "doc_id", F.array_join(F.slice(names, 1, 12), " ").alias("names"), F.size(names).cast("long").alias("n_names"), F.array_join(F.array_distinct(F.regexp_extract_all("text", F.lit(ROAD), F.lit(1))), ",").alias("roads"),
        *[kind(w).alias(k) for k, w in KINDS], F.regexp_extract("text", POINT, 1).alias("lat"), F.regexp_extract("text", POINT, 2).alias("lon"),
    )


@query(f"""WITH t AS (SELECT doc_id, {TEXT_SQL} AS text FROM documents), s AS (SELECT doc_id, text, {SENTENCES.format(x='text')} AS s FROM t), f AS (SELECT doc_id, text, list_filter(s, lambda x: length(x) BETWEEN 40 AND 240) AS f FROM s)
SELECT doc_id, len(f) AS n_candidates, md5(array_to_string(f[1:18], '|')) AS facts_md5, array_to_string({ONCE.format(a=f"regexp_extract_all(text, '{DATE}', 1)")}, ',') AS dates, len(list_distinct(regexp_extract_all(text, '[a-z,] ([A-Z][a-z]+)', 1))) AS n_entities,
  round(CASE WHEN len(f) >= 2 THEN 0.5 WHEN len(f) = 1 THEN 0.3 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '[a-z,] ([A-Z][a-z]+)', 1)) > 0 THEN 0.3 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '{DATE}', 1)) > 0 THEN 0.2 ELSE 0 END, 2)::DOUBLE AS confidence FROM f""")
def fact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of 40 to 240 characters, the first eighteen, with dates, entities and how much there is to go by."""
    return fact_rows(table(spark, sf_dir, "documents"))


def fact_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"f": F.filter(T.sentences(F.col("text")), lambda s: F.length(s).between(40, 240)), "d": F.array_distinct(F.regexp_extract_all("text", F.lit(DATE), F.lit(1))), "e": classify.entities(F.col("text"))})
    n = F.size("f")
    confidence = F.when(n >= 2, 0.5).when(n == 1, 0.3).otherwise(0.0) + F.when(F.size("e") > 0, 0.3).otherwise(0.0) + F.when(F.size("d") > 0, 0.2).otherwise(0.0)
    return rows.select("doc_id", n.cast("long").alias("n_candidates"), F.md5(F.array_join(F.slice("f", 1, 18), "|")).alias("facts_md5"), F.array_join("d", ",").alias("dates"), F.size("e").cast("long").alias("n_entities"), F.round(confidence, 2).alias("confidence"))


DOMAINS = ("src3.example.com", "src7.example.com")
TITLED = "SELECT doc_id AS id, regexp_replace(regexp_extract(text, '^[ \\t\\r\\n]*((?:[^ \\t\\r\\n]+[ \\t\\r\\n]+){0,11}[^ \\t\\r\\n]+)', 1), '[ \\t\\r\\n]+', ' ', 'g') AS text FROM documents"
W = "list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
FORMS_SQL = " OR ".join(f"regexp_matches(title, '{p}')" for p in editorial.NO_NEWS)


@query(f"""WITH {ITEMS_SQL}, {rules_sql('blocked', texts=TITLED)}, h AS (SELECT DISTINCT id AS hit FROM hits)
SELECT id, regexp_replace(lower(regexp_extract(link, '^[a-zA-Z]+://([^/?#:]+)', 1)), '^www\\.', '') IN {DOMAINS} OR hit IS NOT NULL OR {FORMS_SQL} OR len({W.format(x='title')}) <= 2 AS blocked FROM items LEFT JOIN h ON hit = id""")
def local_blocklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are no local news: domains, terms of the rule table in the title, forms of titles, titles too short."""
    rows = items(spark, sf_dir)
    named = hits(spark, sf_dir, "blocked", texts=rows.select("id", F.col("title").alias("text"))).select("id").distinct().withColumn("hit", F.lit(True))
    return rows.join(named, "id", "left").select("id", editorial.blocked(F.col("title"), F.col("link"), DOMAINS, F.coalesce("hit", F.lit(False))).alias("blocked"))


#: Places by phrases of the benchmark: city and state are its words 2 to 3 and 5, an alias words 7 to 8.
@query(f"""WITH {ITEMS_SQL}, pl AS (SELECT item_id, k[2:3].array_to_string(' ') AS city, k[5] AS state, k[7:8].array_to_string(' ') AS alias FROM (SELECT item_id, {W.format(x='text')} AS k FROM benchmark) WHERE len(k) >= 8),
x AS (SELECT id, ' ' || array_to_string({W.format(x="concat_ws(' ', title, " + SUMMARY_SQL + ", source_name)")}, ' ') || ' ' AS said, ' ' || array_to_string({W.format(x='title')}, ' ') || ' ' AS titled, source_name FROM items)
SELECT id, count(*) AS n_cities, min(item_id) AS first_city FROM x JOIN pl ON contains(said, ' ' || city || ' ') OR (contains(said, ' ' || string_split(city, ' ')[1] || ' ') AND contains(said, ' ' || string_split(city, ' ')[2] || ' ')) OR (contains(titled, ' ' || state || ' ') AND contains(source_name, string_split(city, ' ')[1])) OR contains(said, ' ' || alias || ' ') GROUP BY id""")
def local_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items about a city: by its name, all its words, state and source, or an alias."""
    k = T.words(F.col("text"))
    b = table(spark, sf_dir, "benchmark").select("item_id", k.alias("k")).where(F.size("k") >= 8)
    cities = b.select(F.col("item_id").alias("city_id"), F.array_join(F.slice("k", 2, 2), " ").alias("city"), F.get("k", F.lit(4)).alias("state"), F.array(F.array_join(F.slice("k", 7, 2), " ")).alias("aliases"))
    canon = lambda c: F.concat(F.lit(" "), F.array_join(T.words(c), " "), F.lit(" "))
    rows = items(spark, sf_dir).select("id", canon(F.concat_ws(" ", "title", T.summary(F.col("text")), "source_name")).alias("said"), canon(F.col("title")).alias("titled"), "source_name")
    return editorial.about(rows, cities).groupBy("id").agg(F.count("*").alias("n_cities"), F.min("city_id").alias("first_city"))


@query(f"""WITH {PLACES_SQL}, b AS (SELECT place_id, [name || ' ' || code, name || ' ' || code || ' local news', name || ' ' || state || ' local news', '"' || name || '" ' || code, '"' || name || '" ' || state] AS v FROM (SELECT *, upper(substr(state, 1, 2)) AS code FROM places)),
a AS (SELECT place_id, unnest(list_concat(v, list_transform(v[1:4], lambda x: x || ' when:2d'), list_transform(v[1:4], lambda x: x || ' when:7d'))) AS query FROM b) SELECT DISTINCT place_id, query FROM a""")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked for each place, up to thirteen phrases; distinct within the row, so nothing is shuffled."""
    code = F.upper(F.substring("state", 1, 2))
    quoted = F.concat(F.lit('"'), "name", F.lit('"'))
    base = F.array(F.concat_ws(" ", "name", code), F.concat_ws(" ", "name", code, F.lit("local news")), F.concat_ws(" ", "name", "state", F.lit("local news")), F.concat_ws(" ", quoted, code), F.concat_ws(" ", quoted, "state"))
    rows = places(spark, sf_dir).select("place_id", base.alias("v"))
    late = lambda span: F.transform(F.slice("v", 1, 4), lambda x: F.concat(x, F.lit(f" when:{span}")))
    return rows.select("place_id", F.explode(F.array_distinct(F.concat("v", late("2d"), late("7d")))).alias("query"))


RISKS = ("sensitive", "filler", "robotic")


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT id, title, {SUMMARY_SQL} AS summary, source_name FROM items), {rules_sql(*RISKS, texts="SELECT id * 2 AS id, title AS text FROM c UNION ALL SELECT id * 2 + 1, summary FROM c")},
b AS (SELECT id // 2 AS id, bool_or(id % 2 = 0) AS t, bool_or(id % 2 = 1) AS s, array_to_string(list_sort(list(DISTINCT rule)), ',') AS reasons FROM hits WHERE kind <> 'sensitive' OR n > negated GROUP BY 1)
SELECT c.id, CASE WHEN title <> '' AND NOT coalesce(t, false) THEN title WHEN summary <> '' AND NOT coalesce(s, false) THEN summary ELSE 'A story from ' || source_name END AS card, CASE WHEN coalesce(t, false) AND coalesce(s, false) THEN 'limited' WHEN coalesce(t, false) THEN 'replaced' ELSE 'full' END AS status, coalesce(reasons, '') AS reasons FROM c LEFT JOIN b ON b.id = c.id""")
def display_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of title, summary and a fixed line without a risky or weak phrase of the rule table, and why others are not."""
    rows = items(spark, sf_dir).select("id", "title", T.summary(F.col("text")).alias("summary"), "source_name")
    texts = rows.select((F.col("id") * 2).alias("id"), F.col("title").alias("text")).unionByName(rows.select((F.col("id") * 2 + 1).alias("id"), F.col("summary").alias("text")))
    found = hits(spark, sf_dir, *RISKS, texts=texts).where("kind <> 'sensitive' or n > negated")
    per = found.groupBy(F.floor(F.col("id") / 2).alias("id")).agg(F.bool_or(F.col("id") % 2 == 0).alias("t"), F.bool_or(F.col("id") % 2 == 1).alias("s"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("reasons"))
    rows = rows.join(per, "id", "left").na.fill(False, ["t", "s"])
    card = F.when((F.col("title") != "") & ~F.col("t"), F.col("title")).when((F.col("summary") != "") & ~F.col("s"), F.col("summary")).otherwise(F.concat(F.lit("A story from "), "source_name"))
    return rows.select("id", card.alias("card"), F.when(F.col("t") & F.col("s"), "limited").when(F.col("t"), "replaced").otherwise("full").alias("status"), F.coalesce("reasons", F.lit("")).alias("reasons"))


#: Validators: entity -> (failures, warnings), each name -> what must hold.
VALID = {
    "cluster": ({"id": "cluster_id > 0", "topic": "topic <> ''", "started_at": "started_at IS NOT NULL", "known_status": "public_status IN ('live', 'expired')", "expires_later": "expires_at > started_at"}, {"indexed": "index_status = 'index'", "weight": "weight >= 20000"}),
    "signal": ({"id": "signal_id > 0", "source": "source_name <> ''", "known_type": "source_type IN ('official', 'publisher', 'community')", "score": "score BETWEEN 0 AND 90000"}, {"not_returned": "flag <> 'R'"}),
    "place": ({"id": "place_id > 0", "name": "name <> ''", "lat": "lat BETWEEN -90 AND 90", "lon": "lon BETWEEN -180 AND 180"}, {"habitable": "abs(lat) <= 75"}),
}
VALID_SQL = " UNION ALL ".join(
    f"SELECT '{e}' AS entity, " + ", ".join(f"array_to_string(list_filter([{', '.join(f'CASE WHEN NOT coalesce({x}, false) THEN {chr(39)}{n}{chr(39)} END' for n, x in rules_.items())}], lambda r: r IS NOT NULL), ',') AS {name}" for name, rules_ in zip(("failures", "warnings"), both, strict=True)) + f" FROM {e}s"
    for e, both in VALID.items()
)


@query(f"WITH {CLUSTERS_SQL}, {SIGNALS_SQL}, {PLACES_SQL}, v AS ({VALID_SQL}) SELECT entity, failures, warnings, count(*) AS n FROM v GROUP BY ALL")
def entity_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many clusters, signals and places break which rules, and which warnings they have."""
    frames = {"cluster": clusters(spark, sf_dir), "signal": signals(spark, sf_dir), "place": places(spark, sf_dir)}
    out = None
    for name, (bad, odd) in VALID.items():
        said = lambda found: F.array_join(classify.failures({n: F.expr(x) for n, x in found.items()}), ",")
        part = frames[name].select(F.lit(name).alias("entity"), said(bad).alias("failures"), said(odd).alias("warnings"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("entity", "failures", "warnings").agg(F.count("*").alias("n"))


FIRST5 = "array_to_string({w}[1:5], ' ')"
BAD = [name for name, _ in GATES if name in ("empty_summary", "vague_filler", "robotic_opener", "database_language")]
BAD_SQL = ", ".join(f"CASE WHEN {x} THEN '{n}' END" for n, x in GATES if n in BAD)


@query(f"""WITH {DRAFTS_SQL}, c AS (SELECT *, list_filter([{FIRST5.format(w='k')}, {FIRST5.format(w='dk')}, {FIRST5.format(w='tk')}], lambda x: x <> '') AS openings FROM dr)
SELECT id AS doc_id, array_to_string(list_filter([{BAD_SQL}, CASE WHEN len(openings) > len(list_distinct(openings)) THEN 'same_opening' END, CASE WHEN source_name = '' THEN 'no_source' END], lambda x: x IS NOT NULL), ',') AS failures,
  array_to_string(list_filter([CASE WHEN NOT exact THEN 'no_exact_page' END, CASE WHEN length(summary) > 220 THEN 'long_caption' END, CASE WHEN sensitive > 0 THEN 'needs_review' END], lambda x: x IS NOT NULL), ',') AS warnings FROM c""")
def social_draft_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures and warnings of a draft's captions: phrases, missing parts, variants that open alike, pages and length."""
    first = lambda w: F.array_join(F.slice(w, 1, 5), " ")
    rows = drafts(spark, sf_dir).withColumn("openings", F.filter(F.array(first("k"), first("dk"), first("tk")), lambda x: x != ""))
    held = gates()
    failures = classify.failures({n: held[n] for n in BAD} | {"same_opening": F.size("openings") == F.size(F.array_distinct("openings")), "no_source": F.col("source_name") != ""})
    warnings = classify.failures({"no_exact_page": F.col("exact"), "long_caption": F.length("summary") <= 220, "needs_review": F.col("sensitive") == 0})
    return rows.select(F.col("id").alias("doc_id"), F.array_join(failures, ",").alias("failures"), F.array_join(warnings, ",").alias("warnings"))


@query("SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 6")
def latest_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each reader's six latest records."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return ranking.top_per_group(rows, ["user_id"], [F.desc("ts"), F.desc("event_id")], 6).select("user_id", "event_id", "event_type", "rank")


@query("SELECT source, count(*) AS n, max(doc_id) AS newest FROM documents WHERE source <> 'src3' GROUP BY source")
def stream_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents land as JSON lines, some of one source cut short; that source is kept out and the others are refreshed."""
    base = f"{shared_folder(spark)}/refresh-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    line = F.to_json(F.struct("doc_id", "lang"))
    cut = F.when((F.col("source") == "src3") & (F.col("doc_id") % 4 == 3), F.substring(line, 1, 9)).otherwise(line)
    docs.select(cut.alias("value"), "source").write.partitionBy("source").text(f"{base}/landed")
    lines = spark.readStream.schema("value string, source string").option("maxFilesPerTrigger", 64).text(f"{base}/landed")
    schema = StructType().add("doc_id", "long").add("lang", "string")
    refresh.run(lines, schema, base)
    return refresh.refreshed(spark, base, schema).groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("newest"))


@query("SELECT 1 AS version, lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY lang UNION ALL SELECT 2, lang, count(*) FROM documents GROUP BY lang")
def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a table of two versions: a reader of the first keeps it after the second is there, and data without a version is
    not read."""
    base = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    store.replace(docs.where("doc_id % 2 = 0"), base)
    pinned = store.read(spark, base)
    store.replace(docs, base)
    store.stage(docs.where("false"), base)
    counted = lambda df, v: df.groupBy("lang").agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "lang", "n")
    return counted(pinned, 1).unionByName(counted(store.read(spark, base), 2))
