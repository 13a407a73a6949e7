"""Rule queries: topics, urgency, sensitivity, beats, audiences and social patterns, by rule tables.

The rules are the given ones and, so that texts of any language meet some, terms drawn from the benchmark's texts: its fifth
and sixth words as a phrase and, of every other one, its first telling word; the item's number says which rule they join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import text as T
from tidewire.operators import ranking, rules
from tidewire.plans.feed import tokens_sql
from tidewire.sources.landed import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Kinds whose rules take terms from the benchmark.
DRAWN = ("topic", "urgency", "sensitive", "beat", "core", "audience", "gossip", "filler", "robotic", "overstated", "respect", "blocked")


def drawn(spark: SparkSession, sf_dir: str, kinds: tuple[str, ...]) -> DataFrame:
    """Terms of the benchmark's items, dealt to the rules of each kind."""
    b = table(spark, sf_dir, "benchmark").select("item_id", T.words(F.col("text")).alias("w"), T.title_tokens(F.col("text"), 1).alias("k"))
    phrase = F.when(F.size("w") >= 6, F.array(F.array_join(F.slice("w", 5, 2), " "))).otherwise(F.array().cast("array<string>"))
    terms = b.select("item_id", F.explode(F.concat(phrase, F.when(F.col("item_id") % 2 == 0, F.col("k")).otherwise(F.array().cast("array<string>")))).alias("term"))
    parts = []
    for kind in kinds:
        names = list(rules.GIVEN[kind])
        parts.append(terms.select(F.lit(kind).alias("kind"), F.element_at(F.array(*map(F.lit, names)), (F.col("item_id") % len(names) + 1).cast("int")).alias("rule"), "term"))
    return reduce(DataFrame.unionByName, parts)


def hits(spark: SparkSession, sf_dir: str, *kinds: str, texts: DataFrame | None = None) -> DataFrame:
    wanted = rules.given_rules(spark, kinds)
    own = tuple(k for k in kinds if k in DRAWN)
    wanted = wanted.unionByName(drawn(spark, sf_dir, own)) if own else wanted
    return rules.term_hits(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text") if texts is None else texts, wanted)


def rules_sql(*kinds: str, texts: str = "SELECT doc_id AS id, text FROM documents") -> str:
    w = "list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
    parts = [f"SELECT * FROM (VALUES {rules.given_sql(kinds)}) v(kind, rule, term)"]
    for kind in (k for k in kinds if k in DRAWN):
        names = list(rules.GIVEN[kind])
        rule = f"[{', '.join(repr(n) for n in names)}][item_id % {len(names)} + 1]"
        parts.append(f"SELECT '{kind}', {rule}, unnest(list_concat(CASE WHEN len({w}) >= 6 THEN [array_to_string({w}[5:6], ' ')] ELSE [] END, CASE WHEN item_id % 2 = 0 THEN {tokens_sql('text').replace('[1:12]', '[1:1]')} ELSE [] END)) FROM benchmark")
    return f"rr AS ({' UNION ALL '.join(parts)}), tx AS ({texts}), {rules.hits_sql('tx', 'rr')}"


def source_type(source):
    """Sources of the given tables by the last digit of their name."""
    last = F.substring(source, -1, 1)
    return F.when(last == "1", "official").when(last.isin("2", "3"), "publisher").otherwise("community")


TYPE_SQL = "CASE right(source, 1) WHEN '1' THEN 'official' WHEN '2' THEN 'publisher' WHEN '3' THEN 'publisher' ELSE 'community' END"
HINT_SQL = "CASE topic " + " ".join(f"WHEN '{t}' THEN '{h}'" for t, h in rules.TOPIC_HINT.items()) + " ELSE '' END"
FLOOR_SQL = ", ".join(f"('{t}', '{s}')" for t, s in rules.TOPIC_FLOOR)
TOPICS_SQL = f"""{rules_sql('topic')}, th AS (SELECT id, rule AS topic, least(82, 34 + 12 * count(*)) AS c, array_to_string(list_sort(list(term)), ',') AS reasons FROM hits GROUP BY id, rule),
tf AS (SELECT doc_id AS id, topic, 58 AS c, '' AS reasons FROM documents JOIN (VALUES {FLOOR_SQL}) f(topic, kind) ON kind = {TYPE_SQL}),
tc AS (SELECT id, topic, max(c) AS confidence, max(reasons) AS reasons FROM (SELECT * FROM th UNION ALL SELECT * FROM tf) GROUP BY id, topic)"""


def topic_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, topic, confidence, reasons): 34 and 12 for each term, 82 at most; from some kinds of source 58 at least."""
    scored = rules.rule_scores(hits(spark, sf_dir, "topic"), "topic").select("id", F.col("rule").alias("topic"), F.least(F.lit(82), 34 + 12 * F.col("n_terms")).alias("c"), F.array_join("terms", ",").alias("reasons"))
    floors = F.broadcast(spark.createDataFrame(list(rules.TOPIC_FLOOR), "topic string, kind string"))  # a given list of two
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), source_type(F.col("source")).alias("kind"))
    least = docs.join(floors, "kind").select("id", "topic", F.lit(58).cast("long").alias("c"), F.lit("").alias("reasons"))
    return scored.unionByName(least).groupBy("id", "topic").agg(F.max("c").alias("confidence"), F.max("reasons").alias("reasons"))


@query(f"""WITH {TOPICS_SQL}, n AS (SELECT id, count(*) AS n_topics FROM tc GROUP BY id), b AS (SELECT * FROM tc QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, topic) = 1),
j AS (SELECT doc_id, coalesce(topic, 'community') AS topic, coalesce(confidence, 30) AS confidence, coalesce(n_topics, 0) AS n_topics, coalesce(reasons, 'no rule') AS reasons FROM documents d LEFT JOIN b ON b.id = doc_id LEFT JOIN n ON n.id = doc_id)
SELECT doc_id, topic, CAST(confidence AS BIGINT) AS confidence, n_topics, reasons, topic = 'public_safety' AS sensitive, {HINT_SQL} AS urgency_hint FROM j""")
def topic_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's best topic with its reasons; community at 30 where no rule and no source speaks."""
    best = topic_candidates(spark, sf_dir).groupBy("id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "topic", "reasons")).alias("b"), F.count("*").alias("n_topics"))
    topic = F.coalesce("b.topic", F.lit("community"))
    hint = reduce(lambda c, x: c.when(topic == x[0], x[1]), rules.TOPIC_HINT.items(), F).otherwise("")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).join(best, "id", "left").select(
        F.col("id").alias("doc_id"), topic.alias("topic"), F.coalesce(-F.col("b.c"), F.lit(30)).cast("long").alias("confidence"), F.coalesce("n_topics", F.lit(0)).alias("n_topics"),
        F.coalesce("b.reasons", F.lit("no rule")).alias("reasons"), (topic == "public_safety").alias("sensitive"), hint.alias("urgency_hint"),
    )


@query(f"""WITH {rules_sql('topic', 'urgency')}, u AS (SELECT id, array_to_string(list_sort(list(term) FILTER (rule = 'high')), ',') AS high, array_to_string(list_sort(list(term) FILTER (rule = 'low')), ',') AS low,
  array_to_string(list_sort(list(term) FILTER (rule = 'breaking')), ',') AS breaking FROM hits WHERE kind = 'urgency' GROUP BY id),
t AS (SELECT DISTINCT id FROM hits WHERE kind = 'topic' AND rule IN ('public_safety', 'weather')),
j AS (SELECT doc_id, breaking, high, low, t.id IS NOT NULL AS hinted FROM documents LEFT JOIN u ON u.id = doc_id LEFT JOIN t ON t.id = doc_id)
SELECT doc_id, CASE WHEN breaking <> '' THEN 'breaking' WHEN high <> '' OR hinted THEN 'high' WHEN low <> '' THEN 'low' ELSE 'normal' END AS urgency,
  CASE WHEN breaking <> '' THEN breaking WHEN high <> '' THEN high WHEN hinted THEN 'topic' WHEN low <> '' THEN low ELSE 'none' END AS reasons FROM j""")
def urgency_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """breaking, high, low or normal, with the terms or the topic that say so."""
    found = hits(spark, sf_dir, "topic", "urgency")
    said = lambda rule: F.array_join(F.array_sort(F.collect_list(F.when((F.col("kind") == "urgency") & (F.col("rule") == rule), F.col("term")))), ",").alias(rule)
    hinted = F.bool_or((F.col("kind") == "topic") & F.col("rule").isin(*rules.TOPIC_HINT)).alias("hinted")
    per = found.groupBy("id").agg(said("breaking"), said("high"), said("low"), hinted)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).join(per, "id", "left")
    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    topic = F.coalesce("hinted", F.lit(False))
    return rows.select(
        F.col("id").alias("doc_id"), F.when(has("breaking"), "breaking").when(has("high") | topic, "high").when(has("low"), "low").otherwise("normal").alias("urgency"),
        F.when(has("breaking"), F.col("breaking")).when(has("high"), F.col("high")).when(topic, "topic").when(has("low"), F.col("low")).otherwise("none").alias("reasons"),
    )


@query(f"""WITH {rules_sql('sensitive')}, s AS (SELECT id, list_sort(list(DISTINCT rule)) AS flags FROM hits WHERE n > negated GROUP BY id), g AS (SELECT id, sum(negated) AS negated FROM hits GROUP BY id)
SELECT doc_id, coalesce(array_to_string(flags, ','), '') AS flags, coalesce(list_contains(flags, 'advisory'), false) AS active_alert, CAST(coalesce(negated, 0) AS BIGINT) AS negated FROM documents LEFT JOIN s ON s.id = doc_id LEFT JOIN g ON g.id = doc_id""")
def sensitivity_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensitive rules that a text meets without a negation before the term, and how many terms were negated."""
    per = hits(spark, sf_dir, "sensitive").groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("n") > F.col("negated"), F.col("rule")))).alias("f"), F.sum("negated").alias("negated"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")).join(per, "id", "left")
    return rows.select(F.col("id").alias("doc_id"), F.coalesce(F.array_join("f", ","), F.lit("")).alias("flags"), F.coalesce(F.array_contains("f", "advisory"), F.lit(False)).alias("active_alert"), F.coalesce("negated", F.lit(0)).alias("negated"))


@query(f"""WITH {rules_sql('beat', 'core', 'ordinary', 'sensitive')}, c AS (SELECT id, count(*) FILTER (kind = 'core') AS core, count(*) FILTER (kind = 'ordinary') AS ordinary, list_sort(list(DISTINCT rule) FILTER (kind = 'sensitive' AND n > negated)) AS flags FROM hits GROUP BY id),
bs AS (SELECT id, rule, count(*) AS n FROM hits WHERE kind = 'beat' GROUP BY id, rule), b AS (SELECT * FROM bs QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, rule) = 1),
j AS (SELECT doc_id, right(source, 1) = '4' AS cat, right(source, 1) = '5' AS src, right(source, 1) = '6' AS risky, coalesce(core, 0) AS core, coalesce(ordinary, 0) AS ordinary, coalesce(b.n, 0) AS best, b.rule AS beat, flags FROM documents LEFT JOIN c ON c.id = doc_id LEFT JOIN b ON b.id = doc_id),
s AS (SELECT *, (cat OR src OR core > 0 OR best > 0) AND NOT (risky AND core = 0) AS central, 38 + CASE WHEN cat THEN 28 ELSE 0 END + CASE WHEN src THEN 18 ELSE 0 END + least(core * 6, 24) + least(best * 8, 24) - CASE WHEN ordinary > 0 AND NOT src AND NOT cat THEN 25 ELSE 0 END AS c FROM j)
SELECT doc_id, CASE WHEN central THEN coalesce(beat, 'general') ELSE '' END AS beat, CAST(CASE WHEN central THEN least(100, greatest(0, c)) ELSE 0 END AS BIGINT) AS confidence, central AND c >= 45 AS is_entertainment, coalesce(array_to_string(flags, ','), '') AS flags FROM s""")
def entertainment_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beat with most terms; 38 and a bonus for category, source, core and beat terms, less 25 for ordinary news. A risky
    category without a core term is none. Sources stand in for categories: 4 is entertainment, 5 writes of it, 6 is crime."""
    found = hits(spark, sf_dir, "beat", "core", "ordinary", "sensitive")
    per = found.groupBy("id").agg(
        F.count_if(F.col("kind") == "core").alias("core"), F.count_if(F.col("kind") == "ordinary").alias("ordinary"),
        F.array_sort(F.collect_set(F.when((F.col("kind") == "sensitive") & (F.col("n") > F.col("negated")), F.col("rule")))).alias("f"),
    )
    best = rules.rule_scores(found, "beat").groupBy("id").agg(F.min(F.struct((-F.col("n_terms")).alias("n"), "rule")).alias("b")).select("id", (-F.col("b.n")).alias("best"), F.col("b.rule").alias("beat"))
    last = F.substring("source", -1, 1)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (last == "4").alias("cat"), (last == "5").alias("src"), (last == "6").alias("risky")).join(per, "id", "left").join(best, "id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    central = (F.col("cat") | F.col("src") | (n("core") > 0) | (n("best") > 0)) & ~(F.col("risky") & (n("core") == 0))
    bonus = F.when(F.col("cat"), 28).otherwise(0) + F.when(F.col("src"), 18).otherwise(0) + F.least(n("core") * 6, F.lit(24)) + F.least(n("best") * 8, F.lit(24))
    score = 38 + bonus - F.when((n("ordinary") > 0) & ~F.col("src") & ~F.col("cat"), 25).otherwise(0)
    return rows.select(
        F.col("id").alias("doc_id"), F.when(central, F.coalesce("beat", F.lit("general"))).otherwise("").alias("beat"),
        F.when(central, F.least(F.lit(100), F.greatest(F.lit(0), score))).otherwise(0).cast("long").alias("confidence"), (central & (score >= 45)).alias("is_entertainment"), F.coalesce(F.array_join("f", ","), F.lit("")).alias("flags"),
    )


#: Audience patterns: (name, priority, language whose readers they are).
AUDIENCES = (("parents", 60, "en"), ("commuters", 50, "fr"), ("renters", 40, "es"), ("shoppers", 30, "de"))
AUDIENCE_SQL = f"(VALUES {', '.join(map(str, AUDIENCES))}) a(pattern, priority, lang)"
PATTERN_SQL = f"""{rules_sql('audience')}, ah AS (SELECT id, rule, count(*) AS n, count(*) FILTER (contains(term, ' ')) AS phrases FROM hits GROUP BY id, rule),
ap AS (SELECT doc_id, pattern, priority, d.lang = a.lang AS own, coalesce(n, 0) AS n, coalesce(phrases, 0) AS phrases FROM documents d CROSS JOIN {AUDIENCE_SQL} LEFT JOIN ah ON ah.id = doc_id AND ah.rule = pattern)"""


def audience_hits(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(doc_id, pattern, priority, own, n, phrases) of every pattern: a given list of four, so each text has four rows."""
    scored = rules.rule_scores(hits(spark, sf_dir, "audience", *more), "audience").select(F.col("id").alias("doc_id"), F.col("rule").alias("pattern"), F.col("n_terms").alias("n"), F.col("n_phrases").alias("phrases"))
    patterns = F.explode(F.array(*[F.struct(F.lit(a).alias("pattern"), F.lit(p).alias("priority"), F.lit(c).alias("c")) for a, p, c in AUDIENCES])).alias("a")
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", patterns).select("doc_id", "a.pattern", "a.priority", (F.col("lang") == F.col("a.c")).alias("own"))
    return rows.join(scored, ["doc_id", "pattern"], "left").na.fill(0, ["n", "phrases"])


@query(f"WITH {PATTERN_SQL}, s AS (SELECT doc_id, pattern, n AS hits, round(4 * n + CASE WHEN own THEN 2 ELSE 0 END + priority / 100.0::DOUBLE, 2) AS score FROM ap) SELECT doc_id, pattern, hits, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pattern) AS rank FROM s WHERE score >= 4 AND hits > 0 QUALIFY rank <= 4")
def audience_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four points a term, two for the pattern's own category, a hundredth of its priority; four or more count."""
    score = F.round(4 * F.col("n") + F.when(F.col("own"), 2).otherwise(0) + F.col("priority") / 100.0, 2)
    rows = audience_hits(spark, sf_dir).where("n > 0").select("doc_id", "pattern", F.col("n").alias("hits"), score.alias("score")).where("score >= 4")
    return ranking.top_per_group(rows, ["doc_id"], [F.desc("score"), F.asc("pattern")], 4)


@query(f"""WITH {PATTERN_SQL}, s AS (SELECT doc_id, pattern, CASE WHEN own OR n > 0 THEN CASE WHEN own THEN priority + 24 ELSE 0 END + 14 * phrases + 10 * (n - phrases) ELSE 0 END AS score FROM ap),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pattern) AS rank FROM s WHERE score > 60 QUALIFY rank <= 3),
g AS (SELECT doc_id, list(pattern ORDER BY rank) AS p, max(score) AS score FROM t GROUP BY doc_id)
SELECT doc_id, array_to_string(p, ',') AS patterns, CAST(score AS BIGINT) AS score, CASE WHEN list_contains(p, 'renters') THEN 'Local Impact' WHEN list_contains(p, 'parents') THEN 'Watchlist' ELSE 'Breaking Clarity' END AS post_shape,
  array_to_string(list_distinct(list_concat(['#news', '#' || d.lang], list_transform(p, lambda x: '#' || x)))[1:5].list_sort(), ' ') AS tags FROM g JOIN documents d USING (doc_id)""")
def social_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audience patterns for a post: priority and 24 for the own category, 14 a phrase, 10 a word; above 60, the best three; the
    post's shape and at most five tags follow from them."""
    score = F.when(F.col("own"), F.col("priority") + 24).otherwise(0) + 14 * F.col("phrases") + 10 * (F.col("n") - F.col("phrases"))
    rows = audience_hits(spark, sf_dir).select("doc_id", "pattern", score.alias("score")).where("score > 60")
    best = ranking.top_per_group(rows, ["doc_id"], [F.desc("score"), F.asc("pattern")], 3).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pattern"))).alias("r"), F.max("score").alias("score"))
    p = F.transform("r", lambda x: x["pattern"])
    shape = F.when(F.array_contains(p, "renters"), "Local Impact").when(F.array_contains(p, "parents"), "Watchlist").otherwise("Breaking Clarity")
    tags = F.array_sort(F.slice(F.array_distinct(F.concat(F.array(F.lit("#news"), F.concat(F.lit("#"), "lang")), F.transform(p, lambda x: F.concat(F.lit("#"), x)))), 1, 5))
    return best.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select("doc_id", F.array_join(p, ",").alias("patterns"), F.col("score").cast("long").alias("score"), shape.alias("post_shape"), F.array_join(tags, " ").alias("tags"))


@query(f"""WITH {rules_sql('beat', 'gossip')}, h AS (SELECT id, bool_or(kind = 'beat' AND rule = 'trailers') AS trailer, bool_or(kind = 'beat' AND rule = 'film') AS film, bool_or(kind = 'gossip') AS gossip FROM hits GROUP BY id)
SELECT doc_id, coalesce(trailer AND film, false) AS film_trailer, coalesce(gossip, false) AS gossip_risk, regexp_matches('https://' || source || '.example.com/' || CASE WHEN doc_id % 3 = 0 THEN 'stories/' || doc_id ELSE 'tag/' || lang END, '^(https?://[^/]+)?/stories/[^/?#]+') AS exact_story FROM documents LEFT JOIN h ON h.id = doc_id""")
def entertainment_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is of a film's trailer, risks gossip, and whether its address is that of one exact story."""
    found = hits(spark, sf_dir, "beat", "gossip")
    is_ = lambda kind, rule=None: F.bool_or((F.col("kind") == kind) & (F.lit(True) if rule is None else F.col("rule") == rule))
    per = found.groupBy("id").agg((is_("beat", "trailers") & is_("beat", "film")).alias("t"), is_("gossip").alias("g"))
    path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("stories/"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("tag/"), "lang"))
    link = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), path)
    rows = table(spark, sf_dir, "documents").join(per, F.col("doc_id") == F.col("id"), "left")
    return rows.select("doc_id", F.coalesce("t", F.lit(False)).alias("film_trailer"), F.coalesce("g", F.lit(False)).alias("gossip_risk"), exact_story(link).alias("exact_story"))


def exact_story(link):
    """Whether a link or a path leads to one story."""
    return link.rlike("^(https?://[^/]+)?/stories/[^/?#]+")
