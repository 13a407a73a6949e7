"""Copy risk and distance, summary gates, writing checks, draft gates, SEO fields, critic scores, rewrite strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import classify, similarity, writing
from tidewire.operators.shuffles import beside, join_unique, maybe_in, saved
from tidewire.plans.feed import tokens_sql
from tidewire.plans.rules import hits, rules_sql
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


WORDS = "list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
CLEAN = "trim(regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"
SENTENCES = "list_filter(string_split(regexp_replace(" + CLEAN + ", '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
STRUCTURE = "[" + ", ".join(f"'{w}'" for w in writing.STRUCTURE) + "]"
SHAPE = f"CASE WHEN regexp_matches({{w}}, '^[0-9]+$') THEN 'NUM' WHEN list_contains({STRUCTURE}, {{w}}) THEN {{w}} WHEN length({{w}}) <= 3 THEN 'SHORT' ELSE substr({{w}}, 1, 3) || length({{w}}) END"


def grams_sql(k: str, n: int) -> str:
    return f"CASE WHEN len({k}) >= {n} THEN list_transform(range(1, len({k}) - {n - 2}), lambda p: array_to_string({k}[p:p + {n - 1}], ' ')) ELSE [] END"


def overlap_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0::DOUBLE ELSE len(list_intersect({a}, {b})) / least(len(list_distinct({a})), len(list_distinct({b}))) END"


def copies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = saved(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), T.words(F.col("text")).alias("tokens")), "words")
    s = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sid"), T.words(F.col("text")).alias("tokens"))
    return c, s


COPIES_SQL = f"c AS (SELECT doc_id, {WORDS.format(x='text')} AS k FROM documents), s AS (SELECT item_id, {WORDS.format(x='text')} AS k FROM benchmark)"
JACCARD = "(CASE WHEN len(c.k) + len(s.k) = 0 THEN 0 ELSE len(list_intersect(c.k, s.k)) / len(list_distinct(list_concat(c.k, s.k))) END)"


@query(f"""WITH {COPIES_SQL}, g AS (SELECT doc_id, len(k) AS n_words, unnest(list_distinct(list_concat({grams_sql('k', 6)}, {grams_sql('k', 7)}, {grams_sql('k', 8)}))) AS gram FROM c),
q AS (SELECT item_id, unnest(list_distinct(list_filter(list_concat({grams_sql('k', 6)}, {grams_sql('k', 7)}, {grams_sql('k', 8)}), lambda x: length(x) >= 35))) AS gram FROM s),
n AS (SELECT doc_id, item_id, count(*) AS n_copied FROM g JOIN q USING (gram) GROUP BY ALL),
p AS (SELECT c.doc_id, s.item_id, coalesce(n_copied, 0) AS n_copied, {JACCARD} AS j, len(s.k) >= 6 AND contains(array_to_string(c.k, ' '), array_to_string(s.k, ' ')) AS holds FROM c CROSS JOIN s LEFT JOIN n ON n.doc_id = c.doc_id AND n.item_id = s.item_id WHERE n.doc_id IS NOT NULL OR len(list_distinct(c.k)) <= 100)
SELECT doc_id, item_id, n_copied, round(j, 6) AS similarity, holds AS holds_source, CASE WHEN holds OR n_copied > 0 OR j >= 0.82 THEN 'block' ELSE 'warn' END AS severity, CASE WHEN holds OR n_copied > 0 OR j >= 0.82 THEN 35 ELSE 72 END AS score FROM p WHERE n_copied > 0 OR holds OR j >= 0.66""")
def copy_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents too close to a source text: they hold it, or phrases of six to eight words and 35 characters of it, or their
    words are alike by .82 (block) or .66 (warn)."""
    c, s = copies(spark, sf_dir)
    copied = saved(writing.copied_phrases(c, s), "copied-phrases")
    # a source that a text holds has a copied phrase, unless all its words are short
    short = F.forall(T.ngrams(F.col("tokens"), 8), lambda g: F.length(g) < 35) & F.forall(T.ngrams(F.col("tokens"), 6), lambda g: F.length(g) < 35)
    holds_short = writing.sharing_grams(c, s.where((F.size("tokens") >= 6) & short), 6, 0.0)
    pairs = saved(copied.select("cid", "sid").unionByName(writing.alike_sets(c, s, 0.66)).unionByName(holds_short).distinct(), "risk-pairs")
    # each text's different words as hashes and its words as one text, once a text and not once a pair
    held = lambda df, key, x: df.select(key, F.array_distinct(F.transform("tokens", lambda w: F.xxhash64(w))).alias(f"{x}w"), F.array_join("tokens", " ").alias(f"{x}t"), F.size("tokens").alias(f"{x}n"))
    rows = pairs.join(copied, ["cid", "sid"], "left").join(held(maybe_in(c, pairs, "cid"), "cid", "c"), "cid").join(held(s, "sid", "s"), "sid")
    rows = rows.withColumn("both", F.size(F.array_intersect("cw", "sw")))
    rows = rows.withColumn("either", F.size("cw") + F.size("sw") - F.col("both"))
    n = F.coalesce("n_copied", F.lit(0))
    alike = F.when(F.col("either") > 0, F.col("both") / F.col("either")).otherwise(F.lit(0.0))
    holds = (F.col("sn") >= 6) & F.contains("ct", "st")
    # saved, or the filter would work out again what it looks at
    rows = saved(rows.select("cid", "sid", n.alias("n_copied"), alike.alias("j"), holds.alias("holds")), "risks").where("n_copied > 0 or holds or j >= 0.66")
    block = F.col("holds") | (F.col("n_copied") > 0) | (F.col("j") >= 0.82)
    return rows.select(F.col("cid").alias("doc_id"), F.col("sid").alias("item_id"), "n_copied", F.round("j", 6).alias("similarity"), F.col("holds").alias("holds_source"), F.when(block, "block").otherwise("warn").alias("severity"), F.when(block, 35).otherwise(72).alias("score"))


NAMES = "list_transform(regexp_extract_all(text, '[a-z,] ([A-Z][a-z]+)', 1), lambda x: lower(x))"
BARE = f"list_filter({{k}}, lambda w: NOT list_contains({STRUCTURE}, w) AND NOT list_contains(names, w))"
SKELETON = f"""{overlap_sql('ag', 'bg')} * 0.38::DOUBLE + {overlap_sql('a', 'b')} * 0.32::DOUBLE + len(a) / greatest(len(a), len(b)) * least(len(a), len(b)) / len(a) * 0.18::DOUBLE + {overlap_sql('ah', 'bh')} * 0.12::DOUBLE"""
SKELETON = SKELETON.replace("len(a) / greatest(len(a), len(b)) * least(len(a), len(b)) / len(a)", "least(len(a), len(b)) / greatest(len(a), len(b))")


def sentence_sql(frm: str, key: str, name: str, x: str) -> str:
    w = WORDS.format(x="x")
    return f"""{name}0 AS (SELECT {key}, {w} AS {x} FROM (SELECT {key}, unnest({SENTENCES.format(x='text')}) AS x FROM {frm})),
{name} AS (SELECT {key}, {x}, {grams_sql(f"list_transform({x}, lambda w: {SHAPE.format(w='w')})", 3)} AS {x}g, list_filter({x}, lambda w: list_contains({STRUCTURE}, w)) AS {x}h FROM {name}0 WHERE len({x}) > 0)"""


DISTANCE_SQL = f"""{COPIES_SQL}, cg AS (SELECT doc_id, len(g) AS n, unnest(g) AS gram FROM (SELECT doc_id, list_distinct({grams_sql('k', 4)}) AS g FROM c)), sg AS (SELECT item_id, len(g) AS n, unnest(g) AS gram FROM (SELECT item_id, list_distinct({grams_sql('k', 4)}) AS g FROM s)),
pr AS (SELECT doc_id, item_id FROM cg JOIN sg USING (gram) GROUP BY doc_id, item_id, cg.n, sg.n HAVING count(*) >= 0.2::DOUBLE * least(cg.n, sg.n)),
pd AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM pr)), {sentence_sql('pd', 'doc_id', 'cs', 'a')}, {sentence_sql('benchmark', 'item_id', 'ss', 'b')},
st AS (SELECT doc_id, item_id, max(round({SKELETON}, 3)) AS structure FROM pr JOIN cs USING (doc_id) JOIN ss USING (item_id) GROUP BY doc_id, item_id),
nm AS (SELECT item_id, {NAMES} AS names FROM benchmark),
ov AS (SELECT doc_id, item_id, names, c.k AS ck, s.k AS sk, {overlap_sql('c.k', 's.k')} AS lexical, {BARE.format(k='c.k')} AS cb, {BARE.format(k='s.k')} AS sb, greatest({", ".join(overlap_sql(grams_sql('c.k', n), grams_sql('s.k', n)) for n in (4, 5, 6))}) AS phrase,
  {overlap_sql(grams_sql('c.k', 3), grams_sql('s.k', 3))} AS trigram, len(s.k) >= 4 AND contains(array_to_string(c.k, ' '), array_to_string(s.k, ' ')) AS distinctive FROM pr JOIN c USING (doc_id) JOIN s USING (item_id) JOIN nm USING (item_id)),
sc AS (SELECT *, {overlap_sql('cb', 'sb')} AS bare, len(sb) < 3 AND lexical >= 0.75 AS fact_only FROM ov JOIN st USING (doc_id, item_id)),
sx AS (SELECT *, CASE WHEN fact_only THEN 0 ELSE least(lexical, bare + 0.25::DOUBLE) END AS lx, CASE WHEN fact_only THEN 0 ELSE phrase END AS ph, CASE WHEN fact_only THEN 0 ELSE structure END AS sr FROM sc),
wr AS (SELECT *, least(1.0::DOUBLE, greatest(lx * 0.78::DOUBLE, bare * 0.9::DOUBLE) * 0.34::DOUBLE + ph * 0.27::DOUBLE + sr * 0.27::DOUBLE + CASE WHEN distinctive THEN 0.24::DOUBLE ELSE 0 END) AS w FROM sx),
rk AS (SELECT *, CASE WHEN distinctive OR ph >= 0.72 OR sr >= 0.84 OR (lexical >= 0.92 AND bare >= 0.58 AND (ph >= 0.45 OR sr >= 0.82)) THEN 'blocked' WHEN w >= 0.7 OR ph >= 0.52 OR sr >= 0.82 OR (lexical >= 0.95 AND bare >= 0.75 AND sr >= 0.78) THEN 'high' WHEN w >= 0.42 OR bare >= 0.58 OR sr >= 0.62 THEN 'medium' ELSE 'low' END AS risk FROM wr)"""


@query(f"""WITH {DISTANCE_SQL} SELECT doc_id, item_id, round(lexical, 3) AS lexical_overlap, round(bare, 3) AS bare_overlap, round(trigram, 3) AS trigram_overlap, round(phrase, 3) AS phrase_overlap, round(structure, 3) AS structural_similarity, distinctive, risk,
  CAST(floor(greatest(0, 100 - w * 100 - CASE risk WHEN 'blocked' THEN 20 WHEN 'high' THEN 10 ELSE 0 END) + 0.5) AS BIGINT) AS score FROM rk""")
def copy_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that share a fifth of their four-word phrases: words, words without names, phrases of three to six words and
    sentence skeletons, whether the whole source is in the text, the risk and a score of 0 to 100."""
    docs, items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cid"), "text"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sid"), "text")
    worded = lambda df, key: df.select(key, T.words(F.col("text")).alias("tokens"))
    s = worded(items, "sid")
    pairs = saved(writing.sharing_grams(worded(docs, "cid"), s, 4, 0.2), "copy-pairs")
    # few texts are near a source: only these are looked at again
    near = saved(maybe_in(docs, pairs, "cid"), "copy-texts")
    c = worded(near, "cid")
    # words of a sentence inside the array, so that a filter after the explode doesn't work them out again
    cut = lambda df, key, x: df.select(key, F.explode_outer(F.transform(T.sentences(F.col("text")), T.words)).alias(x)).where(F.size(x) > 0)
    sentences = lambda df, key, x: writing.skeletons(cut(df, key, x), key, x)
    each = pairs.join(saved(sentences(near, "cid", "a"), "copy-sentences"), "cid").join(beside(sentences(items, "sid", "b")), "sid")
    structure = each.groupBy("cid", "sid").agg(F.max(F.round(writing.skeletons_alike(F.col("a"), F.col("b")), 3)).alias("structure"))
    names = items.select("sid", F.transform(classify.entities(F.col("text")), lambda x: F.lower(x)).alias("names"))
    held = F.array(*map(F.lit, writing.STRUCTURE))
    bare = lambda k: F.filter(k, lambda w: ~F.array_contains(held, w) & ~F.array_contains("names", w))
    # the different phrases of each text as hashes, once a text and not once a pair
    sizes = (3, 4, 5, 6)
    phrased = lambda df, key, x: writing.hashed(df, key, sizes).select(key, F.col("tokens").alias(f"{x}k"), *[F.array_distinct(f"h{n}").alias(f"{x}{n}") for n in sizes])
    full = pairs.join(phrased(c, "cid", "c"), "cid").join(phrased(s, "sid", "s"), "sid").join(names, "sid").join(structure, ["cid", "sid"])
    over = lambda n: writing.share(F.col(f"c{n}"), F.col(f"s{n}"))
    full = full.select(
        "cid", "sid", "structure", T.overlap(F.col("ck"), F.col("sk")).alias("lexical"), bare(F.col("ck")).alias("cb"), bare(F.col("sk")).alias("sb"), over(3).alias("trigram"),
        F.greatest(over(4), over(5), over(6)).alias("phrase"), ((F.size("sk") >= 4) & F.contains(F.array_join("ck", " "), F.array_join("sk", " "))).alias("distinctive"),
    ).withColumn("bare", T.overlap(F.col("cb"), F.col("sb")))
    facts = (F.size("sb") < 3) & (F.col("lexical") >= 0.75)
    off = lambda x: F.when(facts, 0.0).otherwise(x)
    full = full.withColumns({"lx": off(F.least(F.col("lexical"), F.col("bare") + 0.25)), "ph": off(F.col("phrase")), "sr": off(F.col("structure"))})
    weighted = F.greatest(F.col("lx") * 0.78, F.col("bare") * 0.9) * 0.34 + F.col("ph") * 0.27 + F.col("sr") * 0.27 + F.when(F.col("distinctive"), 0.24).otherwise(0.0)
    full = full.withColumn("w", F.least(F.lit(1.0), weighted))
    full = full.withColumn("risk", writing.risk_of(F.col("w"), F.col("ph"), F.col("sr"), F.col("lexical"), F.col("bare"), F.col("distinctive")))
    less = F.when(F.col("risk") == "blocked", 20).when(F.col("risk") == "high", 10).otherwise(0)
    return full.select(
        F.col("cid").alias("doc_id"), F.col("sid").alias("item_id"), F.round("lexical", 3).alias("lexical_overlap"), F.round("bare", 3).alias("bare_overlap"), F.round("trigram", 3).alias("trigram_overlap"),
        F.round("phrase", 3).alias("phrase_overlap"), F.round("structure", 3).alias("structural_similarity"), "distinctive", "risk", T.half_up(F.greatest(F.lit(0.0), 100 - F.col("w") * 100 - less)).cast("long").alias("score"),
    )


# --- drafts: an item's first two sentences, against its title, the next ones and its facts

PHRASES = ("filler", "robotic", "overstated", "respect")
READERS = "readers residents workers users fans families voters consumers investors students drivers lecteurs lectores leser".split()
DANGLING = "and or but with for of to the a und der die de la et que y".split()


def drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its title, summary (sentences 1 and 2), description (3 and 4), facts (of 3 to 8, 40 to 240
    characters), their words, and how often phrases of the rule table stand in the summary."""
    s = T.sentences(F.col("text"))
    cut = lambda a, n: F.trim(F.substring(F.array_join(F.slice("s", a, n), " "), 1, 260))
    rows = items(spark, sf_dir).select("id", "title", "source_name", "category", "sensitive", s.alias("s"))
    rows = rows.select("*", cut(1, 2).alias("summary"), cut(3, 2).alias("description"), F.filter(F.slice("s", 3, 6), lambda x: F.length(x).between(40, 240)).alias("facts")).drop("s")
    said = hits(spark, sf_dir, *PHRASES, texts=rows.select("id", F.col("summary").alias("text")))
    counts = said.groupBy("id").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in PHRASES])
    rows = rows.join(counts, "id", "left").na.fill(0, list(PHRASES))
    rows = rows.withColumns({
        "k": T.words(F.col("summary")), "dk": T.words(F.col("description")), "tk": T.words(F.col("title")), "tt": F.array_distinct(T.title_tokens(F.col("title"))),
        "fw": F.transform("facts", T.words), "sw": F.transform(T.sentences(F.col("summary")), T.words), "exact": F.col("id") % 3 == 0,
    })
    return rows.withColumns({"evidence": F.concat("tk", "dk", F.flatten("fw")), "n": F.size("k"), "lens": F.transform("sw", lambda w: F.size(w)), "n_facts": F.size("facts")})


S = SENTENCES.format(x="text")
COUNTS_SQL = ", ".join(f"CAST(coalesce(sum(n) FILTER (kind = '{k}'), 0) AS BIGINT) AS {k}" for k in PHRASES)
DRAFTS_SQL = f"""{ITEMS_SQL}, ds AS (SELECT id, title, source_name, category, sensitive, {S} AS s FROM items),
dd AS (SELECT id, title, source_name, category, sensitive, trim(substr(array_to_string(s[1:2], ' '), 1, 260)) AS summary, trim(substr(array_to_string(s[3:4], ' '), 1, 260)) AS description, list_filter(s[3:8], lambda x: length(x) BETWEEN 40 AND 240) AS facts FROM ds),
{rules_sql(*PHRASES, texts="SELECT id, summary AS text FROM dd")}, hc AS (SELECT id, {COUNTS_SQL} FROM hits GROUP BY id),
dw AS (SELECT dd.*, {", ".join(f"coalesce({k}, 0) AS {k}" for k in PHRASES)}, {WORDS.format(x='summary')} AS k, {WORDS.format(x='description')} AS dk, {WORDS.format(x='title')} AS tk, list_distinct({tokens_sql('title')}) AS tt, list_transform(facts, lambda f: {WORDS.format(x='f')}) AS fw,
  list_transform({SENTENCES.format(x='summary')}, lambda f: {WORDS.format(x='f')}) AS sw, dd.id % 3 = 0 AS exact FROM dd LEFT JOIN hc ON hc.id = dd.id),
dr AS (SELECT *, list_concat(tk, dk, flatten(fw)) AS evidence, len(k) AS n, list_transform(sw, lambda w: len(w)) AS lens, len(facts) AS n_facts FROM dw)"""


def jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


def doubled(k: Column) -> Column:
    return F.exists(F.zip_with(k, F.slice(k, 2, F.greatest(F.size(k), F.lit(1))), lambda a, b: a == b), lambda x: F.coalesce(x, F.lit(False)))


DOUBLED = "len(list_filter(k, lambda w, i: i > 1 AND w = k[i - 1])) > 0"
RUN13 = f"list_has_any({grams_sql('k', 13)}, {grams_sql('dk', 13)})"
CLOSE = f"(summary <> '' AND lower(summary) = lower(description)) OR {RUN13} OR ({jaccard_sql('k', 'dk')} >= 0.9 AND k[1:4] = dk[1:4] AND len(k) >= 0.75 * len(dk))"
GATES = (
    ("empty_summary", "summary = ''"), ("too_short", "n < 18"), ("too_long", "n > 35"), ("no_sentence_end", "NOT regexp_matches(summary, '[.!?]$')"), ("lower_case_start", "regexp_matches(summary, '^[a-z]')"),
    ("repeats_words", "len(list_distinct(k)) * 10 < n * 6"), ("robotic_opener", "robotic > 0"), ("vague_filler", "filler > 0"), ("database_language", "regexp_matches(lower(summary), 'password=|%%%|###|null|undefined')"),
    ("doubled_word", DOUBLED), ("dangling_punctuation", "regexp_matches(summary, '[,;:][ ]*$')"), ("dangling_end", f"len(list_filter(sw, lambda w: len(w) > 0 AND list_contains({DANGLING!r}, w[len(w)]))) > 0"),
    ("too_close_to_source", CLOSE), ("repeats_title", "len(tk) >= 5 AND contains(array_to_string(k, ' '), array_to_string(tk, ' '))"),
    ("missing_detail", "NOT (list_has_any(tt, k) AND len(list_filter(evidence, lambda w: length(w) >= 4 AND list_contains(k, w) AND NOT list_contains(tk, w))) > 0)"),
)


def gates() -> dict[str, Column]:
    """What a summary must hold to be shown: rule -> column that is true if it does."""
    c, k, s = F.col, F.col("k"), F.col("summary")
    run = lambda x: T.ngrams(F.col(x), 13)
    close = ((s != "") & (F.lower(s) == F.lower("description"))) | F.arrays_overlap(run("k"), run("dk")) | ((T.jaccard(k, c("dk")) >= 0.9) & (F.slice("k", 1, 4) == F.slice("dk", 1, 4)) & (c("n") >= 0.75 * F.size("dk")))
    detail = F.filter("evidence", lambda w: (F.length(w) >= 4) & F.array_contains("k", w) & ~F.array_contains("tk", w))
    ends = F.exists("sw", lambda w: (F.size(w) > 0) & F.element_at(w, -1).isin(*DANGLING))
    return {
        "empty_summary": s != "", "too_short": c("n") >= 18, "too_long": c("n") <= 35, "no_sentence_end": s.rlike("[.!?]$"), "lower_case_start": ~s.rlike("^[a-z]"),
        "repeats_words": F.size(F.array_distinct("k")) * 10 >= c("n") * 6, "robotic_opener": c("robotic") == 0, "vague_filler": c("filler") == 0, "database_language": ~F.lower(s).rlike("password=|%%%|###|null|undefined"),
        "doubled_word": ~doubled(k), "dangling_punctuation": ~s.rlike("[,;:][ ]*$"), "dangling_end": ~F.coalesce(ends, F.lit(False)), "too_close_to_source": ~F.coalesce(close, F.lit(False)),
        "repeats_title": ~((F.size("tk") >= 5) & F.contains(F.array_join("k", " "), F.array_join("tk", " "))), "missing_detail": F.coalesce(F.arrays_overlap("tt", "k"), F.lit(False)) & (F.size(detail) > 0),
    }


@query(f"WITH {DRAFTS_SQL} SELECT id AS doc_id, n AS n_words, array_to_string(list_filter([{', '.join(f'CASE WHEN {x} THEN {chr(39)}{name}{chr(39)} END' for name, x in GATES)}], lambda x: x IS NOT NULL), ',') AS failures, round({jaccard_sql('k', 'dk')}, 4) AS source_similarity FROM dr")
def summary_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen gates for each text's summary: length, form, phrases, closeness to the source, title repeated, detail backed."""
    rows = drafts(spark, sf_dir)
    return rows.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_words"), F.array_join(classify.failures(gates()), ",").alias("failures"), F.round(T.jaccard(F.col("k"), F.col("dk")), 4).alias("source_similarity"))


CHECKS = ("focus", "faithfulness", "clarity", "specificity", "rhetoric", "rhythm", "respected", "digital", "copying", "fallback")
BOUND = "least(100, greatest(0, {x}))"
STARTS = "list_transform(sw, lambda w: array_to_string(w[1:3], ' '))"
CHECKS_SQL = f"""ce AS (SELECT *, CASE WHEN len(tt) = 0 THEN 0 ELSE len(list_intersect(tt, k)) / len(tt) END AS ratio, len(list_filter(fw, lambda f: {jaccard_sql('k', 'f')} >= 0.2)) AS fact_hits, len(list_filter(fw, lambda f: {jaccard_sql('k', 'f')} >= 0.18)) AS useful,
  len(list_filter(list_distinct(k), lambda w: length(w) >= 4 AND NOT list_contains(evidence, w))) AS unsupported, len(list_distinct(regexp_extract_all(summary, '[a-z,] ([A-Z][a-z]+)', 1))) > 0 AS named, {jaccard_sql('k', 'dk')} AS alike, list_has_any({grams_sql('k', 6)}, {grams_sql('dk', 6)}) AS runs FROM dr),
cs_ AS (SELECT *, {BOUND.format(x='35 + ratio * 45 + least(fact_hits, 2) * 10')} AS focus0, {BOUND.format(x='100 - unsupported * 8 - unsupported / greatest(1, n) * 50 - overstated * 18')} AS faithfulness0,
  {BOUND.format(x=f"100 - (filler + robotic) * 22 - len(list_filter(lens, lambda x: x > 34)) * 12 - CASE WHEN {DOUBLED} THEN 20 ELSE 0 END - CASE WHEN n < 5 THEN 20 ELSE 0 END")} AS clarity,
  {BOUND.format(x='45 + least(useful, 2) * 20 + CASE WHEN named THEN 15 ELSE 0 END - filler * 35')} AS specificity,
  72 + CASE WHEN len(fw) > 0 AND {jaccard_sql('k', 'fw[1]')} >= 0.12 THEN 12 ELSE 0 END + CASE WHEN list_has_any(k, {READERS!r}) THEN 8 ELSE 0 END + CASE WHEN contains(lower(summary), lower(source_name)) THEN 8 ELSE 0 END AS rhetoric,
  92 - CASE WHEN len(sw) > 1 AND len(list_distinct({STARTS})) < len(sw) THEN 20 ELSE 0 END - CASE WHEN len(sw) > 1 AND list_max(lens) - list_min(lens) <= 2 THEN 10 ELSE 0 END - CASE WHEN len(sw) = 1 AND n > 30 THEN 10 ELSE 0 END AS rhythm,
  CASE WHEN respect > 0 THEN 35 ELSE 100 END AS respected, 100 - CASE WHEN n > 55 THEN 18 ELSE 0 END - CASE WHEN n < 8 THEN 15 ELSE 0 END - CASE WHEN NOT exact THEN 45 ELSE 0 END AS digital,
  CASE WHEN alike >= 0.82 OR runs THEN 35 WHEN alike >= 0.66 THEN 72 ELSE 100 END AS copying, {BOUND.format(x='100 - filler * 35 - CASE WHEN n_facts = 0 THEN 18 ELSE 0 END')} AS fallback FROM ce),
ck AS (SELECT *, CAST(floor(focus0 + 0.5) AS BIGINT) AS focus, CAST(floor(faithfulness0 + 0.5) AS BIGINT) AS faithfulness FROM cs_),
ct AS (SELECT *, CAST(floor(focus * 0.25::DOUBLE + faithfulness * 0.25::DOUBLE + specificity * 0.15::DOUBLE + clarity * 0.1::DOUBLE + rhythm * 0.1::DOUBLE + floor((rhetoric + copying + respected) / 3.0::DOUBLE + 0.5) * 0.1::DOUBLE + digital * 0.05::DOUBLE + 0.5) AS BIGINT) AS total FROM ck),
cf AS (SELECT *, list_filter([CASE WHEN focus < 85 THEN 'focus' END, CASE WHEN faithfulness < 90 OR overstated > 0 OR unsupported >= 5 THEN 'faithfulness' END, CASE WHEN filler + robotic > 0 OR {DOUBLED} OR clarity < 76 THEN 'clarity' END, CASE WHEN filler > 0 OR specificity < 70 THEN 'specificity' END, CASE WHEN rhetoric < 72 THEN 'rhetoric' END,
  CASE WHEN rhythm < 70 THEN 'rhythm' END, CASE WHEN respect > 0 THEN 'respected' END, CASE WHEN NOT exact OR digital < 55 THEN 'digital' END, CASE WHEN copying = 35 THEN 'copying' END, CASE WHEN filler > 0 OR n_facts = 0 THEN 'fallback' END, CASE WHEN total < 85 THEN 'total' END], lambda x: x IS NOT NULL) AS failed FROM ct)"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """drafts with ten checks of 0 to 100, their weighted total, and which fail."""
    c, k = F.col, F.col("k")
    bound = lambda x: F.least(F.lit(100), F.greatest(F.lit(0), x))
    part = lambda ok, x: F.when(ok, x).otherwise(0)
    close = lambda least: F.size(F.filter("fw", lambda f: T.jaccard(F.col("k"), f) >= least))
    rows = drafts(spark, sf_dir).withColumns({
        "ratio": F.when(F.size("tt") == 0, 0.0).otherwise(F.size(F.array_intersect("tt", "k")) / F.size("tt")), "fact_hits": close(0.2), "useful": close(0.18),
        "unsupported": F.size(F.filter(F.array_distinct("k"), lambda w: (F.length(w) >= 4) & ~F.array_contains("evidence", w))), "named": F.size(classify.entities(c("summary"))) > 0,
        "alike": T.jaccard(k, c("dk")), "runs": F.coalesce(F.arrays_overlap(T.ngrams(k, 6), T.ngrams(c("dk"), 6)), F.lit(False)), "doubled": doubled(k),
    })
    starts = F.array_distinct(F.transform("sw", lambda w: F.array_join(F.slice(w, 1, 3), " ")))
    several = F.size("sw") > 1
    rows = rows.withColumns({
        "focus": T.half_up(bound(35 + c("ratio") * 45 + F.least(c("fact_hits"), F.lit(2)) * 10)).cast("long"),
        "faithfulness": T.half_up(bound(100 - c("unsupported") * 8 - c("unsupported") / F.greatest(F.lit(1), c("n")) * 50 - c("overstated") * 18)).cast("long"),
        "clarity": bound(100 - (c("filler") + c("robotic")) * 22 - F.size(F.filter("lens", lambda x: x > 34)) * 12 - part(c("doubled"), 20) - part(c("n") < 5, 20)),
        "specificity": bound(45 + F.least(c("useful"), F.lit(2)) * 20 + part(c("named"), 15) - c("filler") * 35),
        "rhetoric": 72 + part((F.size("fw") > 0) & (T.jaccard(k, F.get("fw", F.lit(0))) >= 0.12), 12) + part(F.arrays_overlap("k", F.array(*map(F.lit, READERS))), 8) + part(F.contains(F.lower("summary"), F.lower("source_name")), 8),
        "rhythm": 92 - part(several & (F.size(starts) < F.size("sw")), 20) - part(several & (F.array_max("lens") - F.array_min("lens") <= 2), 10) - part((F.size("sw") == 1) & (c("n") > 30), 10),
        "respected": F.when(c("respect") > 0, 35).otherwise(100), "digital": 100 - part(c("n") > 55, 18) - part(c("n") < 8, 15) - part(~c("exact"), 45),
        "copying": F.when((c("alike") >= 0.82) | c("runs"), 35).when(c("alike") >= 0.66, 72).otherwise(100), "fallback": bound(100 - c("filler") * 35 - part(c("n_facts") == 0, 18)),
    })
    source = T.half_up((c("rhetoric") + c("copying") + c("respected")) / 3.0)
    total = c("focus") * 0.25 + c("faithfulness") * 0.25 + c("specificity") * 0.15 + c("clarity") * 0.1 + c("rhythm") * 0.1 + source * 0.1 + c("digital") * 0.05
    rows = rows.withColumn("total", T.half_up(total).cast("long"))
    failed = classify.failures({
        "focus": c("focus") >= 85, "faithfulness": (c("faithfulness") >= 90) & (c("overstated") == 0) & (c("unsupported") < 5), "clarity": (c("filler") + c("robotic") == 0) & ~c("doubled") & (c("clarity") >= 76),
        "specificity": (c("filler") == 0) & (c("specificity") >= 70), "rhetoric": c("rhetoric") >= 72, "rhythm": c("rhythm") >= 70, "respected": c("respect") == 0, "digital": c("exact") & (c("digital") >= 55),
        "copying": c("copying") > 35, "fallback": (c("filler") == 0) & (c("n_facts") > 0), "total": c("total") >= 85,
    })
    return rows.withColumn("failed", failed).withColumn("passed", F.size("failed") == 0)


@query(f"WITH {DRAFTS_SQL}, {CHECKS_SQL} SELECT id AS doc_id, {', '.join(CHECKS)}, total, array_to_string(failed, ',') AS failed, len(failed) = 0 AS passed FROM cf")
def writing_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten checks of each draft, the weighted total, and what fails."""
    return checked(spark, sf_dir).select(F.col("id").alias("doc_id"), *CHECKS, "total", F.array_join("failed", ",").alias("failed"), "passed")


@query(f"WITH {DRAFTS_SQL}, {CHECKS_SQL} SELECT source_name, category, id AS doc_id, total, len(failed) = 0 AS passed FROM cf QUALIFY row_number() OVER (PARTITION BY source_name, category ORDER BY len(failed), copying DESC, total DESC, id) = 1")
def candidate_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source's drafts in a language: fewest failures (none first), least copied, the total, the first. One aggregate."""
    best = checked(spark, sf_dir).groupBy("source_name", "category").agg(F.min(F.struct(F.size("failed").alias("f"), (-F.col("copying")).alias("c"), (-F.col("total")).alias("t"), "id")).alias("b"))
    return best.select("source_name", "category", F.col("b.id").alias("doc_id"), (-F.col("b.t")).alias("total"), (F.col("b.f") == 0).alias("passed"))


@query(f"WITH {DRAFTS_SQL}, {CHECKS_SQL} SELECT category, count(*) AS n, round(avg(total), 4) AS mean_total, min(total) AS least_total, min(faithfulness) AS least_faithfulness, bool_and(len(failed) = 0) AS all_passed, round(count(*) FILTER (len(failed) = 0) / count(*), 3) AS rate FROM cf GROUP BY category")
def exam_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).groupBy("category").agg(
        F.count("*").alias("n"), F.round(F.avg("total"), 4).alias("mean_total"), F.min("total").alias("least_total"), F.min("faithfulness").alias("least_faithfulness"), F.bool_and("passed").alias("all_passed"),
        F.round(F.count_if("passed") / F.count("*"), 3).alias("rate"),
    )


#: What to do about a failed check.
STRATEGIES = (
    ("copying", "fact_map_rewrite"), ("focus", "story_focus_rewrite"), ("specificity", "specificity_rewrite"), ("clarity", "plain_english_rewrite"), ("rhythm", "rhythm_rewrite"),
    ("fallback", "no_fallback_rewrite"), ("faithfulness", "evidence_rewrite"),
)
STRATEGY_SQL = ", ".join(f"CASE WHEN list_contains(failed, '{c}') THEN '{s}' END" for c, s in STRATEGIES)


@query(f"""WITH {DRAFTS_SQL}, {CHECKS_SQL}, a AS (SELECT id, failed, list_filter([{STRATEGY_SQL}, CASE WHEN sensitive > 0 THEN 'neutral_rewrite' END], lambda x: x IS NOT NULL) AS a FROM cf WHERE len(failed) > 0)
SELECT id AS doc_id, CASE WHEN len(a) > 0 THEN array_to_string(a, ',') ELSE 'fact_map_rewrite' END AS strategies, CASE WHEN list_contains(failed, 'copying') THEN 'source_like' WHEN list_contains(failed, 'fallback') THEN 'template' WHEN list_contains(failed, 'focus') THEN 'unfocused' WHEN list_contains(failed, 'specificity') THEN 'generic' WHEN list_contains(failed, 'clarity') THEN 'unclear' ELSE 'other' END AS weak_shape FROM a""")
def rewrite_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How to rewrite each draft that fails, and what kind of weak draft it is."""
    # saved, or the filter would be put before the checks and work all of them out again, nested into each other
    rows = saved(checked(spark, sf_dir).select("id", "sensitive", "failed"), "checked").where(F.size("failed") > 0)
    has = lambda code: F.array_contains("failed", code)
    found = F.array_compact(F.array(*[F.when(has(code), s) for code, s in STRATEGIES], F.when(F.col("sensitive") > 0, "neutral_rewrite")))
    kind = F.when(has("copying"), "source_like").when(has("fallback"), "template").when(has("focus"), "unfocused").when(has("specificity"), "generic").when(has("clarity"), "unclear").otherwise("other")
    return rows.select(F.col("id").alias("doc_id"), F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise("fact_map_rewrite").alias("strategies"), kind.alias("weak_shape"))


MOST = "list_max(list_transform(list_distinct(st), lambda w: len(list_filter(st, lambda v: v = w))))"


@query(f"""WITH {DRAFTS_SQL}, {CHECKS_SQL}, se AS (SELECT *, {tokens_sql('summary').removesuffix('[1:12]')} AS st FROM cf), sf AS (SELECT *, coalesce({MOST}, 0) AS most FROM se), sg AS (SELECT *, most >= 4 OR (len(st) >= 6 AND most >= 0.28 * len(st)) AS stuffed FROM sf)
SELECT id AS doc_id, array_to_string({tokens_sql('title')}[1:5], ' ') AS primary_keyword, array_to_string(list_filter(list_concat({tokens_sql('title')}, st), lambda w, i: list_position(list_concat({tokens_sql('title')}, st), w) = i)[1:8], ',') AS related,
  array_to_string(list_filter([CASE WHEN len(failed) > 0 THEN 'exam' END, CASE WHEN filler > 0 THEN 'fallback' END, CASE WHEN stuffed THEN 'stuffed' END, CASE WHEN copying = 35 THEN 'copied' END, CASE WHEN NOT exact THEN 'no_exact_url' END], lambda x: x IS NOT NULL), ',') AS blocking FROM sg""")
def seo_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a draft can be a description for search engines, with its keyword and related queries."""
    rows = checked(spark, sf_dir).withColumns({"st": T.title_tokens(F.col("summary"), 10_000), "kw": T.title_tokens(F.col("title"))})
    blocking = classify.failures({"exam": F.col("passed"), "fallback": F.col("filler") == 0, "stuffed": similarity.stuffing(F.col("st")) == 0, "copied": F.col("copying") > 35, "no_exact_url": F.col("exact")})
    return rows.select(
        F.col("id").alias("doc_id"), F.array_join(F.slice("kw", 1, 5), " ").alias("primary_keyword"), F.array_join(F.slice(F.array_distinct(F.concat("kw", "st")), 1, 8), ",").alias("related"), F.array_join(blocking, ",").alias("blocking"),
    )


@query(f"""WITH {DRAFTS_SQL}, {CHECKS_SQL}, cr AS (SELECT *, greatest(focus, {overlap_sql('k', 'tk')} * 100) AS relevance, {BOUND.format(x='100 - unsupported * 12')} AS support, {BOUND.format(x="62 + CASE WHEN regexp_matches(summary, '[.!?]') THEN 12 ELSE 0 END + CASE WHEN n >= 8 THEN 14 ELSE 0 END - filler * 20")} AS clear,
  {BOUND.format(x=f"50 + least(fact_hits, 3) * 14 + CASE WHEN {overlap_sql('k', 'evidence')} > 0.2 THEN 12 ELSE 0 END")} AS useful_, {BOUND.format(x="CASE WHEN n_facts >= 2 THEN 62 WHEN n_facts = 1 THEN 52 ELSE 40 END + CASE WHEN exact THEN 18 ELSE 0 END + CASE WHEN n_facts > 0 THEN 10 ELSE -20 END")} AS context,
  {BOUND.format(x='unsupported * 18 + overstated * 35')} AS claims, {BOUND.format(x='filler * 35')} AS vague, {BOUND.format(x='overstated * 35')} AS over FROM cf),
cw AS (SELECT *, CAST(floor((relevance + support + clear + useful_ + context + 100 - claims + 100 - vague + 100 - over) / 8.0::DOUBLE + 0.5) AS BIGINT) AS score FROM cr)
SELECT id AS doc_id, score, array_to_string(list_filter([CASE WHEN n_facts = 0 THEN 'no_facts' END, CASE WHEN claims >= 55 THEN 'unsupported' END, CASE WHEN vague >= 50 THEN 'vague' END, CASE WHEN over > 0 THEN 'overstated' END, CASE WHEN relevance < 70 THEN 'off_topic' END], lambda x: x IS NOT NULL), ',') AS warnings FROM cw""")
def critic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of eight sub-scores of a draft, and warnings that block it."""
    c = F.col
    bound = lambda x: F.least(F.lit(100), F.greatest(F.lit(0), x))
    part = lambda ok, x: F.when(ok, x).otherwise(0)
    rows = checked(spark, sf_dir).withColumns({
        "relevance": F.greatest(c("focus"), T.overlap(c("k"), c("tk")) * 100), "support": bound(100 - c("unsupported") * 12), "clear": bound(62 + part(c("summary").rlike("[.!?]"), 12) + part(c("n") >= 8, 14) - c("filler") * 20),
        "helps": bound(50 + F.least(c("fact_hits"), F.lit(3)) * 14 + part(T.overlap(c("k"), c("evidence")) > 0.2, 12)),
        "context": bound(F.when(c("n_facts") >= 2, 62).when(c("n_facts") == 1, 52).otherwise(40) + part(c("exact"), 18) + F.when(c("n_facts") > 0, 10).otherwise(-20)),
        "claims": bound(c("unsupported") * 18 + c("overstated") * 35), "vague": bound(c("filler") * 35), "over": bound(c("overstated") * 35),
    })
    score = (c("relevance") + c("support") + c("clear") + c("helps") + c("context") + 100 - c("claims") + 100 - c("vague") + 100 - c("over")) / 8.0
    warnings = classify.failures({"no_facts": c("n_facts") > 0, "unsupported": c("claims") < 55, "vague": c("vague") < 50, "overstated": c("over") == 0, "off_topic": c("relevance") >= 70})
    return rows.select(c("id").alias("doc_id"), T.half_up(score).cast("long").alias("score"), F.array_join(warnings, ",").alias("warnings"))


DRAFT_GATES = ("attribution", "originality", "style", "grounding", "readability", "safety")


@query(f"""WITH {DRAFTS_SQL}, sg AS (SELECT *, array_to_string(k[1:6], ' ') AS signature FROM dr), sn AS (SELECT signature, count(*) AS held FROM sg GROUP BY signature),
gs AS (SELECT id, 80 + CASE WHEN description <> '' THEN 20 ELSE 0 END AS attribution, greatest(0, 100 - 35 * least(3, len(list_intersect({grams_sql('k', 6)}, {grams_sql('dk', 6)}))) - CASE WHEN lower(summary) = lower(title) THEN 45 ELSE 0 END) AS originality,
  greatest(0, 100 - robotic * 18 - CASE WHEN held > 1 THEN 25 ELSE 0 END - CASE WHEN coalesce(list_max(lens) - list_min(lens), 0) < 2 THEN 10 ELSE 0 END) AS style, 50 + CASE WHEN n_facts >= 2 THEN 20 ELSE 0 END + CASE WHEN n_facts >= 3 THEN 15 ELSE 0 END + CASE WHEN summary <> '' THEN 10 ELSE 0 END AS grounding,
  greatest(0, 100 - CASE WHEN description = '' OR length(description) > 220 THEN 15 ELSE 0 END - CASE WHEN len(sw) NOT BETWEEN 2 AND 3 THEN 15 ELSE 0 END - 10 * len(list_filter(lens, lambda x: x > 32)) - CASE WHEN n_facts < 3 THEN 15 ELSE 0 END) AS readability, 100 - CASE WHEN sensitive > 0 THEN 35 ELSE 0 END AS safety FROM sg JOIN sn USING (signature)),
gt AS (SELECT *, CAST(floor(attribution * 0.22::DOUBLE + originality * 0.2::DOUBLE + style * 0.16::DOUBLE + grounding * 0.18::DOUBLE + readability * 0.12::DOUBLE + safety * 0.12::DOUBLE + 0.5) AS BIGINT) AS total FROM gs)
SELECT id AS doc_id, {', '.join(DRAFT_GATES)}, total, total >= 80 AND {' AND '.join(f'{g} >= 75' for g in DRAFT_GATES)} AS passed FROM gt""")
def draft_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six weighted scores of a draft; 80 in all and 75 in each pass. Drafts that open alike are found by their signature."""
    c = F.col
    part = lambda ok, x: F.when(ok, x).otherwise(0)
    floor0 = lambda x: F.greatest(F.lit(0), x)
    rows = drafts(spark, sf_dir).withColumn("signature", F.array_join(F.slice("k", 1, 6), " "))
    rows = saved(rows.select("id", "title", "summary", "description", "sensitive", "robotic", "k", "dk", "lens", F.size("sw").alias("n_sentences"), "n_facts", "signature"), "drafts")
    held = rows.groupBy("signature").agg(F.count("*").alias("n")).where("n > 1")
    rows = join_unique(rows, held.select("signature", F.lit(True).alias("again")), "signature", "left", counts=held)
    shared = F.size(F.array_intersect(T.ngrams(c("k"), 6), T.ngrams(c("dk"), 6)))
    spread = F.coalesce(F.array_max("lens") - F.array_min("lens"), F.lit(0))
    rows = rows.select(
        "id", (80 + part(c("description") != "", 20)).alias("attribution"), floor0(100 - 35 * F.least(F.lit(3), shared) - part(F.lower("summary") == F.lower("title"), 45)).alias("originality"),
        floor0(100 - c("robotic") * 18 - part(c("again"), 25) - part(spread < 2, 10)).alias("style"), (50 + part(c("n_facts") >= 2, 20) + part(c("n_facts") >= 3, 15) + part(c("summary") != "", 10)).alias("grounding"),
        floor0(100 - part((c("description") == "") | (F.length("description") > 220), 15) - part(~c("n_sentences").between(2, 3), 15) - 10 * F.size(F.filter("lens", lambda x: x > 32)) - part(c("n_facts") < 3, 15)).alias("readability"),
        (100 - part(c("sensitive") > 0, 35)).alias("safety"),
    )
    total = T.half_up(c("attribution") * 0.22 + c("originality") * 0.2 + c("style") * 0.16 + c("grounding") * 0.18 + c("readability") * 0.12 + c("safety") * 0.12).cast("long")
    rows = rows.withColumn("total", total)
    passed = c("total") >= 80
    for g in DRAFT_GATES:
        passed = passed & (c(g) >= 75)
    return rows.select(c("id").alias("doc_id"), *DRAFT_GATES, "total", passed.alias("passed"))
