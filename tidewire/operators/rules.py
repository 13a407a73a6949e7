"""Rule tables against texts: terms are rows (kind, rule, term), matched by whole words with a negation guard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators.shuffles import beside

#: Words that take back what follows them within `guard` words.
NEGATIONS = ("no", "not", "never", "without")
#: A rule table of so many rows at most is sent to every task; a greater one is joined by a shuffle.
MOST_RULES = 100_000
#: Different terms up to which a text is looked through for them before anything is made of its n-grams.
MOST_SOUGHT = 2_000

#: Our own rules: kind -> rule -> terms. Callers may give their own table.
GIVEN = {
    "topic": {
        "public_safety": ("police", "fire department", "evacuation", "missing person"), "weather": ("storm", "flood warning", "heat wave", "snowfall"),
        "schools": ("school board", "teacher", "students", "graduation"), "housing": ("rent", "eviction", "zoning", "affordable housing"),
        "transport": ("road closure", "traffic", "bus route", "train service"), "business": ("small business", "layoffs", "market", "license"),
    },
    "urgency": {
        "breaking": ("breaking news", "developing story"), "high": ("evacuation order", "shelter in place", "amber alert", "boil water"), "low": ("opinion", "recap", "photo gallery"),
    },
    "sensitive": {
        "violence": ("shooting", "stabbing", "assault"), "self_harm": ("suicide", "self harm"), "abuse": ("idiot", "moron", "scum", "stupid", "child abuse"),
        "advisory": ("evacuation order", "shelter in place", "boil water"),
    },
    "beat": {
        "film": ("box office", "movie", "director", "premiere"), "music": ("album", "concert", "tour dates"), "television": ("season finale", "episode", "streaming series"),
        "trailers": ("trailer", "teaser"), "games": ("video game", "esports", "console"),
    },
    "core": {"entertainment": ("celebrity", "actor", "actress", "entertainment", "red carpet")},
    "ordinary": {"ordinary": ("city council", "budget", "election")},
    "audience": {
        "parents": ("school", "teacher", "child care"), "commuters": ("traffic", "train service", "parking"), "renters": ("rent", "eviction", "landlord"),
        "shoppers": ("discount", "groceries", "prices"),
    },
    "filler": {"filler": ("this article discusses", "in a recent development", "latest update", "read more about this story", "full report")},
    "robotic": {"robotic": ("it is important to note", "in conclusion", "delve into", "remains to be seen")},
    "overstated": {"overstated": ("proves that", "guarantees", "everyone knows", "without doubt")},
    "respect": {"respect": ("illegals", "crazy people", "these people")},
    "blocked": {"blocked": ("obituary", "obituaries", "funeral home", "things to do", "weekend guide", "homes for sale", "live stream", "where to watch", "tv channel", "betting odds", "final score", "match report", "game summary", "horoscope", "coupon")},
    "gossip": {"gossip": ("gossip", "rumor", "breakup", "dating")},
}
#: What a topic says of urgency; of what is sensitive; the least score from a kind of source.
TOPIC_HINT = {"public_safety": "high", "weather": "high"}
TOPIC_FLOOR = (("public_safety", "official"), ("business", "publisher"))


def given_rules(spark: SparkSession, kinds: tuple[str, ...] = tuple(GIVEN)) -> DataFrame:
    rows = [(k, r, t) for k in kinds for r, terms in GIVEN[k].items() for t in terms]
    return spark.createDataFrame(rows, "kind string, rule string, term string")


def term_hits(texts: DataFrame, rules: DataFrame, guard: int = 8) -> DataFrame:
    """texts (id, text), rules (kind, rule, term) -> (id, kind, rule, term, n, negated): how often a text has a term as whole
    words, and how often a negation stands within `guard` words before it. Texts are cut into n-grams of the lengths that
    terms have and joined to the rules; nothing but the hits is shuffled."""
    terms = rules.select("kind", "rule", "term", F.array_join(T.words(F.col("term")), " ").alias("gram")).where("gram <> ''").distinct()
    lengths = sorted(r[0] for r in terms.select(F.size(F.split("gram", " "))).distinct().collect())  # a few small numbers
    words = T.words(F.col("text"))
    no = F.array(*map(F.lit, NEGATIONS))
    # lambdas over an array of one work out its element once; a column could be put into the inner lambdas by the optimizer
    let = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def hit(w: Column, g: Column, i: Column) -> Column:
        return F.struct(g.alias("gram"), F.arrays_overlap(F.slice(w, F.greatest(F.lit(1), i - guard + 1), F.least(i, F.lit(guard))), no).alias("negated"))

    def of_terms(w: Column, n: int) -> Column:
        """The n-grams that are terms: one intersection says which of them a text has, and only for these the rest is worked out."""
        none = F.array().cast("array<struct<gram:string,negated:boolean>>")
        places = lambda g, found: F.array_compact(F.transform(g, lambda x, i: F.when(F.array_contains(found, x), hit(w, x, i))))
        return let(T.ngrams(w, n) if n > 1 else w, lambda g: let(F.array_intersect(g, F.col("grams")), lambda found: F.when(F.size(found) > 0, places(g, found)).otherwise(none)))

    known = terms.select("gram").distinct()
    if known.count() <= MOST_SOUGHT:
        rows = texts.select("id", "text").crossJoin(F.broadcast(known.agg(F.collect_list("gram").alias("grams"))))  # one row of MOST_SOUGHT grams at most
        cut = let(words, lambda w: F.concat(*[of_terms(w, n) for n in lengths or [1]]))
    else:
        rows = texts.select("id", words.alias("w"))
        cut = F.concat(*[F.transform(T.ngrams(F.col("w"), n), lambda g, i: hit(F.col("w"), g, i)) for n in lengths])
    # outer, or the grams would be worked out again to see whether there are any
    each = rows.select("id", F.explode_outer(cut).alias("x")).select("id", "x.gram", "x.negated")
    return each.join(beside(terms, MOST_RULES), "gram").groupBy("id", "kind", "rule", "term").agg(F.count("*").alias("n"), F.count_if("negated").alias("negated"))


def rule_scores(hits: DataFrame, kind: str, guarded: bool = False) -> DataFrame:
    """(id, rule, n_terms, n_phrases, terms): the different terms of each rule of a kind that a text has; guarded rules need
    an occurrence that isn't negated."""
    rows = hits.where(F.col("kind") == kind)
    rows = rows.where("n > negated") if guarded else rows
    return rows.groupBy("id", "rule").agg(
        F.count("*").alias("n_terms"), F.count_if(F.contains("term", F.lit(" "))).alias("n_phrases"), F.array_sort(F.collect_list("term")).alias("terms")
    )


def hits_sql(texts: str, rules: str, guard: int = 8, longest: int = 3) -> str:
    """The same for DuckDB as CTEs; texts (id, text) and rules (kind, rule, term) are CTEs or tables. Gives hits."""
    words = "list_filter(string_split(trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
    no = ", ".join(f"'{x}'" for x in NEGATIONS)
    grams = " UNION ALL ".join(
        f"SELECT id, k, unnest(range(1, len(k) - {n - 2})) AS p, {n} AS n FROM rw WHERE len(k) >= {n}" for n in range(1, longest + 1)
    )
    return f"""rw AS (SELECT id, {words.format(x='text')} AS k FROM {texts}),
rt AS (SELECT DISTINCT kind, rule, term, array_to_string({words.format(x='term')}, ' ') AS gram FROM {rules}),
rg AS (SELECT id, array_to_string(k[p:p + n - 1], ' ') AS gram, list_has_any(k[greatest(1, p - {guard}):p - 1], [{no}]) AS neg FROM ({grams})),
hits AS (SELECT id, kind, rule, term, count(*) AS n, count(*) FILTER (neg) AS negated FROM rg JOIN rt USING (gram) GROUP BY ALL)"""


def given_sql(kinds: tuple[str, ...] = tuple(GIVEN)) -> str:
    return ", ".join(f"('{k}', '{r}', '{t}')" for k in kinds for r, terms in GIVEN[k].items() for t in terms)
