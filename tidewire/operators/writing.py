"""Copy distance between candidates and sources, and the checks that texts go through before they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators.shuffles import beside, maybe_in, saved

#: Words that hold a sentence together; a skeleton keeps them as they are.
STRUCTURE = "the and for with that this from after before while when where who which will would could are was were has have had not but into over under about".split()
#: Grams of a source table of so many at most are sent to every task; more are joined by a shuffle.
MOST_GRAMS = 2_000_000
SIZES = (3, 4, 5, 6)


def shape(word: Column) -> Column:
    """A word of a skeleton: NUM, a structure word, SHORT, or its first three letters and its length."""
    return F.when(word.rlike("^[0-9]+$"), "NUM").when(word.isin(*STRUCTURE), word).when(F.length(word) <= 3, "SHORT").otherwise(F.concat(F.substring(word, 1, 3), F.length(word).cast("string")))


def skeletons(rows: DataFrame, key: str, words: str) -> DataFrame:
    """What skeletons_alike asks of each sentence (an array of words), worked out once: (key, and as a struct `words`) its
    length, its different words, shape trigrams and structure words, as 64-bit hashes."""
    once = lambda x: F.array_distinct(F.transform(x, lambda w: F.xxhash64(w)))
    held = once(F.filter(words, lambda x: x.isin(*STRUCTURE)))
    shapes = rows.select(key, F.size(words).alias("n"), once(F.col(words)).alias("w"), held.alias("h"), F.transform(words, shape).alias("shapes"))
    return shapes.select(key, F.struct("n", "w", "h", once(T.ngrams(F.col("shapes"), 3)).alias("g")).alias(words)).distinct()


def share(a: Column, b: Column) -> Column:
    """T.overlap of arrays without repeats."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def skeletons_alike(a: Column, b: Column) -> Column:
    """skeleton_similarity of two sentences as skeletons() has them."""
    length = F.least(a["n"], b["n"]) / F.greatest(a["n"], b["n"])
    return share(a["g"], b["g"]) * 0.38 + share(a["w"], b["w"]) * 0.32 + length * 0.18 + share(a["h"], b["h"]) * 0.12


def skeleton_similarity(a: Column, b: Column) -> Column:
    """Two sentences as word arrays: .38 shared shape trigrams, .32 shared words, .18 length, .12 shared structure words."""
    grams = lambda w: T.ngrams(F.transform(w, shape), 3)
    held = lambda w: F.filter(w, lambda x: x.isin(*STRUCTURE))
    length = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    return T.overlap(grams(a), grams(b)) * 0.38 + T.overlap(a, b) * 0.32 + length * 0.18 + T.overlap(held(a), held(b)) * 0.12


def hashed(texts: DataFrame, key: str, sizes: tuple[int, ...]) -> DataFrame:
    """texts (key, tokens) with a column h<n> for each size: the 64-bit hashes of the n-grams, in order. A gram's hash is that
    of the hash of its head and its last word, so no gram is built as text."""
    rows = texts.withColumn("h1", F.transform("tokens", lambda w: F.xxhash64(w)))
    for n in range(2, max(sizes) + 1):
        rest = F.slice("h1", n, F.greatest(F.size("h1"), F.lit(1)))
        longer = F.zip_with(f"h{n - 1}", rest, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.xxhash64(x, y)))
        rows = rows.withColumn(f"h{n}", F.filter(longer, lambda x: x.isNotNull()))
    return rows.select(key, "tokens", *[f"h{n}" for n in sizes])


def sharing_grams(candidates: DataFrame, sources: DataFrame, n: int, least: float) -> DataFrame:
    """candidates (cid, tokens), sources (sid, tokens) -> (cid, sid) whose distinct n-grams overlap by `least` of the smaller
    side or more. Only grams that some source has leave a task, as hashes. Arrays are exploded as outer ones here, or Spark
    would work them out again to see whether they are empty; the join drops the nulls."""
    c, s = hashed(candidates, "cid", (n,)), hashed(sources, "sid", (n,))
    mine = c.select("cid", F.array_distinct(f"h{n}").alias("g")).select("cid", F.size("g").alias("mine"), F.explode_outer("g").alias("h"))
    theirs = s.select("sid", F.array_distinct(f"h{n}").alias("g")).select("sid", F.size("g").alias("theirs"), F.explode_outer("g").alias("h"))
    met = mine.join(beside(theirs, MOST_GRAMS), "h").groupBy("cid", "sid", "mine", "theirs").agg(F.count("*").alias("shared"))
    return met.where(F.col("shared") >= least * F.least("mine", "theirs")).select("cid", "sid")


def copied_phrases(candidates: DataFrame, sources: DataFrame, sizes: tuple[int, ...] = (6, 7, 8), chars: int = 35) -> DataFrame:
    """(cid, sid, n_copied): the different source phrases of these sizes, of `chars` characters or more, in a candidate. The
    hash of a gram follows from its words one by one, so grams of different sizes have different hashes."""
    long = F.concat(*[F.filter(T.ngrams(F.col("tokens"), n), lambda g: F.length(g) >= chars) for n in sizes])
    phrases = sources.select("sid", F.explode_outer(F.array_distinct(long)).alias("g")).where("g is not null").select("sid", F.split("g", " ").alias("tokens"))
    keyed = hashed(phrases.withColumn("key", F.struct("sid", F.size("tokens").alias("n"))), "key", sizes)
    theirs = keyed.select("key.sid", F.coalesce(*[F.when(F.col("key.n") == n, F.get(f"h{n}", F.lit(0))) for n in sizes]).alias("h")).distinct()
    # who has a phrase has its first words, as many as the shortest phrases have: only such candidates are cut into all sizes
    least = min(sizes)
    heads = beside(keyed.select(F.get(f"h{least}", F.lit(0)).alias("h")).distinct(), MOST_GRAMS)
    starts = hashed(candidates, "cid", (least,)).select("cid", F.explode_outer(f"h{least}").alias("h")).join(heads, "h", "left_semi").select("cid").distinct()
    some = maybe_in(candidates, saved(starts, "phrase-starts"), "cid")
    every = F.concat(*[F.array_distinct(f"h{n}") for n in sizes])
    mine = hashed(some, "cid", sizes).select("cid", F.explode_outer(every).alias("h"))
    return mine.join(beside(theirs, MOST_GRAMS), "h").groupBy("cid", "sid").agg(F.count("*").alias("n_copied"))


def alike_sets(candidates: DataFrame, sources: DataFrame, least: float) -> DataFrame:
    """(cid, sid) whose distinct words may be alike by `least` (Jaccard): their sizes allow for it, and they share one of the
    source's first words (in any fixed order), as many as a partner can't all lack."""
    s = sources.select("sid", F.array_sort(F.array_distinct("tokens")).alias("k")).where(F.size("k") > 0).withColumn("size", F.size("k"))
    theirs = s.select("sid", "size", F.explode_outer(F.slice("k", 1, F.col("size") - F.ceil(least * F.col("size")).cast("int") + 1)).alias("w"))
    bounds = s.agg(F.min("size").alias("low"), F.max("size").alias("high")).first()
    # no filter: it would be put before the different words, and work them out again
    c = candidates.select("cid", F.array_distinct("tokens").alias("k")).withColumn("n", F.size("k"))
    near = (F.col("n") >= least * (bounds.low or 0)) & (F.col("n") * least <= (bounds.high or 0))
    mine = c.select("cid", "n", F.explode_outer(F.when(near, F.col("k"))).alias("w"))
    met = mine.join(beside(theirs, MOST_GRAMS), "w").where((F.col("n") >= least * F.col("size")) & (F.col("size") >= least * F.col("n")))
    return met.select("cid", "sid").distinct()


def risk_of(weighted: Column, phrase: Column, structure: Column, lexical: Column, bare: Column, distinctive: Column) -> Column:
    blocked = distinctive | (phrase >= 0.72) | (structure >= 0.84) | ((lexical >= 0.92) & (bare >= 0.58) & ((phrase >= 0.45) | (structure >= 0.82)))
    high = (weighted >= 0.7) | (phrase >= 0.52) | (structure >= 0.82) | ((lexical >= 0.95) & (bare >= 0.75) & (structure >= 0.78))
    return F.when(blocked, "blocked").when(high, "high").when((weighted >= 0.42) | (bare >= 0.58) | (structure >= 0.62), "medium").otherwise("low")
