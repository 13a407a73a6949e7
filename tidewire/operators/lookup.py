"""Which texts contain which strings: an index of character grams, looked up by each query's rarest gram and verified on hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators.shuffles import join_unique, maybe_in, saved

SIZE = 3


def grams(text: Column, n: int) -> Column:
    """The different runs of n characters; none if the text is shorter."""
    places = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(places, lambda k: F.substr(text, k, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """texts (id, text) and queries (query_id, q) -> (query_id, id) of the texts that contain q, which is not empty.

    A text is cut into the grams that some query has; each query meets the texts of its rarest one, and those are compared.
    Neither side is looked through for each row of the other, and a gram that many texts hold is no hot key."""
    asked = queries.where("q <> ''").withColumn("n", F.least(F.lit(SIZE), F.length("q")))
    sizes = [r.n for r in asked.select("n").distinct().collect()]  # three at most
    none = F.array().cast("array<string>")
    own = F.coalesce(*[F.when(F.col("n") == n, grams(F.col("q"), n)) for n in sizes], none)
    parts = saved(asked.select("query_id", "q", F.explode(own).alias("gram")), "lookup-queries")
    wanted = parts.select("gram").distinct()
    cut = texts.select("id", F.explode(F.concat(*[grams(F.col("text"), n) for n in sizes], none)).alias("gram"))
    index = saved(maybe_in(cut, wanted, "gram").join(wanted, "gram", "left_semi"), "lookup-index")
    held = index.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no text has answers its query with nothing
    rare = parts.join(held, "gram", "left").groupBy("query_id", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")).where("best.n > 0")
    by_gram = rare.groupBy(F.col("best.gram").alias("gram")).agg(F.collect_list(F.struct("query_id", "q")).alias("asks"))
    met = join_unique(index, by_gram, "gram", counts=held).select("id", F.explode("asks").alias("ask"))
    return met.join(texts, "id").where(F.contains("text", F.col("ask.q"))).select("ask.query_id", "id").distinct()


def words_containing(postings: DataFrame, tokens: DataFrame) -> DataFrame:
    """postings (id, word) and tokens (token) -> (id, token), where a word of id contains the token. Tokens are looked up in the
    vocabulary, not in the texts."""
    postings = saved(postings, "lookup-postings")
    vocabulary = saved(postings.groupBy("word").agg(F.count("*").alias("n")), "lookup-words")
    found = containing(vocabulary.select(F.col("word").alias("id"), F.col("word").alias("text")), tokens.select(F.col("token").alias("query_id"), F.col("token").alias("q")).distinct())
    by_word = found.groupBy(F.col("id").alias("word")).agg(F.collect_list("query_id").alias("tokens"))
    return join_unique(postings, by_word, "word", counts=vocabulary).select("id", F.explode("tokens").alias("token")).distinct()


def token_hits(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """texts (id, text in lower case) and queries (query_id, tokens of letters and digits) -> (query_id, token, n, id): texts
    that contain a token, which the query has n times."""
    asked = saved(queries.select("query_id", F.explode("tokens").alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("n")), "lookup-tokens")
    met = saved(words_containing(texts.select("id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")), asked.select("token")), "lookup-hits")
    askers = asked.groupBy("token").agg(F.collect_list(F.struct("query_id", "n")).alias("asks"))
    return join_unique(met, askers, "token").select("id", "token", F.explode("asks").alias("ask")).select("ask.query_id", "token", "ask.n", "id")


def near_words(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """texts (id, said: words between blanks) and phrases (key, phrase) -> (id, key): texts that hold the rarest word of one of a
    key's phrases. Whoever says a phrase is among them; the caller compares."""
    asks = saved(phrases.select("key", "phrase", F.explode(F.filter(F.split("phrase", " "), lambda w: w != "")).alias("word")).distinct(), "near-asks")
    wanted = asks.select("word").distinct()
    cut = texts.select("id", F.explode(F.array_distinct(F.filter(F.split("said", " "), lambda w: w != ""))).alias("word"))
    index = saved(maybe_in(cut, wanted, "word").join(wanted, "word", "left_semi"), "near-index")
    held = index.groupBy("word").agg(F.count("*").alias("n"))
    rare = asks.join(held, "word", "left").groupBy("key", "phrase").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("best")).where("best.n > 0")
    by_word = rare.groupBy(F.col("best.word").alias("word")).agg(F.collect_set("key").alias("keys"))
    return join_unique(index, by_word, "word", counts=held).select("id", F.explode("keys").alias("key")).distinct()


def phrases_in(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """texts (id, said: words between blanks, one at each end) and phrases (phrase) -> (id, phrase) of the texts that say it."""
    met = near_words(texts, phrases.where("phrase <> ''").select(F.col("phrase").alias("key"), "phrase"))
    return met.join(texts, "id").where(F.contains("said", F.concat(F.lit(" "), "key", F.lit(" ")))).select("id", F.col("key").alias("phrase"))
