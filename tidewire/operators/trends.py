"""Trend topics, attention and the stories of the day and week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators.shuffles import beside


def attention(weekly: bool = False) -> Column:
    """0 to 100 of clicks, views, velocity, social score and sustained days."""
    days = F.col("sustained_days")
    bonus = F.least(F.lit(28.0), days * 8) if weekly else F.least(F.lit(12.0), days * 4)
    total = F.col("clicks") * (2.05 if weekly else 2.35) + F.col("views") * 0.08 + F.col("velocity") * (7 if weekly else 10) + F.col("social_score") * 0.45 + bonus
    return T.clamp(total.cast("double"), 0.0, 100.0)


def freshness(hours: Column, limit: float) -> Column:
    return F.when(hours > limit, 0.0).otherwise(T.clamp(100 - F.greatest(F.lit(0.0), hours) / limit * 100, 0.0, 100.0))


def significance() -> Column:
    return T.clamp(F.greatest(F.lit(1), "source_count") * 14 + F.greatest(F.lit(1.0), "source_weight") * 12 + F.col("score") * 0.55, 0.0, 100.0)


def quality() -> Column:
    words = F.size(T.words(F.col("summary")))
    return (F.when(words >= 18, 28) .otherwise(12) + F.when(F.length("source_name") > 0, 18).otherwise(6) + F.when(F.length("title") > 20, 22).otherwise(10)).cast("double")


def strength(daily: bool = True) -> Column:
    """Of one signal; a topic has the greatest of its signals."""
    preferred = F.col("timeframe").isin(*(("24h", "48h", "72h") if daily else ("72h", "7d", "30d")))
    sustained = F.lit(1.0) if daily else T.clamp(F.col("signal_days") / 3, 0.35, 1.4)
    growth = T.clamp(50 + F.col("baseline_delta") * 0.3 + F.col("growth_rate") * 0.25, 0.0, 100.0) / 100
    return F.col("interest") * F.col("confidence") * F.when(preferred, 1.0).otherwise(0.65) * sustained * (0.8 + growth * 0.4)


def matches(stories: DataFrame, signals: DataFrame) -> DataFrame:
    """(id, signal_id, overlap): the signal's topic stands in the story as whole words, or a share of 0.22 of keywords agrees
    (0.25 where the categories differ). Candidates come from equi joins on keywords, and on the story's words and pairs of
    neighbouring words as topics."""
    s = stories.select("id", "category", F.array_distinct("keywords").alias("keywords"), T.words(F.lower(F.concat_ws(" ", "title", "summary"))).alias("said"))
    g = signals.select("signal_id", F.col("category").alias("signal_category"), F.array_distinct("keywords").alias("signal_keywords"), F.lower("topic").alias("topic"))
    own = beside(g.select("signal_id", F.explode("signal_keywords").alias("word")))
    shared = s.select("id", F.explode("keywords").alias("word")).join(own, "word").groupBy("id", "signal_id").agg(F.count("*").alias("shared"))
    phrases = s.select("id", F.explode_outer(F.array_distinct(F.concat("said", T.ngrams(F.col("said"), 2)))).alias("topic"))
    stands = phrases.join(beside(g.where("topic <> ''").select("signal_id", "topic")), "topic").select("id", "signal_id", F.lit(True).alias("stands"))
    met = shared.join(stands, ["id", "signal_id"], "full").join(s.select("id", "category", F.size("keywords").alias("n")), "id").join(g.select("signal_id", "signal_category", F.size("signal_keywords").alias("m")), "signal_id")
    overlap = F.when((F.col("n") == 0) | (F.col("m") == 0), 0.0).otherwise(F.coalesce("shared", F.lit(0)) / F.least("n", "m"))
    same = (F.col("signal_category") == "top") | (F.col("signal_category") == F.col("category")) | (overlap >= 0.25)
    return met.where(same & (F.coalesce("stands", F.lit(False)) | (overlap >= 0.22))).select("id", "signal_id", overlap.alias("overlap"))
