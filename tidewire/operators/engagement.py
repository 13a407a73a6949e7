"""Engagement: post scores, shapes, profiles, seen state, windows, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import text as T


def post_score(clicks: Column, saves: Column, follows: Column, views: Column, reports: Column) -> Column:
    """5 a click, 3 a save, 2 a follow, 0.01 a view, less 18 a report; not below 0."""
    return F.greatest(F.lit(0), T.half_up(clicks * 5 + saves * 3 + follows * 2 + views * 0.01 - reports * 18)).cast("long")


def best_shapes(posts: DataFrame, keys: list[str], shape: str = "shape", score: str = "score") -> DataFrame:
    """Of each group the best shape by mean score, where it reaches 8 and 1.15 times the second's."""
    stats = posts.groupBy(*keys, shape).agg(F.avg(score).alias("mean_score"), F.count("*").alias("n"))
    ranked = stats.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("mean_score"), shape))).where("rank <= 2")
    of = lambda r, c: F.max(F.when(F.col("rank") == r, F.col(c)))
    two = ranked.groupBy(*keys).agg(of(1, shape).alias("best"), of(2, shape).alias("second"), of(1, "mean_score").alias("best_score"), of(2, "mean_score").alias("second_score"), F.sum("n").alias("n"))
    return two.where((F.col("best_score") > 0) & (F.col("best_score") >= F.greatest(F.lit(8.0), F.col("second_score") * 1.15)))


def profiles(events: DataFrame, user: str = "user_id", category: str = "category", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """(user, category, views, streaks, score): 1 a view and 5 more each time a run of one category reaches three views,
    times 0.7 for each gap of over seven days within the category.

    Runs are found with windows per user (islands); the decay of a gap applies to all before it, which is 0.7 to the power
    of the gaps after a view, so the score is a sum and needs no fold."""
    w = Window.partitionBy(user).orderBy(time, tie)
    c = Window.partitionBy(user, category).orderBy(time, tie)
    seq = events.withColumns({"n": F.row_number().over(w), "m": F.row_number().over(c), "last": F.lag(time).over(c)})
    seq = seq.withColumn("island", F.col("n") - F.col("m"))
    place = F.row_number().over(Window.partitionBy(user, category, "island").orderBy("n"))
    seq = seq.withColumns({"third": (place == 3).cast("int"), "gap": (F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp")) > 7 * 86400 * 1000000).cast("int")})
    later = Window.partitionBy(user, category).orderBy(F.desc(time), F.desc(tie)).rowsBetween(Window.unboundedPreceding, -1)
    gaps = F.coalesce(F.sum(F.coalesce("gap", F.lit(0))).over(later), F.lit(0))
    worth = (1 + 5 * F.col("third")) * F.pow(F.lit(0.7), gaps)
    return seq.withColumn("worth", worth).groupBy(user, category).agg(F.count("*").alias("views"), F.sum("third").alias("streaks"), F.round(F.sum("worth"), 6).alias("score"))


def sessions(events: DataFrame, gap: str = "30 minutes", user: str = "user_id", time: str = "ts") -> DataFrame:
    """(user, session start, end, events, seconds between first and last)."""
    out = events.groupBy(user, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n_events"), F.min(time).alias("first_at"), F.max(time).alias("last_at"))
    return out.select(user, "first_at", "last_at", "n_events", (F.unix_seconds(F.col("last_at").cast("timestamp")) - F.unix_seconds(F.col("first_at").cast("timestamp"))).alias("seconds"))
