"""Structured Streaming jobs: dedupe, engagement windows, page counters, reader profiles, live clusters, refresh.

Each takes a streaming (or, for the transforms, a batch) DataFrame. Late rows are waited for as long as the public
window lasts. Streams keep their state in the checkpoint that the caller gives; a restart goes on from there."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PUBLIC_WINDOW = "7 days"


def fresh(signals: DataFrame, time: str = "fetched_at", keys: tuple[str, ...] = ("url_hash", "content_hash")) -> DataFrame:
    """The first signal of each url, then of each content, within the window."""
    out = signals.withWatermark(time, PUBLIC_WINDOW)
    for key in keys:
        out = out.dropDuplicatesWithinWatermark([key])
    return out


def velocity(events: DataFrame, time: str = "ts", size: str = "6 hours", slide: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Events and value by type in sliding windows."""
    w = events.withWatermark(time, late).groupBy(F.window(time, size, slide).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "value")


def page_counters(events: DataFrame, time: str = "ts", day: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events of each user and day."""
    w = events.withWatermark(time, late).groupBy(F.window(time, day).alias("w"), "user_id")
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("views")).select(F.col("w.start").alias("day"), "user_id", "n", "views")


def interest(rows: list[tuple[int, int, str]], state: dict[str, list], run: list) -> None:
    """Adds views (micros, event_id, category) in order: +1, +5 when a run of one category reaches three, and 0.7 of what
    was there after a gap of over seven days in the category."""
    for at, _, category in sorted(rows):
        kept = state.setdefault(category, [0.0, 0, 0, at])
        if at - kept[3] > 7 * 86400 * 1000000:
            kept[0] *= 0.7
        run[:] = [category, run[1] + 1 if run[0] == category else 1]
        third = run[1] == 3
        kept[0] += 1 + 5 * third
        kept[1] += 1
        kept[2] += third
        kept[3] = at


PROFILE = "user_id long, category string, views long, streaks long, score double"


def profiles(views: DataFrame) -> DataFrame:
    """views (user_id, ts, event_id, category) -> each changed profile row; the state of a user is a row per category."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, values, run = state.get if state.exists else ([], [], ["", 0])
        kept = dict(zip(names, (list(v) for v in values), strict=True))
        run = [run[0], int(run[1])]
        rows = [(int(t), int(i), c) for f in frames for t, i, c in zip(f["at"], f["event_id"], f["category"], strict=True)]
        interest(rows, kept, run)
        state.update((list(kept), [[float(x) for x in v] for v in kept.values()], [run[0], str(run[1])]))
        out = [(key[0], c, int(v[1]), int(v[2]), round(v[0], 6)) for c, v in kept.items()]
        yield pd.DataFrame(out, columns=["user_id", "category", "views", "streaks", "score"])

    rows = views.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "category")
    kind = "names array<string>, values array<array<double>>, run array<string>"
    return rows.groupBy("user_id").applyInPandasWithState(update, PROFILE, kind, "update", GroupStateTimeout.NoTimeout)


def live_clusters(signals: DataFrame) -> DataFrame:
    """signals (cluster_key, signal_id, source_id, at timestamp) -> an event for each cluster that opens or gains a source;
    a cluster ends when seven days pass without a signal."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], "expired", 0)], columns=["cluster_key", "event_type", "source_count"])
            return
        sources = set(state.get[0]) if state.exists else set()
        latest, out = 0, []
        for f in frames:
            for at, source in sorted(zip(f["at"], f["source_id"], strict=True)):
                latest = max(latest, int(at) // 1000)
                if source not in sources:
                    out.append((key[0], "source_added" if sources else "first_seen", len(sources) + 1))
                    sources.add(source)
        state.update((sorted(sources),))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1) + 7 * 86400 * 1000)
        yield pd.DataFrame(out, columns=["cluster_key", "event_type", "source_count"])

    timed = signals.withWatermark("at", PUBLIC_WINDOW).withColumn("ms", F.unix_micros(F.col("at").cast("timestamp")))
    rows = timed.select("cluster_key", "source_id", F.col("ms").alias("at_us"), F.col("at").alias("event_at"))
    renamed = rows.withColumnRenamed("at_us", "at")
    return renamed.groupBy("cluster_key").applyInPandasWithState(update, "cluster_key string, event_type string, source_count long", "sources array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def refresh(landed: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str):
    """Every available batch of landed rows to rebuild(batch, number); a batch that fails is tried again on restart."""
    return landed.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drains what is there into Parquet. In update mode each batch is a table of its own under path."""
    if mode == "append":
        job = stream.writeStream.format("parquet").option("path", path).outputMode("append")
    else:
        job = stream.writeStream.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)).outputMode(mode)
    job.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
