"""Live stories on a stream: the match ladder as a stateful processor for each city, expiry by event-time timers, and tables
that micro-batches write once.

The session needs the RocksDB state store (ROCKSDB). A city's live stories are one map in its state; a story leaves it, with one
`expired` event, when the watermark passes the hour in which its life ends. A second map says which stories end in an hour, so
there is a timer for each hour, and it reads its own stories only. Late rows beyond the watermark are dropped by the engine."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators import ladder

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
NOWHERE = "\0"


class LiveStories(StatefulProcessor):
    """A city's ladder; only stories that a batch touches are written back."""

    def __init__(self, hours: int, least: float, days: int):
        self.rule = (hours, least, days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stories = handle.getMapState("stories", "cluster long", "story string")
        self.ends = handle.getMapState("ends", "hour long", "clusters string")

    def _events(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=ladder.EVENT_ARROW.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fold = ladder.Ladder(*self.rule)
        for _, (story,) in self.stories.iterator():
            fold.add(json.loads(story))
        known, names = set(fold.stories), [*ladder.COLUMNS]
        signals = [s for frame in rows for s in zip(*(frame[c].tolist() for c in names), strict=True)]
        signals.sort(key=lambda s: (s[-1], s[0]))  # us, signal_id
        touched, out = {}, []
        for s in signals:
            events = fold.step(plain(dict(zip(names, s, strict=True))))
            touched |= {e[1]: fold.stories[e[1]] for e in events}
            out += events
        ending: dict[int, list[int]] = defaultdict(list)
        for number, story in touched.items():
            self.stories.updateValue((number,), (json.dumps(fold.stored(story)),))
            if number not in known:
                ending[-(-(story["at"] + fold.life) // ladder.HOUR)].append(number)
        for hour, numbers in ending.items():
            self.ends.updateValue((hour,), (json.dumps(self._ending(hour) + numbers),))
            self.handle.registerTimer(hour * (ladder.HOUR // 1000))
        yield self._events(out)

    def _ending(self, hour: int) -> list[int]:
        return json.loads(self.ends.getValue((hour,))[0]) if self.ends.containsKey((hour,)) else []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hour = expiredTimerInfo.getExpiryTimeInMs() * 1000 // ladder.HOUR
        life = ladder.Ladder(*self.rule).life
        gone = [json.loads(self.stories.getValue((number,))[0]) for number in self._ending(hour)]
        for story in gone:
            self.stories.removeKey((story["id"],))
        self.ends.removeKey((hour,))
        yield self._events([(s["city"], s["id"], None, "expired", "", s["label"], s["at"] + life) for s in gone])

    def close(self) -> None:
        pass


def plain(s: dict) -> dict:
    """A row as the fold takes it: nulls as None, arrays as lists."""
    listed = ("title_tokens", "refs", "entities", "source_kinds")
    out = {k: (None if v is None else list(v)) if k in listed else (None if v is None or v != v else v) for k, v in s.items()}
    return out | {"city": None if s["city"] == NOWHERE else s["city"], "source_id": None if out["source_id"] is None else int(out["source_id"])}


def live_stories(signals: DataFrame, hours: int = 72, least: float = 0.52, days: int = 7, late: str = "1 hour") -> DataFrame:
    """A stream of signals (as match_ladder takes them) -> a stream of events. Stories are kept by city: signals of unknown places
    are a city of their own here, and stories of several cities that share a url or content are joined by reconcile()."""
    rows = signals.withWatermark("at", late)
    keyed = rows.select(*[F.coalesce("city", F.lit(NOWHERE)).alias("city") if c == "city" else F.col(c) for c in ladder.COLUMNS[:-1]], "at", F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    return keyed.groupBy("city").transformWithStateInPandas(LiveStories(hours, least, days), ladder.EVENT, "append", "eventTime")


def write_batch(batch: DataFrame, number: int, path: str) -> None:
    """A micro-batch as path/batch=N. A batch that is run again replaces what it wrote before, so each row is there once."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def run_events(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drains a stream of events into path, batch by batch."""
    job = stream.writeStream.outputMode("append").foreachBatch(lambda df, n: write_batch(df, n, path))
    job.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_events(spark: SparkSession, path: str, schema: str = ladder.EVENT) -> DataFrame:
    return spark.read.schema(f"{schema}, batch long").parquet(path)


def reconcile(events: DataFrame, signals: DataFrame) -> DataFrame:
    """Events of run_events and the signals they tell of -> (cluster, story): stories of several cities that share a url or
    content are one."""
    attached = events.where("signal_id is not null and event <> 'confidence_changed'").select("signal_id", "cluster")
    hashes = signals.select("signal_id", F.explode(F.array_compact(F.array(F.concat(F.lit("u:"), "url_hash"), F.concat(F.lit("c:"), "content_hash")))).alias("hash"))
    return ladder.joined_cities(attached.join(hashes, "signal_id").select("cluster", "hash"))
