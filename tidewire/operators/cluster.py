"""Story clusters by an ordered greedy fold: components of alike titles stream through it, each in order of time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.graph import components
from tidewire.operators.similarity import AlikeTitles, link_score, title_classes, title_forest


class Greedy:
    """The fold: newest first, an item joins the cluster with the best scoring link to one of its first `sample` members, or
    opens a new one. Only members that an item to come can link to are held: those of the last `hours`."""

    def __init__(self, hours: int = 30, sample: int = 6):
        self.reach, self.sample, self.opened = hours * 3600 * 1000000, sample, 0
        self.members: dict[int, tuple[int, int]] = {}  # id -> cluster, its number
        self.alike = AlikeTitles(lambda k, n, m: link_score(k, n, m) > 0)
        self.recent: deque[tuple[int, int]] = deque()
        self.sizes: dict[int, list[int]] = {}  # cluster -> first members so far, those still held

    def _forget(self, us: int) -> None:
        while self.recent and self.recent[0][0] - us > self.reach:
            cluster, _ = self.members.pop(member := self.recent.popleft()[1])
            self.alike.remove((), member)
            self.sizes[cluster][1] -= 1
            if not self.sizes[cluster][1]:
                del self.sizes[cluster]

    def step(self, item: int, us: int, tokens: frozenset[str]) -> int:
        self._forget(us)
        best, target, n = (0.0, 0), None, len(tokens)
        for member in self.alike.near((), tokens):
            title = self.alike.titles[member]
            cluster, number = self.members[member]
            if (place := (link_score(len(tokens & title), n, len(title)), -number)) > best:
                best, target = place, cluster
        if target is None:
            target, number = item, self.opened
            self.opened += 1
            self.sizes[item] = [0, 0]
        else:
            number = -best[1]
        count = self.sizes[target]
        if count[0] < self.sample:
            self.sizes[target] = [count[0] + 1, count[1] + 1]
            self.members[item] = (target, number)
            self.recent.append((us, item))
            self.alike.add((), item, tokens)
        return target


OUT = pa.schema([("id", pa.int64()), ("cluster", pa.int64())])


def story_clusters(items: DataFrame, hours: int = 30) -> DataFrame:
    """(id, cluster), cluster being its first item. Clusters never leave a component of classes of alike titles of neighbouring
    stretches of `hours`, so the fold of each gives what one pass over all would. Classes are linked, not items, by as few
    links as connect them; a component's rows stream by, without texts, and its task holds what the last hours may still link to."""
    members, classes = title_classes(items, hours)
    homes = components(title_forest(classes), "title-components").withColumnRenamed("node", "class")
    rows = members.join(homes, "class", "left").select("id", F.coalesce("component", "class").alias("component"))
    body = items.select("id", F.array_distinct("title_tokens").alias("tokens"), F.unix_micros("published_at").alias("us"), "base_score")
    width = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.join(body, "id").repartition(width, "component").sortWithinPartitions("component", F.desc("us"), F.desc("base_score"), "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        greedy, component = Greedy(hours), None
        for batch in batches:
            ids, homes, tokens, times = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "component", "tokens", "us"))
            found = []
            for i, home, k, us in zip(ids, homes, tokens, times, strict=True):
                if home != component:
                    greedy, component = Greedy(hours), home
                found.append(greedy.step(i, us, frozenset(k)))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], schema=OUT)

    found = dealt.select("id", "component", "tokens", "us", "base_score").mapInArrow(fold, "id long, cluster long")
    alone = items.where(F.size(F.array_distinct("title_tokens")) < 3).select("id", F.col("id").alias("cluster"))
    return found.unionByName(alone)
