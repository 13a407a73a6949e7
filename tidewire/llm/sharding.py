"""Resharding by minimum-cost flow: documents are moved between shards in blocks so that new sizes hold and few bytes move.

Each old shard is cut into blocks by a hash, so a block is a small share of its shard at any size. The blocks' sizes, at most
shards x blocks numbers, are all that the driver sees. A flow from old sizes to new capacities (nothing for bytes that stay,
a price for those that move) says how many bytes go where; whole blocks fill it, the largest first, and the last small
differences are evened out. Rows follow their block through a broadcast map of the same bound: no row of text is shuffled for
that. Only shards that gain or lose a block are written again, in ranges, so a shard of any size is many files.

Defined results: a null text has no bytes; a null or repeated doc_id is a value like any other; rows equal in doc_id and text
stay in one block; an empty table has no rows in any shard. Columns named as those that are added are dropped first."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import shuffle_width, with_slots

#: Bytes that a row needs besides its text.
ROW_BYTES = 16
ADDED = ("size", "text_crc32", "old", "block", "shard", "slot", "at")
Blocks = dict[tuple[int, int], int]


def measured(docs: DataFrame, old: Column | None = None, blocks: int = 1024) -> DataFrame:
    """docs with size, text_crc32, old (the shard a row is in) and block."""
    text_crc = F.coalesce(F.crc32("text"), F.lit(0).cast("long"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    named = docs.select(*kept, *([F.col("old")] if old is None else [old.cast("int").alias("old")]))
    named = named.withColumns({"size": size, "text_crc32": text_crc})
    return named.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int"))


def capacities(total: int, shards: int) -> list[int]:
    """Sizes as equal as whole bytes allow."""
    return [total // shards + (k < total % shards) for k in range(shards)]


def cheapest_flow(supply: list[int], capacity: list[int], price: Callable[[int, int], int]) -> dict[tuple[int, int], int]:
    """(old, new) -> bytes, at the least sum of price x bytes: shortest augmenting paths with potentials. Supplies and
    capacities sum up to the same. Old shards are nodes 1.., new ones follow; one node for each shard is all it holds."""
    n, m = len(supply), len(capacity)
    source, sink = 0, n + m + 1
    left: list[dict[int, int]] = [{} for _ in range(n + m + 2)]  # what may still flow
    cost: dict[tuple[int, int], int] = {}

    def edge(a: int, b: int, most: int, unit: int) -> None:
        left[a][b], cost[a, b], cost[b, a] = most, unit, -unit
        left[b].setdefault(a, 0)

    for i, x in enumerate(supply):
        edge(source, 1 + i, x, 0)
        for j in range(m):
            edge(1 + i, 1 + n + j, x, price(i, j))
    for j, x in enumerate(capacity):
        edge(1 + n + j, sink, x, 0)
    rank = [0] * (n + m + 2)
    while True:
        far, back, todo = {source: 0}, {}, [(0, source)]
        while todo:
            d, a = heapq.heappop(todo)
            if d > far[a]:
                continue
            for b, most in left[a].items():
                if most > 0 and d + cost[a, b] + rank[a] - rank[b] < far.get(b, float("inf")):
                    far[b], back[b] = d + cost[a, b] + rank[a] - rank[b], a
                    heapq.heappush(todo, (far[b], b))
        if sink not in far:
            return {(i, j): x for i in range(n) for j in range(m) if (x := left[1 + n + j].get(1 + i, 0))}
        most_far = max(far.values())
        rank = [r + far.get(k, most_far) for k, r in enumerate(rank)]
        path, b = [], sink
        while b != source:
            path.append((back[b], b))
            b = back[b]
        amount = min(left[a][b] for a, b in path)
        for a, b in path:
            left[a][b] -= amount
            left[b][a] += amount


def transfers(sizes: Blocks, room: list[int], price: Callable[[int, int], int] | None = None, tolerance: float = 1e-3) -> dict[tuple[int, int], int]:
    """(old, block) -> new shard. Blocks fill the cheapest flow, the largest first, each going where most of its shard's flow
    is still open; then blocks go from full shards to empty ones until these differ by less than tolerance of a shard."""
    stay_free = price or (lambda old, new: int(old != new))
    olds = sorted({old for old, _ in sizes})
    supply = [sum(x for (o, _), x in sizes.items() if o == old) for old in olds]
    flow = cheapest_flow(supply, room, lambda i, j: stay_free(olds[i], j))
    open_ = {old: {j: x for (i, j), x in flow.items() if olds[i] == old} for old in olds}
    home: dict[tuple[int, int], int] = {}
    held: list[list] = [[] for _ in room]  # (size, block), ascending
    load = [-x for x in room]  # above or below what it should hold
    for key, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        most = open_[key[0]]
        j = max(most, key=lambda j: (most[j], j == key[0], -j))
        most[j] -= size
        home[key] = j
        insort(held[j], (size, key))
        load[j] += size
    while len(room) > 1:
        low = min(range(len(room)), key=load.__getitem__)
        for high in sorted(range(len(room)), key=lambda j: -load[j]):
            gap = load[high] - load[low]
            if gap <= tolerance * sum(room) / len(room):
                return home
            near = bisect_left(held[high], (gap // 2, (-1, -1)))
            best = min((x for x in held[high][max(0, near - 1) : near + 1] if 0 < x[0] < gap), key=lambda x: abs(2 * x[0] - gap), default=None)
            if best:
                held[high].remove(best)
                insort(held[low], best)
                home[best[1]] = low
                load[high] -= best[0]
                load[low] += best[0]
                break
        else:
            return home
    return home


def plan(rows: DataFrame, shards: int, room: list[int] | None = None, price: Callable[[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """The moves of measured rows to `shards` shards: of equal sizes, or as `room` (bytes by shard) shares them out."""
    found = rows.groupBy("old", "block").agg(F.sum("size").alias("size")).collect()  # shards x blocks numbers at most
    sizes = {(r.old, r.block): r["size"] for r in found}
    total = sum(sizes.values())
    if room is not None:
        asked = sum(room)
        room = [total * x // asked for x in room]
        room[0] += total - sum(room)
    return transfers(sizes, room or capacities(total, shards), price) if sizes else {}


def moved(rows: DataFrame, moves: dict[tuple[int, int], int]) -> DataFrame:
    """Measured rows with their new shard."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(o, b, s) for (o, b), s in sorted(moves.items())], "old int, block int, shard int")
    return rows.join(F.broadcast(table), ["old", "block"])  # shards x blocks rows at most


def write_shards(rows: DataFrame, folder: str, order: list[str]) -> DataFrame:
    """rows with `shard` as files under folder/shard=K, in order; returns what was written, with slot, the place in the shard."""
    keys = ["shard", *order]
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = dealt.withColumn("at", F.monotonically_increasing_id())
    placed.write.partitionBy("shard").parquet(folder)
    return with_slots(rows.sparkSession.read.schema(placed.schema).parquet(folder), "shard").drop("group_size")


ORDER = ["doc_id", "text_crc32", "size"]


def lay_out(docs: DataFrame, folder: str, shards: int, old: Column | None = None, blocks: int = 1024) -> DataFrame:
    """The first version of a sharded table under folder: docs, that are in shards `old` (one, if none are given), moved to
    `shards` shards of equal bytes. Returns its rows with size, text_crc32, shard and slot."""
    rows = measured(docs, F.lit(0) if old is None else old, blocks)
    moves = plan(rows, shards)
    placed = write_shards(moved(rows, moves).drop("old", "block"), f"{folder}/v=1", ORDER)
    _publish(docs.sparkSession, folder, 1, {s: 1 for s in moves.values()})
    return placed


def _publish(spark: SparkSession, folder: str, version: int, shards: dict[int, int]) -> None:
    """The list of a version's shards and where their files are; what has no list is not part of the table."""
    rows = spark.createDataFrame([(s, v) for s, v in sorted(shards.items())], "shard int, v int").coalesce(1)
    rows.write.parquet(f"{folder}/manifest/version={version}")


def published(spark: SparkSession, folder: str) -> tuple[int, dict[int, int]]:
    """The latest version and, for each of its shards, the version that wrote its files."""
    lists = spark.read.schema("shard int, v int, version int").parquet(f"{folder}/manifest")
    version = lists.agg(F.max("version")).first()[0]
    return version, {r.shard: r.v for r in lists.where(F.col("version") == version).collect()}  # one row for each shard


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the latest version, with shard."""
    _, shards = published(spark, folder)
    if not shards:
        raise ValueError(f"{folder} has no shard with rows")
    files = [f"{folder}/v={v}/shard={s}" for s, v in sorted(shards.items())]
    return spark.read.option("basePath", folder).parquet(*files).drop("v", "at")


def reshard(spark: SparkSession, folder: str, shards: int, room: list[int] | None = None, price: Callable[[int, int], int] | None = None, blocks: int = 1024) -> dict[int, int]:
    """The next version of the table under folder, with `shards` shards (of equal sizes, or as room shares them out). Only files
    of shards that gain or lose a block are read whole and written again; the others stay where they are. Returns {shard:
    version of its files}."""
    version, before = published(spark, folder)
    rows = measured(stored(spark, folder).withColumnRenamed("shard", "old"), None, blocks)
    moves = plan(rows, shards, room, price)
    touched = {s for (old, _), new in moves.items() if old != new for s in (old, new)}
    affected = moved(rows.where(F.col("old").isin(*touched)), moves) if touched else None
    if affected is not None:
        write_shards(affected.drop("old", "block"), f"{folder}/v={version + 1}", ORDER)
    after = {s: version + 1 if s in touched else before[s] for s in set(moves.values())}
    _publish(spark, folder, version + 1, after)
    return after
