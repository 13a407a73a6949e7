"""Keeping one row of those that are the same: by key, by fold, by url or content."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions import text as T
from tidewire.operators.shuffles import groups


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which should end in a unique column."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def keep_latest(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The latest row of each key; a plain aggregate, so partial results are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(time).alias("__t"), F.col(tie).alias("__i"), *rest)).alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def next_greater(values: list) -> list[int]:
    """For each place the first later one with a greater value, else the length."""
    out, open_ = [len(values)] * len(values), []
    for k, v in enumerate(values):
        while open_ and values[open_[-1]] < v:
            out[open_.pop()] = k
        open_.append(k)
    return out


def steps(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Rows (time, score, id) of one key in order, as a function of the row kept before them: (time, score, id kept at the end) of
    each row that a kept one may be replaced by first, which are those that exceed all before them in time or score."""
    after = [min(p) for p in zip(next_greater([r[0] for r in rows]), next_greater([r[1] for r in rows]), strict=True)]
    end = list(range(len(rows)))
    for k in range(len(rows) - 1, -1, -1):
        if after[k] < len(rows):
            end[k] = end[after[k]]
    out, most = [], (None, None)
    for k, (time, score, _) in enumerate(rows):
        if not k or time > most[0] or score > most[1]:
            out.append((time, score, *rows[end[k]]))
            most = (time, score) if not k else (max(most[0], time), max(most[1], score))
    return out


def apply_steps(kept: tuple | None, block: list[tuple]) -> tuple:
    """The (time, score, id) kept after a block of steps."""
    if kept is None:
        return tuple(block[0][2:])
    return next((tuple(x[2:]) for x in block if x[0] > kept[0] or x[1] > kept[1]), kept)


def fold_duplicates(items: DataFrame, key: str = "link", id_col: str = "id") -> DataFrame:
    """(key, id): of each key's rows in order of id, the next row replaces the kept one if it is newer or scores higher.

    That is no order, so it can't be a maximum; but a run of rows is a function of what was kept before it, and functions compose.
    Rows are dealt in ranges of (key, id), so that a key of any size lies over several tasks; each task turns its part of a key
    into steps, and the parts of a key, at most as many as there are ranges, are applied in their order."""
    kind = items.schema[key].dataType.simpleString()
    rows = items.select(F.col(key).alias("key"), F.unix_micros("published_at").alias("time"), F.col("base_score").cast("long").alias("score"), F.col(id_col).cast("long").alias("id"))
    width = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(width, "key", "id").sortWithinPartitions("key", "id")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, names = TaskContext.get().partitionId(), ["key", "part", "steps"]
        step = pa.list_(pa.struct([("at", pa.int64()), ("score", pa.int64()), ("kept_at", pa.int64()), ("kept_score", pa.int64()), ("kept", pa.int64())]))
        for group in groups(batches, "key"):
            found = steps(list(zip(*(group.column(c).to_pylist() for c in ("time", "score", "id")), strict=True)))
            told = [dict(zip(("at", "score", "kept_at", "kept_score", "kept"), x, strict=True)) for x in found]
            yield pa.record_batch([group.column("key").combine_chunks()[:1], pa.array([part]), pa.array([told], step)], names=names)

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, "key"):
            kept = None
            for block in group.column("steps").to_pylist():
                kept = apply_steps(kept, [tuple(x.values()) for x in block])
            yield pa.record_batch([group.column("key").combine_chunks()[:1], pa.array([kept[2]], pa.int64())], names=[key, id_col])

    parts = dealt.mapInArrow(summed, f"key {kind}, part long, steps array<struct<at:long,score:long,kept_at:long,kept_score:long,kept:long>>")
    return parts.repartition(width, "key").sortWithinPartitions("key", "part").mapInArrow(applied, f"`{key}` {kind}, `{id_col}` long")


def item_key(link: Column, source: Column, title: Column) -> Column:
    """The link, else source and title's letters and digits."""
    return F.coalesce(F.when(link != "", link), F.concat_ws(":", source, T.alnum_key(title)))


def fresh_signals(new: DataFrame, history: DataFrame, url: str = "url_hash", content: str = "content_hash", id_col: str = "id") -> DataFrame:
    """New signals with a rejection_reason: known url, known content, or the same within the batch (the least id stays)."""
    known = lambda c: history.select(F.col(c).alias(f"__{c}"), F.lit(True).alias(f"__known_{c}")).distinct()
    rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(id_col))
    marked = new.join(known(url), F.col(url) == F.col(f"__{url}"), "left").join(known(content), F.col(content) == F.col(f"__{content}"), "left")
    reason = F.when(F.col(f"__known_{url}") | (rank(url) > 1), "duplicate_url").when(F.col(f"__known_{content}") | (rank(content) > 1), "duplicate_content")
    return marked.withColumn("rejection_reason", reason).select(*new.columns, "rejection_reason")


def changed_keys(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys in one of two snapshots only, and in which."""
    gone = before.select(key).distinct().join(after.select(key), key, "left_anti").withColumn("change", F.lit("gone"))
    return gone.unionByName(after.select(key).distinct().join(before.select(key), key, "left_anti").withColumn("change", F.lit("new")))


def capped_log(log: DataFrame, newest: str, tie: str, cap: int) -> DataFrame:
    """The newest `cap` rows of a log; a top-k, not a sort of all."""
    return log.orderBy(F.desc(newest), F.desc(tie)).limit(cap)
