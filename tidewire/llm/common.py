"""What several operators of this folder share: tables, saved tables, grouped work on sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.operators.shuffles import beside
from tidewire.operators.shuffles import groups as groups_in_arrow
from tidewire.operators.shuffles import saved as written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_sorted_key(
    df: DataFrame, key: str, work: Callable[[pa.Table], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """work on each group of equal keys. Groups are bounded by whoever builds the key; many small ones share a task
    without a call of Spark for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in_arrow(batches, key):
            out = work(group)
            if out is not None and out.num_rows:
                yield out

    width = shuffle_width(df.sparkSession)
    return df.repartition(width, key).sortWithinPartitions(key).mapInArrow(run, schema)


#: `at` holds the number of a partition above this many bits, the place in the partition below.
PLACE_BITS = 33


def in_order(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows as a saved table, with `at` long: it rises with `order` over the whole table (nulls first), without repeats and
    with gaps. Rows are dealt in ranges of `order`, so a hot value is split as long as later columns differ."""
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).sortWithinPartitions(*order)
    return written(dealt.withColumn("at", F.monotonically_increasing_id()), name)


def with_slots(placed: DataFrame, group: str) -> DataFrame:
    """placed, as in_order saved it with group (not null) first, with slot long (from 0, without gaps in its group) and
    group_size long in place of `at`. No group meets in one task: a partition's part of a group starts behind the
    parts before it, and only a row for each part is ranked."""
    part = F.shiftright("at", PLACE_BITS)
    parts = placed.groupBy(group, part.alias("__part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    up_to = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = parts.select(group, "__part", (F.sum("n").over(up_to) - F.col("n") - F.col("first")).alias("__shift"), F.sum("n").over(Window.partitionBy(group)).alias("group_size"))
    met = placed.withColumn("__part", part).join(beside(starts), [group, "__part"])
    return met.withColumn("slot", F.col("at") + F.col("__shift")).drop("__part", "__shift", "at")


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with slot and group_size, by group (not null) and order."""
    return with_slots(in_order(rows, [group, *order], name), group)
