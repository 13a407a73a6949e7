"""Refresh of landed JSON lines with each source on its own: what can't be read keeps its source out, and no other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tidewire.streaming.live import write_batch

BROKEN = "_broken"


def parsed(lines: DataFrame, schema: StructType) -> DataFrame:
    """lines (source, value) with the fields of schema; _broken holds a line that is no such record, else null."""
    whole = StructType([*schema.fields]).add(BROKEN, StringType())
    read = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    rows = lines.select("source", read.alias("r"), "value").select("source", "r.*", "value")
    empty = F.trim(F.coalesce("value", F.lit(""))) == ""
    return rows.withColumn(BROKEN, F.when(F.col(BROKEN).isNotNull() | empty, F.coalesce("value", F.lit("")))).drop("value")


def split_sources(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A parsed batch -> (rows of sources without a broken line, the broken lines). Sources are few: their names are broadcast."""
    broken = batch.where(F.col(BROKEN).isNotNull()).select("source", F.col(BROKEN).alias("line"))
    return batch.join(F.broadcast(broken.select("source").distinct()), "source", "left_anti").drop(BROKEN), broken


def run(lines: DataFrame, schema: StructType, base: str) -> None:
    """Drains a stream of lines: items under base/items, broken lines under base/quarantine, each batch in a folder of its own that
    a second run of the batch replaces."""
    stream = parsed(lines, schema)

    def write(batch: DataFrame, number: int) -> None:
        good, broken = split_sources(batch)
        write_batch(broken, number, f"{base}/quarantine")
        write_batch(good, number, f"{base}/items")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


def refreshed(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """Items of the sources that have no line in quarantine."""
    kept = StructType([*schema.fields]).add("batch", "long")
    names = [f.name for f in schema.fields]
    items = spark.read.schema(kept if "source" in names else kept.add("source", "string")).parquet(f"{base}/items")
    return items.join(F.broadcast(quarantined(spark, base).select("source")), "source", "left_anti").drop("batch")


def quarantined(spark: SparkSession, base: str) -> DataFrame:
    """(source, n) of what could not be read."""
    lines = spark.read.schema("source string, line string, batch long").parquet(f"{base}/quarantine")
    return lines.groupBy("source").agg(F.count("*").alias("n"))


def release(spark: SparkSession, base: str, source: str) -> None:
    """Takes a source out of quarantine once its lines have been mended; what it sends from then on counts."""
    lines = spark.read.schema("source string, line string, batch long").parquet(f"{base}/quarantine")
    for number in [r.batch for r in lines.where(F.col("source") == source).select("batch").distinct().collect()]:  # batches with faults
        rest = spark.createDataFrame(lines.where((F.col("batch") == number) & (F.col("source") != source)).select("source", "line").toArrow(), "source string, line string")
        write_batch(rest, number, f"{base}/quarantine")
