"""Tables in versions: data first, then one small file that makes it the table. Readers hold on to the version they opened.

A version's data is a folder of its own; versions/N.json names it. That file is created only if it is not there, which stores of
the Hadoop kind do in one step, so of two writers one fails and no reader sees half a table. A writer that dies before has changed
nothing; clean() takes away what no version names."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def versions(spark: SparkSession, base: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{base}/versions") if n.endswith(".json"))


def stage(df: DataFrame, base: str) -> tuple[str, str]:
    """Writes the data of a version to be; (folder, schema). No reader sees it yet."""
    folder = f"data/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{base}/{folder}")
    return folder, df.schema.json()


def publish(spark: SparkSession, base: str, staged: tuple[str, str], after: int | None = None) -> int:
    """Makes staged data the next version; `after` is the version that it was made from (the latest, if None). If another writer
    was faster, this raises and the table is as that one left it."""
    number = 1 + (max(versions(spark, base), default=0) if after is None else after)
    fs, where = _fs(spark, f"{base}/versions/{number:012d}.json")
    if fs.exists(where):
        raise FileExistsError(f"version {number} of {base} is there already")
    out = fs.create(where, False)
    try:
        out.write(bytearray(json.dumps({"folder": staged[0], "schema": staged[1]}).encode()))
    finally:
        out.close()
    return number


def replace(df: DataFrame, base: str) -> int:
    """The whole table anew; its version."""
    spark = df.sparkSession
    before = max(versions(spark, base), default=0)
    return publish(spark, base, stage(df, base), before)


def _entry(spark: SparkSession, base: str, version: int) -> dict:
    text = "".join(r.value for r in spark.read.text(f"{base}/versions/{version:012d}.json").collect())  # one line
    return json.loads(text)


def read(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The latest version or a given one. The frame stays with it, whatever is published later."""
    from pyspark.sql.types import StructType

    if version is None:
        version = max(versions(spark, base), default=0)
    if not version:
        raise FileNotFoundError(f"{base} has no version")
    entry = _entry(spark, base, version)
    return spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{base}/{entry['folder']}")


def clean(spark: SparkSession, base: str, keep: int = 3, pinned: tuple[int, ...] = ()) -> list[int]:
    """Deletes all but the last `keep` versions and pinned ones, and data that no version names. Run it when no writer is between
    stage and publish. Returns the versions that went."""
    every = versions(spark, base)
    stay = {*every[-keep:], *pinned}
    gone = [v for v in every if v not in stay]
    for v in gone:
        fs, where = _fs(spark, f"{base}/versions/{v:012d}.json")
        fs.delete(where, False)
    named = {_entry(spark, base, v)["folder"].split("/")[1] for v in every if v in stay}
    for folder in _names(spark, f"{base}/data"):
        if folder not in named:
            fs, where = _fs(spark, f"{base}/data/{folder}")
            fs.delete(where, True)
    return gone
