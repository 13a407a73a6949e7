"""What keeps shuffles sound at any size: saved tables that cut lineage, and joins whose hot keys don't meet in one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it. Where it is unset, a local session gets a folder of its own; a cluster
    is an error, since its executors could not read what others write."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The folder below the shared one that tables are saved in, inside a scratch block.
_scratch: ContextVar[str] = ContextVar("scratch", default="")


def deleted(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store, through the file system that its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """saved(), outside of any scratch block."""
    token = _scratch.set("")
    try:
        return saved(df, name)
    finally:
        _scratch.reset(token)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives the loss of executors. Tables saved in a
    scratch block go when it ends; others stay until drop() or the owner of the folder removes them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{_scratch.get()}{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table that saved() returned, when nothing that is still to run reads it."""
    spark = df.sparkSession
    own = urlparse(shared_folder(spark)).path + "/"
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if urlparse(path).path.startswith(own):  # never a file of anyone else
            deleted(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is saved inside is deleted at the end: write the result before, with what keeps it outside of the block."""
    folder = f"scratch-{uuid.uuid4().hex}/"
    token = _scratch.set(folder)
    try:
        yield
    finally:
        _scratch.reset(token)
        deleted(spark, f"{shared_folder(spark)}/{folder}")


#: Buckets of maybe_in: their numbers are all that it broadcasts.
BUCKETS = 1 << 20


def maybe_in(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """rows without most of those whose key is not among keys, so that less of them is shuffled by the join that follows. It
    keeps what falls into a bucket of some key; at most BUCKETS numbers are broadcast, whatever the input."""
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("__bucket")
    hit = keys.select(bucket).distinct()
    return rows.withColumn("__bucket", bucket).join(F.broadcast(hit), "__bucket", "left_semi").drop("__bucket")


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None, share: int = 1000) -> DataFrame:
    """left joined ("inner" or "left") to right, which has one row at most for each key; columns of left, then of right.

    A key that holds more than 1 / share of left's rows is hot. There are fewer than `share` such keys whatever the input, so
    their rows of right are broadcast, and left's rows of them are dealt evenly instead of meeting in one task. All other
    keys are joined by a shuffle. counts (key, n): how many rows of left have a key, if that is known. left is read twice
    if it isn't, and should be a table then."""
    total = left.count()
    counts = left.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    hot = counts.where((F.col("n") > 1) & (F.col("n") * share > total) & F.col(key).isNotNull()).select(key)
    payload = [c for c in right.columns if c != key]
    theirs = right.join(F.broadcast(hot), key, "left_semi")  # fewer than `share` rows, as above
    marked = left.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left").join(
        F.broadcast(theirs.select(key, F.lit(True).alias("__hot_met"), *[F.col(c).alias(f"__hot_{c}") for c in payload])), key, "left"
    )
    apart = F.when(F.col("__hot") | F.col(key).isNull(), F.xxhash64(*left.columns)).otherwise(F.lit(0).cast("long"))
    # zero for every row, but no constant: the optimizer would take a constant out of the join's keys, and hot rows would meet
    zero = F.pmod(F.xxhash64(key), F.lit(1))
    cold = right.select(key, zero.alias("__apart"), F.lit(True).alias("__met"), *[F.col(c).alias(f"__cold_{c}") for c in payload])
    # merged at every size: a broadcast of right would grow with the input
    met = marked.withColumn("__apart", apart).join(cold.hint("merge"), [key, "__apart"], "left")
    if how == "inner":
        met = met.where(F.coalesce("__met", "__hot_met"))
    return met.select(*left.columns, *[F.coalesce(f"__cold_{c}", f"__hot_{c}").alias(c) for c in payload])


def stored_bytes(df: DataFrame) -> int:
    """The size of a table that saved() returned, as it is stored."""
    spark, total = df.sparkSession, 0
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        total += where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
    return total


def beside(df: DataFrame, most: int = 1_000_000, most_bytes: int = 32 << 20) -> DataFrame:
    """The smaller side of an equi join, worked out once as a saved table: sent to every task if it has `most` rows and
    `most_bytes` on disk at most, else merged after a shuffle."""
    table = saved(df, "beside")
    return F.broadcast(table) if table.count() <= most and stored_bytes(table) <= most_bytes else table.hint("merge")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal keys of a partition that is sorted by key, each as one table; a run may span batches."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.Table.from_batches(held)
