"""Saved tables and their clean-up; the bounded prefilter of a join."""

import os

from pyspark.sql import functions as F

from tidewire.operators import shuffles
from tidewire.operators.graph import components


def held(spark):
    base = shuffles.shared_folder(spark)
    return {f"{d.removeprefix(base)}/{n}" for d, _, names in os.walk(base) for n in names if n.endswith(".parquet")} if os.path.isdir(base) else set()


def test_scratch_tables_go_and_kept_ones_stay(spark):
    before = held(spark)
    with shuffles.scratch(spark):
        a = shuffles.saved(spark.range(10), "a")
        b = shuffles.kept(a.where("id > 4"), "b")
        with shuffles.scratch(spark):
            shuffles.saved(spark.range(3), "inner")
        assert a.count() == 10 and any("/a-" in f for f in held(spark) - before)
    assert b.count() == 5
    left = held(spark) - before
    assert left and all(f.startswith("/b-") for f in left)
    shuffles.drop(b)
    assert held(spark) == before
    shuffles.drop(spark.read.parquet("/root/testdata/sf0.001/nation.parquet"))  # not ours: stays
    assert os.path.exists("/root/testdata/sf0.001/nation.parquet")


def test_components_keep_only_their_labels(spark):
    before = held(spark)
    labels = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    assert {r.component for r in labels.collect()} == {0}
    assert {f.split("/")[1].rsplit("-", 1)[0] for f in held(spark) - before} == {"components"}
    assert len({f.split("/")[1] for f in held(spark) - before}) == 1


def test_maybe_in_loses_no_key(spark):
    rows, keys = spark.range(5000).selectExpr("id % 700 AS k", "id"), spark.range(0, 700, 7).selectExpr("id AS k")
    some = shuffles.maybe_in(rows, keys, "k")
    assert some.columns == ["k", "id"] and some.count() < 1000
    assert some.join(keys, "k").count() == rows.join(keys, "k").count()


def test_hot_and_null_keys_do_not_meet_in_one_task(spark):
    left = shuffles.saved(spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id % 500 END AS k", "id"), "left")
    right = shuffles.saved(spark.range(500).selectExpr("id AS k", "id * 2 AS v"), "right")
    had = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = shuffles.join_unique(left, right, "k", "left")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for c, v in had.items():
            spark.conf.set(c, v)
    assert sum(sizes) == 30_000 and len(sizes) == 16 and max(sizes) < 3 * min(sizes)
    rows = shuffles.join_unique(left, right, "k").collect()
    assert len(rows) == 20_000 and all(r.v == 2 * r.k for r in rows)


def test_the_smaller_side_is_sent_by_rows_and_bytes(spark):
    rows, side = spark.range(3000), spark.range(1000).selectExpr("id", "concat(md5(cast(id AS string)), md5(cast(id + 7 AS string))) AS t")
    for most, most_bytes, sent in ((10_000, 1 << 20, True), (999, 1 << 20, False), (10_000, 20_000, False)):
        joined = rows.join(shuffles.beside(side, most, most_bytes), "id")
        assert ("BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()) == sent
        assert joined.count() == 1000
