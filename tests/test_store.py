"""Versioned tables, refresh with broken sources, and the duplicate fold over several tasks."""

import datetime as dt
import random

import pytest
from pyspark.sql.types import StructType

from tidewire.operators import dedupe
from tidewire.sources import store
from tidewire.streaming import refresh

T0 = dt.datetime(2024, 1, 1)


def test_readers_keep_their_version(spark, tmp_path):
    base = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        store.read(spark, base)
    assert store.replace(spark.range(3), base) == 1
    old = store.read(spark, base)
    assert store.replace(spark.range(10).selectExpr("id", "'x' AS name"), base) == 2
    assert old.count() == 3 and store.read(spark, base).count() == 10 and store.read(spark, base, 1).columns == ["id"]


def test_a_crash_before_publishing_changes_nothing(spark, tmp_path):
    base = f"{tmp_path}/t"
    store.replace(spark.range(3), base)
    staged = store.stage(spark.range(99), base)  # a writer that stops here
    assert store.read(spark, base).count() == 3 and store.versions(spark, base) == [1]
    other = store.stage(spark.range(5), base)
    assert store.publish(spark, base, other, after=1) == 2
    with pytest.raises(FileExistsError):
        store.publish(spark, base, staged, after=1)
    assert store.read(spark, base).count() == 5
    assert store.clean(spark, base, keep=1) == [1]
    assert store.read(spark, base).count() == 5 and len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_clean_keeps_what_is_pinned(spark, tmp_path):
    base = f"{tmp_path}/t"
    for n in range(1, 6):
        store.replace(spark.range(n), base)
    pinned = store.read(spark, base, 2)
    assert store.clean(spark, base, keep=2, pinned=(2,)) == [1, 3]
    assert pinned.count() == 2 and store.versions(spark, base) == [2, 4, 5]


def test_a_broken_source_stops_no_other(spark, tmp_path):
    schema = StructType().add("n", "long").add("t", "string")
    land = lambda rows: spark.createDataFrame(rows, "value string, source string").coalesce(1).write.mode("append").partitionBy("source").text(f"{tmp_path}/landed")
    lines = lambda: spark.readStream.schema("value string, source string").text(f"{tmp_path}/landed")
    land([('{"n": 1, "t": "a"}', "s1"), ('{"n": 2}', "s1"), ('{"n": 3, "t"', "s2"), ('{"n": 4}', "s2"), ("[1]", "s3"), ('{"n": 7, "t": null}', "s4")])
    refresh.run(lines(), schema, f"{tmp_path}/base")
    got = {(r.source, r.n) for r in refresh.refreshed(spark, f"{tmp_path}/base", schema).collect()}
    assert got == {("s1", 1), ("s1", 2), ("s4", 7)}
    assert {(r.source, r.n) for r in refresh.quarantined(spark, f"{tmp_path}/base").collect()} == {("s2", 1), ("s3", 1)}
    land([('{"n": 5}', "s2"), ('{"n": 6}', "s1")])
    refresh.run(lines(), schema, f"{tmp_path}/base")
    after = lambda: {(r.source, r.n) for r in refresh.refreshed(spark, f"{tmp_path}/base", schema).collect()}
    assert after() == got | {("s1", 6)}
    refresh.release(spark, f"{tmp_path}/base", "s2")
    assert after() == got | {("s1", 6), ("s2", 5)}
    assert {r.source for r in refresh.quarantined(spark, f"{tmp_path}/base").collect()} == {"s3"}


def test_steps_compose_to_the_fold():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(rng.randrange(6), rng.randrange(6), i) for i in range(rng.randrange(1, 20))]
        kept = None
        for r in rows:
            if kept is None or r[0] > kept[0] or r[1] > kept[1]:
                kept = r
        cuts = sorted(rng.sample(range(1, len(rows)), rng.randrange(0, len(rows))))
        state = None
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            state = dedupe.apply_steps(state, dedupe.steps(rows[a:b]))
        assert state == kept


def test_a_key_of_all_rows_is_folded_over_tasks(spark):
    rng = random.Random(2)
    rows = [(i, "one" if i % 5 else f"k{i % 35}", T0 + dt.timedelta(minutes=rng.randrange(5000)), rng.randrange(70, 90)) for i in range(4000)] + [(9000, None, T0, 70), (9001, None, T0, 71)]
    df = spark.createDataFrame(rows, "id long, link string, published_at timestamp, base_score long").repartition(5)
    kept = {}
    for i, link, at, score in rows:
        old = kept.get(link)
        if old is None or at > old[1] or score > old[2]:
            kept[link] = (i, at, score)
    assert {r.link: r.id for r in dedupe.fold_duplicates(df).collect()} == {k: v[0] for k, v in kept.items()}
