"""The match ladder against a plain scan of all stories and their signals, in one go and on a stream that stops and goes on."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import ladder
from tidewire.operators.editorial import title_similarity
from tidewire.plans import streams
from tidewire.streaming import live

SCHEMA = "signal_id long, city string, topic string, url_hash string, content_hash string, title_tokens array<string>, refs array<string>, entities array<string>, source_id long, source_kinds array<string>, developing boolean, at timestamp"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
KINDS = {1: ["official"], 2: ["official", "established"], 3: ["established"], 4: ["established"], 5: ["community"], 6: [], 7: None}


def some_signals(seed, n=150, cities=("a", "b", None)):
    rng = random.Random(seed)
    words, people = [f"word{k}" for k in range(12)], [f"person {k}" for k in range(8)]
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 60, 3600, 20 * 3600 if rng.random() < 0.3 else 600])
        source = rng.choice([*KINDS, None])
        rare = lambda xs, p: rng.choice(xs) if rng.random() < p else None
        rows.append(dict(
            signal_id=i, city=rng.choice(cities), topic=rng.choice("xy"), url_hash=rare([f"u{k}" for k in range(40)], 0.5), content_hash=rare([f"c{k}" for k in range(60)], 0.5),
            title_tokens=rng.sample(words, rng.randrange(0, 6)), refs=rng.sample(["case 123", "order 7-77", "alert a1b"], rng.randrange(0, 2) if rng.random() < 0.2 else 0),
            entities=rng.sample(people, rng.randrange(0, 4)) if rng.random() < 0.6 else None, source_id=source, source_kinds=KINDS.get(source), developing=rng.random() < 0.2, at=T0 + dt.timedelta(seconds=at),
        ))
    return rows


def label_of(signals):
    sources = {s["source_id"]: s["source_kinds"] for s in signals if s["source_id"] is not None}
    known = [k for k in sources.values() if k is not None]
    n = lambda kind: sum(kind in k for k in known)
    clear = any(s["city"] is not None for s in signals)
    if n("official"):
        return "official"
    if len(sources) >= 2 and n("established"):
        return "confirmed_multiple_sources"
    if n("established") == 1:
        return "reported_one_source"
    if not clear:
        return "low_confidence"
    if n("community"):
        return "community_source"
    return "developing" if any(s["developing"] for s in signals) else "low_confidence"


def plain_fold(rows):
    """Every story is looked at, newest first, signal by signal."""
    stories, out = [], []
    hours = lambda d: abs(d.total_seconds()) / 3600
    for s in sorted(rows, key=lambda s: (s["at"], s["signal_id"])):
        pairs = set(s["entities"] or ())
        best, chosen = None, None
        for c in stories:
            if hours(s["at"] - c["at"]) >= 7 * 24:
                continue
            same = [m for m in c["signals"] if (s["url_hash"] and s["url_hash"] == m["url_hash"]) or (s["content_hash"] and s["content_hash"] == m["content_hash"])]
            if same:
                chosen = (c, "url" if any(s["url_hash"] and s["url_hash"] == m["url_hash"] for m in same) else "content")
                break
            if c["city"] == s["city"] and c["topic"] == s["topic"] and hours(s["at"] - c["last"]) <= 72:
                score = title_similarity(set(s["title_tokens"]), set(c["tokens"]))
                if score >= 0.52 and (best is None or score > best[1]):
                    best = (c, score)
            if best is None and (c["city"] == s["city"] or s["city"] is None):
                is_official = lambda m: "official" in (m["source_kinds"] or ())
                refs = [m for m in c["signals"] if set(s["refs"] or ()) & set(m["refs"] or ())]
                met = [m for m in c["signals"] if (is_official(s) or is_official(m)) and len(pairs & set(m["entities"] or ())) >= 2]
                if refs or met:
                    chosen = (c, "incident" if refs else "entity")
                    break
        if chosen is None and best is not None:
            chosen = (best[0], "title")
        if chosen is None:
            c = dict(id=s["signal_id"], city=s["city"], topic=s["topic"], at=s["at"], last=s["at"], tokens=s["title_tokens"], signals=[s], label=label_of([s]))
            stories.insert(0, c)
            out.append((c["city"], c["id"], s["signal_id"], "first_seen", "", c["label"]))
            continue
        c, kind = chosen
        c["signals"].append(s)
        c["last"] = max(c["last"], s["at"])
        before, c["label"] = c["label"], max(c["label"], label_of(c["signals"]), key=ladder.LABELS.index)
        out.append((c["city"], c["id"], s["signal_id"], "official_update" if "official" in (s["source_kinds"] or ()) else "source_added", kind, c["label"]))
        if c["label"] != before:
            out.append((c["city"], c["id"], s["signal_id"], "confidence_changed", kind, c["label"]))
    return out


def key(r):
    return tuple(map(str, r))


def told(df):
    return sorted((tuple(r)[:6] for r in df.where("event <> 'expired'").select(*ladder.EVENT_ARROW.names).collect()), key=key)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ladder_equals_a_plain_scan(spark, seed):
    rows = some_signals(seed)
    got = told(ladder.match_ladder(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    want = sorted(plain_fold(rows), key=key)
    assert got == want
    assert {r[3] for r in got} == {"first_seen", "source_added", "official_update", "confidence_changed"}
    if seed == 1:
        assert {r[4] for r in got} == {"", "url", "content", "title", "incident", "entity"}


def test_ladder_of_nothing(spark):
    assert ladder.match_ladder(spark.createDataFrame([], SCHEMA)).count() == 0
    bare = [dict.fromkeys(["city", "topic", "url_hash", "content_hash", "title_tokens", "refs", "entities", "source_id", "source_kinds", "developing"]) | {"signal_id": i, "at": T0} for i in range(2)]
    assert [r.event for r in ladder.match_ladder(spark.createDataFrame(bare, SCHEMA)).collect()] == ["first_seen"] * 2


def test_references(spark):
    text = "Order no. 77-B was signed; case #4411, Permit 9, and the case against Alert: XY1. Case closed"
    assert spark.range(1).select(ladder.references(F.lit(text))).first()[0] == ["order no 77-b", "case #4411", "case against", "alert xy1", "case closed"]


def stream_of(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


@pytest.fixture()
def rocks(spark):
    spark.conf.set(*live.ROCKSDB)
    yield spark
    spark.conf.unset(live.ROCKSDB[0])


@pytest.mark.parametrize("cuts", [[60], [10, 40, 41, 90]])
def test_stream_equals_the_batch_at_any_split(rocks, tmp_path, cuts):
    """Files land one by one; the job ends after each and starts again from its checkpoint."""
    spark, rows = rocks, some_signals(5, 110, ("a", "b"))
    places = [0, *cuts, len(rows)]
    for a, b in zip(places[:-1], places[1:], strict=True):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live.run_events(live.live_stories(stream_of(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/state")
    got = live.read_events(spark, f"{tmp_path}/out")
    want = sorted((e for city in "ab" for e in plain_fold([r for r in rows if r["city"] == city])), key=key)
    assert told(got) == want
    # one event for each story that has ended before the last signal (less the hour that late rows have), none twice
    last = max(r["at"] for r in rows)
    opened = {r["signal_id"]: r["at"] for r in rows if any(e[1] == r["signal_id"] for e in want)}
    ended = [r.cluster for r in got.where("event = 'expired'").collect()]
    assert len(ended) == len(set(ended)) and set(ended) <= set(opened)
    assert {c for c, at in opened.items() if at + dt.timedelta(days=7) < last - dt.timedelta(hours=30)} <= set(ended)
    state = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "stories").load()
    assert state.count() == len(opened) - len(ended)  # what has ended is no longer held


def test_a_batch_that_runs_again_is_there_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1, "first_seen", "", "official", 0)], ladder.EVENT)
    for n in (0, 1, 1):
        live.write_batch(df, n, f"{tmp_path}/out")
    assert live.read_events(spark, f"{tmp_path}/out").count() == 2


def test_stories_of_several_cities_are_joined(spark):
    events = spark.createDataFrame([("a", 1, 1, "first_seen", "", "", 0), ("b", 2, 2, "first_seen", "", "", 0), ("b", 2, 3, "source_added", "url", "", 0), ("c", 4, 4, "first_seen", "", "", 0), ("d", 5, 5, "first_seen", "", "", 0)], ladder.EVENT)
    signals = spark.createDataFrame([(1, "u1", None), (2, "u2", "c2"), (3, "u1", None), (4, None, "c2"), (5, None, None)], "signal_id long, url_hash string, content_hash string")
    assert {(r.cluster, r.story) for r in live.reconcile(events, signals).collect()} == {(1, 1), (2, 1), (4, 1)}


def test_queries_equal_a_plain_scan(rocks):
    sf = "/root/testdata/sf0.001"
    rows = [r.asDict() | {"at": r["at"].replace(tzinfo=dt.timezone.utc)} for r in streams.as_signals(rocks.read.parquet(f"{sf}/documents.parquet")).collect()]
    assert told(streams.match_ladder(rocks, sf)) == sorted(plain_fold(rows), key=key)
    by_city = [e for city in {r["city"] for r in rows} for e in plain_fold([r for r in rows if r["city"] == city])]
    assert told(streams.stream_match_ladder(rocks, sf)) == sorted(by_city, key=key)
