"""Operators against naive folds on random rows, and on edge cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import classify, cluster, dedupe, engagement, local, ranking, similarity
from tidewire.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def naive_diversify(stories, cap, limit):
    groups = {}
    for s in sorted(stories, key=lambda s: (-s["source_count"], -s["score"], -s["published_at"].timestamp(), s["id"])):
        groups.setdefault(s["source_name"], []).append(s["id"])
    out, taken, lists = [], dict.fromkeys(groups, 0), {k: list(v) for k, v in groups.items()}
    while len(out) < limit:
        before = len(out)
        for source in groups:
            if len(out) >= limit or not lists[source]:
                continue
            if cap and taken[source] >= cap and any(lists[o] for o in groups if o != source):
                continue
            out.append(lists[source].pop(0))
            taken[source] += 1
        if len(out) == before:
            break
    return out


def test_diversify_equals_round_robin(spark):
    rng = random.Random(4)
    for n, sources, cap, limit in ((30, 4, 2, 50), (30, 4, 0, 12), (12, 2, 3, 50), (9, 1, 2, 5), (20, 6, 1, 50)):
        rows = [dict(id=i, source_name=f"s{rng.randrange(sources)}", source_count=rng.randrange(1, 4), score=rng.randrange(70, 75), published_at=T0 + dt.timedelta(hours=rng.randrange(9))) for i in range(n)]
        got = ranking.diversify(spark.createDataFrame(rows), cap, limit, ranking.spotlight_order()).orderBy("position")
        assert [r.id for r in got.collect()] == naive_diversify(rows, cap, limit)


def test_fold_duplicates_is_the_ordered_fold(spark):
    rng = random.Random(5)
    rows = [dict(id=i, link=f"l{rng.randrange(8)}", published_at=T0 + dt.timedelta(hours=rng.randrange(6)), base_score=rng.randrange(70, 74)) for i in range(120)]
    kept = {}
    for r in rows:
        old = kept.get(r["link"])
        if old is None or r["base_score"] > old["base_score"] or r["published_at"] > old["published_at"]:
            kept[r["link"]] = r
    got = {r.link: r.id for r in dedupe.fold_duplicates(spark.createDataFrame(rows)).collect()}
    # rows of equal time and score stand for one another
    same = lambda a, b: (rows[a]["published_at"], rows[a]["base_score"]) == (rows[b]["published_at"], rows[b]["base_score"])
    assert got.keys() == kept.keys() and all(same(got[k], kept[k]["id"]) for k in kept)


def pair(a, b):
    shared, union = len(a & b), len(a | b)
    c = shared / min(len(a), len(b))
    score = max(shared / union, 0.65 * c + 0.35 * shared / union)
    return score if shared >= 5 or (shared >= 4 and c >= 0.62) or (shared >= 3 and score >= 0.72) else 0


def test_greedy_clusters_equal_one_pass_over_all(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(14)]
    rows = [dict(id=i, published_at=T0 + dt.timedelta(hours=rng.randrange(60)), base_score=rng.randrange(70, 80), title_tokens=rng.sample(words, rng.randrange(3, 7))) for i in range(50)]
    clusters = []
    for r in sorted(rows, key=lambda r: (-r["published_at"].timestamp(), -r["base_score"], r["id"])):
        best, target = 0, None
        for c in clusters:
            for m in c[:6]:
                near = abs((m["published_at"] - r["published_at"]).total_seconds()) <= 30 * 3600
                s = pair(set(r["title_tokens"]), set(m["title_tokens"])) if near else 0
                if s > best:
                    best, target = s, c
        target.append(r) if target else clusters.append([r])
    want = {m["id"]: c[0]["id"] for c in clusters for m in c}
    got = {r.id: r.cluster for r in cluster.story_clusters(spark.createDataFrame(rows)).collect()}
    assert got == want


def one_pass(rows):
    clusters = []
    for r in sorted(rows, key=lambda r: (-r["published_at"].timestamp(), -r["base_score"], r["id"])):
        best, target = 0, None
        for c in clusters:
            for m in c[:6]:
                near = abs((m["published_at"] - r["published_at"]).total_seconds()) <= 30 * 3600
                s = pair(set(r["title_tokens"]), set(m["title_tokens"])) if near and r["title_tokens"] and m["title_tokens"] else 0
                if s > best:
                    best, target = s, c
        target.append(r) if target else clusters.append([r])
    return {m["id"]: c[0]["id"] for c in clusters for m in c}


def shapes():
    rng = random.Random(16)
    at = lambda h: T0 + dt.timedelta(hours=h)
    chain = [["shared", f"c{k}", f"c{k + 1}", f"c{k + 2}", f"c{k + 3}"] for k in range(60)]
    star = [["hub1", "hub2", "hub3", "hub4", f"leaf{k}"] for k in range(60)]
    copies = [["same", "old", "title", "again"]] * 80
    giant = [rng.sample([f"w{k}" for k in range(9)], rng.randrange(3, 7)) for _ in range(150)]
    for name, titles in (("chain", chain), ("star", star), ("copies", copies), ("giant", giant)):
        yield name, [dict(id=i * 7 % 1009, published_at=at(rng.randrange(400) if name != "star" else rng.randrange(30)), base_score=rng.randrange(70, 73), title_tokens=t) for i, t in enumerate(titles)]
    yield "empty titles", [dict(id=i, published_at=at(i), base_score=70, title_tokens=[["a", "b"], ["a", "a", "a"], ["a", "b", "c", "c"], ["c", "b", "a"]][i % 4]) for i in range(12)]


def test_greedy_clusters_of_every_shape(spark):
    """Chains, stars, copies and one giant component; cells of two classes for a token."""
    for name, rows in shapes():
        df = spark.createDataFrame(rows, "id long, published_at timestamp, base_score long, title_tokens array<string>").repartition(3)
        assert {r.id: r.cluster for r in cluster.story_clusters(df).collect()} == one_pass(rows), name


def test_equal_titles_cost_a_row_each(spark):
    rows = [(i, [f"t{i % 3}", "b", "c", "d"]) for i in range(90)]
    members, classes = similarity.title_classes(spark.createDataFrame(rows, "id long, title_tokens array<string>"))
    assert members.count() == 90 and classes.count() == 3
    for cell in (1, 2, 2000):
        assert similarity.title_links(classes, cell).count() == 0  # three shared tokens of four are too few
    near = spark.createDataFrame([(1, list("abcde")), (2, list("abcdf")), (3, list("abcdefgh")), (4, list("xyz"))], "class long, k array<string>")
    for cell in (1, 2000):
        assert sorted((r.a, r.b, r.shared) for r in similarity.title_links(near, cell).collect()) == [(1, 2, 4), (1, 3, 5), (2, 3, 5)]


def test_title_pairs_equal_all_pairs(spark):
    rng = random.Random(7)
    words = [f"w{i:02d}x" for i in range(12)]
    rows = [dict(id=i, published_at=T0 + dt.timedelta(hours=rng.randrange(90)), title_tokens=rng.sample(words, rng.randrange(1, 7))) for i in range(60)]
    want = {(a["id"], b["id"]) for a in rows for b in rows if a["id"] < b["id"] and abs((a["published_at"] - b["published_at"]).total_seconds()) <= 30 * 3600 and pair(set(a["title_tokens"]), set(b["title_tokens"]))}
    assert {(r.a, r.b) for r in similarity.title_pairs(spark.createDataFrame(rows)).collect()} == want


def test_profiles_equal_the_fold(spark):
    rng = random.Random(8)
    rows, at = [], 0
    for i in range(300):
        at += rng.choice((60, 3600, 86400, 9 * 86400 if rng.random() < 0.1 else 600))
        rows.append(dict(event_id=i, user_id=i % 3, category=rng.choice("ab"), ts=T0 + dt.timedelta(seconds=at)))
    want = {}
    for user in range(3):
        state, run = {}, ["", 0]
        jobs.interest([(int(r["ts"].timestamp() * 1e6), r["event_id"], r["category"]) for r in rows if r["user_id"] == user], state, run)
        want |= {(user, c): (int(v[1]), int(v[2]), round(v[0], 4)) for c, v in state.items()}
    got = {(r.user_id, r.category): (r.views, r.streaks, round(r.score, 4)) for r in engagement.profiles(spark.createDataFrame(rows)).collect()}
    assert got == want


def test_urls_and_slugs(spark):
    df = spark.createDataFrame([("HTTPS://www.Example.com/A/?utm_source=x&b=2&a=1#top",), ("http://m.example.com",), ("https://example.org/x/?ref=1",)], "u string")
    assert [r[0] for r in df.select(T.canonical_url(F.col("u"))).collect()] == ["https://example.com/A?a=1&b=2", "http://m.example.com", "https://example.org/x"]
    assert df.select(T.slug(F.lit("Crème brûlée: 3 ways!"))).first()[0] == "creme-brulee-3-ways"


def test_sentences_and_half_up(spark):
    row = spark.range(1).select(T.summary(F.lit("<p>One a. Two b! Three c?</p>")).alias("s"), T.half_up(F.lit(-2.5)).alias("h"), T.half_up(F.lit(2.5)).alias("p")).first()
    assert (row.s, row.h, row.p) == ("One a. Two b!", -2, 3)


def test_windows_at_their_edges(spark):
    now = "2024-01-31 00:00:00"
    at = dt.datetime(2024, 1, 31)
    rows = [(1, "live", at - dt.timedelta(days=7), at), (2, "live", at - dt.timedelta(days=7) + dt.timedelta(seconds=1), at + dt.timedelta(seconds=1)), (3, "live", None, None), (4, "live", at + dt.timedelta(hours=1), at + dt.timedelta(days=7)), (5, "hidden", at, at + dt.timedelta(days=7)), (6, "live", at - dt.timedelta(hours=48), at + dt.timedelta(days=5))]
    df = spark.createDataFrame(rows, "cluster_id int, public_status string, started_at timestamp, expires_at timestamp").withColumn("index_status", F.lit("index"))
    got = {r.cluster_id: (r.w, r.c, r.x) for r in df.select("cluster_id", local.window_state(now).alias("w"), local.response_code(now).alias("c"), local.should_expire(now).alias("x")).collect()}
    assert got == {1: ("expired", 410, True), 2: ("day-3-7", 200, False), 3: ("expired", 410, True), 4: ("day-3-7", 200, False), 5: ("expired", 404, False), 6: ("0-48h", 200, False)}


def test_conform_and_failures(spark):
    df = spark.createDataFrame([("a", "", "7", "odd"), ("b", "x", "n", "rss")], "key string, name string, n string, kind string")
    out = classify.conform(df, {"id": ("string", None, None), "name": ("string", "none", None), "n": ("int", "0", None), "kind": ("string", "html", ("rss", "html"))}, {"id": ("key",)})
    assert [tuple(r) for r in out.collect()] == [("a", "none", 7, "html"), ("b", "x", 0, "rss")]
    fails = out.select(F.array_join(classify.failures({"positive": F.col("n") > 0, "named": F.col("name") != "none"}), ",").alias("f"))
    assert [r.f for r in fails.collect()] == ["named", "positive"]


def test_forbidden_names_in_nested_schemas(spark):
    df = spark.createDataFrame([], "a struct<b: array<struct<email: string, x: int>>>, token string, m map<string, struct<phone: string>>")
    assert classify.forbidden_columns(df) == ["a.b.email", "token", "m.phone"]


def test_fresh_signals_and_changes(spark):
    new = spark.createDataFrame([(1, "u1", "c1"), (2, "u1", "c2"), (3, "u3", "c9"), (4, "u4", "c1"), (5, "u5", "c5")], "id int, url_hash string, content_hash string")
    old = spark.createDataFrame([("u0", "c9")], "url_hash string, content_hash string")
    got = {r.id: r.rejection_reason for r in dedupe.fresh_signals(new, old).collect()}
    assert got == {1: None, 2: "duplicate_url", 3: "duplicate_content", 4: "duplicate_content", 5: None}
    changes = dedupe.changed_keys(spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int"), "id")
    assert {(r.id, r.change) for r in changes.collect()} == {(1, "gone"), (3, "new")}


def test_expiry_writes_one_event(spark):
    at = dt.datetime(2024, 1, 31)
    rows = spark.createDataFrame([(1, "live", at - dt.timedelta(days=9), at, "index"), (2, "live", at - dt.timedelta(days=9), at, "index"), (3, "live", at, at + dt.timedelta(days=7), "index")], "cluster_id int, public_status string, started_at timestamp, expires_at timestamp, index_status string")
    had = spark.createDataFrame([(2, "expired")], "cluster_id int, event_type string")
    after, events = local.expire(rows, had, "2024-01-31 00:00:00")
    assert {r.cluster_id: (r.public_status, r.index_status) for r in after.collect()} == {1: ("expired", "noindex"), 2: ("expired", "noindex"), 3: ("live", "index")}
    assert [r.cluster_id for r in events.collect()] == [1]


def test_empty_tables(spark):
    items = spark.createDataFrame([], "id long, published_at timestamp, base_score long, title_tokens array<string>")
    assert cluster.story_clusters(items).count() == 0
    stories = spark.createDataFrame([], "id long, source_name string, source_count long, score long, published_at timestamp")
    assert ranking.diversify(stories, 2, 8, ranking.spotlight_order()).count() == 0
    assert similarity.title_pairs(items).count() == 0
