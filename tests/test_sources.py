"""Readers of landed files, and the incremental clusters against one pass over all signals."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.operators import editorial
from tidewire.sources import feeds


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_registry_and_table(spark, tmp_path):
    p = put(tmp_path, "r.json", '{"schemaVersion": "1", "sources": [{"id": "a", "name": "A", "weight": 1.2}, {"id": "b", "extra": 1}]}')
    assert [(r.id, r.weight) for r in feeds.registry(spark, p).orderBy("id").collect()] == [("a", 1.2), ("b", 1.0)]
    t = put(tmp_path, "t.json", '{"rows": [{"key": "x", "n": "3"}, {"id": "y", "n": "bad", "kind": "odd"}]}')
    out = feeds.json_table(spark, t, "rows", {"id": ("string", None, None), "n": ("int", "0", None), "kind": ("string", "html", ("rss", "html"))}, {"id": ("key",)})
    assert sorted(tuple(r) for r in out.collect()) == [("x", 3, "html"), ("y", 0, "html")]


def test_xml_feeds(spark, tmp_path):
    r = put(tmp_path, "f.xml", "<rss><channel><item><title>One</title><link>https://www.a.com/x?utm_source=q</link><description>&lt;b&gt;Hi&lt;/b&gt; there</description><pubDate>Mon, 29 Jan 2024 10:00:00 GMT</pubDate></item><item><title>No link</title></item></channel></rss>")
    row = feeds.rss(spark, r).collect()
    assert [(x.title, x.canonical_url, x.excerpt, x.published_at, x.kind) for x in row] == [("One", "https://a.com/x", "Hi there", dt.datetime(2024, 1, 29, 10), "rss")]
    a = put(tmp_path, "a.xml", '<feed><entry><title>Two</title><link href="https://b.com/2"/><updated>2024-01-30T01:02:03Z</updated></entry></feed>')
    assert [(x.title, x.canonical_url, x.published_at) for x in feeds.atom(spark, a).collect()] == [("Two", "https://b.com/2", dt.datetime(2024, 1, 30, 1, 2, 3))]
    s = put(tmp_path, "s.xml", "<urlset><url><loc> https://c.com/1 </loc><lastmod>2024-01-02</lastmod></url><url><loc>https://c.com/2</loc></url></urlset>")
    assert sorted((x.title, x.published_at) for x in feeds.sitemap(spark, s).collect() if x.published_at)[0] == ("https://c.com/1", dt.datetime(2024, 1, 2))
    assert feeds.sitemap(spark, s).count() == 2


def test_api_trends_metrics_fallback(spark):
    pages = spark.createDataFrame([('{"results": [{"headline": "H", "web_url": "https://d.com/1"}, {"title": "no link"}], "nextCursor": "c2"}',), ("not json",)], "body string")
    assert [(r.title, r.canonical_url, r.kind) for r in feeds.api(pages).collect()] == [("H", "https://d.com/1", "api")]
    assert [r[0] for r in pages.select(feeds.next_cursor(F.col("body"))).collect()] == ["c2", None]
    export = spark.createDataFrame([("A  b", 140.0, 9)], "topic string, interest double, volume long")
    got = {r.provider: (r.topic, r.interest, r.volume) for r in feeds.trends({"search_console": export, "manual": export}).collect()}
    assert got == {"search_console": ("A b", 100.0, 9), "manual": ("A b", 100.0, None)}
    m = feeds.metrics(spark.createDataFrame([("u", 5, -1)], "url string, impressions int, clicks int")).first()
    assert (m.views, m.link_clicks) == (5.0, 0.0)
    live, other = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "a int")
    assert [r.a for r in feeds.or_fallback(live, other).collect()] == [1]
    assert [r.a for r in feeds.or_fallback(live.limit(0), other).collect()] == [2]


def test_versions_are_not_overwritten(spark, tmp_path):
    df = spark.range(3)
    path = feeds.replace_table(df, str(tmp_path / "t"), "1")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="already exists"):
        feeds.replace_table(df, str(tmp_path / "t"), "1")


def one_pass(rows, hours, least):
    """The plain fold over all signals in order."""
    urls, clusters, out = {}, [], {}
    for r in sorted(rows, key=lambda r: (r["at"], r["signal_id"])):
        tokens, home = set(r["title_tokens"]), urls.get(r["url_hash"])
        if home is None:
            best, target = 0.0, None
            for c in clusters:
                if c["where"] == (r["city"], r["topic"]) and (r["at"] - c["last"]).total_seconds() <= hours * 3600 and tokens and c["tokens"]:
                    both = len(tokens & c["tokens"])
                    score = max(2 * both / (len(tokens) + len(c["tokens"])), 0.82 * both / min(len(tokens), len(c["tokens"])))
                    if score >= least and score > best:
                        best, target = score, c
            if target:
                home, target["last"] = target["id"], r["at"]
        out[r["signal_id"]] = (r["signal_id"] if home is None else home, "first_seen" if home is None else "source_added")
        if home is None:
            home = r["signal_id"]
            clusters.append({"id": home, "where": (r["city"], r["topic"]), "tokens": tokens, "last": r["at"]})
        if r["url_hash"] is not None:
            urls.setdefault(r["url_hash"], home)
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_incremental_clusters_equal_one_pass(spark, seed):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(16)]
    rows = [
        dict(signal_id=i, city=rng.choice("ab"), topic=rng.choice("xy"), url_hash=rng.choice([None, f"u{rng.randrange(45)}"]), title_tokens=rng.sample(words, rng.randrange(0, 6)), at=dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(400)))
        for i in range(160)
    ]
    rows += [dict(signal_id=1000 + i, city="a", topic="x", url_hash=None, title_tokens=["t1", "t2"], at=dt.datetime(2024, 1, 1) + dt.timedelta(hours=50 * i)) for i in range(20)]
    got = {r.signal_id: (r.cluster, r.event) for r in editorial.incremental_clusters(spark.createDataFrame(rows)).collect()}
    assert got == one_pass(rows, 72, 0.52)


def test_coverage_and_evidence(spark):
    df = spark.createDataFrame([(["A", "b", "a", "C", "D", "E"], "A"), (["A"], "a")], "s array<string>, own string")
    assert [r[0] for r in df.select(editorial.coverage_line(F.col("s"), F.col("own"))).collect()] == ["Also covered by C, D, E and 1 more.", ""]
    rows = spark.createDataFrame([(1, 0, "boost", 8), (1, 1, "max", 72), (1, 2, "boost", 40), (2, 0, "boost", 5)], "k int, ord int, kind string, points int")
    assert {r.k: r.score for r in editorial.evidence_score(rows, ["k"]).collect()} == {1: 100.0, 2: 0.0}
