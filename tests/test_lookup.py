"""Lookup by grams and words against a scan of every text for every query; entities and facts of written texts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidewire.operators import editorial, lookup, ranking
from tidewire.plans import checks

T0 = dt.datetime(2024, 1, 1)


def some_texts(rng, n, alphabet="abcdé #-"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 14))) for _ in range(n)] + ["", "a", "ab", "aaa aaa"]


def test_containing_equals_a_scan(spark):
    rng = random.Random(2)
    texts = some_texts(rng, 300)
    asked = sorted({t[a : a + rng.randrange(1, 6)] for t in texts if t for a in [rng.randrange(len(t))]} | {"zzz", "", "d #", "é"})
    got = lookup.containing(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame(list(enumerate(asked)), "query_id int, q string"))
    assert {(r.query_id, r.id) for r in got.collect()} == {(k, i) for k, q in enumerate(asked) if q for i, t in enumerate(texts) if q in t}
    none = spark.createDataFrame([], "query_id int, q string")
    assert lookup.containing(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), none).count() == 0


def stories(spark, rng, n):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 6)))
    rows = [(i, rng.randrange(70, 75), T0 + dt.timedelta(hours=rng.randrange(9)), " ".join(word() for _ in range(6)).title(), f"src{i % 5}", rng.choice(["en", "de"]), " ".join(word() for _ in range(9))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, score long, published_at timestamp, title string, source_name string, category string, summary string")


def test_ten_thousand_queries_find_what_a_scan_finds(spark):
    rng = random.Random(3)
    df = stories(spark, rng, 150)
    asked = spark.createDataFrame([(k, " ".join(rng.choice(["ab", "cde", "the", "src1", "en", "fg", "hhh", "abc abc", "x"]) if rng.random() < 0.7 else "".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(rng.randrange(0, 4)))) for k in range(10_000)], "query_id int, query string")
    by_index, by_scan = (ranking.search(df, asked, 5, few=few) for few in (50, 10_000))
    rows = sorted(map(tuple, by_index.collect()))
    assert len(rows) > 10_000 and rows == sorted(map(tuple, by_scan.collect()))


def test_preview_equals_a_scan(spark):
    rng = random.Random(4)
    df = stories(spark, rng, 80)
    titles = [(r.id, r.title.lower(), r.score, r.published_at) for r in df.collect()]
    asked = [(k, t[a : a + rng.randrange(2, 9)].strip()) for k in range(60) for t in [rng.choice(titles)[1]] for a in [0 if k % 2 else rng.randrange(len(t) - 2)]]
    asked = [(k, q) for k, q in asked if q]
    want = []
    for k, q in asked:
        hits = [(40 * t.startswith(q) + 20 * (q in t) + 6 * sum(w in t for w in q.split(" ")), s, at, i) for i, t, s, at in titles]
        best = sorted((h for h in hits if h[0]), key=lambda h: (-h[0], -h[1], -h[2].timestamp(), h[3]))[:5]
        want += [(k, i, p, n + 1) for n, (p, _, _, i) in enumerate(best)]
    got = ranking.preview(df, spark.createDataFrame(asked, "query_id int, query string"))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_texts_about_cities_equal_a_scan(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(14)]
    said = [" " + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 8))) + " " for _ in range(120)]
    rows = [(i, t, " ".join(["", *t.split()[:3], ""]), rng.choice(["w1 post", "w2 news", "other"])) for i, t in enumerate(said)]
    cities = [(k, " ".join(rng.sample(words, rng.randrange(0, 3))), rng.choice([*words, ""]), [" ".join(rng.sample(words, 2))] if k % 2 else []) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, said string, titled string, source_name string")
    known = spark.createDataFrame(cities, "city_id long, city string, state string, aliases array<string>")
    want = df.crossJoin(known).where(editorial.relevant(*map(F.col, ("said", "titled", "source_name", "city", "state", "aliases"))))
    assert {(r.id, r.city_id) for r in editorial.about(df, known).collect()} == {(r.id, r.city_id) for r in want.collect()}


def test_entities_and_facts_of_written_texts(spark):
    text = (
        "Crews worked on Route 66 and I-80, then on Highway 5. Lincoln High School and Park College took part in it all day long. "
        "The Springfield Police Department and the City Council met. St Mary Hospital and the Riverside Library Foundation helped. It was seen at 40.7128, -74.0060 on 12 March 2024."
    )
    df = spark.createDataFrame([(1, text), (2, None), (3, "nothing here")], "doc_id long, text string")
    rows = {r.doc_id: r for r in checks.entity_rows(df).collect()}
    assert rows[1].roads == "Route 66,I-80,Highway 5" and (rows[1].lat, rows[1].lon) == ("40.7128", "-74.0060")
    assert "Lincoln High School" in rows[1].schools and "City Council" in rows[1].agencies and "Riverside Library Foundation" in rows[1].organizations
    assert rows[2].names == rows[3].roads == ""
    facts = {r.doc_id: r for r in checks.fact_rows(df).collect()}
    assert facts[1].n_candidates == 5 and facts[1].dates == "12 March 2024" and facts[1].confidence == 1.0 and facts[2].n_candidates == 0
