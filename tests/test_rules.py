"""Rule tables, writing checks, media and places against written fixtures and brute force."""

import math
import random

from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import local, media, rules, writing


def hits(spark, texts, *kinds):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return rules.term_hits(df, rules.given_rules(spark, kinds))


def test_terms_match_whole_words_and_phrases(spark):
    texts = ["Police closed the road. A flood warning is out!", "The policeman floods a warning", "School board: teachers and students met; the school-board agreed", "", None, "rent rent RENT"]
    got = {(r.id, r.rule, r.term): r.n for r in hits(spark, texts, "topic").collect()}
    assert got == {(0, "public_safety", "police"): 1, (0, "weather", "flood warning"): 1, (2, "schools", "school board"): 2, (2, "schools", "students"): 1, (5, "housing", "rent"): 3}


def test_negated_terms_do_not_alert(spark):
    texts = ["There is no evacuation order for the town.", "An evacuation order was given.", "No one was hurt. Much later that same long evening an evacuation order was given to all.", "not a shooting, and without a shooting there was no assault"]
    found = rules.rule_scores(hits(spark, texts, "sensitive"), "sensitive", guarded=True)
    assert {(r.id, r.rule) for r in found.collect()} == {(1, "advisory"), (2, "advisory")}
    every = {(r.id, r.term): (r.n, r.negated) for r in hits(spark, texts, "sensitive").collect()}
    assert every[0, "evacuation order"] == (1, 1) and every[1, "evacuation order"] == (1, 0) and every[3, "shooting"] == (2, 2)


def test_large_rule_tables_are_joined_by_a_shuffle(spark, monkeypatch):
    few = sorted(map(str, hits(spark, ["police and a storm"] * 3, "topic").collect()))
    monkeypatch.setattr(rules, "MOST_RULES", 0)
    assert sorted(map(str, hits(spark, ["police and a storm"] * 3, "topic").collect())) == few


def test_nearest_place_equals_brute_force_also_at_the_poles(spark):
    rng = random.Random(5)
    lat = lambda: rng.choice([rng.uniform(-90, 90), rng.uniform(78, 90), rng.uniform(-90, -78)])
    places = [(i, lat(), rng.uniform(-180, 180)) for i in range(150)] + [(900, 89.9, 10.0), (901, 10.0, 179.9), (902, 10.0, -179.9)]
    points = [(i, lat(), rng.uniform(-180, 180)) for i in range(300)] + [(900, 89.8, -170.0), (901, 10.0, 180.0), (902, 90.0, 0.0), (903, -90.0, 0.0), (904, 0.0, -180.0)]

    def km(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return 6371 * 2 * math.atan2(math.sqrt(x), math.sqrt(max(0.0, 1 - x)))

    got = {r.point_id: (r.place_id, r.distance_km) for r in local.nearest_place(spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(places, "place_id long, lat double, lon double")).collect()}
    assert len(got) == len(points)
    for i, a, b in points:
        best = min(km(a, b, c, d) for _, c, d in places)
        assert abs(got[i][1] - best) <= 0.06, (i, a, b)


def test_images_of_a_page(spark):
    html = (
        '<meta property="og:image" content="/a.jpg"><meta name="twitter:image" content="//t.example/b.png"><script type="application/ld+json">{"image":["https://x.example/c.webp"]}</script>'
        '<img src="d.jpg"><img src="/logo.png"><img srcset="/e.jpg 1x, /f.jpg 2x"><img class="x" data-src="/g.jpg"><img src="/a.jpg"><img src="/h.svg"><img src="/i.jpg?w=50">'
    )
    df = spark.createDataFrame([(html, "https://s.example/p/q"), ("", "https://s.example/"), (None, None)], "html string, url string")
    got = [r[0] for r in df.select(media.images(F.col("html"), F.col("url"))).collect()]
    assert got[0] == ["https://s.example/a.jpg", "https://t.example/b.png", "https://x.example/c.webp", "https://s.example/d.jpg", "https://s.example/e.jpg", "https://s.example/f.jpg", "https://s.example/g.jpg"]
    assert got[1] == [] and not got[2]
    fields = spark.createDataFrame([(["https://m/x.mp3", "https://m/y.jpg"],), ([],)], "f array<string>")
    assert [r[0] for r in fields.select(media.first_image([F.col("f")], F.lit('<img src="/z.png">'), F.lit("https://s.example/"))).collect()] == ["https://m/y.jpg", "https://s.example/z.png"]


def test_images_in_any_order_and_quotes(spark):
    html = (
        "<META content='/1.jpg' PROPERTY='og:image:secure_url'/><meta name=\"og:image\" content=\"/2.jpg\"><meta content=\"/3.png\" itemprop=\"image\"><link href='/4.webp' rel='icon image_src'>"
        "<link rel='icon' href='/no.png'><img data-lazy-src='/5.jpg' alt=\"a > b 'c'\" src='/6.jpg'><img data-caption='/no.jpg' data-original = '/7.jpg'><source srcset='/8.jpg 1x,/9.jpg 2x'>"
        "<script type='application/ld+json'>{\"image\": {\"@id\": \"/10.jpg\"}, \"@graph\": [{\"image\": [\"/11.jpg\", {\"contentUrl\": \"/12.jpg\"}]}, {\"primaryImageOfPage\": {\"url\": \"/13.jpg\"}}], \"x\": \"a < b\"}</script>"
        "<script>{\"image\": \"/no.jpg\"}</script><script type='application/ld+json'>not json</script><meta content='/no.jpg' name='author'><img alt='no source'>"
    )
    got = spark.createDataFrame([(html,)], "html string").select(media.image_links(F.col("html"))).first()[0]
    assert got == [f"/{k}.{x}" for k, x in [(1, "jpg"), (2, "jpg"), (3, "png"), (4, "webp"), (10, "jpg"), (11, "jpg"), (12, "jpg"), (13, "jpg"), (6, "jpg"), (8, "jpg"), (9, "jpg"), (5, "jpg"), (7, "jpg")]]
    long = "<img alt='" + "x" * 300_000 + "' src='/a.jpg'>" + "<img " * 2000
    assert spark.createDataFrame([(long,)], "html string").select(media.image_links(F.col("html"))).first()[0] == ["/a.jpg"]


def tokens(spark, texts, key):
    return spark.createDataFrame(list(enumerate(texts)), f"{key} long, text string").select(key, T.words(F.col("text")).alias("tokens"))


def test_copies_equal_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "deltas", "epsilon", "zeta", "etas", "theta"]) + rng.choice(["", "s", "x"])
    sources = [" ".join(word() for _ in range(rng.randrange(4, 30))) for _ in range(12)]
    texts = []
    for _ in range(40):
        own = [word() for _ in range(rng.randrange(0, 40))]
        if rng.random() < 0.6:
            s = rng.choice(sources).split()
            a = rng.randrange(len(s))
            own[rng.randrange(len(own) + 1) : 0] = s[a : a + rng.randrange(1, 20)]
        texts.append(" ".join(own))
    c, s = tokens(spark, texts, "cid"), tokens(spark, sources, "sid")
    grams = lambda t, n: {tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)}
    want = {}
    for i, t in enumerate(texts):
        for j, u in enumerate(sources):
            n = sum(len({g for g in grams(t, k) & grams(u, k) if len(" ".join(g)) >= 35}) for k in (6, 7, 8))
            if n:
                want[i, j] = n
    for most in (2_000_000, 0):
        monkeypatch.setattr(writing, "MOST_GRAMS", most)
        assert {(r.cid, r.sid): r.n_copied for r in writing.copied_phrases(c, s).collect()} == want and want
        shared = {(i, j) for i, t in enumerate(texts) for j, u in enumerate(sources) if (a := grams(t, 4)) and (b := grams(u, 4)) and len(a & b) >= 0.2 * min(len(a), len(b)) and a & b}
        assert {(r.cid, r.sid) for r in writing.sharing_grams(c, s, 4, 0.2).collect()} == shared
        alike = {(i, j) for i, t in enumerate(texts) for j, u in enumerate(sources) if t and len(set(t.split()) & set(u.split())) >= 0.66 * len(set(t.split()) | set(u.split()))}
        assert alike <= {(r.cid, r.sid) for r in writing.alike_sets(c, s, 0.66).collect()}


def test_risk_has_every_level(spark):
    rows = [(0.1, 0.1, 0.1, 0.1, 0.1, False), (0.5, 0.1, 0.1, 0.1, 0.1, False), (0.1, 0.1, 0.65, 0.1, 0.1, False), (0.71, 0.1, 0.1, 0.1, 0.1, False), (0.1, 0.73, 0.1, 0.1, 0.1, False), (0.0, 0.0, 0.0, 0.0, 0.0, True)]
    df = spark.createDataFrame(rows, "w double, p double, s double, l double, b double, d boolean")
    assert [r[0] for r in df.select(writing.risk_of(*map(F.col, "wpslbd"))).collect()] == ["low", "medium", "medium", "high", "blocked", "blocked"]
    same = spark.createDataFrame([("the mayor opened 12 new parks", "the mayor opened 40 old parks"), ("a b c", "x y z w")], "a string, b string").select(T.words(F.col("a")).alias("a"), T.words(F.col("b")).alias("b"))
    close, far = (r[0] for r in same.select(writing.skeleton_similarity(F.col("a"), F.col("b"))).collect())
    assert close > 0.85 and far < 0.6
