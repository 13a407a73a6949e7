"""City candidates against a fold over every city for every signal."""

import math
import random
import re

from tidewire.operators import candidates

SIGNALS = "signal_id long, text string, source_id long, lat double, lon double, existing array<struct<city_id:long,confidence:double>>"
CITIES = "city_id long, name string, state_abbr string, state_name string, county_name string, neighbourhoods array<string>, lat double, lon double"
COVERAGE = "ord int, source_id long, city_id long, coverage_type string, confidence double"
SOURCES = "source_id long, source_type string, text string"


def said(x):
    return " " + re.sub("[^a-z0-9+.-]+", " ", (x or "").lower()).strip() + " "


def says(text, phrase):
    return bool(said(phrase).strip()) and f" {said(phrase).strip()} " in said(text)


def miles(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 6371 * 2 * math.atan2(math.sqrt(x), math.sqrt(max(0.0, 1 - x))) * 0.621371


def plain(signals, cities, coverage, sources):
    out = {}
    kinds = {s[0]: s for s in sources}
    for i, text, source, lat, lon, existing in signals:
        score = {}

        def up(city, points):
            if points > 0:
                score[city] = min(100.0, max(score.get(city, 0.0), points))

        def add(city, points):
            if city in score:
                score[city] = min(100.0, score[city] + points)

        ids = {c[0] for c in cities}
        for city, confidence in existing or []:
            if city in ids:
                up(city, 60 if confidence is None else confidence)
        for _, s, city, kind, confidence in sorted(coverage):
            if s == source and city in ids:
                up(city, confidence or 0)
                if source in kinds and kinds[source][1] in ("official_city", "official_county"):
                    add(city, candidates.COVERAGE_BOOSTS.get(kind, 6))
        for city, name, abbr, state, county, areas, clat, clon in cities:
            if says(text, name):
                up(city, 82)
                add(city, 7 * says(text, abbr))
                add(city, 7 * says(text, state))
            if says(text, county):
                up(city, 66)
            for area in areas or []:
                if says(text, area):
                    up(city, 72)
            if source in kinds and says(kinds[source][2], name):
                up(city, 78 if (kinds[source][1] or "").startswith("official") else 58)
            if None not in (lat, lon, clat, clon):
                far = miles(lat, lon, clat, clon)
                if far <= 100:
                    up(city, 86 if far <= 25 else 72 if far <= 50 else 55)
        out |= {(i, c): round(s, 6) for c, s in score.items() if s >= 35}
    return out


def test_candidates_equal_a_fold_over_all_cities(spark):
    rng = random.Random(4)
    words = ["oak", "st. ann", "new port", "river-side", "elm", "lake view park", "fort", "cedar", "port"]
    name = lambda p=0.8: rng.choice(words) if rng.random() < p else None
    at = lambda p=0.6: (30 + rng.random() * 3, -90 + rng.random() * 3) if rng.random() < p else (None, None)
    cities = [(k, rng.choice(words), rng.choice(["al", "tx", None]), rng.choice(["alabama", "texas", ""]), name(0.5), rng.choice([None, [], [rng.choice(words)], ["elm", "cedar"]]), *at()) for k in range(25)]
    kinds = ["official_city", "official_county", "official_school", "tv", None]
    sources = [(k, kinds[k % 5], " ".join(rng.sample(words, rng.randrange(0, 3)))) for k in range(10)]
    coverage = [(n, rng.randrange(12), rng.randrange(28), rng.choice(["primary", "nearby", "statewide", "regional", "odd"]), rng.choice([0.0, 20.0, 50.0, 90.0, None])) for n in range(60)]
    text = lambda: ", ".join(rng.sample([*words, "AL", "Texas", "and more", "Oak.", "x"], rng.randrange(0, 6)))
    signals = [(i, rng.choice([text(), text(), None]), rng.choice([*range(12), None]), *at(0.4), rng.choice([None, [], [(rng.randrange(28), rng.choice([None, 30.0, 70.0]))]])) for i in range(160)]
    frames = [spark.createDataFrame(r, s) for r, s in ((signals, SIGNALS), (cities, CITIES), (coverage, COVERAGE), (sources, SOURCES))]
    got = {(r.signal_id, r.city_id): round(r.confidence, 6) for r in candidates.city_candidates(*frames).collect()}
    want = plain(signals, cities, coverage, sources)
    assert got == want and {v for v in want.values()} > {36.0, 86.0, 89.0, 96.0, 55.0, 58.0, 66.0, 72.0, 78.0} - {36.0}


def test_candidates_of_nothing(spark):
    frames = [spark.createDataFrame([], s) for s in (SIGNALS, CITIES, COVERAGE, SOURCES)]
    assert candidates.city_candidates(*frames).count() == 0
