"""What the findings of the fourth round name, on rows that failed before."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import cluster, editorial, graph, ladder, shuffles, similarity
from tidewire.streaming import live

T0 = dt.datetime(2024, 1, 1)
SIGNALS = "signal_id long, city string, topic string, url_hash string, content_hash string, title_tokens array<string>, refs array<string>, entities array<string>, source_id long, source_kinds array<string>, developing boolean, at timestamp"


def signal(i, **given):
    blank = dict(city="c", topic="t", url_hash=None, content_hash=None, title_tokens=[], refs=[], entities=[], source_id=None, source_kinds=None, developing=False, at=T0 + dt.timedelta(minutes=i))
    return blank | dict(signal_id=i) | given


def test_alike_titles_make_no_rows_of_pairs(spark, monkeypatch):
    """components were drawn from every two alike titles: 79,800 links here."""
    links = []
    monkeypatch.setattr(ladder, "components", lambda edges, name: links.append(edges.count()) or graph.components(edges, name))
    rows = [signal(i, title_tokens=["one", "two", "three", "four", f"x{i}"], url_hash=f"u{i // 2}", topic="t" if i % 3 else "s") for i in range(400)]
    got = ladder.match_ladder(spark.createDataFrame(rows, SIGNALS))
    assert got.where("event = 'first_seen'").count() == 2
    assert links[0] <= 2


def test_a_long_story_is_not_gone_through_at_each_signal():
    """each signal went through all keys of its story."""

    class Keys(dict):
        walked = 0

        def __iter__(self):
            Keys.walked += len(self)
            return super().__iter__()

        def items(self):
            Keys.walked += len(self)
            return super().items()

    fold = ladder.Ladder()
    for i in range(300):
        fold.step(signal(i, us=i, url_hash="u", content_hash=f"c{i}"))
        story = fold.stories[0]
        assert isinstance(story["keys"], dict)  # it was a list, made a dict of at each signal
        story["keys"] = Keys(story["keys"]) if i == 0 else story["keys"]
    assert Keys.walked == 0 and len(fold.stories[0]["keys"]) == 301


def test_a_summary_of_the_start_is_that_of_the_whole(spark):
    """a summary broke the whole text into sentences, and each of two columns drew its own."""
    texts = ["", None, "One. Two! Three? Four.", "<" + "a" * 3000 + "> Late. Words. Here.", "No end " * 900 + ". Second. Third.", "A < b. " * 400, "<p>x</p> " * 500 + "End. Of. It.", "\x01. \x01\x01 ! " * 300 + "tail", "x" * 261 + ". y", "x" * 260, "a. b <i" + " " * 2000 + ">. c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = F.trim(F.substring(F.array_join(F.slice(T.sentences(F.col("text")), 1, 2), " "), 1, 260))
    assert df.where(~whole.eqNullSafe(T.summary(F.col("text")))).count() == 0
    assert df.where("text = 'One. Two! Three? Four.'").select(T.summary(F.col("text"))).first()[0] == "One. Two!"


def test_incremental_clusters_make_no_rows_of_pairs(spark, monkeypatch):
    """every two alike titles were linked (44,850 rows here), and each signal carried its title's list of links."""
    written = []
    monkeypatch.setattr(editorial, "saved", lambda df, name: written.append((out := shuffles.saved(df, name)).count()) or out)
    rows = [dict(signal_id=i, city="c", topic="t", url_hash=None, title_tokens=["one", "two", "three", "four", f"x{i}"], at=T0 + dt.timedelta(hours=i)) for i in range(300)]
    got = editorial.incremental_clusters(spark.createDataFrame(rows, "signal_id long, city string, topic string, url_hash string, title_tokens array<string>, at timestamp"))
    assert {(r.signal_id, r.cluster, r.event) for r in got.collect()} == {(i, 0, "source_added" if i else "first_seen") for i in range(300)}
    assert sum(written) <= 3 * len(rows)


def test_a_url_leads_to_the_cluster_of_its_first_signal(spark):
    """Over cities, after any time, and without a word to later titles; nulls in every column."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    rows = [
        (9, "a", "x", "u", ["one", "two"], at(0)), (3, "b", "x", "u", ["three", "four"], at(1)), (4, "b", "x", None, ["three", "four"], at(2)), (5, None, None, "u", [], at(900)),
        (6, "a", "x", "v", ["one", "two"], at(72)), (7, "b", "y", "v", ["one", "two"], at(140)), (8, "a", "x", None, ["one", "two"], at(145)), (10, None, "x", "w", None, at(3)), (2, "a", "x", "w", ["one"], at(3)),
    ]
    got = editorial.incremental_clusters(spark.createDataFrame(rows, "signal_id long, city string, topic string, url_hash string, title_tokens array<string>, at timestamp"))
    assert {r.signal_id: r.cluster for r in got.collect()} == {9: 9, 3: 9, 4: 4, 5: 9, 6: 9, 7: 9, 8: 8, 10: 9, 2: 9}


def joined(pairs, nodes):
    home = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            home[a] = home[b] = min(home[a], home[b])
    return home


def test_links_of_titles_are_as_few_as_connect_them(spark):
    """every two alike titles of neighbouring stretches were linked. In cells of any size, what is connected stays so."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(15)]
    rows = [(i, T0 + dt.timedelta(hours=rng.randrange(200)), rng.sample(words, rng.randrange(2, 9))) for i in range(220)]
    _, classes = similarity.title_classes(spark.createDataFrame(rows, "id long, published_at timestamp, title_tokens array<string>"), 30)
    names = [r["class"] for r in classes.collect()]
    pairs = [(r.a, r.b) for r in similarity.title_links(classes).collect()]
    assert len(set(joined(pairs, names).values())) > 5
    for cell in (7, 50_000):
        forest = [(r.a, r.b) for r in similarity.title_forest(classes, cell).collect()]
        assert joined(forest, names) == joined(pairs, names)
        assert len(set(forest)) == len(forest) and (cell == 7 or len(forest) < 2 * len(names))


def test_story_clusters_link_copies_of_a_template_once(spark, monkeypatch):
    """400 alike titles within some hours made 79,800 links."""
    links = []
    monkeypatch.setattr(cluster, "components", lambda edges, name: links.append(edges.count()) or graph.components(edges, name))
    rows = [dict(id=i, published_at=T0 + dt.timedelta(minutes=i), base_score=70, title_tokens=["one", "two", "three", "four", "five", f"x{i}"]) for i in range(400)]
    got = cluster.story_clusters(spark.createDataFrame(rows, "id long, published_at timestamp, base_score long, title_tokens array<string>"))
    assert {r.cluster for r in got.collect()} == {399}
    assert links[0] <= 399


class Held(dict):
    """A map state that counts what is read of it; a handle that notes timers."""

    read = 0

    def iterator(self):
        for k, v in sorted(self.items()):
            self.read += 1
            yield k, v

    def getValue(self, k):  # noqa: N802
        self.read += 1
        return self[k]

    updateValue, removeKey, containsKey = dict.__setitem__, dict.__delitem__, dict.__contains__  # noqa: N815


class Handle:
    def __init__(self):
        self.maps, self.timers = {}, []

    def getMapState(self, name, *_):  # noqa: N802
        return self.maps.setdefault(name, Held())

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms)


def test_a_timer_reads_the_stories_that_end_then():
    """each story had a timer of its own, and each timer went through all stories of the city."""
    handle, live_stories = Handle(), live.LiveStories(72, 0.52, 7)
    live_stories.init(handle)
    hour = ladder.HOUR
    rows = [signal(i, us=i * hour // 100 + 1, url_hash=f"u{i}", title_tokens=[]) for i in range(1000)]
    for part in (rows[::2], rows[1::2]):  # two batches, in each of which every hour has stories
        list(live_stories.handleInputRows(("c",), iter([pd.DataFrame(part)]), None))
    stories = handle.maps["stories"]
    assert len(stories) == 1000 and set(handle.timers) == {(7 * 24 + h) * 3_600_000 for h in range(1, 11)} and len(handle.timers) <= 20
    ended, stories.read = [], 0
    for ms in sorted(set(handle.timers)):
        expired = type("Expired", (), {"getExpiryTimeInMs": lambda self, ms=ms: ms})()
        frame = pd.concat(live_stories.handleExpiredTimer(("c",), None, expired))
        assert (frame["us"] <= ms * 1000).all() and (frame["us"] > ms * 1000 - hour).all() and (frame["event"] == "expired").all()
        ended += frame["cluster"].tolist()
    assert sorted(ended) == list(range(1000)) and stories.read == 1000 and not any(handle.maps.values())
