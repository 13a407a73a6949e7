"""Signals matched to live stories by several kinds of evidence in order of priority, with the events that follow.

A signal joins the story that its url or content is already part of; or one that shares an official's incident reference or
two entities with it, unless a newer story has a title like its own; or the best titled story of its city and topic; else it
opens one. Stories are looked through from the newest on, so the newest of a kind wins. A story takes signals for `days` after
it opened.

Ladder is the fold of one city or component, in order of time; it finds candidates through an index of keys and holds stories
only as long as they live. match_ladder() finds the groups (a city and topic) that may meet by the keys they share and streams
each component's rows through it; streaming.live runs the same fold on a stream."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.editorial import similarity_of
from tidewire.operators.graph import components
from tidewire.operators.shuffles import beside, join_unique, saved
from tidewire.operators.similarity import AlikeTitles

#: How far a story is confirmed, from the weakest on.
LABELS = ("low_confidence", "community_source", "developing", "reported_one_source", "confirmed_multiple_sources", "official")
HOUR = 3_600_000_000
COLUMNS = (
    "signal_id", "city", "topic", "url_hash", "content_hash", "title_tokens", "refs", "entities", "source_id", "source_kinds", "developing", "us",
)
EVENT = "city string, cluster long, signal_id long, event string, kind string, label string, us long"
EVENT_ARROW = pa.schema([("city", pa.string()), ("cluster", pa.int64()), ("signal_id", pa.int64()), ("event", pa.string()), ("kind", pa.string()), ("label", pa.string()), ("us", pa.int64())])


#: The kinds of a source that say something of a story.
TELLING = ("official", "established", "community")


def confidence(sources: dict, clear: bool, developing: bool) -> str:
    """What a story's sources (how many there are in all, and of each kind; no kind for one that no registry knows) say of it."""
    if sources["official"]:
        return "official"
    if sources["established"]:
        return "confirmed_multiple_sources" if sources["all"] >= 2 else "reported_one_source"
    if not clear:
        return "low_confidence"
    if sources["community"]:
        return "community_source"
    return "developing" if developing else "low_confidence"


def keys_of(s: dict) -> list[tuple[str, str]]:
    """(kind, key) of the keys that a signal shares with others; two shared entities are one shared pair."""
    keys = [(kind, s[c]) for kind, c in (("url", "url_hash"), ("content", "content_hash")) if s[c]]
    if s["refs"]:
        keys += [("incident", x) for x in sorted(set(s["refs"]))]
    if s["entities"]:
        keys += [("entity", "\n".join(p)) for p in combinations(sorted(set(s["entities"])), 2)]
    return keys


class Ladder:
    """Stories and the index of their keys; the last one opened is the newest."""

    def __init__(self, hours: int = 72, least: float = 0.52, days: int = 7):
        self.window, self.least, self.life = hours * HOUR, least, days * 24 * HOUR
        self.stories: dict[int, dict] = {}
        self.index: dict[tuple, dict[int, bool]] = {}  # kind, key -> story -> whether an official source gave it
        self.ends: list[tuple[int, int]] = []
        self.alike = AlikeTitles(lambda k, n, m: similarity_of(k, n, m) >= least)
        self.titles, self.sizes = self.alike.titles, self.alike.sizes

    def add(self, story: dict) -> None:
        """Takes a story as stored() gives it, or a new one."""
        story["tokens"] = frozenset(story["tokens"])
        if not isinstance(story["keys"], dict):
            story["keys"] = {(kind, x): by for kind, x, by in story["keys"]}
        if not isinstance(story.get("sources"), dict):
            given, story["sources"], story["kinds"] = story.get("sources", ()), {}, dict.fromkeys(("all", *TELLING), 0)
            for source, kinds in given:
                self._source(story, source, kinds)
        self.stories[story["id"]] = story
        heapq.heappush(self.ends, (story["at"] + self.life, story["id"]))
        for key, official in story["keys"].items():
            self._note(story["id"], key, official)
        self.alike.add((story["city"], story["topic"]), story["id"], story["tokens"])

    @staticmethod
    def stored(story: dict) -> dict:
        """A story as JSON holds it."""
        plain = {k: v for k, v in story.items() if k != "kinds"}
        return plain | {"tokens": sorted(story["tokens"]), "keys": [[*k, by] for k, by in story["keys"].items()], "sources": [[x, kinds] for x, kinds in story["sources"].items()]}

    @staticmethod
    def _source(story: dict, source: int, kinds: list[str] | None) -> None:
        story["sources"][source] = kinds
        story["kinds"]["all"] += 1
        for k in TELLING:
            story["kinds"][k] += k in (kinds or ())

    def _note(self, story: int, key: tuple[str, str], official: bool) -> None:
        at = self.index.get(key)
        if at is None:
            self.index[key] = {story: official}
        else:
            at[story] = at.get(story, False) or official

    def expire(self, now: int) -> list[dict]:
        """Takes out what has lived its time."""
        gone = []
        while self.ends and self.ends[0][0] <= now:
            story = self.stories.pop(heapq.heappop(self.ends)[1])
            gone.append(story)
            self.alike.remove((story["city"], story["topic"]), story["id"])
            for key in story["keys"]:
                at = self.index[key]
                del at[story["id"]]
                if not at:
                    del self.index[key]
        return gone

    def near(self, s: dict, tokens: set[str]) -> set[int]:
        """The stories of s's city and topic whose titles are alike."""
        return self.alike.near((s["city"], s["topic"]), tokens)

    def titled(self, s: dict) -> tuple[tuple | None, dict | None]:
        """Of the stories with a title like s's: the place of the newest, and the best one (of equals, the newest)."""
        tokens, us = set(s["title_tokens"] or ()), s["us"]
        n, last, best, found = len(tokens), None, None, None
        for number in self.near(s, tokens):
            story = self.stories[number]
            if abs(us - story["last"]) <= self.window:
                title = story["tokens"]
                score, place = similarity_of(len(tokens & title), n, len(title)), (story["at"], number)
                last = place if last is None or place > last else last
                if best is None or (score, place) > best:
                    best, found = (score, place), story
        return last, found

    def match(self, s: dict, keys: list[tuple[str, str]], official: bool) -> tuple[str, dict] | None:
        city, stories = s["city"], self.stories
        newest: dict[str, tuple | None] = dict.fromkeys(("url", "content", "incident", "entity"))
        for key in keys:
            kind = key[0]
            for number, by in self.index.get(key, {}).items():
                story = stories[number]
                if kind in ("url", "content") or ((city is None or story["city"] == city) and (kind == "incident" or official or by)):
                    place = (story["at"], number)
                    if newest[kind] is None or place > newest[kind]:
                        newest[kind] = place
        latest = lambda *kinds: max((p for k in kinds if (p := newest[k])), default=None)
        same, related = latest("url", "content"), latest("incident", "entity")
        # a related story gives way to a newer one of the same url or content, or of a title alike
        if same and not (related and related > same):
            return ("url" if newest["url"] == same else "content"), stories[same[1]]
        last, best = self.titled(s)
        if related and not (last and last >= related):
            return ("incident" if newest["incident"] == related else "entity"), stories[related[1]]
        if same:
            return ("url" if newest["url"] == same else "content"), stories[same[1]]
        return ("title", best) if best else None

    def take(self, s: dict) -> list[tuple]:
        """The events of the next signal: first_seen; or official_update or source_added, and confidence_changed."""
        keys = keys_of(s)
        kinds = None if s["source_kinds"] is None else list(s["source_kinds"])
        official = "official" in (kinds or ())
        met = self.match(s, keys, official)
        event = lambda c, name, kind: (c["city"], c["id"], s["signal_id"], name, kind, c["label"], s["us"])
        if met is None:
            story = {
                "id": s["signal_id"], "at": s["us"], "last": s["us"], "city": s["city"], "topic": s["topic"], "tokens": s["title_tokens"] or (), "keys": dict.fromkeys(keys, official),
                "sources": [] if s["source_id"] is None else [[s["source_id"], kinds]], "clear": s["city"] is not None, "developing": bool(s["developing"]), "label": "",
            }
            self.add(story)
            story["label"] = confidence(story["kinds"], story["clear"], story["developing"])
            return [event(story, "first_seen", "")]
        kind, story = met
        for key in keys:
            story["keys"][key] = story["keys"].get(key, False) or official
            self._note(story["id"], key, official)
        if s["source_id"] is not None and s["source_id"] not in story["sources"]:
            self._source(story, s["source_id"], kinds)
        story["last"] = max(story["last"], s["us"])
        story["clear"], story["developing"] = story["clear"] or s["city"] is not None, story["developing"] or bool(s["developing"])
        before = story["label"]
        story["label"] = max(before, confidence(story["kinds"], story["clear"], story["developing"]), key=LABELS.index)
        events = [event(story, "official_update" if official else "source_added", kind)]
        return events + [event(story, "confidence_changed", kind)] * (story["label"] != before)

    def step(self, s: dict) -> list[tuple]:
        self.expire(s["us"])
        return self.take(s)


def in_ladder(signals: DataFrame) -> DataFrame:
    """signals with the time `at` as COLUMNS. A null city is unknown; null source_kinds are of a source without a record."""
    return signals.select(*COLUMNS[:-1], F.unix_micros(F.col("at").cast("timestamp")).alias("us"))


def shared_keys(rows: DataFrame) -> DataFrame:
    """(spot, city, key) of what may join two signals, but titles: hashes, references, pairs of entities."""
    some = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    pairs = F.flatten(F.transform(some(F.col("entities")), lambda x: F.transform(F.filter(some(F.col("entities")), lambda y: y > x), lambda y: F.concat(F.lit("e:"), x, F.lit("\n"), y))))
    tagged = lambda tag, c: F.when(F.col(c).isNotNull(), F.array(F.concat(F.lit(tag), c))).otherwise(F.array().cast("array<string>"))
    every = F.concat(tagged("u:", "url_hash"), tagged("c:", "content_hash"), F.transform(some(F.col("refs")), lambda x: F.concat(F.lit("r:"), x)), pairs)
    return rows.select("spot", "city", F.explode(every).alias("key"))


def meeting_spots(rows: DataFrame) -> DataFrame:
    """rows with `spot`, a number of their city and topic -> (a, b): spots whose signals could come to be in one story are
    connected. Titles are compared within a spot only. A key links its spots to the least of them, in a city of its own where
    the ladder asks for one city; signals of unknown places link the cities. No pairs of signals are made."""
    local = F.col("key").startswith("r:") | F.col("key").startswith("e:")
    keyed = shared_keys(rows).select("spot", F.xxhash64(F.when(local, F.coalesce("city", F.lit("\0"))), "key").alias("at"), F.when(local, F.col("key")).alias("open"), F.col("city").isNull().alias("anywhere"))
    at = saved(keyed.distinct(), "ladder-keys")
    firsts = saved(at.groupBy("at").agg(F.min("spot").alias("first"), F.count("*").alias("n"), F.min("open").alias("open"), F.bool_or("anywhere").alias("anywhere")), "ladder-firsts")
    stars = join_unique(at.select("spot", "at"), firsts.where("n > 1").select("at", "first"), "at", counts=firsts.select("at", "n"))
    unknown = firsts.where("anywhere and open is not null").select("open", F.col("first").alias("anyone"))
    across = join_unique(firsts.where("open is not null").select("first", "open"), unknown, "open")
    return stars.select("first", "spot").union(across.select("first", "anyone")).toDF("a", "b").where("a <> b").distinct()


def match_ladder(signals: DataFrame, hours: int = 72, least: float = 0.52, days: int = 7) -> DataFrame:
    """signals -> their events (city, cluster, signal_id, event, kind, label, us) in order of time, then id; cluster is the
    story's first signal, kind the evidence. A component's rows stream through one task, which holds its live stories."""
    spot = F.xxhash64(F.coalesce("city", F.lit("\0")), F.coalesce("topic", F.lit("\0"))).alias("spot")
    rows = saved(in_ladder(signals).select("*", spot), "ladder-signals")
    labels = components(meeting_spots(rows), "ladder-components").withColumnRenamed("node", "spot")
    ready = rows.join(beside(labels), "spot", "left").withColumn("component", F.coalesce("component", "spot")).drop("spot")
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ready.repartition(width, "component").sortWithinPartitions("component", "us", "signal_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ladder, component = Ladder(hours, least, days), None
        for batch in batches:
            out: list[tuple] = []
            for s in batch.to_pylist():
                if s["component"] != component:
                    ladder, component = Ladder(hours, least, days), s["component"]
                out += ladder.step(s)
            columns = zip(*out, strict=True) if out else [()] * len(EVENT_ARROW)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, EVENT_ARROW, strict=True)], schema=EVENT_ARROW)

    return dealt.mapInArrow(run, EVENT)


#: What official numbers are given to, and what may stand before a number.
NUMBERED = ("incident", "case", "alert", "advisory", "order", "permit", "project")
MARKS = ("#", "no", "number")


def references(text: Column) -> Column:
    """The numbered things that a text names: one of NUMBERED, a mark or none, and a number or name of three letters or more."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9#-]+", " ")), " ")
    marks, things = F.array(*map(F.lit, MARKS)), F.array(*map(F.lit, NUMBERED))

    def named(words: Column, word: Column, k: Column) -> Column:
        after, then = F.get(words, k + 1), F.get(words, k + 2)
        marked = F.array_contains(marks, after) & then.isNotNull()
        number = F.when(marked, then).otherwise(after)
        good = F.array_contains(things, word) & (F.length(F.regexp_replace(number, "^[#-]+", "")) >= 3)
        return F.when(good, F.when(marked, F.concat_ws(" ", word, after, then)).otherwise(F.concat_ws(" ", word, after)))

    # as the variable of an outer transform, the words are worked out once a text and not at each word
    each = F.flatten(F.transform(F.array(words), lambda w: F.transform(w, lambda word, k: named(w, word, k))))
    return F.array_distinct(F.array_compact(each))


def joined_cities(opened: DataFrame) -> DataFrame:
    """(cluster, hash) of stories that were told apart by city -> (cluster, story): those that share a url or content are one
    story, named after the first."""
    firsts = saved(opened.groupBy("hash").agg(F.min("cluster").alias("first"), F.count("*").alias("n")), "joined-hashes")
    edges = join_unique(saved(opened, "joined-clusters"), firsts.where("n > 1").select("hash", "first"), "hash", counts=firsts.select("hash", "n"))
    found = components(edges.select(F.col("first").alias("a"), F.col("cluster").alias("b")).where("a <> b"), "joined-components")
    every = opened.select("cluster").distinct()
    return every.join(found.withColumnRenamed("node", "cluster"), "cluster", "left").select("cluster", F.coalesce("component", "cluster").alias("story"))
