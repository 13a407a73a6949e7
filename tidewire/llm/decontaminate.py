"""Benchmark decontamination by templates.

Numbers, names and units become typed placeholders, neighbouring ones of a type a single one, so that a slot may be filled
with any number of words; windows of `window` (five) template words are hashed and the document's windows are joined to
those of the benchmark by hash. A text has several forms, and a window may match in any: words that open a sentence as
literals or, with a capital, as names; and without names, in lower case, so copies in capitals or in lower case match.
For each document and item, matches are chained in order; between two of them the distance may drift by as many words as
slots have. A chain that holds at least `share` (0.8) of the item's windows is a candidate. Then slots are checked on the
aligned words: literal words must be equal, and within the item each slot value must always map to one value of the
document and differing values must stay apart. A candidate that passes is a copy (all slots equal) or a re-parameterised
copy. In a copy that gives no names away by case, numbers and units may differ, names not.

A template says something only if it has `window` template words or more and at least `LITERALS` of them are no
placeholders. Any other item is matched as it is: its literal words, in windows of five, if it has so many; a shorter one
("42", "two words") only where an entire line of a document is the item (in any case, whatever the punctuation at edges).

The benchmark is a given set of questions; it is split into blocks of at most `block_windows` windows, and each block
is sent to the executors, so what is broadcast is bounded however large the benchmark grows; more blocks take more
passes over the documents. Documents are never shuffled: what leaves a task is one row for each hit.

Null or empty texts and items have no windows and are never contaminated; items with a null id take no part, documents
with a null id are judged like others. Repeated rows are judged each; items repeated under one id are one, the least text.
Very long texts are read whole, in time linear in their words. Other columns are carried along or not read, whatever their
names. An empty table of documents gives an empty one; an empty benchmark finds nothing.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that stand for a unit after a number.
UNITS = frozenset(
    "mm cm m km inch inches ft feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds "
    "oz ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week "
    "weeks month months year years percent degree degrees dollar dollars euro euros cent cents mph kmh".split()
)
#: Words that stand for a number.
NUMERALS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
    "nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
EDGES = "\"'“”‘’()[]{}<>.,;:!?¿¡*_`«»"
ENDS = (".", "!", "?", ":")
MASK = (1 << 64) - 1
MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)
CACHE_WORDS = 500_000
NUMBER_STARTS = frozenset("0123456789$€£+-")
#: Numbers of the placeholders; those of literal words are greater.
KINDS = {"<number>": 1, "<name>": 2, "<unit>": 3}
LAST_KIND = 3
#: Least literal words of a template that may match with other slots.
LITERALS = 3


#: A unit right behind its number.
GLUED = re.compile("(?i)([0-9])(" + "|".join(sorted(UNITS, key=lambda u: (-len(u), u))) + ")(?![A-Za-z0-9])")


def split_words(text: str) -> list[str]:
    """Words between blanks; a unit that is glued to its number is a word of its own."""
    return GLUED.sub(r"\1 \2", text).split()


def is_numeral(word: str) -> bool:
    """A spelt number, also in parts with hyphens between them (in lower case)."""
    return word in NUMERALS or ("-" in word and all(part in NUMERALS or part == "and" for part in word.split("-")) and word.split("-")[0] in NUMERALS)


def kind_of(core: str, first: bool) -> str:
    """'' for a literal word, else its placeholder. A capitalised word is a name unless it opens a sentence."""
    if core[:1] in NUMBER_STARTS and NUMBER.fullmatch(core):
        return "<number>"
    if is_numeral(core.lower()):
        return "<number>"
    if core.lower() in UNITS:
        return "<unit>"
    return "<name>" if not first and core[:1].isupper() else ""


def template_words(text: str) -> list[tuple[str, str]]:
    """(core, placeholder or literal in lower case) of each word."""
    out, first = [], True
    for raw in split_words(text):
        core = raw.strip(EDGES) or raw
        out.append((core, kind_of(core, first) or core.lower()))
        first = raw.endswith(ENDS)
    return out


class Words(dict):
    """Raw words -> places in lists of their numbers; 0 is the number of every word that no template has. Such words in
    lower case, the most by far, share places 0 and 1 (the latter ends a sentence)."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.exact = vocabulary
        self.literal = vocabulary | dict.fromkeys(UNITS, KINDS["<unit>"]) | dict.fromkeys(NUMERALS, KINDS["<number>"])
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.opening, self.inner, self.as_is, self.ends = array("Q", (0, 0)), array("Q", (0, 0)), array("Q", (0, 0)), array("b", (0, 1))

    def __missing__(self, raw: str) -> int:
        core = raw.strip(EDGES) or raw
        number, ends = self.literal.get(core.lower(), 0), raw[-1] in ENDS
        if not number and is_numeral(core.lower()):
            number = KINDS["<number>"]
        if not number and core[0].islower():
            self[raw] = int(ends)
            return int(ends)
        n = len(self.ends)
        kind = kind_of(core, True)
        self.opening.append(KINDS[kind] if kind else number)
        self.inner.append(KINDS[kind or "<name>"] if kind or core[:1].isupper() else number)
        self.as_is.append(self.exact.get(core.lower(), 0))
        self.ends.append(ends)
        self[raw] = n
        return n

    def forms(self, text: str, as_is: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """The template in each of its forms, as (number of each template word, the raw word it starts at): words that
        open a sentence as literals; as names if they have a capital; no names at all, every word in lower case; and, if
        asked for, all words as they are. Neighbouring placeholders of a type are one template word."""
        if len(self) > CACHE_WORDS:
            self.clear()
        raws = split_words(text)
        at = np.fromiter(map(self.__getitem__, raws), np.int64, len(raws))
        first = np.ones(len(at), bool)
        first[1:] = np.frombuffer(self.ends, np.int8)[at[:-1]]
        opening, inner = np.frombuffer(self.opening, np.uint64)[at], np.frombuffer(self.inner, np.uint64)[at]
        out = [merged(x) for x in (np.where(first, opening, inner), inner, opening)]
        return [*out, (np.frombuffer(self.as_is, np.uint64)[at], np.arange(len(at)))] if as_is else out


def merged(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """numbers with runs of one placeholder (or of unknown words) as one, and where each starts."""
    starts = np.ones(len(numbers), bool)
    starts[1:] = (numbers[1:] != numbers[:-1]) | (numbers[1:] > LAST_KIND)
    starts = np.flatnonzero(starts)
    return numbers[starts], starts


def window_hashes(numbers: np.ndarray, window: int, form: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each window of so many words of a form, all of which some template has."""
    n = len(numbers) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    unknown = np.concatenate([[0], np.cumsum(numbers == 0)])
    at = np.flatnonzero(unknown[window:] == unknown[:n])
    out = np.full(len(at), np.uint64(window * 4 + form), np.uint64)
    for k in range(window):
        out += numbers[at + k] * MULTIPLIERS[k]
    out ^= out >> np.uint64(31)
    return at, out


class Text:
    """Words of a text with what opens a sentence, in forms."""

    def __init__(self, text: str, forms: list[tuple[np.ndarray, np.ndarray]]):
        raws = split_words(text)
        self.cores = [r.strip(EDGES) or r for r in raws]
        self.lower = [c.lower() for c in self.cores]
        self.first = [True, *(r.endswith(ENDS) for r in raws[:-1])]
        self.numbers = [x.tolist() for x, _ in forms]
        self.starts = [[*x.tolist(), len(raws)] for _, x in forms]
        # how many words before each could be part of a slot
        slots = [kind_of(c, False) != "" for c in self.cores]
        self.slots = [0, *np.cumsum(slots).tolist()]
        self.names = {c for c, f, x in zip(self.lower, self.first, self.cores, strict=True) if kind_of(x, f) == "<name>"}

    def opens(self, k: int) -> bool:
        """Whether a word has a capital and opens a sentence."""
        return k >= 0 and self.first[k] and kind_of(self.cores[k], False) == "<name>"


class Index:
    """The windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.window = window
        literals = sorted({w for _, t in items for core, x in template_words(t) for w in (core.lower(), x) if w not in KINDS})
        self.words = Words({w: (0xD6E8FEB86659FD93 * (k + 1) & MASK) | 1 << 63 | 1 for k, w in enumerate(literals)})
        self.items: dict[int, Text] = {}
        self.windows: dict[int, list[tuple[int, int]]] = {}
        self.as_is = False
        self.lines: dict[str, list[int]] = {}
        rows: list[tuple] = []
        for i, t in items:
            forms = self.words.forms(t, True)
            own = self.items[i] = Text(t, forms)
            template = forms[0][0]
            says = len(template) >= window and int((template > LAST_KIND).sum()) >= LITERALS
            if not says and len(own.cores) < window:
                self.lines.setdefault(" ".join(own.lower), []).append(i)
                continue
            self.as_is |= not says
            for form, (numbers, _) in enumerate(forms):
                spans = own.starts[form]
                if form == (0 if says else 3):
                    self.windows[i] = [(spans[k], spans[k + window]) for k in range(len(numbers) - window + 1)]
                if says == (form == 3):
                    continue
                for k, h in zip(*(x.tolist() for x in window_hashes(numbers, window, form)), strict=True):
                    if form != 1 or max(own.numbers[1][k : k + window]) > LAST_KIND:
                        rows.append((h, i, spans[k], spans[k + window], form, k, window))
        self.rows = sorted(rows)
        self.h = np.array([r[0] for r in self.rows], np.uint64)

    def matches(self, forms: list[tuple[np.ndarray, np.ndarray]]) -> dict[int, set[tuple]]:
        """Item -> (its start and end, form, its place, width, place in the document)."""
        out: dict[int, set[tuple]] = defaultdict(set)
        for form, (numbers, _) in enumerate(forms):
            places, h = window_hashes(numbers, self.window, form)
            a, b = np.searchsorted(self.h, h, "left"), np.searchsorted(self.h, h, "right")
            hit = a < b
            for d, s, e in zip(places[hit].tolist(), a[hit].tolist(), b[hit].tolist(), strict=True):
                for _, item, *row in self.rows[s:e]:
                    out[item].add((*row, d))
        return out

    def held(self, item: int, spans: set[tuple[int, int]]) -> int:
        """How many windows of the item the spans of words cover."""
        covered = {k for s, e in spans for k in range(s, e)}
        return sum(all(k in covered for k in range(s, e)) for s, e in self.windows[item])

    def pairs(self, own: Text, doc: Text, hit: tuple) -> list[tuple[bool, int, int, int, int]] | None:
        """(whether it is a slot, start and end here, start and end there) of each template word; None if they differ."""
        _, _, form, k, wide, d = hit
        out = []
        for t in range(wide):
            x = own.numbers[form][k + t]
            s, e, ds, de = own.starts[form][k + t], own.starts[form][k + t + 1], doc.starts[form][d + t], doc.starts[form][d + t + 1]
            a, b = own.lower[s], doc.lower[ds]
            if x > LAST_KIND and a != b:
                return None
            # a word that opens a sentence in both is a name only if it opens the item or the item has it as a name
            if x == KINDS["<name>"] and a != b and s and own.first[s] and doc.first[ds] and a not in own.names:
                return None
            # a name behind a capital that opens a sentence may go on to its left; the form with both as names has it whole
            if form == t == 0 and x == KINDS["<name>"] and own.opens(s - 1) != doc.opens(ds - 1) and (s == 0 or ds == 0 or own.lower[s - 1] != doc.lower[ds - 1]):
                return None
            out.append((x <= LAST_KIND or a in own.names, s, e, ds, de))
        return out

    def chains(self, own: Text, doc: Text, hits: list[tuple[int, int, int]]) -> list[list[int]]:
        """Numbers of hits (start, end, start there; in order of the last) that go on from each other. The distance may
        change by as many words as slots between them have."""
        chains: list[list[int]] = []
        for n, (s, e, d) in enumerate(hits):
            best, least = None, None
            for chain in reversed(chains):
                p, _, q = hits[chain[-1]]
                if p > s or q > d:
                    continue
                drift = abs((d - q) - (s - p))
                if drift <= own.slots[e] - own.slots[p] + doc.slots[d] - doc.slots[q] and (least is None or drift < least):
                    best, least = chain, drift
                if least == 0:
                    break
            if best is None:
                chains.append([n])
            else:
                best.append(n)
        return chains

    def hits(self, text: str | None, share: float) -> Iterator[tuple[int, int, int, int, bool]]:
        """(item, start word, windows matched, windows of the item, whether all slots are equal)."""
        if not text:
            return
        yield from self.whole_lines(text)
        forms = self.words.forms(text, self.as_is)
        doc = None
        for item, found in sorted(self.matches(forms).items()):
            n = len(self.windows[item])
            if self.held(item, {(h[0], h[1]) for h in found}) < share * n:
                continue
            own = self.items[item]
            doc = Text(text, forms) if doc is None else doc
            rows = sorted((doc.starts[h[2]][h[5]], h[0], h[1], p) for h in found if (p := self.pairs(own, doc, h)) is not None)
            for chain in self.chains(own, doc, [(s, e, d) for d, s, e, _ in rows]):
                part = [rows[k] for k in chain]
                matched = self.held(item, {(s, e) for _, s, e, _ in part})
                if matched < share * n:
                    continue
                slots = {x[1:] for *_, p in part for x in p if x[0]}
                slots |= self.opening_names(own, doc, part)
                values = aligned(own, doc, slots)
                if values is not None:
                    yield item, part[0][0] - part[0][1], matched, n, all(a == b for _, a, b in values)

    def whole_lines(self, text: str) -> Iterator[tuple[int, int, int, int, bool]]:
        """Hits of the items that are matched only by an entire line."""
        if not self.lines:
            return
        start = 0
        for line in text.split("\n"):
            raws = split_words(line)
            if 0 < len(raws) < self.window:
                for item in self.lines.get(" ".join((r.strip(EDGES) or r).lower() for r in raws), ()):
                    yield item, start, 1, 1, True
            start += len(raws)

    def opening_names(self, own: Text, doc: Text, part: list[tuple]) -> set[tuple[int, int, int, int]]:
        """Slots outside the matched windows: words of the item that are names elsewhere in it, where the document has a
        capital."""
        covered = {k for _, s, e, _ in part for k in range(s, e)}
        out = set()
        for k, word in enumerate(own.lower):
            if k not in covered and word in own.names:
                d, s, *_ = min(part, key=lambda r: abs(r[1] - k))
                at = d + k - s
                if 0 <= at < len(doc.cores) and doc.cores[at][:1].isupper():
                    out.add((k, k + 1, at, at + 1))
        return out


def aligned(own: Text, doc: Text, slots: set[tuple[int, int, int, int]]) -> list[tuple[str, str, str]] | None:
    """(kind, value, value in the document) of slots if they map one to one, else None: word by word where a slot has as
    many on both sides, else as a whole. A slot at an edge of the item may run on into the document's own words; there
    the value is what the slot has elsewhere, or as many words as the item has."""
    there, back, out = {}, {}, []
    runs_on = {x for x in slots if x[3] - x[2] > x[1] - x[0] and (x[0] == 0 or x[1] == len(own.lower))}
    for s, e, ds, de in [*sorted(slots - runs_on), *sorted(runs_on)]:
        kind, mine, theirs = kind_of(own.cores[s], True), own.lower[s:e], doc.lower[ds:de]
        if (s, e, ds, de) in runs_on:
            known = there.get((kind, " ".join(mine)), "").split() or [there.get((kind, w)) for w in mine]
            size = len(" ".join(w or "" for w in known).split()) if all(known) else len(mine)
            theirs = theirs[-size:] if s == 0 else theirs[:size]
            if all(known):
                mine, theirs = [" ".join(mine)], [" ".join(theirs)]
                known = [" ".join(known)]
                if theirs != known:
                    return None
        for a, b in zip(mine, theirs, strict=True) if len(mine) == len(theirs) else [(" ".join(mine), " ".join(theirs))]:
            if there.setdefault((kind, a), b) != b or back.setdefault((kind, b), a) != a:
                return None
            out.append((kind, a, b))
    return out


def blocks_of(benchmark: DataFrame, window: int, block_windows: int, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Blocks of items; one at a time is on the driver."""
    held: list[tuple[int, str]] = []
    n = 0
    named = benchmark.where(F.col(item_col).isNotNull() & (F.length(F.trim(text_col)) > 0)).select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    rows = named.groupBy("i").agg(F.min("t").alias("t"))
    for r in rows.toLocalIterator(prefetchPartitions=False):
        held.append((r.i, r.t))
        n += max(1, len(r.t.split()) - window + 1)
        if n >= block_windows:
            yield held
            held, n = [], 0
    if held:
        yield held


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 5, share: float = 0.8, block_windows: int = 500_000,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(id, item_id, start_word, n_matched, n_windows, exact): every alignment of an item in a document that passes."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, item_id long, start_word long, n_matched long, n_windows long, exact boolean"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for block in blocks_of(benchmark, window, block_windows, item_col, item_text):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, window)
            for batch in batches:
                rows = [(i, *hit) for i, t in enumerate(batch.column(1).to_pylist()) for hit in index.hits(t, share)]
                if rows:
                    at, *cols = zip(*rows, strict=True)
                    yield pa.record_batch([batch.column(0).take(pa.array(at)), *map(pa.array, cols)], names=["id", "item_id", "start_word", "n_matched", "n_windows", "exact"])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return (spark.createDataFrame([], schema) if out is None else out).withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 5, share: float = 0.8, block_windows: int = 500_000, text_col: str = "text") -> DataFrame:
    """docs without the rows that hold an item of the benchmark; one pass per block, all columns stay."""
    spark, at_text = docs.sparkSession, docs.columns.index(text_col)
    for block in blocks_of(benchmark, window, block_windows, "item_id", "text"):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value, window)
            for batch in batches:
                yield batch.filter(pa.array([next(index.hits(t, share), None) is None for t in batch.column(at_text).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
