"""Personal data in whole texts: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns find emails, IPv4 addresses, payment cards and phone numbers; their spans always stay. The field then reads
what the patterns left over: stretches of neighbouring chunks with a digit or "@", and emails with a spelt mark ("(at)",
"[at]", or "at" where a "dot" is spelt, too). It scores whole candidate segments (shape, digit groups, separators, check
digit, word before) for each type, and a dynamic programme over bounded segments (`MAX_TOKENS` tokens, `MAX_CHARS`
characters) chooses boundaries and types together; tokens outside segments score 0. A segment may stand for a type only if
it has an at mark, 7 to 19 digits, or four numbers. It is trained on this corpus: on the patterns' own spans in a bounded
sample of documents, on re-spelt forms of them that the patterns miss (a phone without "+", a card with dots or digit
by digit, an address in brackets, an email with a spelt mark), and on made-up contexts of national phone numbers, spelt
emails, sums, dates, versions, book and order numbers. An added span is kept if its segment scores `margin` or more.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Texts of any length are read once; the work is
linear in the text, also for endless runs of digits, and memory is a few numbers for each token of a stretch. Repeated rows,
and rows with a null id, each have their spans. Columns other than id and text are not read, whatever their names; an empty
table gives an empty one, and a field trained on one adds nothing.
"""

from __future__ import annotations

import heapq
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.pii_lessons import lessons

#: Kinds in the order of reports, and the patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: All that an ip, card or phone is made of; "+" only starts one.
RUN = re.compile(r"[0-9][0-9+().\x20-]*")
NOT_DIGIT = re.compile("[^0-9]")

MAX_TOKENS = 40
MAX_CHARS = 64
TRIGGER = re.compile("[0-9@]")
CHUNK_REST = re.compile(r"[^\s]*(?:\s{1,8}(?:[^\sA-Za-z0-9@]\s{1,2})?[^\s0-9@]*[0-9@][^\s]*)*")
#: A spelt mark, and what follows it in an email: with a bare "at", the dots are spelt as well.
AT = re.compile(r"\x20?[(\[{]at[)\]}]\x20?|\x20at\x20", re.I)
DOT_BEFORE = re.compile(r"(?<=[A-Za-z0-9_%+-])(?:\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)\Z", re.I)
AFTER = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)[A-Za-z0-9-]+)+", re.I)
AFTER_BARE = re.compile(r"[A-Za-z0-9-]+(?:\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)[A-Za-z0-9-]+(?:(?:\.|\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)[A-Za-z0-9-]+)*", re.I)
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|.", re.S)
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    over, p = 0, text.find("@")
    while p >= 0:
        s = p
        while s > over and text[s - 1] in LOCAL:
            s -= 1
        if s < p and (m := DOMAIN.match(text, p + 1)):
            over = m.end()
            yield s, over, "email"
        p = text.find("@", max(p + 1, over))


def base_spans(text: str) -> list[Span]:
    """By kind, then start."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    found["email"] = list(_emails(text))
    for run in RUN.finditer(text):
        s, e = run.span()
        if s and text[s - 1] == "+":
            s -= 1
        elif e - s < 7:
            continue
        for m in IP.finditer(text, s, e):
            if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
                found["ip"].append((*m.span(), "ip"))
        for m in CARD.finditer(text, s, e):
            digits = NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                found["card"].append((*m.span(), "card"))
        for m in PHONE.finditer(text, s, e):
            if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                found["phone"].append((*m.span(), "phone"))
    return [x for k in KINDS for x in found[k]]


def features(text: str, s: int, e: int) -> list[str]:
    """Of a whole segment, with the characters around it."""
    seg = text[s:e]
    digits = NOT_DIGIT.sub("", seg)
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", lambda m: f"9{min(len(m.group()), 6)}", seg))
    groups = re.findall(r"[0-9]+", seg)
    goes_on = re.match(r"[^A-Za-z0-9]{0,3}[0-9]", text[e : e + 4]) is not None, re.search(r"[0-9][^A-Za-z0-9]{0,3}$", text[max(0, s - 4) : s]) is not None
    inside = re.match(r"[._%+-]?[A-Za-z0-9]", text[e : e + 2]) is not None, re.search(r"[A-Za-z0-9][._%+-]?$", text[max(0, s - 2) : s]) is not None
    sizes = sorted({min(len(x), 7) for x in groups})
    marks = "".join(sorted(set(re.sub(r"[A-Za-z0-9]", "", seg))))
    n = len(digits)
    before = re.search(r"([A-Za-z]*)[^A-Za-z]?$", text[max(0, s - 16) : s])
    edge = lambda c: "9" if c.isdigit() else "a" if c.isalpha() else c or "^"
    return [
        "1", f"n{min(n, 20)}", f"g{len(groups)}", f"m{marks}", f"c{'9' in shape}{'a' in shape}", f"s{shape[:24]}" if len(shape) <= 24 else "s~",
        f"l{13 <= n <= 19 and luhn(digits)}{n}", f"i{len(groups) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in groups)}{marks}",
        f"w{before.group(1).lower()}" if before else "w", f"b{edge(seg[0])}", f"e{edge(seg[-1])}",
        f"o{edge(text[s - 1 : s])}{edge(text[e : e + 1])}", f"@{seg.count('@')}{AT.search(seg) is not None}{AFTER.search(seg) is not None}{seg[:1].isalnum()}",
        f"x{goes_on}", f"y{inside}{'9' in shape}", f"p{sizes}{n if len(sizes) == 1 else ''}",
    ]


class SegmentField:
    """Weights for (feature, type), the best segmentation of a stretch, and its training."""

    def __init__(self, weights: dict[str, list[float]] | None = None):
        self.weights = weights or {}
        self.cache: dict[tuple, list[float]] = {}

    def _scores(self, names: list[str]) -> list[float]:
        out = [0.0] * len(KINDS)
        for f in names:
            w = self.weights.get(f)
            if w:
                for k in range(len(KINDS)):
                    out[k] += w[k]
        return out

    def segments(self, text: str, edges: list[int], j: int) -> Iterator[tuple[int, list[str]]]:
        """(start, features) of the segments that may end at edge j of a stretch's tokens."""
        if text[edges[j] - 1].isspace():
            return
        at, digits, dots = False, 0, 0
        for i in range(j - 1, max(-1, j - 1 - MAX_TOKENS), -1):
            a, b = edges[i], edges[i + 1]
            if edges[j] - a > MAX_CHARS or (digits > 19 and not at):
                break
            c = text[a]
            if c.isdigit():
                digits += b - a
            dots += c == "."
            at = at or c == "@" or (b - a == 2 and text[a:b].lower() == "at" and text[a - 1 : a] in OPENS and text[b : b + 1] in CLOSES)
            if not c.isspace() and edges[j] - a >= 7 and (at or 7 <= digits <= 19 or (dots >= 3 and digits >= 4)):
                yield i, features(text, a, edges[j])

    def best(self, text: str, s: int, e: int) -> list[tuple[int, int, str, float]]:
        edges = edges_of(text, s, e)
        top, back = [0.0] * len(edges), [None] * len(edges)
        for j in range(1, len(edges)):
            top[j] = top[j - 1]
            for i, names in self.segments(text, edges, j):
                for k, x in enumerate(self._scores(names)):
                    if top[i] + x > top[j]:
                        top[j], back[j] = top[i] + x, (i, k, x)
        out, j = [], len(edges) - 1
        while j > 0:
            if back[j]:
                i, k, x = back[j]
                out.append((edges[i], edges[j], KINDS[k], x))
                j = i
            else:
                j -= 1
        return out[::-1]

    def learn(self, examples: list[tuple[str, list[Span]]], epochs: int = 4, step: float = 0.25, decay: float = 1e-3, seed: int = 3) -> None:
        """Ascends the conditional likelihood: features of the right segments less those expected (forward-backward)."""
        rng = random.Random(seed)
        ready = []
        for text, spans in examples:
            edges = edges_of(text, 0, len(text))
            ends = {j: list(self.segments(text, edges, j)) for j in range(1, len(edges))}
            ready.append((edges, ends, {(a, b): KINDS.index(k) for a, b, k in spans}))
        total: dict[str, list[float]] = defaultdict(lambda: [1e-2] * len(KINDS))
        for _ in range(epochs):
            rng.shuffle(ready)
            for edges, ends, gold in ready:
                n = len(edges)
                scored = {j: [(i, names, self._scores(names)) for i, names in ends.get(j, ())] for j in range(1, n)}
                fwd = [0.0] * n
                for j in range(1, n):
                    fwd[j] = _logsum([fwd[j - 1], *(fwd[i] + x for i, _, xs in scored[j] for x in xs)])
                bwd = [0.0] * n
                into: dict[int, list] = defaultdict(list)
                for j, rows in scored.items():
                    for i, _, xs in rows:
                        into[i].append((j, xs))
                for i in range(n - 2, -1, -1):
                    bwd[i] = _logsum([bwd[i + 1], *(bwd[j] + x for j, xs in into[i] for x in xs)])
                slope: dict[str, list[float]] = {}
                for j, rows in scored.items():
                    for i, names, xs in rows:
                        want = gold.get((edges[i], edges[j]), -1)
                        g = [(k == want) - math.exp(min(0.0, fwd[i] + x + bwd[j] - fwd[-1])) for k, x in enumerate(xs)]
                        if max(map(abs, g)) > 1e-4:
                            for f in names:
                                own = slope.setdefault(f, [0.0] * len(KINDS))
                                for k in range(len(KINDS)):
                                    own[k] += g[k]
                for f, g in slope.items():
                    w, t = self.weights.setdefault(f, [0.0] * len(KINDS)), total[f]
                    for k in range(len(KINDS)):
                        x = g[k] - decay * w[k]
                        t[k] += x * x
                        w[k] += step * x / math.sqrt(t[k])


#: What may stand around a spelt mark.
OPENS, CLOSES = tuple("([{ "), tuple(")]} ")


def edges_of(text: str, s: int, e: int) -> list[int]:
    return [s, *(m.end() for m in TOKEN.finditer(text, s, e))]


def _logsum(xs: list[float]) -> float:
    m = max(xs)
    return m + math.log(sum(math.exp(x - m) for x in xs))


def spelt_emails(text: str) -> Iterator[tuple[int, int]]:
    """Where an email with a spelt mark may stand."""
    over = 0
    for m in AT.finditer(text):
        s = m.start()
        while s > over and text[s - 1] in LOCAL:
            s -= 1
            if s > over and (dot := DOT_BEFORE.search(text, max(over, s - 12), s)):
                s = dot.start()
        bare = m.group().strip().lower() == "at"
        if s < m.start() and (rest := (AFTER_BARE if bare else AFTER).match(text, m.end())):
            over = rest.end()
            yield s, over


def numbered_chunks(text: str) -> Iterator[tuple[int, int]]:
    over, m = 0, TRIGGER.search(text)
    while m:
        s = m.start()
        while s > over and not text[s - 1].isspace():
            s -= 1
        over = CHUNK_REST.match(text, m.end()).end()
        yield s, over
        m = TRIGGER.search(text, over)


def chunks(text: str) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring chunks that each hold a digit or "@", and emails with a spelt mark; what overlaps is one."""
    s = e = None
    for a, b in heapq.merge(numbered_chunks(text), spelt_emails(text)):
        if e is not None and a < e:
            e = max(e, b)
            continue
        if e is not None:
            yield s, e
        s, e = a, b
    if e is not None:
        yield s, e


def stretches(text: str, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """Neighbouring chunks with a digit or "@", without what is taken."""
    for s, e in chunks(text):
        for a, b, _ in sorted(x for x in taken if x[0] < e and x[1] > s):
            if a - s >= 7:
                yield s, a
            s = max(s, b)
        if e - s >= 7:
            yield s, e


def _chunk_texts(text: str, longest: int = 160) -> Iterator[tuple[str, list[Span]]]:
    """Short contexts of a text with the patterns' spans in them, for training."""
    spans, marks = base_spans(text), list(spelt_emails(text))
    for s, e in chunks(text):
        # a spelt mark has no label of its own, so it can't teach that it is none
        if 7 <= e - s <= longest and not any(s <= a < e for a, _ in marks):
            yield text[s:e], [(a - s, b - s, k) for a, b, k in spans if s <= a and b <= e]


#: Ways to spell what the patterns know as they don't know it.
SPELLINGS = {
    "phone": (
        lambda x: re.sub(r"^\+[0-9]{1,3}[\x20.-]?", "", x), lambda x: "00" + x[1:], lambda x: re.sub("[^0-9]+", ".", x[1:]), lambda x: re.sub("[^0-9]+", "/", x[1:]),
    ),
    "card": (lambda x: re.sub(r"[\x20-]", ".", x), lambda x: "_".join(NOT_DIGIT.sub("", x)), lambda x: "/".join(re.findall(".{1,4}", NOT_DIGIT.sub("", x))), lambda x: "  ".join(re.findall(".{1,4}", NOT_DIGIT.sub("", x)))),
    "email": (lambda x: x.replace("@", "(at)"), lambda x: x.replace("@", " [at] "), lambda x: x.replace("@", " at ").replace(".", " dot "), lambda x: x.replace("@", "{at}")),
    "ip": (lambda x: x.replace(".", "[.]"), lambda x: x.replace(".", " . "), lambda x: x.replace(".", "(.)")),
}


def respelt(text: str, spans: list[Span], seed: int = 0) -> Iterator[tuple[str, list[Span]]]:
    """The same with one span spelt as the patterns don't know it, once for each span."""
    for n, (a, b, k) in enumerate(spans):
        seg = text[a:b]
        ways = SPELLINGS[k]
        new = ways[(a + b + n + seed) % len(ways)](seg)
        if new != seg and len(new) <= MAX_CHARS and (k != "phone" or len(NOT_DIGIT.sub("", new)) >= 7):
            shift = len(new) - len(seg)
            yield text[:a] + new + text[b:], [(a, a + len(new), k) if s == a else (s + shift * (s > a), e + shift * (s > a), q) for s, e, q in spans if s == a or e <= a or s >= b]


def train_on(
    docs: DataFrame, max_docs: int = 1500, max_examples: int = 1200, per_doc: int = 8, longest: int = 160, n_lessons: int = 700, id_col: str = "doc_id", text_col: str = "text"
) -> SegmentField:
    """A field fitted on short contexts of at most max_docs documents that hold a digit or "@", those of least id hash, and on
    n_lessons made-up ones. Only hashes are sorted to find them; a second scan reads their texts, and per_doc contexts of at
    most `longest` characters leave a task for each document."""
    rows = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    last = rows.select("h").orderBy("h").limit(max_docs).agg(F.max("h")).first()[0]
    if last is None:
        return SegmentField()  # nothing to read in any text

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, texts, at = [], [], []
            for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, (c, _) in enumerate(islice(_chunk_texts(t, longest), per_doc)):
                    hs.append(h), texts.append(c), at.append(n)
            yield pa.record_batch([pa.array(hs, pa.int64()), pa.array(at, pa.int32()), pa.array(texts, pa.string())], names=["h", "n", "c"])

    sample = rows.where(F.col("h") <= last).mapInArrow(contexts, "h long, n int, c string").orderBy("h", "n", "c").limit(max_examples)
    examples = []
    for n, c in enumerate(sample.toArrow()["c"].to_pylist()):
        spans = sorted(base_spans(c), key=lambda x: (x[0], -x[1]))
        spans = [x for k, x in enumerate(spans) if all(y[1] <= x[0] for y in spans[:k])]
        examples.append((c, spans))
        examples += respelt(c, spans, n)
    field = SegmentField()
    field.learn(examples + list(lessons(n_lessons)))
    return field


def find(text: str | None, field: SegmentField, margin: float = 2.0) -> tuple[list[Span], list[Span]]:
    """(spans of the patterns, all spans), each by kind, then start."""
    if not text:
        return [], []
    base = base_spans(text)
    own = [(s, e, k) for a, b in stretches(text, base) for s, e, k, x in field.best(text, a, b) if x >= margin]
    return base, sorted({*base, *own}, key=lambda x: (KINDS.index(x[2]), x[0], x[1]))


def said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_spans(docs: DataFrame, field: SegmentField, margin: float = 2.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end, base>>) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(field.weights)  # bounded by the training sample
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SegmentField(sent.value)
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                base, every = find(t, own, margin)
                fixed = set(base)
                out.append([{"kind": k, "start": s, "end": e, "base": (s, e, k) in fixed} for s, e, k in every])
            yield pa.record_batch([batch.column(0), pa.array(out, pa.list_(item))], names=["id", "spans"])

    schema = f"id {kind}, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and the digests of find_spans' rows."""
    text = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select(id_col, *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
