"""Line dedup by pairwise alignment.

Lines are trimmed and hashed. A line of at least `min_words` words, or as long in characters, can link documents; it is
keyed with its number among the equal lines of its document, so the second of a document meets the second of another. Two
linking lines are keyed together as well, in their order, if they are at most REACH linking lines apart. Each key links a
document to the first one (least id) that holds it and to the holder just before it. A rare line gives its few links, and a
line that thousands share gives each of them two, with no cut-off by frequency and no pairs within a group.

Each linked pair is aligned by patience diff: of the linking lines that both hold, the longest run that increases in both
goes from the later document. The lines between two neighbouring linking lines, before the first or after the last, are a
gap, and alignment goes on inside it:

- line by line from an aligned linking line, forwards and backwards, as far as some earlier document goes on alike;
- between two aligned linking lines (or an edge of the text), lines that an earlier document has between the same two
  (numbered among equals) are aligned again, longest increasing run first.

A text without linking lines goes if an earlier document has all its lines. Aligned blocks are deleted from the later
document (greater id); the first copy always stays. Linking lines that cross the aligned run of all documents they link to
stay; any two that are near each other and in the same order in some earlier document are linked to it by their common key.

What is shuffled is a few keys for each line, never a document's lines for each partner; texts are read once to hash and
once to cut. Keys that a thousandth of all rows share are joined by broadcast, so boilerplate is no hot key.

A null text stays null, an empty or blank one as it is; they link with nothing. Ids are taken to name one text; repeated
rows of an id are all cut alike, and rows with a null id are left as they are. Equal lines within one document are not
touched by that alone. All columns stay, whatever their names; only one called n_removed is replaced by the count. An
empty table gives an empty one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tidewire.llm.common import PLACE_BITS, in_order, written
from tidewire.operators.shuffles import join_unique

#: Letters of scripts that are written without blanks.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")


def line_hash(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def can_link(line: str, min_words: int) -> bool:
    """Whether a line has so many words: by blanks, at six characters a word, or at two where the script has no blanks."""
    return len(line.split(None, min_words)) >= min_words or len(line) >= 6 * min_words or len(UNSPACED.findall(line)) >= 2 * min_words


#: Kinds of keys: a linking line, two that are near, a gap's lines onwards from the linking line before it, backwards
#: from the one behind it, a line between two of them, a whole text.
LINE, PAIR, ONWARDS, BACKWARDS, BETWEEN, WHOLE = range(6)
#: How far apart, in linking lines, two lines are keyed as an ordered pair.
REACH = 3


def keys_of(text: str, min_words: int) -> list[tuple[int, int, int, int, int]]:
    """(key, kind, place, before, behind) of a text's lines. before and behind: how far the linking lines around a gap's line
    are, 0 for an edge of the text; for a pair, behind is how far its second line is; for a whole text, its lines."""
    lines = [x.strip() for x in text.split("\n")]
    if not any(lines):
        return []
    hashes = [line_hash(x) for x in lines]
    links = [k for k, x in enumerate(lines) if can_link(x, min_words)]
    out: list[tuple[int, int, int, int, int]] = []
    seen: Counter = Counter()

    def add(kind: int, place: int, before: int, behind: int, *parts) -> None:
        seen[kind, parts] += 1
        said = f"{kind} {seen[kind, parts]} " + " ".join(map(str, parts))
        out.append((line_hash(said), kind, place, before, behind))

    if not links:
        add(WHOLE, 0, 0, len(lines), *hashes)
        return out
    for n, (a, b) in enumerate(zip([-1, *links], [*links, len(lines)], strict=True)):
        before, behind = hashes[a] if a >= 0 else None, hashes[b] if b < len(lines) else None
        if a >= 0:
            add(LINE, a, 0, 0, before)
            for later in links[n : n + REACH]:
                add(PAIR, a, 0, later - a, before, hashes[later])
        far = {k: (k - a if a >= 0 else 0, b - k if b < len(lines) else 0) for k in range(a + 1, b)}
        chain = before
        for k in range(a + 1, b):
            if a >= 0:
                chain = line_hash(f"{chain} {hashes[k]}")
                add(ONWARDS, k, *far[k], chain)
            add(BETWEEN, k, *far[k], before, behind, hashes[k])
        chain = behind
        for k in range(b - 1, a, -1) if b < len(lines) else ():
            chain = line_hash(f"{chain} {hashes[k]}")
            add(BACKWARDS, k, *far[k], chain)
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[int]:
    """Positions of the longest run that increases in both places; pairs come in order of the first, those with the same
    one in falling order of the second, so that it counts once."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tops, j)
        back.append(at[p - 1] if p else -1)
        if p == len(tops):
            tops.append(j)
            at.append(k)
        else:
            tops[p], at[p] = j, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def aligned(pairs: set[tuple[int, int]]) -> set[int]:
    """Places of the later document in the longest run of (place, place in the earlier one)."""
    ordered = sorted(pairs, key=lambda x: (x[0], -x[1]))
    return {ordered[k][0] for k in increasing(ordered)}


def common_places(rows: list[dict]) -> list[int]:
    """Places of the aligned blocks in the later document. rows: its keys that an earlier document has."""
    runs: dict[int, set[tuple[int, int]]] = defaultdict(set)
    inside: dict[tuple, set[tuple[int, int]]] = defaultdict(set)
    onwards, backwards, out = [], [], set()
    for r in rows:
        kind, place, there = r["kind"], r["place"], r["their_place"]
        if kind in (LINE, PAIR):
            runs[r["earlier"]].add((place, there))
        if kind == PAIR:
            runs[r["earlier"]].add((place + r["behind"], there + r["their_behind"]))
        elif kind == WHOLE:
            out.update(range(r["behind"]))
        elif kind == ONWARDS:
            onwards.append((place, r["before"], r["earlier"], r["before"] + r["their_behind"] if r["their_behind"] else 0))
        elif kind == BACKWARDS:
            backwards.append((place, r["before"], r["behind"], r["earlier"]))
        elif kind == BETWEEN:
            start = place - r["before"] if r["before"] else -1
            end = place + r["behind"] if r["behind"] else -1
            inside[start, end, r["earlier"]].add((place, there))
    for pairs in runs.values():
        out |= aligned(pairs)
    gone = frozenset(out)
    met: dict[tuple[int, int], tuple[int, int]] = {}
    for place, before, earlier, width in sorted(onwards):
        if place - before in gone:
            out.add(place)
            met[place - before, earlier] = before, width
    for place, before, behind, earlier in backwards:
        # a line of the earlier document's gap counts once, from one side
        ahead, width = met.get((place - before, earlier), (0, 0)) if before else (0, 0)
        if place + behind in gone and (not width or ahead + behind < width):
            out.add(place)
    for (start, end, _), pairs in inside.items():
        if (start < 0 or start in gone) and (end < 0 or end in gone) and (start >= 0 or end >= 0):
            out |= aligned(pairs)
    return sorted(out)


def linking(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, kind, place, before, behind): see keys_of."""
    kinds = (pa.int64(), pa.int64(), pa.int8(), pa.int32(), pa.int32(), pa.int32())
    names = ["id", "key", "kind", "place", "before", "behind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                rows = [(i, *x) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for x in keys_of(t, min_words)]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    named = docs.where(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "id long, key long, kind byte, place int, before int, behind int")


def before_them(shared: DataFrame) -> DataFrame:
    """shared (key, id, place, behind and more), keys that several documents hold -> the rows with the holder of the key just
    before them: earlier, their_place, their_behind. Keys are dealt in ranges of (key, id); where a key goes on in the next
    range, the last holder of the one before is looked up, of which there are fewer than ranges."""
    placed = in_order(shared, ["key", "id", "place"], "line-holders")
    part, holder = F.shiftright("at", PLACE_BITS), F.struct("id", "place", "behind")
    ends = placed.groupBy("key", part.alias("part")).agg(F.max_by(holder, "at").alias("last"))
    ranges = placed.groupBy(part.alias("part")).agg(F.min_by("key", "at").alias("opens"), F.max_by("key", "at").alias("closes"))  # one row a range
    cut_keys = ranges.select(F.col("opens").alias("key")).union(ranges.select("closes")).distinct()
    carried = ends.join(F.broadcast(cut_keys), "key", "left_semi").select("key", "part", F.lag("last").over(Window.partitionBy("key").orderBy("part")).alias("carried")).where("carried is not null")
    within = placed.withColumns({"part": part, "near": F.lag(holder).over(Window.partitionBy("key", part).orderBy("at"))})
    met = within.join(F.broadcast(carried), ["key", "part"], "left").withColumn("near", F.coalesce("near", "carried")).where("near is not null and near.id < id")
    return met.select(*shared.columns, F.col("near.id").alias("earlier"), F.col("near.place").alias("their_place"), F.col("near.behind").alias("their_behind"))


def deletions(docs: DataFrame, min_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, gone array<int>): places of the lines to delete from each document that loses any."""
    keys = written(linking(docs, min_words, id_col, text_col), "lines")
    owners = keys.groupBy("key").agg(F.min(F.struct("id", "place", "behind")).alias("first"), F.max("id").alias("most"), F.count("*").alias("n")).where("most > first.id")
    theirs = written(owners.select("key", F.col("first.id").alias("earlier"), F.col("first.place").alias("their_place"), F.col("first.behind").alias("their_behind"), "n"), "line-owners")
    met = written(join_unique(keys, theirs.drop("n"), "key", counts=theirs.select("key", "n")).distinct(), "line-links")
    own = ["key", "id", "kind", "place", "before", "behind"]
    links = met.where("id > earlier").unionByName(before_them(met.select(*own))).drop("key").distinct()
    pairs = links.groupBy("id").agg(F.collect_list(F.struct("kind", "place", "before", "behind", "earlier", "their_place", "their_behind")).alias("rows"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [common_places(rows) for rows in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], names=["id", "gone"])

    return written(pairs.mapInArrow(align, "id long, gone array<int>").where(F.size("gone") > 0), "line-deletions")


def cut(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the places' lines taken out of the text, and n_removed, how many."""
    docs = docs.drop("n_removed")
    names = docs.columns
    at = names.index(text_col)
    # one column holds all of docs, so no name can clash; merged at every size, as a broadcast of the deletions would grow
    whole = docs.select(F.struct(*names).alias("doc"), F.col(id_col).cast("long").alias("id"))
    joined = whole.join(gone.hint("merge"), "id", "left").select("doc", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = [], []
            cols = batch.column(0).flatten()
            for t, g in zip(cols[at].to_pylist(), batch.column(1).to_pylist(), strict=True):
                if g and t is not None:
                    g = set(g)
                    t = "\n".join([line for k, line in enumerate(t.split("\n")) if k not in g])
                texts.append(t), n.append(len(g or ()))
            cols[at] = pa.array(texts, pa.string())
            yield pa.record_batch([*cols, pa.array(n, pa.int64())], names=[*names, "n_removed"])

    return joined.mapInArrow(run, StructType([*docs.schema.fields, StructField("n_removed", LongType())]))


def dedup_lines(docs: DataFrame, min_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the later copies of common blocks deleted, and n_removed. All rows stay."""
    return cut(docs, deletions(docs, min_words, id_col, text_col), id_col, text_col)
