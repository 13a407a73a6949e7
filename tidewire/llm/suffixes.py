"""Removal of long repeated byte strings by hash-compared suffix sorting.

Each byte covered by a string of `length` (400) bytes that also starts anywhere else, in any document, is removed.

1. Suffixes that can share so long a prefix are brought together. In every window of `length` bytes the leftmost 64-byte
   gram of least hash is its anchor; equal windows have equal anchors at equal places. Neighbouring windows with the same
   anchor form a chunk. Grams that occur once in the corpus cannot belong to a repeat and are dropped.
2. Chunks of equal bytes (128-bit digest) are one class; windows of a class with two or more members are all repeats.
3. Where a gram has several classes, one chunk of each is cut into cells by the window's place before the anchor and by
   a digest of the bytes that all windows of that place range share, so a cell only holds chunks that agree there, and is
   dropped if it holds one. In a cell the suffixes (window starts) are merge-sorted. Two suffixes are compared by the
   length of their common extension, found by binary search over prefix polynomial hashes; the order of suffixes that
   start one byte earlier follows by a stable sort of that byte. Neighbours in order that agree on `length` bytes,
   confirmed byte by byte, are repeats. A cell of more than `HOT_CELL` chunks, as many near copies make, is not sorted in
   one task: its windows are one row each, and equal ones are counted by their 128-bit digests, as chunks are in step 2.

Work is counted over all documents; one copy is not kept (every occurrence goes, as asked). Null and empty texts have
no bytes; texts shorter than `length` lose nothing. Rows with a null id take no part. Repeated rows of an id are one
document, the least text if they differ. Columns other than id and text are not read, whatever their names; an empty table
gives an empty one. Documents are cut into overlapping pieces of at most `PIECE` bytes for anchoring, which changes no
anchor, so long texts need no more memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import groups_in_arrow, shuffle_width, written
from tidewire.operators.shuffles import join_unique

GRAM = 64
PIECE = 1 << 20
PLACES = 64
HOT_CELL = 1024
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
LOW = np.uint64((1 << 24) - 1)


class Powers:
    """Powers of the base and its inverse modulo 2^64, as far as asked."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(INVERSE, k, 1 << 64))])
        return self.up[:n], self.down[:n]


POWERS = Powers()


class Prefixes:
    """Polynomial hashes of all prefixes of a buffer; of any substring in one step."""

    def __init__(self, raw: np.ndarray):
        up, self.down = POWERS(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]


def sliding_least(x: np.ndarray, wide: int) -> np.ndarray:
    """The least of each `wide` neighbours."""
    n = len(x)
    full = -(-n // wide) * wide
    padded = np.full(full, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    blocks = padded.reshape(-1, wide)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - wide + 1], head[wide - 1 : n])


def anchors(raw: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, anchor, first window, last window) of each chunk of a text."""
    grams, places, firsts, lasts = [], [], [], []
    wide = length - GRAM + 1
    for s in range(0, max(0, len(raw) - length + 1), PIECE - length):
        buffer = np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - s), s)
        if len(buffer) < length:
            break
        h = Prefixes(buffer).of(np.arange(len(buffer) - GRAM + 1), GRAM)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        least = sliding_least((h & ~LOW) | np.arange(len(h), dtype=np.uint64), wide)
        at = (least & LOW).astype(np.int64)
        # the last piece apart, a piece answers for the windows that start before the next one
        at = at if s + PIECE >= len(raw) else at[: PIECE - length]
        edge = np.flatnonzero(at[1:] != at[:-1]) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge - 1, [len(at) - 1]])
        grams.append(h[at[first]].view(np.int64)), places.append(at[first] + s), firsts.append(first + s), lasts.append(last + s)
        if s + PIECE >= len(raw):
            break
    if not grams:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in (grams, places, firsts, lasts))


def chunk_rows(docs: DataFrame, length: int) -> DataFrame:
    """(gram, chunk, id, first, back, windows) of docs (id, text): back is the anchor's place in the chunk."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 300):
                part = batch.slice(s, 300)
                cols: list[list] = [[], [], [], [], [], []]
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = t.encode("utf-8", "surrogatepass")
                    gram, place, first, last = anchors(raw, length)
                    view = memoryview(raw)
                    cols[0].append(gram)
                    cols[1] += [xxhash.xxh3_128_digest(view[a : b + length]) + (p - a).to_bytes(2, "little") for a, b, p in zip(first.tolist(), last.tolist(), place.tolist(), strict=True)]
                    cols[2].append(np.full(len(gram), i)), cols[3].append(first), cols[4].append(place - first), cols[5].append(last - first + 1)
                if cols[1]:
                    yield pa.record_batch(
                        [pa.array(np.concatenate(cols[0])), pa.array(cols[1], pa.binary()), *(pa.array(np.concatenate(c).astype(np.int64)).cast(k) for c, k in zip(cols[2:], (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True))],
                        names=["gram", "chunk", "id", "first", "back", "windows"],
                    )

    return docs.mapInArrow(run, "gram long, chunk binary, id long, first long, back int, windows int")


def cells_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(gram, chunk, body, back, places array<int>, cells array<long>) for the wanted chunks: their bytes, and a key for each
    range of `PLACES` places of the window before the anchor."""
    import xxhash

    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("gram", "chunk", "first", "back", "windows")).alias("wanted"))
    joined = docs.join(lists.hint("merge"), "id").select("text", "wanted")  # merged at every size, as is the next

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                part = batch.slice(s, 200)
                rows = []
                for t, chunks in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = t.encode("utf-8", "surrogatepass")
                    for c in chunks:
                        a, back, n = c["first"], c["back"], c["windows"]
                        body = raw[a : a + n - 1 + length]
                        # windows start `back - k` places before the anchor, k from 0 to n - 1
                        at, keys = [], []
                        for place in range((back - n + 1) // PLACES, back // PLACES + 1):
                            low, high = max(place * PLACES, back - n + 1), min(place * PLACES + PLACES - 1, back)
                            core = raw[a + back - place * PLACES : a + back - place * PLACES - PLACES + 1 + length]
                            at.append(place), keys.append(xxhash.xxh3_64_intdigest(core + c["gram"].to_bytes(8, "little", signed=True) + bytes([place])) - (1 << 63))
                            assert low <= high
                        rows.append((c["gram"], c["chunk"], body, back, at, keys))
                if rows:
                    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                    yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["gram", "chunk", "body", "back", "places", "cells"])

    return joined.mapInArrow(run, "gram long, chunk binary, body binary, back int, places array<int>, cells array<long>")


class SuffixOrder:
    """Suffixes of one buffer, compared on their first `length` bytes."""

    def __init__(self, buffer: bytes, length: int):
        self.raw = np.frombuffer(buffer, np.uint8)
        self.hashes, self.length = Prefixes(self.raw), length

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes at a and b share, up to length."""
        low, high = np.zeros(a.shape, np.int64), np.full(a.shape, self.length, np.int64)
        same = self.hashes.of(a, self.length) == self.hashes.of(b, self.length)
        low[same] = self.length
        while (open_ := low < high).any():
            middle = np.where(open_, (low + high + 1) // 2, low)
            equal = self.hashes.of(a, middle) == self.hashes.of(b, middle)
            low, high = np.where(open_ & equal, middle, low), np.where(open_ & ~equal, middle - 1, high)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        e = self.extension(a, b)
        k = np.minimum(e, self.length - 1)
        return np.where(e == self.length, or_equal, self.raw[a + k] < self.raw[b + k])

    def merged(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Two sorted runs in each row -> one: each suffix's rank is its own place and, by binary search, its place in the
        other run."""
        def rank(of: np.ndarray, among: np.ndarray, or_equal: bool) -> np.ndarray:
            low, high = np.zeros(of.shape, np.int64), np.full(of.shape, among.shape[1], np.int64)
            while (open_ := low < high).any():
                middle = (low + high) // 2
                other = np.take_along_axis(among, np.minimum(middle, among.shape[1] - 1), 1)
                less = self.before(other, of, or_equal)
                low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
            return low

        out = np.empty((len(x), x.shape[1] + y.shape[1]), np.int64)
        np.put_along_axis(out, np.arange(x.shape[1]) + rank(x, y, False), x, 1)
        np.put_along_axis(out, np.arange(y.shape[1]) + rank(y, x, True), y, 1)
        return out

    def sorted(self, starts: np.ndarray) -> np.ndarray:
        """Each row of starts in suffix order."""
        runs = [starts[:, k : k + 1] for k in range(starts.shape[1])]
        while len(runs) > 1:
            runs = [self.merged(runs[k], runs[k + 1]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
        return runs[0]

    def repeats(self, tops: np.ndarray, heights: np.ndarray) -> list[np.ndarray]:
        """Each row of tops is a set of suffixes that are compared with one another, and so are those that start 1, 2 ...
        height - 1 bytes before them. Gives the starts whose first `length` bytes start another of their set, too.

        Only the tops are merge-sorted. One byte earlier the order follows from it: by the byte, then by the order of what
        comes after, which is a stable sort of bytes."""
        found, order = [], self.sorted(tops)
        for step in range(int(heights.max())):
            if step:
                on = heights > step
                order, heights = order[on] - 1, heights[on]
                order = np.take_along_axis(order, np.argsort(self.raw[order], axis=1, kind="stable"), 1)
            a, b = order[:, :-1].ravel(), order[:, 1:].ravel()
            alike = self.hashes.of(a, self.length) == self.hashes.of(b, self.length)
            a, b = a[alike], b[alike]
            sure = self.same_bytes(a, b)
            found += [a[sure], b[sure]]
        return found

    def same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        views = np.lib.stride_tricks.sliding_window_view(self.raw, self.length)
        parts = [(views[a[s : s + 4000]] == views[b[s : s + 4000]]).all(axis=1) for s in range(0, len(a), 4000)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)


def cells_repeats(bodies: list[bytes], backs: np.ndarray, places: np.ndarray, cells: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of several cells (cells ascend) -> (chunk, first, last): ranges of windows, by their place in the chunk, that
    another chunk of the cell has, too. Suffixes of all cells with as many members are sorted side by side."""
    size = np.fromiter(map(len, bodies), np.int64, len(bodies))
    at = np.cumsum(size) - size
    lows, highs = np.maximum(places * PLACES, backs - (size - length)), np.minimum(places * PLACES + PLACES - 1, backs)
    order = SuffixOrder(b"".join(bodies), length)
    anchors_at = at + backs
    tops: dict[int, list[np.ndarray]] = {}
    heights: dict[int, list[int]] = {}
    edge = np.flatnonzero(cells[1:] != cells[:-1]) + 1
    for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(cells)], strict=True):
        if e - s < 2:
            continue
        low, high, anchor = lows[s:e], highs[s:e], anchors_at[s:e]
        cuts = np.unique(np.concatenate([low, high + 1])).tolist()
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            members = anchor[(low <= x) & (x <= high)]
            if len(members) > 1:
                tops.setdefault(len(members), []).append(members - x)
                heights.setdefault(len(members), []).append(y - x)
    found = [p for n, rows in tops.items() for p in order.repeats(np.stack(rows), np.array(heights[n]))]
    p = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    owner = np.searchsorted(at, p, "right") - 1
    cut = np.flatnonzero((np.diff(p) != 1) | (np.diff(owner) != 0))
    first, last = np.concatenate([[0], cut + 1]).astype(np.int64), np.concatenate([cut, [len(p) - 1]]).astype(np.int64)
    return (owner[first], p[first] - at[owner[first]], p[last] - at[owner[last]]) if len(p) else (p, p, p)


def compared(cells: DataFrame, length: int, together: int = 1500) -> DataFrame:
    """cells (cell, place, gram, chunk, body, back) -> (gram, chunk, start, stop): ranges of windows of the chunk, by their
    place in it, that are repeats. Small cells are worked on together, about `together` chunks at once."""

    def flush(held: list[pa.Table]) -> pa.RecordBatch | None:
        group = pa.concat_tables(held)
        column = lambda c: group.column(c).to_numpy().astype(np.int64)
        owner, start, stop = cells_repeats(group.column("body").to_pylist(), column("back"), column("place"), column("cell"), length)
        if not len(owner):
            return None
        rows = group.select(["gram", "chunk"]).take(pa.array(owner)).combine_chunks().to_batches()[0]
        return pa.record_batch([rows.column(0), rows.column(1), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["gram", "chunk", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n = 0
        for group in groups_in_arrow(batches, "cell"):
            held.append(group if isinstance(group, pa.Table) else pa.Table.from_batches([group]))
            n += group.num_rows
            if n >= together:
                if (out := flush(held)) is not None:
                    yield out
                held, n = [], 0
        if held and (out := flush(held)) is not None:
            yield out

    dealt = cells.select("cell", "place", "gram", "chunk", "body", "back").repartition(shuffle_width(cells.sparkSession), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "gram long, chunk binary, start int, stop int")


def counted(cells: DataFrame, length: int) -> DataFrame:
    """cells (cell, place, gram, chunk, body, back) -> (gram, chunk, start, stop) as compared gives it, by counting equal
    windows; no task holds a cell."""
    import xxhash

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                at, starts, digests = [], [], []
                for n, (place, body, back) in enumerate(zip(*(part.column(c).to_pylist() for c in (0, 3, 4)), strict=True)):
                    low, high = max(place * PLACES, back - (len(body) - length)), min(place * PLACES + PLACES - 1, back)
                    for start in range(back - high, back - low + 1):
                        at.append(n), starts.append(start), digests.append(xxhash.xxh3_128_digest(body[start : start + length]))
                rows = part.take(pa.array(at, pa.int64()))
                yield pa.record_batch([rows.column(1), rows.column(2), pa.array(starts, pa.int32()), pa.array(digests, pa.binary())], names=["gram", "chunk", "start", "window"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, firsts, lasts = [], [], []
            for n, starts in enumerate(batch.column(2).to_pylist()):
                cut = [k for k in range(1, len(starts)) if starts[k] != starts[k - 1] + 1]
                for a, b in zip([0, *cut], [*cut, len(starts)], strict=True):
                    at.append(n), firsts.append(starts[a]), lasts.append(starts[b - 1])
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], names=["gram", "chunk", "start", "stop"])

    rows = written(cells.select("place", "gram", "chunk", "body", "back").mapInArrow(windows, "gram long, chunk binary, start int, window binary"), "chunk-windows")
    counts = written(rows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1"), "chunk-windows")
    alike = join_unique(rows, counts.select("window"), "window", counts=counts)
    lists = alike.groupBy("gram", "chunk").agg(F.sort_array(F.collect_list("start")).alias("starts"))  # a chunk has fewer than `length` windows
    return lists.mapInArrow(runs, "gram long, chunk binary, start int, stop int")


def repeated_ranges(docs: DataFrame, length: int = 400) -> DataFrame:
    """(id, ranges array<struct<start, stop>>) of docs (id, text): byte ranges to remove; they may overlap."""
    chunks = written(chunk_rows(docs, length), "chunks")
    classes = written(
        chunks.groupBy("gram", "chunk").agg(
            F.count("*").alias("n"), F.min(F.struct("id", "first")).alias("one"), F.first("back").alias("back"), F.first("windows").alias("windows")
        ),
        "chunk-classes",
    )
    grams = written(classes.groupBy("gram").agg(F.count("*").alias("kinds"), F.sum("n").alias("total")).where("total > 1"), "chunk-grams")
    whole = classes.where("n > 1").select("gram", "chunk", F.lit(0).alias("start"), (F.col("windows") - 1).alias("stop"))
    several = grams.where("kinds > 1")
    mixed = join_unique(classes, several.select("gram"), "gram", counts=several.select("gram", F.col("kinds").alias("n"))).select("gram", "chunk", "one.*", "back", "windows")
    bodies = written(cells_of(docs, mixed, length), "chunk-bodies")
    keyed = bodies.select("gram", "chunk", F.explode(F.arrays_zip("cells", "places")).alias("x")).select("gram", "chunk", F.col("x.cells").alias("cell"), F.col("x.places").alias("place"))
    met = written(keyed.groupBy("cell").agg(F.count("*").alias("kinds")).where("kinds > 1"), "chunk-cells")
    wanted = written(join_unique(keyed, met, "cell", counts=met.select("cell", F.col("kinds").alias("n"))), "chunk-meetings")
    held = bodies.select("gram", "chunk", "body", "back")
    parts = compared(wanted.where(F.col("kinds") <= HOT_CELL).join(held, ["gram", "chunk"]), length)
    dealt = counted(wanted.where(F.col("kinds") > HOT_CELL).join(held, ["gram", "chunk"]), length)
    ranges = written(parts.union(dealt).union(whole), "chunk-ranges")
    kind = F.struct("gram", "chunk").alias("kind")
    by_kind = ranges.groupBy(kind).agg(F.collect_set(F.struct("start", "stop")).alias("parts"))  # a chunk has fewer than `length` windows
    met = join_unique(chunks.select(kind, "id", "first"), by_kind, "kind", counts=classes.where("n > 1").select(kind, "n"))
    own = met.select("id", "first", F.explode("parts").alias("part")).select("id", "first", "part.*")
    spans = own.select("id", F.struct((F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop") + length).alias("stop")).alias("x"))
    return spans.groupBy("id").agg(F.collect_set("x").alias("ranges"))


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, removed array<struct<start, stop>>, kept binary) of each document; removed runs are maximal."""
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    texts = named.groupBy("id").agg(F.min("text").alias("text")) if _repeats_ids(named) else named
    ranges = written(repeated_ranges(texts, length), "byte-ranges")
    item = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                n, gone, kept = [], [], []
                for t, rs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    raw = t.encode("utf-8", "surrogatepass")
                    runs = united([(r["start"], r["stop"]) for r in rs or ()])
                    ends = [0, *(x for r in runs for x in r), len(raw)]
                    n.append(len(raw)), gone.append([{"start": a, "stop": b} for a, b in runs])
                    kept.append(b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if runs else raw)
                yield pa.record_batch([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.list_(item)), pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"])

    out = texts.join(ranges.hint("merge"), "id", "left").select("id", "text", "ranges").mapInArrow(run, "id long, n_bytes long, removed array<struct<start:long,stop:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def _repeats_ids(named: DataFrame) -> bool:
    return not named.groupBy("id").count().where("count > 1").isEmpty()


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of without_repeats' rows."""
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return found.select(id_col, "n_bytes", lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

