"""Near-duplicates by min-max hashing, with every link confirmed on full shingle sets.

A document's set holds its distinct shingles of `words` words (A-Z in lower case, words of non-blank characters), as
64-bit hashes; with fewer words the whole sequence is one shingle. Under each of `hashes` random functions both the
least and the greatest value are kept, so a signature of 2 * hashes values costs `hashes` evaluations for each shingle.
Bands of `rows` values are bucket keys. With 80 functions and 5 rows there are 16 bands of each kind; two sets of
similarity 0.8 miss all 32 with a chance of 3e-6, those of 0.85 with 7e-9. Sets are kept as 40 bits of each hash, for
which two different shingles of a pair of sets agree with a chance of 1e-7.

Documents of equal sets are one class first. Within a bucket every class is compared with the bucket's pivot, in cells
of at most `cell` classes that are compared with one another as well. The links give components. A bucket that still
holds several components, and more classes than one cell compares, is settled exactly: its classes outside the largest
component are compared with all of that component and with each other, in cells of bounded size; such a component's
outsiders are gathered over all its buckets, so a pair is compared once. No pairs are emitted: a cell gives links that
span what it has joined. Memory in a task is that of one cell.

Null, empty and blank texts have an empty set and link with nothing. Rows with a null id take no part. Repeated rows of
an id are one document, with the set of least fingerprint if their texts differ. Columns other than id and text are not
read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import by_sorted_key, written
from tidewire.operators.graph import components
from tidewire.operators.shuffles import join_unique, maybe_in

#: Fixed value: blanks between words.
BLANKS = " \t\n\v\f\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
CACHE_WORDS = 400_000


class Shingler:
    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of a text's shingles."""
        raws = WORD.findall(text.lower() if text.isascii() else text.translate(LOWER)) if text else []
        if not raws:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        new = set(raws).difference(known)
        if new:
            known.update((w, hash_of(w)) for w in new)
        x = np.fromiter(map(known.__getitem__, raws), np.uint64, len(raws))
        wide = min(self.words, len(x))
        out = np.zeros(len(x) - wide + 1, np.uint64)
        for k in range(wide):
            out = mix(out + x[k : len(x) - wide + 1 + k] + np.uint64(k + 1))
        return np.unique(out + np.uint64(wide < self.words))


def hash_of(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def functions(hashes: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 32, hashes, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, hashes, np.uint32)


def min_max(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least values under every function, then the greatest ones. Long sets are read in blocks."""
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for s in range(0, len(x), 512):
        v = x[None, s : s + 512] * a[:, None]
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        v += b[:, None]
        low, high = np.minimum(low, v.min(1)), np.maximum(high, v.max(1))
    return np.concatenate([low, high])


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band; keys of different bands differ."""
    bands = len(signature) // rows
    v = signature[: bands * rows].reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + v[:, k])
    return key.view(np.int64)


def packed(shingles: np.ndarray) -> bytes:
    """The upper 40 bits of each sorted hash."""
    return np.ascontiguousarray((shingles >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def shingle_sets(docs: DataFrame, words: int, hashes: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, fingerprint, shingles binary, buckets): the whole set of each document and its band keys."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(words)
        a, b = functions(hashes)
        for batch in batches:
            for s in range(0, batch.num_rows, 200):
                part = batch.slice(s, 200)
                sets = [own(t) for t in part.column(1).to_pylist()]
                yield pa.record_batch(
                    [
                        part.column(0), pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array(map(packed, sets), pa.binary()),
                        pa.array([band_keys(min_max(x, a, b), rows) if len(x) else None for x in sets], pa.list_(pa.int64())),
                    ],
                    names=["id", "n", "fingerprint", "shingles", "buckets"],
                )

    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "id long, n long, fingerprint binary, shingles binary, buckets array<long>")


class Union:
    """Joins places; the root is the least place."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], light: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (similarity of `percent` or more, on the full sets) that span what is linked among the members of a cell;
    only pairs with a light member and of different labels are compared."""
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    done, out = Union(len(ids)), []
    first: dict[int, int] = {}
    for k, label in enumerate(labels.tolist()):
        done.join(k, first.setdefault(label, k))
    for k in np.flatnonzero(light).tolist():
        rest = np.flatnonzero((labels != labels[k]) & (100 * np.minimum(size, size[k]) >= percent * np.maximum(size, size[k])))
        if not len(rest) or all(done.root(k) == done.root(j) for j in rest.tolist()):
            continue
        at = np.searchsorted(sets[k], flat)
        at[at == size[k]] = size[k] - 1
        shared = np.bincount(owner[sets[k][at] == flat], minlength=len(ids))
        for j in rest[100 * shared[rest] >= percent * (size[k] + size[rest] - shared[rest])].tolist():
            if done.join(k, j):
                out.append((int(ids[k]), int(ids[j])))
    return out


def compared(cells: DataFrame, percent: int) -> DataFrame:
    """cells (cell, rep, light, label, shingles) -> links (a, b)."""

    def work(group: pa.Table) -> pa.RecordBatch | None:
        if group.num_rows < 2:
            return None
        ids, light, labels = (group.column(c).to_numpy() for c in ("rep", "light", "label"))
        ids, at = np.unique(ids, return_index=True)
        raw = group.column("shingles")
        sets = [unpacked(raw[int(i)].as_py()) for i in at]
        marked = set(group.column("rep").to_numpy()[light.astype(bool)].tolist())
        links = spanning_links(ids, sets, np.array([i in marked for i in ids.tolist()]), labels[at], percent)
        if not links:
            return None
        a, b = zip(*links, strict=True)
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return by_sorted_key(cells.select("cell", "rep", "light", "label", "shingles"), "cell", work, "a long, b long")


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, hashes: int = 80, rows: int = 5, cell: int = 128, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id): the least id that links lead to, itself included."""
    every = written(shingle_sets(docs, words, hashes, rows, id_col, text_col), "shingle-sets")
    # repeated rows of an id are one document: its least fingerprint stands for it
    sets = every if _unique(every) else written(every.groupBy("id").agg(F.min(F.struct("fingerprint", "n", "shingles", "buckets")).alias("x")).select("id", "x.n", "x.fingerprint", "x.shingles", "x.buckets"), "shingle-sets")
    # equal sets are one class, held by its least id; empty sets are alone
    held = written(sets.where("n > 0").groupBy("fingerprint").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "shingle-holders")
    named = sets.where("n > 0").select("id", "n", "fingerprint")
    classes = written(
        join_unique(named, held.select("fingerprint", "rep"), "fingerprint", counts=held.select("fingerprint", F.col("copies").alias("n")))
        .select("id", "n", "rep").unionByName(sets.where("n = 0").select("id", "n", F.col("id").alias("rep"))),
        "shingle-classes",
    )
    reps = classes.where("id = rep and n > 0").select("rep")
    bodies = sets.select(F.col("id").alias("rep"), "shingles")
    buckets = written(sets.select(F.col("id").alias("rep"), "buckets").join(reps, "rep").select("rep", F.explode("buckets").alias("bucket")), "shingle-buckets")
    pivots = written(buckets.groupBy("bucket").agg(F.count("*").alias("members"), F.min("rep").alias("pivot")).where("members > 1"), "shingle-pivots")
    shared = written(join_unique(buckets, pivots.select("bucket", "pivot"), "bucket", counts=pivots.select("bucket", F.col("members").alias("n"))), "shingle-shared")

    # every class with its buckets' pivots, a pair once; a pivot's classes are dealt to cells by hash
    star = written(shared.select("pivot", "rep").distinct(), "shingle-stars")
    parts = written(star.groupBy("pivot").agg(F.ceil(F.count("*") / cell).alias("parts"), F.count("*").alias("n")), "shingle-parts")
    dealt = join_unique(star, parts.select("pivot", "parts"), "pivot", counts=parts.select("pivot", "n"))
    plain = dealt.where("rep <> pivot").select("rep", F.xxhash64("pivot", F.pmod(F.xxhash64("rep"), "parts")).alias("cell"))
    hubs = dealt.where("rep = pivot").select("rep", "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    met = written(plain.union(hubs.select("rep", F.xxhash64("pivot", "part"))), "shingle-cells")
    cells = met.join(maybe_in(bodies, met, "rep"), "rep").select("cell", "rep", F.lit(True).alias("light"), F.col("rep").alias("label"), "shingles")
    links = written(compared(cells, percent), "shingle-links")
    first = components(links, "shingle-components")

    open_buckets = join_unique(shared, parts.where("parts > 1").select("pivot"), "pivot").select("bucket", "rep")  # in one cell all pairs are compared
    settled = written(settle(open_buckets, first, bodies, percent, cell), "shingle-links")
    # the settled links join components, so only components are followed again
    named_a, named_b = (first.select(F.col("node").alias(x), F.col("component").alias(f"{x}_home")) for x in "ab")
    between = settled.join(named_a, "a", "left").join(named_b, "b", "left").select(F.coalesce("a_home", "a").alias("a"), F.coalesce("b_home", "b").alias("b"))
    merged = components(between, "shingle-components").select(F.col("node").alias("home"), F.col("component").alias("merged"))
    homes = written(reps.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("home")), "shingle-homes")
    found = join_unique(homes, merged, "home", "left").select("rep", F.coalesce("merged", "home").alias("component"))
    return join_unique(classes, found, "rep", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def _unique(rows: DataFrame) -> bool:
    return rows.groupBy("id").count().where("count > 1").isEmpty()


def settle(shared: DataFrame, components: DataFrame, bodies: DataFrame, percent: int, cell: int) -> DataFrame:
    """Links between components that meet in a bucket and may not have been compared there."""
    labelled = written(
        shared.join(components.withColumnRenamed("node", "rep"), "rep", "left").select(
            "bucket", "rep", F.coalesce("component", "rep").alias("label")
        ),
        "shingle-labels",
    )
    counts = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(F.max(F.struct("n", (-F.col("label")).alias("least"))).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    cores = mixed.select("bucket", (-F.col("main.least")).alias("core"))
    light = written(labelled.join(cores, "bucket").where("label <> core").select("core", "rep", "label").distinct(), "shingle-outsiders")
    inside = labelled.join(cores, "bucket").where("label = core").select("core", "rep", "label").distinct()
    everyone = written(light.withColumn("light", F.lit(True)).union(inside.withColumn("light", F.lit(False))), "shingle-meetings")
    size = written(everyone.groupBy("core").agg(F.ceil(F.count("*") / cell).alias("all_parts"), F.ceil(F.count_if("light") / cell).alias("light_parts"), F.count("*").alias("n")), "shingle-cores")
    dealt = join_unique(everyone, size.drop("n"), "core", counts=size.select("core", "n")).withColumn("h", F.xxhash64("rep"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = dealt.select("core", "rep", "label", F.lit(False).alias("light"), F.pmod("h", "all_parts").alias("i"), spread("light_parts").alias("j")).union(
        dealt.where("light").select("core", "rep", "label", "light", spread("all_parts").alias("i"), F.pmod("h", "light_parts").alias("j"))
    )
    cells = written(rows.select(F.xxhash64("core", "i", "j").alias("cell"), "rep", "label", "light"), "shingle-cells")
    return compared(cells.join(maybe_in(bodies, everyone, "rep"), "rep"), percent)


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without those that a smaller id stands for."""
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col)
    return docs.join(gone.hint("merge"), id_col, "left_anti").select(docs.columns)
