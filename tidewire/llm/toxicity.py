"""Toxicity scores of whole texts by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and the first four and five letters of each (endings vary, stems don't),
hashed into buckets. The machine has a weight per bucket and a short vector per bucket; the score is the logistic of
bias + weights + pairwise products of the vectors, so an insult next to a mention of a group can count for more than
both alone. Each term counts once, so long texts are not toxic by length.

It is fitted on a bounded sample of labelled rows (`max_rows`, a parameter: the rows with the least hashes of their
ids, so it does not depend on order or partitions). Terms whose odds in the two classes differ by less
than `least_z` standard errors keep weight zero, or chance terms of long texts would outweigh the rest.
Scoring covers every text. Null and empty texts have no terms; their score is that of the bias alone. If the sample
holds no row of a class, every score is the smoothed share of toxic rows (0 if nothing is labelled). Repeated rows are
scored each, and in training stand for one document (the text of fewest terms, if they differ); a document labelled more
than once counts as toxic if any label says so. Rows with a null id are scored, never held out and never learned from.
Columns other than id, text and label are not read, whatever their names; an empty table gives an empty one. A row's terms
are at most as many as there are buckets, however long the text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 18
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5)
CACHE_WORDS = 500_000


class Terms:
    """Hashed terms of texts; the buckets of words are cached, within a bound."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def _of_word(self, word: str) -> tuple[int, ...]:
        keys = [word, *(f"{word[:k]}*" for k in STEMS if len(word) >= k)]
        return tuple(zlib.crc32(k.encode()) % self.buckets for k in keys)

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct buckets."""
        if not text:
            return np.zeros(0, np.int32)
        found: set[int] = set()
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known = self.known
        for word in set(WORD.findall(text.lower())):
            at = known.get(word)
            if at is None:
                at = known[word] = self._of_word(word)
            found.update(at)
        return np.sort(np.fromiter(found, np.int32, len(found)))


@dataclass
class FactorizationMachine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of rows whose terms are ids[ends[i-1]:ends[i]]."""
        n = len(ends)
        row = np.repeat(np.arange(n), np.diff(ends, prepend=0))
        out = self.bias + np.bincount(row, self.weight[ids], n)
        for k in range(self.factor.shape[1]):
            v = self.factor[ids, k]
            out += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
        ids = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        return 1 / (1 + np.exp(-np.clip(self.margin(ids, ends), -35, 35)))


def fit(
    rows: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS, rank: int = 4, epochs: int = 10, step: float = 0.08,
    decay: float = 2e-4, least_z: float = 3.0, block: int = 256, seed: int = 7,
) -> FactorizationMachine:
    """Logistic loss, AdaGrad on blocks of rows. Deterministic for the same rows in the same order."""
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 0.5) / (len(labels) + 1) if len(labels) else 1e-9
    fm = FactorizationMachine(float(np.log(share / (1 - share))), np.zeros(buckets), np.zeros((buckets, rank)))
    if not len(labels) or labels.min() == labels.max():
        return fm
    used = telling(rows, labels, buckets) >= least_z
    rows = [r[used[r]] for r in rows]
    fm.factor[used] = rng.normal(0, 0.01, (int(used.sum()), rank))
    gw, gv, gb = np.full(buckets, 1e-2), np.full((buckets, rank), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for s in range(0, len(order), block):
            part = [rows[i] for i in order[s : s + block]]
            y, n = labels[order[s : s + block]], len(part)
            size = np.array([len(r) for r in part])
            ids, ends, row = np.concatenate(part), np.cumsum(size), np.repeat(np.arange(n), size)
            v = fm.factor[ids]
            sums = np.stack([np.bincount(row, v[:, k], n) for k in range(rank)], 1)
            margin = fm.bias + np.bincount(row, fm.weight[ids], n)
            margin += 0.5 * (sums**2 - np.stack([np.bincount(row, v[:, k] ** 2, n) for k in range(rank)], 1)).sum(1)
            error = 1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y
            at, own = np.unique(ids, return_inverse=True)
            err = error[row]
            g = np.bincount(own, err, len(at)) + decay * fm.weight[at] * n
            gw[at] += g**2
            fm.weight[at] -= step * g / np.sqrt(gw[at])
            each = err[:, None] * (sums[row] - v)
            g = np.stack([np.bincount(own, each[:, k], len(at)) for k in range(rank)], 1) + decay * fm.factor[at] * n
            gv[at] += g**2
            fm.factor[at] -= 0.3 * step * g / np.sqrt(gv[at])
            gb += float(error.sum()) ** 2
            fm.bias -= step * float(error.sum()) / np.sqrt(gb)
    return fm


def telling(rows: list[np.ndarray], labels: np.ndarray, buckets: int) -> np.ndarray:
    """How many standard errors each term's log odds ratio lies from 0."""
    toxic, clean = labels.sum(), (1 - labels).sum()
    ids, size = np.concatenate(rows), np.array([len(r) for r in rows])
    of_toxic = np.repeat(labels, size)
    a, b = np.bincount(ids, of_toxic, buckets) + 0.5, np.bincount(ids, 1 - of_toxic, buckets) + 0.5
    c, d = toxic - a + 1, clean - b + 1
    return np.where(a + b > 1, np.abs(np.log(a * d / (b * c))) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d), 0.0)


def train_on(
    docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, buckets: int = BUCKETS, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic",
) -> FactorizationMachine:
    """Fits on at most max_rows of the labelled rows. Only their hashed terms reach the driver: some hundred integers a
    row, which max_rows bounds."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
    )

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Terms(buckets)
        for batch in batches:
            ids = [own(t) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["id", "label", "terms"])

    # at most max_rows ids, whatever the corpus: they are broadcast, so the texts stay where they are
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    found = joined.select("id", "label", "text").mapInArrow(terms, "id long, label int, terms array<int>").toArrow()
    got = sorted(zip(found["id"].to_pylist(), found["label"].to_pylist(), found["terms"].to_numpy(), strict=True), key=lambda x: (x[0], len(x[2])))
    seen, rows, marks = set(), [], []
    for i, label, terms_of in got:
        if i not in seen:
            seen.add(i), rows.append(np.asarray(terms_of, np.int32)), marks.append(label)
    return fit(rows, np.array(marks, float), buckets)


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    spark = docs.sparkSession
    kept = np.flatnonzero(model.weight.astype(bool) | model.factor.any(axis=1))
    buckets = len(model.weight)
    sent = spark.sparkContext.broadcast((model.bias, kept, model.weight[kept], model.factor[kept]))  # its size is the model's, not the corpus's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, weight, factor = sent.value
        own = FactorizationMachine(bias, np.zeros(buckets), np.zeros((buckets, factor.shape[1])))
        own.weight[at], own.factor[at] = weight, factor
        terms = Terms(buckets)
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                scores = own.score([terms(t) for t in part.column(1).to_pylist()])
                yield pa.record_batch([part.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def in_fold(doc_id, fold: int = 1, folds: int = 3):
    """Whether crc32 of the id as text falls on this remainder; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def rejected(score_col: str = "score", threshold: float = 0.7):
    return F.col(score_col) >= threshold


def drop_toxic(docs: DataFrame, model: FactorizationMachine, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs without the rows that score threshold or more; all columns stay as they are."""
    spark = docs.sparkSession
    fields = docs.schema
    kept = np.flatnonzero(model.weight.astype(bool) | model.factor.any(axis=1))
    buckets, at_text = len(model.weight), docs.columns.index(text_col)
    sent = spark.sparkContext.broadcast((model.bias, kept, model.weight[kept], model.factor[kept]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, weight, factor = sent.value
        own = FactorizationMachine(bias, np.zeros(buckets), np.zeros((buckets, factor.shape[1])))
        own.weight[at], own.factor[at] = weight, factor
        terms = Terms(buckets)
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                scores = own.score([terms(t) for t in part.column(at_text).to_pylist()])
                yield part.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, fields)
