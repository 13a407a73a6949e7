"""Nearest neighbours by cosine with vantage-point trees, one for each shard.

Vectors are dealt to shards by a hash of their id, so shards are even whatever the vectors. In a shard a tree splits its
vectors at the median distance from a vantage point, on unit vectors, where distance and cosine agree in order. A search
goes down the nearer side first and enters the other side only if the triangle inequality allows for something nearer than
the k-th found so far, times `relax`: at 1 the search is exact; greater factors prune more. Candidates are ranked by the
cosine of the original vectors in double precision, ties to the smaller id, and each shard's best k are merged.

A task holds one shard's tree, built once, and streams the queries through it, a batch at a time. Only vectors of one length
are compared: shards are dealt by length as well. Vectors that are null, empty, zero, or hold a null or non-finite component
take no part, as queries or candidates; nor do rows with a null id. A query never finds itself (its own id). Rows repeated
under one id are one, with the least of their vectors. Fewer than k candidates give as many rows as there are. Columns other
than id and vector are not read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm.common import written

FUZZ = 1e-9
#: Relaxations of the pruning that are tried, from the boldest on.
FACTORS = (4.0, 3.0, 2.5, 2.0, 1.5, 1.25)


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


class Tree:
    """Nodes over positions of `order`: inner (vantage, radius, left, right), leaf (start, end)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = 256):
        """ids ascend."""
        self.vectors, self.ids = vectors, ids
        norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.norm, self.unit = norm, vectors / norm[:, None]
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(ids), leaf, np.random.default_rng(5))
        self.unit = self.unit[self.order]

    def _build(self, s: int, e: int, leaf: int, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if e - s <= leaf:
            self.order[s:e] = np.sort(self.order[s:e])
            self.nodes[at] = (None, s, e)
            return at
        part = self.order[s:e]
        vantage = self.unit[part[rng.integers(e - s)]]
        d = np.sqrt(np.maximum(0, 2 - 2 * self.unit[part] @ vantage))
        half = (e - s) // 2
        split = np.argpartition(d, half)
        self.order[s:e] = part[split]
        inner, outer = float(d[split[:half]].max()), float(d[split[half:]].min())
        self.nodes[at] = (vantage, inner, outer, self._build(s, s + half, leaf, rng), self._build(s + half, e, leaf, rng))
        return at

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best of each query, best first; -1 where there are fewer."""
        n = len(queries)
        norm = np.sqrt(np.einsum("ij,ij->i", queries, queries))
        unit = queries / norm[:, None]
        best_id, best = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)

        def far(rows: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0, 2 - 2 * np.maximum(best[rows, -1], -1))) / relax

        def at_leaf(rows: np.ndarray, s: int, e: int) -> None:
            near = unit[rows] @ self.unit[s:e].T
            own = self.ids[self.order[s:e]]  # ascending, so equal scores come by id
            near[query_ids[rows][:, None] == own[None, :]] = -np.inf
            some = near.max(axis=1) >= best[rows, -1] - FUZZ
            rows, near = rows[some], near[some]
            if not len(rows):
                return
            top = np.argsort(-np.round(near, 12), axis=1, kind="stable")[:, :k]
            valid = np.take_along_axis(near, top, 1) > -np.inf
            p = self.order[s:e][top]
            score = np.einsum("ijk,ik->ij", self.vectors[p], queries[rows]) / (norm[rows][:, None] * self.norm[p])
            ids = np.concatenate([best_id[rows], np.where(valid, own[top], -1)], 1)
            scores = np.concatenate([best[rows], np.where(valid, score, -np.inf)], 1)
            order = np.argsort(ids, axis=1, kind="stable")
            ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            best_id[rows], best[rows] = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

        def visit(node: int, rows: np.ndarray) -> None:
            if not len(rows):
                return
            own = self.nodes[node]
            if own[0] is None:
                at_leaf(rows, own[1], own[2])
                return
            vantage, inner, outer, left, right = own
            d = np.sqrt(np.maximum(0, 2 - 2 * unit[rows] @ vantage))
            first = d < (inner + outer) / 2
            for near, other, side in ((left, right, first), (right, left, ~first)):
                mine, dist = rows[side], d[side]
                visit(near, mine)
                gap = outer - dist if near == left else dist - inner
                visit(other, mine[gap <= far(mine) + FUZZ])

        visit(self.root, np.arange(n))
        return best_id, best


    def fitted(self, k: int, recall: float, probes: int = 128) -> float:
        """The greatest of FACTORS at which vectors of the tree itself find `recall` of their exact neighbours; 1 is exact."""
        at = np.unique(np.linspace(0, len(self.ids) - 1, probes).astype(int))
        exact = self.search(self.vectors[at], self.ids[at], k, 1.0)[0]
        for factor in FACTORS:
            found = self.search(self.vectors[at], self.ids[at], k, factor)[0]
            if sum(len(np.intersect1d(x[x >= 0], y)) for x, y in zip(exact, found, strict=True)) >= recall * (exact >= 0).sum():
                return factor
        return 1.0


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, relax: float | None = None, recall: float = 0.96, shard_rows: int = 16_384, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of queries among those of vectors. Without a relax, each shard takes the
    factor at which a sample of its own vectors finds `recall` of its neighbours."""
    def clean(df: DataFrame) -> DataFrame:
        rows = df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
        once = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).groupBy("id").agg(F.min("v").alias("v"))
        return once.withColumn("size", F.size("v"))

    base, asked = written(clean(vectors), "vectors"), written(clean(queries), "queries")
    # a row for each length of vectors: no more than the longest vector has components, whatever the number of vectors
    sizes = F.broadcast(base.groupBy("size").agg(F.ceil(F.count("*") / shard_rows).alias("shards")))
    shards = max(1, sizes.agg(F.sum("shards")).first()[0] or 0)
    dealt = base.join(sizes, "size").select("size", F.pmod(F.xxhash64("id"), "shards").alias("shard"), F.lit(False).alias("asks"), "id", "v")
    spread = asked.join(sizes, "size").select("size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.lit(True).alias("asks"), "id", "v")
    pairs = dealt.unionByName(spread).repartition(shards, "size", "shard").sortWithinPartitions("size", "shard", "asks", "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at = tree = None
        for batch in batches:
            key = np.stack([batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(3)], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if e == s:
                    continue
                size, shard, asks = key[s].tolist()
                ids, flat = batch.column(3).slice(s, e - s).to_numpy(), batch.column(4).slice(s, e - s).flatten().to_numpy().reshape(-1, size)
                if (size, shard) != at:
                    at, tree, held = (size, shard), None, []
                if not asks:
                    held.append((ids, flat))
                    continue
                if held:
                    tree = Tree(np.concatenate([x for _, x in held]), np.concatenate([x for x, _ in held]))
                    factor = relax or tree.fitted(k, recall)
                    held = []
                if tree is None:
                    continue
                found, score = tree.search(flat, ids, k, factor)
                q, some = np.repeat(ids, k), found.ravel() >= 0
                yield pa.record_batch([pa.array(q[some]), pa.array(found.ravel()[some]), pa.array(score.ravel()[some])], names=["query_id", "vec_id", "score"])

    each = pairs.mapInArrow(work, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
