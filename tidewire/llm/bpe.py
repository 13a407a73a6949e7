"""Byte-level BPE: encoding and decoding of whole texts.

Pieces (matches of the splitting pattern) are encoded as padded numpy matrices, one per length bucket. In every round
each row merges its leftmost pair of least rank; pairs are looked up in an open-addressing hash table, and rows that
can merge no more leave the matrix. Pieces longer than the largest bucket (a run of one letter, say) would cost the
square of their length that way; they are merged with a heap instead, in the same order, so the ids are the same.

Null texts count as empty: no ids, no bytes. Texts of any length are worked on in blocks of pieces, and the cache of
pieces is bounded, so memory does not follow the text or the vocabulary. Every row is encoded by itself: repeated rows, and
rows with a null id, each give their own. Columns other than id and text are not read, whatever their names; an empty table
gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = np.uint32(0xFFFFFFFF)
#: Upper lengths (bytes) of the buckets; longer pieces go to the heap.
BUCKETS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128)
CACHE_PIECES = 600_000
#: Fixed value: the splitting pattern for which SIMPLE holds.
FULL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII and of the letters of U+00C0 to U+017F only, spelt out for the faster standard module.
SIMPLE = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ſ]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9À-ÖØ-öø-ſ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
UNUSUAL = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ſ]").search
BLOCK_PIECES = 200_000


class PairTable:
    """(left id, right id) -> merged id, for arrays; linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 2.5))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(1 << bits, NONE, np.uint32)
        keys = self._key(left, right)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            slots, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.keys[slots], self.values[slots] = keys[won], merged[won]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape = left.shape
        keys = self._key(left, right).ravel()
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], NONE)
        todo = np.flatnonzero((found != keys) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out.reshape(shape)


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.uint32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.pairs = PairTable(*(np.array(x, np.uint32) for x in (left, right, merged)))
        self.pair = dict(zip(zip(left, right, strict=True), merged, strict=True))
        self.number = {i: str(i) for i in ranks.values()}
        self.whole = {t: str(i) for t, i in ranks.items()}
        self.said = {str(i): t for t, i in ranks.items()}
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.cache: dict[str, str] = {}
        self.simple_split = re.compile(SIMPLE).findall if pattern == FULL else None

    def _matrix(self, raw: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """raw: bytes of pieces of one bucket, a row each, of which the first `size` count. Yields (rows, ids, how many
        of the ids count) as rows end."""
        n, wide = raw.shape
        ids = self.byte_ids[raw]
        ids[np.arange(wide) >= size[:, None]] = NONE
        rank = self.pairs.get(ids[:, :-1], ids[:, 1:])
        rows, left = np.arange(n), size.copy()
        while len(rows):
            at = rank.argmin(axis=1)
            k = np.arange(len(rows))
            best = rank[k, at]
            done = best == NONE
            if done.any():
                yield rows[done], ids[done], left[done]
                rows, ids, rank, at, best, left = (x[~done] for x in (rows, ids, rank, at, best, left))
                k = np.arange(len(rows))
                if not len(rows):
                    break
            ids[k, at] = best
            left -= 1
            wide = ids.shape[1] - 1
            keep = np.ones(ids.shape, bool)
            keep[k, at + 1] = False
            ids = ids[keep].reshape(len(rows), wide)
            if wide == 1:
                yield rows, ids, left
                break
            rank = rank[keep[:, 1:]].reshape(len(rows), wide - 1)  # a pair's rank goes with its right part; the new neighbours are looked up
            has = at > 0
            rank[k[has], at[has] - 1] = self.pairs.get(ids[k[has], at[has] - 1], best[has])
            has = at < wide - 1
            rank[k[has], at[has]] = self.pairs.get(best[has], ids[k[has], at[has] + 1])

    def _heap(self, piece: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, get = len(ids), self.pair.get
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = r, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if (s := get((r, ids[nxt[i]]))) is not None:
                    heapq.heappush(heap, (s, i, r, ids[nxt[i]]))
            if (p := prv[i]) >= 0 and (s := get((ids[p], r))) is not None:
                heapq.heappush(heap, (s, p, ids[p], r))
        return [ids[i] for i in range(n) if alive[i]]

    def encode_pieces(self, pieces: list[bytes]) -> list[str]:
        """The decimal ids of each piece, joined by one space."""
        out: list[str] = [""] * len(pieces)
        whole, said = self.whole.get, self.number.__getitem__
        rest = [i for i, p in enumerate(pieces) if not (x := whole(p)) or out.__setitem__(i, x)]
        size = np.fromiter((len(pieces[i]) for i in rest), np.int64, len(rest))
        rest = np.array(rest, np.int64)
        bucket = np.searchsorted(BUCKETS, size)
        for i in rest[bucket == len(BUCKETS)].tolist():
            out[i] = " ".join(map(said, self._heap(pieces[i])))
        for b, wide in enumerate(BUCKETS):
            chosen, own = rest[bucket == b], size[bucket == b]
            for s in range(0, len(chosen), 40_000):
                at, n = chosen[s : s + 40_000].tolist(), own[s : s + 40_000]
                raw = np.frombuffer(b"".join([pieces[i].ljust(wide, b"\0") for i in at]), np.uint8).reshape(-1, wide)
                for rows, ids, left in self._matrix(raw, n):
                    for r, line, k in zip(rows.tolist(), ids.tolist(), left.tolist(), strict=True):
                        out[at[r]] = " ".join(map(said, line[:k]))
        return out

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of new pieces, as decimal text, in the cache."""
        new = list(pieces)
        self.cache.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))

    def pieces_of(self, text: str) -> list[str]:
        return self.simple_split(text) if self.simple_split and not UNUSUAL(text) else self.split.findall(text)

    def encode_texts(self, texts: list[str]) -> Iterator[str]:
        """The decimal ids of each text, joined by one space. Blocks of pieces share a matrix."""
        held: list[list[str]] = []
        n = 0
        for text in texts:
            if len(text) > 4 * BLOCK_PIECES:
                yield from self._flush(held)
                held, n = [], 0
                found, parts = (m.group() for m in self.split.finditer(text)), []
                while block := list(islice(found, BLOCK_PIECES)):
                    parts += self._flush([block])
                yield " ".join(parts)
                continue
            pieces = self.pieces_of(text)
            held.append(pieces)
            n += len(pieces)
            if n >= BLOCK_PIECES:
                yield from self._flush(held)
                held, n = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[list[str]]) -> list[str]:
        new = set().union(*held) if held else set()
        missing = new.difference(self.cache)
        if len(self.cache) + len(missing) > CACHE_PIECES:  # what came first is the most frequent
            self.cache = dict(islice(self.cache.items(), CACHE_PIECES // 2))
            missing = new.difference(self.cache)
        if missing:
            self.learn(missing)
        get = self.cache.__getitem__
        return [" ".join(map(get, pieces)) for pieces in held]

    def decode_said(self, ids: str) -> bytes:
        """The bytes of ids given as decimal text."""
        return b"".join(map(self.said.__getitem__, ids.split(" "))) if ids else b""


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def _texts(batch: pa.RecordBatch, text_col: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the whole text, without special tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                ids = [np.array(x.split(" "), np.int32) if x else [] for x in own.encode_texts(_texts(part, text_col))]
                yield pa.record_batch([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary): the bytes that the ids stand for; they are a text's UTF-8 only if the ids came from one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern).bytes_of
        for batch in batches:
            out = [b"".join(map(own.__getitem__, x or ())) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def round_trip_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) in one pass: encode, decode the ids, and keep digests only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            said = own.encode_texts(_texts(batch, text_col))
            rows = [
                (x.count(" ") + 1 if x else 0, hashlib.sha256(x.encode()).hexdigest(), hashlib.sha256(own.decode_said(x)).hexdigest())
                for x in said
            ]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.record_batch(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    out = df.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
    return out.withColumnRenamed("id", id_col)
