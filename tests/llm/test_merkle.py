"""The Merkle manifest against plain hashing: trees of every arity, proofs, tampering, edge cases."""

import hashlib
import random
import zlib

import pytest

from tidewire.llm import merkle
from tidewire.llm.queries import op11_merkle_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
#: Names that the operator uses inside.
CLASHES = "tree idx n digest other at slot group_size path root subroot leaf siblings o g nr".split()


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, arity):
    """Root of hex digests, and each one's path of (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + arity] for k in range(0, len(nodes), arity)]
        for leaf, k in enumerate(at):
            run, slot = runs[k // arity], k % arity
            paths[leaf].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at[leaf] = k // arity
        nodes = [h("".join(run)) for run in runs]
    return nodes[0], paths


def expected(rows, arity):
    trees = {}
    for r in rows:
        trees.setdefault(b"" if r[2] is None else b"=" + r[2].encode(), []).append(r)
    names = sorted(trees)
    subroots, out = [], []
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of((r[0], r[1], r[2], r[3], r[4]))))
        subroots.append(climb([leaf_of((r[0], r[1], r[2], r[3], r[4])) for r in trees[name]], arity))
    root, crowns = climb([s for s, _ in subroots], arity) if names else (None, [])
    for name, (subroot, paths), crown in zip(names, subroots, crowns, strict=True):
        for r, path in zip(trees[name], paths, strict=True):
            leaf = leaf_of((r[0], r[1], r[2], r[3], r[4]))
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            digest = leaf_of((r[0], r[1], r[2], r[3], text))
            for before, after in path + crown:
                digest = h(before + digest + after)
            proof = h("".join(b + a for b, a in path + crown))
            out.append((r[0], leaf, subroot, root, proof, digest, digest == root))
    return out


def rows_of(seed, n, langs):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "Ärger Über ALLES", "plain words", "Some Text " * rng.randrange(40)])
    return [(i * 3 - 5, rng.choice(["a", None, "bé"]), rng.choice(langs), rng.choice([None, 7, -1]), text()) for i in range(n)]


@pytest.mark.parametrize("arity", [2, 3, 8])
@pytest.mark.parametrize("n", [1, 9, 150])
def test_manifest_equals_plain_hashing(spark, arity, n):
    rows = rows_of(n + arity, n, ["en", None, "de", "zß", "", "Ω"])
    rows += [(None, "x", "en", 1, "No Id"), (None, "y", "en", 1, "No Id"), rows[0], rows[0]]  # null and repeated ids, equal rows
    df = spark.createDataFrame([(*r, *range(len(CLASHES))) for r in rows], SCHEMA + "".join(f", {c} int" for c in CLASHES)).repartition(5)
    got = [tuple(r) for r in merkle.audited(df, arity).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(expected(rows, arity), key=key)
    assert n < 150 or not all(r[-1] for r in got)  # few rows may have nothing to tamper with


def test_empty_and_one_group(spark):
    assert merkle.audited(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(3, "s", "en", 2, "ab")], SCHEMA)
    row = merkle.audited(one).first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == h("") and row.verified


def test_one_group_spreads_over_partitions(spark):
    """A group that holds every row is numbered and climbed without one task for it all."""
    df = spark.range(3000).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang", "1L AS n_chars", "concat('Text ', id) AS text")
    got = merkle.audited(df)
    want = expected([tuple(r) for r in df.collect()], 8)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_query_equals_plain_hashing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    got = op11_merkle_manifest(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect())) == sorted(expected(rows, 8))
