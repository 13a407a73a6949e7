"""A Merkle manifest of a table: a tree of hashes for each group of rows, a tree over the groups' roots, a proof for each row.

Levels are built by self-joins on sibling numbers: a node of a run of `arity` sends its digest to the numbers of its siblings
(the number XOR 1 for pairs, slot offsets within the run otherwise), every node is joined with what was sent to its number, and
the nodes of slot zero emit their parents. Trees hold digests, never texts; a level has an eighth of the rows below it, and
proofs come down from the root, so that all levels together cost little more than the lowest. No group is hot: a join's key is
one node, and numbers come from range partitions.

Defined results: a null group is a group of its own, before all others; a null order column comes first; repeated rows are
leaves of their own, next to each other; an empty table has an empty manifest. Columns that are not asked for don't count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import numbered, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NONE, START = "array<struct<slot:long,digest:binary>>", "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row as lower-case hex."""
    return F.sha2(F.concat(*map(field, values)), 256)


def shown(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _texts(siblings: Column) -> Column:
    return F.array_join(F.transform(siblings, lambda s: shown(s["digest"])), "")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (tree, idx, n, digest and more) with siblings: (slot, digest) of the others of their run, in order."""
    slot = F.pmod(F.col("idx"), F.lit(arity))
    sender = F.struct(slot.alias("slot"), "digest").alias("sibling")
    some = nodes.where("n > 1")
    if arity == 2:
        sent = some.select("tree", F.col("idx").bitwiseXOR(F.lit(1)).alias("idx"), sender)
    else:
        shifts = some.select("tree", "idx", slot.alias("slot"), sender, F.explode(F.sequence(F.lit(1), F.lit(arity - 1))).alias("shift"))
        sent = shifts.select("tree", (F.col("idx") - F.col("slot") + F.pmod(F.col("slot") + F.col("shift"), F.lit(arity))).alias("idx"), "sibling")
    given = sent.groupBy("tree", "idx").agg(F.array_sort(F.collect_list("sibling")).alias("siblings"))  # arity - 1 of a node
    met = nodes.join(given.hint("merge"), ["tree", "idx"], "left")
    return met.withColumn("siblings", F.coalesce("siblings", F.array().cast(NONE)))


def parents(level: DataFrame, arity: int) -> DataFrame:
    """The next level: what the nodes of slot zero emit, in trees that have more than one node."""
    first = level.where((F.col("n") > 1) & (F.pmod(F.col("idx"), F.lit(arity)) == 0))
    digest = F.unhex(F.sha2(F.concat(shown(F.col("digest")), _texts(F.col("siblings"))), 256))
    return first.select("tree", F.floor(F.col("idx") / arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"), digest.alias("digest"))


def levels_of(nodes: DataFrame, arity: int, name: str) -> list[DataFrame]:
    """Saved levels from the leaves up. Each tree ends in one level with n = 1."""
    most, found = nodes.agg(F.max("n")).first()[0] or 0, []
    while True:
        found.append(written(with_siblings(nodes, arity), f"{name}-{len(found)}"))
        if most <= 1:
            return found
        nodes, most = parents(found[-1], arity), -(-most // arity)


def tops_of(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): where each tree ends."""
    tops = [level.where("n = 1").select("tree", "digest") for level in levels]
    out = tops[0]
    for top in tops[1:]:
        out = out.union(top)
    return out


def _step(slot: Column) -> Column:
    """The siblings to the left and to the right of a slot."""
    before, after = F.filter("siblings", lambda s: s["slot"] < slot), F.filter("siblings", lambda s: s["slot"] > slot)
    return F.struct(_texts(before).alias("before"), _texts(after).alias("after"))


def with_paths(levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """The lowest level with the columns of tops (tree, path and more), path being led by the siblings of its own levels:
    (before, after) in hex. From the top down, each level is joined with its parents."""
    more = [c for c in tops.columns if c not in ("tree", "path")]
    above = None
    for level in reversed(levels):
        own = [c for c in level.columns if c != "siblings"]
        step = _step(F.pmod(F.col("idx"), F.lit(arity)))
        found = level.where("n = 1").join(tops.hint("merge"), "tree").select(*own, "path", *more)
        if above is not None:
            up = above.select("tree", F.col("idx").alias("parent"), "path", *more)
            inner = level.where("n > 1").withColumn("parent", F.floor(F.col("idx") / arity)).join(up.hint("merge"), ["tree", "parent"])
            found = inner.select(*own, F.concat(F.array(step), "path").alias("path"), *more).union(found)
        above = found
    return above


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest (hex) and the siblings of its path give."""
    return F.aggregate(path, start, lambda digest, step: F.sha2(F.concat(step["before"], digest, step["after"]), 256))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, from left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), "")


def manifest(rows: DataFrame, columns: list[str], group: str, order: str, arity: int = 8, altered: list[Column] | None = None) -> DataFrame:
    """(order, group, idx, leaf, other, path, subroot, root): a row for each of rows. leaf is the digest of columns, path its
    proof, idx its number in the group; other is the digest of `altered`, the values as another copy of the table holds them
    (leaf if none are given). Digests are hex."""
    leaf = leaf_of([F.col(c) for c in columns])
    other = leaf if altered is None else leaf_of(altered)
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = written(rows.select(tree.alias("tree"), F.col(order).alias("o"), F.col(group).alias("g"), F.unhex(leaf).alias("digest"), F.unhex(other).alias("other"), F.monotonically_increasing_id().alias("nr")), "merkle-leaves")
    # equal rows are kept apart by their numbers; those hold still because the leaves are a table
    placed = numbered(leaves, "tree", ["o", "digest", "nr"], "merkle-order")
    levels = levels_of(placed.select("tree", F.col("slot").alias("idx"), F.col("group_size").alias("n"), "digest", "o", "g", "other"), arity, "merkle-level")
    groups = numbered(tops_of(levels).select(F.lit("").alias("all"), "tree", "digest"), "all", ["tree"], "merkle-groups")
    crown = levels_of(groups.select(F.col("all").alias("tree"), F.col("slot").alias("idx"), F.col("group_size").alias("n"), "digest", F.col("tree").alias("of")), arity, "merkle-crown")
    root = tops_of(crown).select("tree", F.array().cast(START).alias("path"), F.col("digest").alias("root"))
    tops = with_paths(crown, root, arity).select(F.col("of").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    found = with_paths(levels, tops, arity)
    return found.select(F.col("o").alias(order), F.col("g").alias(group), "idx", shown(F.col("digest")).alias("leaf"), shown(F.col("other")).alias("other"), "path", shown(F.col("subroot")).alias("subroot"), shown(F.col("root")).alias("root"))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered(rows: DataFrame) -> list[Column]:
    """The values of FIELDS after tampering: where three divides the crc32 of doc_id, A to Z of the text are lower-cased."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    return [F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text")) if c == "text" else F.col(c) for c in FIELDS]


def audited(rows: DataFrame, arity: int = 8) -> DataFrame:
    """The manifest of documents checked against a tampered copy: each row's proof, the root that its other leaf folds to, and
    whether that is the root."""
    found = manifest(rows, FIELDS, "lang", "doc_id", arity, tampered(rows))
    out = found.withColumn("folded_root", folded(F.col("other"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def crc32_sql(text: str) -> str:
    """The crc32 of an ASCII text; the query needs CRC_TABLE_SQL as a table of its own."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda d: ord(d)::BIGINT)), lambda c, b: xor(c >> 8, tb[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


CRC_TABLE_SQL = "crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS tb)"


def audit_sql(table: str = "documents", arity: int = 8, heights: tuple[int, int] = (10, 6)) -> str:
    """audited() for DuckDB, over trees of at most arity ** heights[0] rows and arity ** heights[1] groups."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: f"sha256({' || '.join(value(text if c == 'text' else c) for c in FIELDS)})"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    hit = f"doc_id IS NOT NULL AND {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0"
    parts = [
        CRC_TABLE_SQL,
        f"lf AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, {leaf('text')} AS leaf, CASE WHEN {hit} THEN {leaf(f'{low}')} ELSE {leaf('text')} END AS other FROM {table}, crc)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest FROM lf)",
    ]

    def climb(a: str, height: int) -> None:
        for k in range(height):
            parts.append(f"{a}s{k} AS (SELECT tree, idx // {arity} AS run, max(n) AS n, list(digest ORDER BY idx) AS l FROM {a}{k} GROUP BY ALL)")
            parts.append(f"{a}{k + 1} AS (SELECT tree, run AS idx, (n + {arity - 1}) // {arity} AS n, CASE WHEN n = 1 THEN l[1] ELSE sha256(array_to_string(l, '')) END AS digest FROM {a}s{k})")

    def descend(a: str, rows: str, height: int) -> str:
        """rows (tree, idx, proof, folded) taken through all levels."""
        for k in range(height):
            own = f"(r.idx // {arity**k}) % {arity}"
            before, after = f"array_to_string(l[1:{own}], '')", f"array_to_string(l[{own} + 2:], '')"
            parts.append(
                f"{a}r{k} AS (SELECT r.* EXCLUDE (proof, folded), CASE WHEN s.n = 1 THEN proof ELSE proof || {before} || {after} END AS proof, CASE WHEN s.n = 1 THEN folded ELSE sha256({before} || folded || {after}) END AS folded "
                f"FROM {rows} r JOIN {a}s{k} s ON s.tree = r.tree AND s.run = r.idx // {arity ** (k + 1)})"
            )
            rows = f"{a}r{k}"
        return rows

    climb("a", heights[0])
    parts.append(f"b0 AS (SELECT '' AS tree, tree AS of, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, digest FROM a{heights[0]})")
    climb("b", heights[1])
    parts.append("ar AS (SELECT doc_id, tree, leaf, idx, '' AS proof, other AS folded FROM a0)")
    last = descend("a", "ar", heights[0])
    parts.append(f"br AS (SELECT doc_id, leaf, b0.tree, b0.idx, b0.digest AS subroot, proof, folded FROM {last} x JOIN b0 ON b0.of = x.tree)")
    last = descend("b", "br", heights[1])
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM {last}, (SELECT digest AS root FROM b{heights[1]})"
