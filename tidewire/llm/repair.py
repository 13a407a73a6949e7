"""Repair of conversations whose turns don't follow the role grammar: generalised LR parsing with weighted edits.

The grammar's LR(0) tables drive a graph-structured stack. Each row may be kept, given another role or deleted, and rows may be
inserted; stacks with equal tops are merged into the one of least (cost, audit). What may follow depends on the top alone in
this grammar, and audits of one place differ before either ends, so merging loses no cheapest repair.

A conversation of any length is parsed in blocks of BLOCK rows: for each top a block may be entered with, the cheapest way to
each top it may be left with; the ways of a conversation's blocks are joined afterwards. Texts are never collected: they pass by,
in order, once the edits are known. A row's duplicates are found by a join that spreads hot texts.

Defined results: null ids, turns, roles and texts count as one space (a null turn comes before all others and is no turn in
gaps); rows of one turn are taken by role, then by the digest of their text; a role without letters has no initial and can't be
kept; repeated rows are duplicates; an empty table gives no conversations. Other columns are left out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import by_sorted_key, in_order, shuffle_width, written
from tidewire.llm.merkle import field
from tidewire.operators.shuffles import join_unique

#: C is a conversation; s, u and a are the initials of its roles.
RULES = (("C", ""), ("C", "B"), ("C", "sB"), ("B", "P"), ("B", "BP"), ("P", "ua"))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
BLOCK_BITS = 12
SPACES = " \t\n\x0b\x0c\r"


class Tables:
    """LR(0) tables of a grammar whose first symbol's rules only accept. A stack is (state, stack below)."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.rules, self.goto, self.ends, self.reduce = rules, {}, set(), {}
        first = rules[0][0]
        states = [self.closure({(k, 0) for k, (left, _) in enumerate(rules) if left == first})]
        for number, items in enumerate(states):  # grows while it is read
            done = [rules[k] for k, dot in items if dot == len(rules[k][1])]
            if any(left == first for left, _ in done):
                self.ends.add(number)
            for left, right in done:
                if left != first:
                    self.reduce[number] = (left, len(right))
            for symbol in sorted({rules[k][1][dot] for k, dot in items if dot < len(rules[k][1])}):
                after = self.closure({(k, dot + 1) for k, dot in items if rules[k][1][dot : dot + 1] == symbol})
                if after not in states:
                    states.append(after)
                self.goto[number, symbol] = states.index(after)
        self.shift = lru_cache(4096)(self._shift)

    def closure(self, items: set) -> frozenset:
        found, todo = set(), list(items)
        while todo:
            k, dot = item = todo.pop()
            if item not in found:
                found.add(item)
                todo += [(n, 0) for n, (left, _) in enumerate(self.rules) if left == self.rules[k][1][dot : dot + 1]]
        return frozenset(found)

    def _shift(self, stack: tuple, symbol: str) -> tuple | None:
        """The stack after a symbol and all reductions; None if it can't come here."""
        state = self.goto.get((stack[0], symbol))
        if state is None:
            return None
        stack = (state, stack)
        while stack[0] in self.reduce:
            left, n = self.reduce[stack[0]]
            for _ in range(n):
                stack = stack[1]
            stack = (self.goto[stack[0], left], stack)
        return stack

    def entries(self, symbols: str) -> dict[int, tuple]:
        """A stack for each top that can be reached. The grammar's stacks must be bounded, as they are without nesting."""
        todo: list[tuple] = [(0, None)]
        for stack in todo:
            todo += [after for s in symbols if (after := self.shift(stack, s)) and after not in todo]
        return {stack[0]: stack for stack in reversed(todo)}


TABLES = Tables(RULES)


def _offer(tops: dict, stack: tuple | None, cost: int, audit: str) -> bool:
    """Merges a stack with the one of equal top: the lesser (cost, audit) stays."""
    if stack is None or (stack[0] in tops and tops[stack[0]][:2] <= (cost, audit)):
        return False
    tops[stack[0]] = (cost, audit, stack)
    return True


def _insert(tops: dict) -> dict:
    changed = True
    while changed:
        changed = False
        for cost, audit, stack in list(tops.values()):
            for role in ROLES:
                changed |= _offer(tops, TABLES.shift(stack, role), cost + INSERT, audit + "I")
    return tops


def parse(tops: dict, rows: list[tuple[str, str]]) -> dict:
    """tops {state: (cost, audit, stack)} after rows of (initial, fault)."""
    tops = _insert(dict(tops))
    for initial, fault in rows:
        after: dict = {}
        more = TRUNCATED if fault == "truncated" else 0
        for cost, audit, stack in tops.values():
            _offer(after, stack, cost + DELETE, audit + "D")
            if fault not in ("blank", "duplicate"):
                _offer(after, TABLES.shift(stack, initial), cost + more, audit + "K")
                for role in ROLES:
                    if role != initial:
                        _offer(after, TABLES.shift(stack, role), cost + REROLE + more, audit + "R")
        tops = _insert(after)
    return tops


WAYS = "array<struct<entry:int,exit:int,cost:long,audit:string>>"
RUN = f"key string, block long, head string, tail string, blank long, duplicate long, truncated long, illegal long, ways {WAYS}"


def _runs(block: pa.Table) -> pa.RecordBatch:
    """A block's rows -> a row for each conversation in it. Only the first one may have begun before."""
    order = np.argsort(block.column("at").to_numpy())
    keys, initials, faults = (block.column(c).to_pylist() for c in ("key", "initial", "fault"))
    keys, initials, faults = ([x[k] for k in order] for x in (keys, initials, faults))
    cuts = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        rows = list(zip(initials[a:b], faults[a:b], strict=True))
        entries = TABLES.entries("sua") if a == 0 else {0: (0, None)}
        ways = [
            {"entry": entry, "exit": leave, "cost": cost, "audit": audit}
            for entry, stack in entries.items() for leave, (cost, audit, _) in parse({entry: (0, "", stack)}, rows).items()
        ]
        counts = {f: faults[a:b].count(f) for f in ("blank", "duplicate", "truncated")}
        illegal = sum(x + y not in LEGAL for x, y in zip(initials[a:b], initials[a + 1 : b], strict=False))
        out.append({"key": keys[a], "block": block.column("block")[0].as_py(), "head": initials[a], "tail": initials[b - 1], **counts, "illegal": illegal, "ways": ways})
    return pa.RecordBatch.from_pylist(out, schema=RUN_ARROW)


WAY_ARROW = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
RUN_ARROW = pa.schema([("key", pa.string()), ("block", pa.int64()), ("head", pa.string()), ("tail", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")], ("ways", pa.list_(WAY_ARROW))])
FOUND = "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
FOUND_ARROW = pa.schema([("key", pa.string()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])


def _join_runs(runs: pa.Table) -> pa.RecordBatch:
    """A conversation's runs -> its cheapest repair: a row for each BLOCK of its rows, without texts."""
    runs = sorted(runs.to_pylist(), key=lambda r: r["block"])
    tops = {0: (0, "")}
    for run in runs:
        after: dict = {}
        for way in run["ways"]:
            if way["entry"] in tops:
                cost, audit = tops[way["entry"]]
                after[way["exit"]] = min(after.get(way["exit"], (float("inf"), "")), (cost + way["cost"], audit + way["audit"]))
        tops = after
    cost, audit = min(v for state, v in tops.items() if state in TABLES.ends)
    total = {c: sum(r[c] for r in runs) for c in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(x["tail"] + y["head"] not in LEGAL for x, y in zip(runs[:-1], runs[1:], strict=True))
    return pa.RecordBatch.from_pylist([{"key": runs[0]["key"], **total, "cost": cost, "audit": audit}], schema=FOUND_ARROW)


def key_of(conv: Column) -> Column:
    return F.coalesce(conv.cast("string"), F.lit(" "))


def faults(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (conv_id, turn, role, text) as (key, turn, role, text, at), a table in order, and (key, at, initial, fault) of each."""
    plain = rows.select(key_of(F.col("conv_id")).alias("key"), "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    same = F.md5(F.concat(*[field(F.col(c)) for c in ("key", "role", "text")]))
    placed = in_order(plain.withColumns({"digest": F.md5("text"), "same": same}), ["key", "turn", "role", "digest"], "repair-rows")
    ended = F.rtrim(F.col("text"), F.lit(SPACES))
    marks = placed.select("key", "at", "same", F.substring("role", 1, 1).alias("initial"), (ended == "").alias("empty"), F.right(ended, F.lit(1)).isin(".", "!", "?").alias("whole"))
    counted = written(marks.groupBy("same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1"), "repair-repeats")
    met = join_unique(marks, counted.select("same", "first"), "same", "left", counts=counted.select("same", "n"))
    fault = F.when(F.col("empty"), "blank").when(F.col("at") > F.col("first"), "duplicate").when(~F.col("whole"), "truncated").otherwise("")
    return placed.select("key", "turn", "role", "text", "at"), met.select("key", "at", "initial", fault.alias("fault"))


def repairs(marked: DataFrame) -> DataFrame:
    """(key, blank, duplicate, truncated, illegal, cost, audit) of each conversation."""
    runs = by_sorted_key(marked.withColumn("block", F.shiftright("at", BLOCK_BITS)), "block", _runs, RUN)
    return by_sorted_key(runs, "key", _join_runs, FOUND)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int | None, str, str, str]]:
    """Rows in order, each conversation led by its audit -> (key, turn, edit, role, text) of every row that stays or is
    inserted, and (key, None, "", "", "") where a conversation begins. Only the audit of one conversation is held."""
    key, audit, place, stack = None, "", 0, (0, None)

    def legal(stack: tuple) -> str:
        return next(r for r in ROLES if TABLES.shift(stack, r))

    def inserted():
        nonlocal place, stack
        while place < len(audit) and audit[place] == "I":
            role = legal(stack)
            place, stack = place + 1, TABLES.shift(stack, role)
            yield key, None, "I", ROLES[role], ""

    for batch in batches:
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "turn", "role", "text"))
        for k, turn, role, text in zip(*columns, strict=True):
            if role is None:
                yield from inserted()
                key, audit, place, stack = k, text, 0, (0, None)
                yield key, None, "", "", ""
                continue
            yield from inserted()
            edit, place = audit[place], place + 1
            if edit == "R":
                role = ROLES[legal(stack)]
            if edit != "D":
                stack = TABLES.shift(stack, role[:1])
                yield key, turn, edit, role, text
    yield from inserted()


def _stream(placed: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order. A conversation streams through one task: its digest has to."""
    heads = found.select("key", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(-1).cast("long").alias("at"))
    rows = placed.select("key", F.col("turn").cast("long").alias("turn"), "role", "text", "at")
    return heads.union(rows).repartition(shuffle_width(placed.sparkSession), "key").sortWithinPartitions("key", "at")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) -> (key, place, turn, role, text, edit): the repaired conversations, place from 0 in
    their order, edit being K, R or I (inserted rows have no turn and an empty text)."""
    placed, marked = faults(rows)
    schema = pa.schema([("key", pa.string()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = [], 0
        for key, turn, edit, role, text in _replay(batches):
            if not edit:
                place = 0
                continue
            out.append((key, place, turn, role, text, edit))
            place += 1
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    return _stream(placed, repairs(marked)).mapInArrow(run, "key string, place long, turn long, role string, text string, edit string")


def digests(placed: DataFrame, found: DataFrame) -> DataFrame:
    """(key, repaired_sha256): sha256 of the repaired rows as role:text, one per line."""
    schema = pa.schema([("key", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, digest, any_ = [], None, None, False
        for k, _, edit, role, text in _replay(batches):
            if not edit:
                if key is not None:
                    done.append({"key": key, "repaired_sha256": digest.hexdigest()})
                key, digest, any_ = k, hashlib.sha256(), False
            else:
                digest.update((b"\n" if any_ else b"") + role.encode() + b":" + text.encode())
                any_ = True
        if key is not None:
            done.append({"key": key, "repaired_sha256": digest.hexdigest()})
        yield pa.RecordBatch.from_pylist(done, schema=schema)  # a short row for each conversation of the partition

    return _stream(placed, found).mapInArrow(run, "key string, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows as a fault injector leaves them: of each twenty values of the crc32 of conv_id:turn, 0 drops the row, 1 empties its
    text, 2 takes its sentence marks, 3 repeats it, 4 makes its role user."""
    kind = F.crc32(F.concat(key_of(F.col("conv_id")), F.lit(":"), key_of(F.col("turn")))) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    told = rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )
    return told.withColumn("times", F.explode(F.sequence(F.lit(1), F.when(F.col("times") > 0, F.col("times"))))).drop("times")


def report(rows: DataFrame, original: DataFrame) -> DataFrame:
    """A row for each conversation of original: what rows (its damaged copy) lack, their faults and their cheapest repair."""
    placed, marked = faults(rows)
    found = written(repairs(marked), "repair-found")
    turns = placed.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    every = original.select("conv_id", key_of(F.col("conv_id")).alias("key")).distinct()
    met = every.join(turns, "key", "left").join(found, "key", "left").join(digests(placed, found), "key", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return met.select(
        "conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
