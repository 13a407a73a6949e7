"""Conversation repair against every sequence of edits and against plain damage; long conversations in blocks."""

import hashlib
import itertools
import random
import re
import zlib

from tidewire.llm import repair
from tidewire.llm.queries import op13_glr_repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLACK = r"[^\x20\x09-\x0D]"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(BLACK, text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "" if last[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def all_repairs(rows, faults, most_inserts):
    """Every edit sequence with up to most_inserts insertions between two rows -> the least (cost, audit, repaired)."""
    best = None
    places = [[""] + ["".join(p) for n in range(1, most_inserts + 1) for p in itertools.product("ua", repeat=n)]] * (len(rows) + 1)
    choices = [["D"] + (["K", "Ru", "Ra"] if f not in ("blank", "duplicate") else []) for f in faults]
    for edits in itertools.product(*choices):
        for inserts in itertools.product(*places):
            cost, audit, out = 0, "", []
            for k in range(len(rows) + 1):
                for x in inserts[k]:
                    cost, audit = cost + 2, audit + "I"
                    out.append(({"u": "user", "a": "assistant"}[x], ""))
                if k < len(rows):
                    e = edits[k]
                    cost += {"D": 3, "K": 0}.get(e, 2) + (e != "D" and faults[k] == "truncated")
                    audit += e[0]
                    if e == "K":
                        out.append(rows[k])
                    elif e != "D":
                        out.append(({"u": "user", "a": "assistant"}[e[1]], rows[k][1]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def sha(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def cheapest(rows, faults):
    """The least repair by a plain table over rows and what has been put out: for longer conversations."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", [])}

    def fill(best):
        for _ in range(3):
            for state, (cost, audit, out) in list(best.items()):
                for x in "ua":
                    to = step.get((state, x))
                    new = (cost + 2, audit + "I", [*out, (name[x], "")])
                    if to and (to not in best or new[:2] < best[to][:2]):
                        best[to] = new
        return best

    best = fill(best)
    for (role, text), fault in zip(rows, faults, strict=True):
        after = {}
        more = fault == "truncated"
        for state, (cost, audit, out) in best.items():
            new = [(state, (cost + 3, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                new.append((step.get((state, role[:1])), (cost + more, audit + "K", [*out, (role, text)])))
                new += [(step.get((state, x)), (cost + 2 + more, audit + "R", [*out, (name[x], text)])) for x in "ua"]
            for to, x in new:
                if to is not None and (to not in after or x[:2] < after[to][:2]):
                    after[to] = x
        best = fill(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def test_tables_of_the_role_grammar():
    entries = repair.TABLES.entries("sua")
    accepted = lambda word: (lambda stack: stack is not None and stack[0] in repair.TABLES.ends)(_feed(word))
    for n in range(7):
        for word in itertools.product("sua", repeat=n):
            assert accepted(word) == bool(re.fullmatch("(s?(ua)+)?", "".join(word)))
    assert len(entries) == 5


def _feed(word):
    stack = (0, None)
    for x in word:
        stack = repair.TABLES.shift(stack, x)
        if stack is None:
            return None
    return stack


def test_parse_equals_every_edit_sequence():
    rng = random.Random(3)
    for _ in range(120):
        rows = [(rng.choice(["system", "user", "assistant", "tool", " "]), rng.choice(["Yes.", "no", "Ok!", "", "Well?"])) for _ in range(rng.randrange(0, 4))]
        faults = faults_of(rows)
        tops = repair.parse({0: (0, "", (0, None))}, [(r[:1], f) for (r, _), f in zip(rows, faults, strict=True)])
        got = min((c, a) for s, (c, a, _) in tops.items() if s in repair.TABLES.ends)
        want = all_repairs(rows, faults, 2)
        assert got == want[:2] == cheapest(rows, faults)[:2]
        assert cheapest(rows, faults)[2] == want[2]


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows, original):
    out = []
    for conv in {r[0] for r in original}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        turns = [r[1] for r in own if r[1] is not None]
        told = [(r[2], r[3]) for r in own]
        faults = faults_of(told)
        cost, audit, fixed = cheapest(told, faults)
        illegal = sum(x[:1] + y[:1] not in ("su", "ua", "au") for (x, _), (y, _) in zip(told, told[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha(fixed)))
    return out


def key(r):
    return tuple(map(str, r))


def some_rows(seed, n, convs):
    rng = random.Random(seed)
    text = lambda: rng.choice(["Yes.", "no", "Ok!", "", " \t", "Well?", "end. \n", "Größe…", None])
    return [(rng.choice(convs), rng.choice([None, *range(12)]), rng.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None]), text()) for _ in range(n)]


def test_report_equals_plain_python(spark):
    rows = some_rows(5, 400, [None, *range(40)])
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA + ", key int, at int, fault int").repartition(3)
    got = repair.report(repair.damaged(df), df)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(damage(rows), rows), key=key)


def test_conversations_of_many_blocks(spark, monkeypatch):
    """A conversation that holds most rows is parsed in blocks; in blocks of 8 rows the result is the same."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["system", "user", "assistant"]), rng.choice(["Yes.", "no", "Ok!", "", f"Line {t}."])) for t in range(300)] + some_rows(6, 60, [2, 3])
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    monkeypatch.setattr(repair, "BLOCK_BITS", 3)
    got = repair.report(df, df)
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(plain, rows), key=key)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again?"), (1, 2, "assistant", "Yes."), (2, 0, "assistant", "cut"), (3, 0, "user", " ")]
    got = repair.repaired_rows(spark.createDataFrame(rows, SCHEMA)).orderBy("key", "place").collect()
    assert [tuple(r) for r in got] == [
        ("1", 0, 0, "user", "Hi.", "K"), ("1", 1, None, "assistant", "", "I"), ("1", 2, 1, "user", "Again?", "K"), ("1", 3, 2, "assistant", "Yes.", "K"),
    ]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.report(repair.damaged(df), df).count() == 0


def test_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op13_glr_repair(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected(damage(rows), rows), key=key)
