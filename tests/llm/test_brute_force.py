"""Line alignment, quotation linking, template leaks, vantage-point trees, added spans and hot cells against brute force."""

import collections
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewire.llm import chat, decontaminate, line_dedup, minhash, pii, suffixes, toxicity, vptree
from tidewire.llm.queries import op7_quote_linking

DOCS = "doc_id long, text string"


def longest_run(pairs):
    """Length of the longest run that increases in both, by trying every end."""
    best = {}
    for a, b in sorted(pairs):
        best[a, b] = 1 + max((n for (x, y), n in best.items() if x < a and y < b), default=0)
    return max(best.values(), default=0)


def numbered(lines, links):
    seen, out = collections.Counter(), {}
    for k, x in enumerate(lines):
        if links(x):
            seen[x] += 1
            out[x, seen[x]] = k
    return out


def is_subsequence(part, whole):
    rest = iter(whole)
    return all(x in rest for x in part)


def test_alignment_of_two_documents_equals_brute_force():
    rng = random.Random(8)
    links = lambda x: line_dedup.can_link(x, 4)
    for _ in range(1500):
        pool = [f"linking line number {i}" for i in range(6)] + ["a", "b", "c", "", "}"]
        earlier, later = ([rng.choice(pool) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        if rng.random() < 0.5:
            s = rng.randrange(len(earlier))
            later[rng.randrange(len(later)) :] = earlier[s : s + rng.randrange(1, 9)]
        owners = {}
        for key, kind, place, _, behind in line_dedup.keys_of("\n".join(earlier), 4):
            owners.setdefault(key, (place, behind))
        rows = [
            {"kind": kind, "place": place, "before": before, "behind": behind, "earlier": 1, "their_place": owners[key][0], "their_behind": owners[key][1]}
            for key, kind, place, before, behind in line_dedup.keys_of("\n".join(later), 4) if key in owners
        ]
        gone = line_dedup.common_places(rows)
        mine, theirs = numbered(later, links), numbered(earlier, links)
        pairs = {(mine[x], theirs[x]) for x in mine if x in theirs}
        near = lambda lines: [(a, b) for own in [[k for k, x in enumerate(lines) if links(x)]] for n, a in enumerate(own) for b in own[n + 1 : n + 1 + line_dedup.REACH]]
        for a, b in near(later):
            for c, d in near(earlier):
                if (later[a], later[b]) == (earlier[c], earlier[d]):
                    pairs |= {(a, c), (b, d)}  # lines that are near meet wherever the pair stands
        removed = sum(links(later[k]) for k in gone)
        exact = longest_run({(mine[x], theirs[x]) for x in mine if x in theirs})
        assert exact <= removed <= longest_run(pairs), (earlier, later, gone)
        if all(n == 1 for n in collections.Counter(earlier).values()):
            assert is_subsequence([later[k] for k in gone if links(later[k])], earlier), (earlier, later, gone)
        # gaps go on line by line from what is aligned
        if earlier == later and any(map(links, later)):
            assert gone == list(range(len(later)))


def plain_dedup(texts, min_words=4):
    """Each document aligned with the first and with the last earlier holder of each of its keys."""
    holders, out = {}, []
    for i, text in enumerate(texts):
        keys = line_dedup.keys_of(text, min_words)
        rows = [
            {"kind": kind, "place": place, "before": before, "behind": behind, "earlier": e, "their_place": p, "their_behind": b}
            for key, kind, place, before, behind in keys for e, p, b in {x for x in (holders.get(key, [None])[0], holders.get(key, [None])[-1]) if x}
        ]
        gone = set(line_dedup.common_places(rows))
        out.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone))
        for key, _, place, _, behind in keys:
            holders.setdefault(key, []).append((i, place, behind))
    return out


def test_lines_that_cross_the_first_holder_go_with_another(spark):
    a, b = "the first of two lines that are shared", "the second of two lines that are shared"
    own = lambda k: "\n".join(f"line {j} that only document {k} has in it" for j in range(6))
    for between in ("x", own(1)):
        texts = [f"{b}\n{a}", f"{a}\n{between}\n{b}", f"{a}\ny\n{b}", f"{a}\n{own(3)}\n{b}"]
        rows = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
        assert rows[2] in ("y", "") and rows[3] == own(3)


@pytest.mark.parametrize("width", [1, 3])
def test_line_dedup_equals_plain_python(spark, width):
    rng = random.Random(width)
    pool = [f"linking line number {k} here" for k in range(9)] + ["a", "b", "", "}"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))) for _ in range(120)] + ["linking line number 0 here"] * 40
    spark.conf.set("spark.sql.shuffle.partitions", str(width * 4))
    try:
        rows = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [rows[i] for i in range(len(texts))] == plain_dedup(texts)


@pytest.mark.parametrize("size", [4, 8, 16, 32])
def test_recall_of_every_dimension(size):
    """Gaussian vectors have no clusters that make a bold pruning right; the factor is fitted to them."""
    rng = np.random.default_rng(size)
    vectors = rng.normal(size=(16_384, size))
    tree = vptree.Tree(vectors, np.arange(len(vectors)))
    asked = np.arange(0, len(vectors), 80)
    exact = tree.search(vectors[asked], asked, 5, 1.0)[0]
    factor = tree.fitted(5, 0.96)
    found = tree.search(vectors[asked], asked, 5, factor)[0]
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    near = unit[asked] @ unit.T
    near[np.arange(len(asked)), asked] = -2
    assert (np.sort(np.argsort(-near, 1)[:, :5], 1) == np.sort(exact, 1)).mean() > 0.999
    assert factor > 1 and np.mean([len(np.intersect1d(x, y)) / 5 for x, y in zip(exact, found, strict=True)]) >= 0.93


def test_alignment_goes_into_gaps(spark):
    a, b, c = "opening line of four words", "closing line of four words", "another line of four words"
    texts = [
        f"{a}\nshort a\nshort b\n{b}\ntail", f"{a}\nshort a\nother c\n{b}\ntail", f"{a}\nx\nshort b\ny\n{b}\nend", f"{c}\n{b}\n{a}", f"{c}\n{b}\n{a}",
        f"own\n{a}\nshort a\nshort a\nshort b\n{b}",
    ]
    rows = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts, 1)), DOCS)).collect()}
    assert rows[1] == texts[0] and rows[2] == "other c" and rows[3] == "x\ny\nend"
    assert rows[4].count("\n") == 1 and rows[5] == ""  # an exact copy of a document whose lines cross goes whole
    assert rows[6] in ("own\nshort a", "own")


def plain_said(x):
    return " ".join(re.findall(r"[^\W_]+", x.lower()))


def plain_runs(text):
    """[(level, [said])] of a text."""
    out, last = [], None
    for line in re.split("\r?\n", text or ""):
        marks = re.match("[ \t]*(>[ \t]*)*", line).group()
        level, said = marks.count(">"), plain_said(line[len(marks) :])
        if said:
            if last == level:
                out[-1][1].append(said)
            else:
                out.append((level, [said]))
        last = level if said else None
    return out


def plain_links(rows):
    parsed = [(c, t, plain_runs(x)) for c, t, _, x in rows]
    out = collections.defaultdict(dict)
    for c, t, runs in parsed:
        for level, said in runs:
            if not level:
                continue
            words, found = " ".join(said), []
            for c2, t2, runs2 in parsed:
                own = [r for lv, r in runs2 if lv == 0]
                says = {" ".join(x for r in own for x in r)} | {" ".join(r) for r in own} | {" ".join(r[i : i + len(said)]) for r in own for i in range(len(r) - len(said) + 1)}
                if c2 == c and words in says:
                    found.append(t2)
            if found and min(found) < t:
                out[c, t][words] = min(found)
    return out


def quoted_conversations(seed):
    rng = random.Random(seed)
    lines = [f"{w} words of line {i}" for i, w in enumerate("some other more few many".split())] + ["Thanks!", "", "Ünïcode Straße?"]
    rows = []
    for c in range(6):
        said = []
        for t in range(9):
            text = []
            for _ in range(rng.randrange(1, 4)):
                if said and rng.random() < 0.7:
                    old = rng.choice(said).split("\n")
                    s = rng.randrange(len(old))
                    mark = rng.choice(["> ", ">", "> > ", ">> "])
                    text += [mark + x for x in old[s : s + rng.randrange(1, 4)]]
                text += [rng.choice(lines) for _ in range(rng.randrange(0, 4))]
            said.append("\n".join(text))
            rows.append((c, t, "user", said[-1]))
    return [*rows, (7, None, "user", "> x"), (None, 1, "user", "a"), (8, 0, None, None), (8, 1, "", ""), (0, 3, "user", rows[3][3])]


@pytest.mark.parametrize("seed", [1, 2])
def test_quotation_links_equal_brute_force_and_sql(spark, tmp_path, seed):
    rows = quoted_conversations(seed)
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "conv_id long, turn int, role string, text string, thread int")
    got = {(r.conv_id, r.turn): r for r in chat.reply_order(df).collect()}
    links = plain_links(rows)
    assert sum(map(len, links.values())) > 20
    for c, t, _, _ in rows:
        own = links.get((c, t), {})
        assert (got[c, t].parent_turn, got[c, t].n_linked) == (max(own.values(), default=None), len(own)), (c, t)
    parent = {k: max(v.values()) for k, v in links.items()}
    for (c, t), r in got.items():
        if c is not None and t is not None:
            top = t
            while (c, top) in parent:
                top = parent[c, top]
            assert r.thread == top
    df.drop("thread").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    spark_rows, sql_rows = op7_quote_linking(spark, str(tmp_path)).collect(), con.sql(chat.reply_sql())
    names = spark_rows[0].__fields__
    said = lambda rs: sorted(str([None if x is None or (isinstance(x, float) and np.isnan(x)) else x for x in r]) for r in rs)
    assert said([[r[n] for n in names] for r in spark_rows]) == said([[dict(zip(sql_rows.columns, r, strict=True))[n] for n in names] for r in sql_rows.fetchall()])


def test_partial_quotes_and_assembled_threads(spark):
    rows = [
        (1, 0, "user", "First point here.\nSecond point here.\nThird point here.\n\nBye"), (1, 1, "bot", "> Second point here.\n> Third point here.\nAgreed.\nFully."),
        (1, 2, "user", "> Agreed\n> fully\n>> second point here. third point here\nGood"), (1, 3, "user", "new"),
    ]
    ordered = chat.reply_order(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert [(r.turn, r.parent_turn, r.thread, r.position, r.n_linked) for r in ordered.orderBy("turn").collect()] == [(0, None, 0, 1, 0), (1, 0, 0, 2, 1), (2, 1, 0, 3, 2), (3, None, 3, 1, 0)]
    texts = {(r.thread, r.part): r.chat for r in chat.assembled(ordered, 2).collect()}
    assert texts[0, 1] == "<|user|>\nGood\n" and texts[0, 0].endswith("<|bot|>\nAgreed.\nFully.\n") and texts[3, 0] == "<|user|>\nnew\n"
    turns = spark.createDataFrame([(1, 0, t % 7000) for t in range(9000)], "conv_id int, thread int, turn int")
    assert {(r.turn, r.position) for r in chat.positions(turns, 100).collect()} == {(t, 1 + t + min(t, 2000)) for t in range(7000)}


def brute_template(item, doc):
    """Whether doc's words are item's with digits and names (capitals; neither opens a sentence) mapped one to one."""
    there, back = {}, {}
    for a, b in zip(item, doc, strict=True):
        kinds = [("n" if x[0].isdigit() else "N" if x[0].isupper() else "") for x in (a, b)]
        if kinds[0] != kinds[1] or (not kinds[0] and a != b):
            return False
        if kinds[0] and (there.setdefault((kinds[0], a), b) != b or back.setdefault((kinds[0], b), a) != a):
            return False
    return True


def test_templates_equal_brute_force():
    rng = random.Random(12)
    literal = [f"w{chr(97 + i)}" for i in range(14)]

    def words(n):
        out, slot = [rng.choice(literal)], False
        while len(out) < n:
            slot = not slot and rng.random() < 0.35  # slots never touch, so one word is one template word
            out.append(rng.choice((str(rng.randrange(2, 9)), rng.choice(("Ann", "Bob", "Cid")))) if slot else rng.choice(literal))
        return out

    items = {i: words(rng.randrange(9, 14)) for i in range(60)}
    index = decontaminate.Index([(i, " ".join(x)) for i, x in items.items()], 5)
    found = missed = 0
    for _ in range(600):
        item = rng.choice(list(items.values()))
        doc = list(item)
        for k, x in enumerate(doc):
            if x[0].isdigit() or x[0].isupper():
                if rng.random() < 0.3:  # sometimes one to one, sometimes not
                    doc = [(y if y != x else (x + "7" if x[0].isdigit() else x + "a")) for y in doc]
                elif rng.random() < 0.35:
                    doc[k] = "8" if x[0].isdigit() else "Dan"
        text = [*words(6), *doc, *words(6)]
        got = {i for i, *_ in index.hits(" ".join(text), 1.0)}
        want = {i for i, x in items.items() for s in range(len(text) - len(x) + 1) if brute_template(x, text[s : s + len(x)])}
        lower = {i for i, x in items.items() if not any(w[0].isupper() for w in x)}
        assert want <= got, (item, doc)
        assert got <= want | lower | {i for i, x in items.items() if len(x) < 9}, (item, doc)
        found, missed = found + bool(want), missed + (not want)
    assert found > 100 and missed > 50


def test_shipped_pruning_keeps_recall_and_lengths_apart(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 32))
    v = centres[rng.integers(40, size=6000)] + 0.6 * rng.normal(size=(6000, 32))
    rows = [(i, x.tolist(), i) for i, x in enumerate(v)] + [(10_000 + i, [1.0, float(i), 2.0], 0) for i in range(100)] + [(20_000, [1.0], 0), (7, v[8].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int")
    got = collections.defaultdict(list)
    for r in vptree.nearest(df, df.where("vec_id % 50 = 0"), 5, shard_rows=2000).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    unit[7] = min(unit[7].tolist(), unit[8].tolist()) if min(v[7].tolist(), v[8].tolist()) == v[8].tolist() else unit[7]
    hits = total = 0
    for q in range(0, 6000, 50):
        s = unit @ unit[q]
        s[q] = -2
        best = set(np.argsort(-s, kind="stable")[:5].tolist())
        hits, total = hits + len(best & set(got[q])), total + 5
    assert hits / total >= 0.9
    assert all(10_000 <= x < 20_000 for x in got[10_000] + got[10_050]) and len(got[10_000]) == 5 and 20_000 not in got


def test_field_adds_spelt_forms_of_held_out_documents(spark):
    rng = random.Random(21)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        while True:
            x = "4" + digits(15)
            if pii.luhn(x):
                return x

    def context():
        seg = rng.choice([lambda: f"+1 ({rng.randrange(200, 999)}) 555-{digits(4)}", lambda: rng.choice(("ann", "jane.doe", "bob_k", f"u.{digits(2)}")) + "@" + rng.choice(("example.com", f"mail{digits(1)}.example.com", "post.example.org")), card, lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4))])()
        before, after = (" ".join(rng.choice("the of and words stand here at home for now".split()) for _ in range(9)) for _ in range(2))
        return f"{before} {seg} {after}"

    texts = [context() for _ in range(900)] + [f"in {rng.randrange(1900, 2030)} some {digits(3)} of {digits(6)} met at {digits(1)}.30" for _ in range(100)]
    field = pii.train_on(spark.createDataFrame(list(enumerate(texts)), DOCS))
    gold = hit = added = 0
    for n in range(400):
        text = context()
        spans = pii.base_spans(text)
        for new, marks in pii.respelt(text, spans, n):
            base, every = pii.find(new, field)
            want, extra = {x for x in marks if x not in base}, {x for x in every if x not in base}
            gold, hit, added = gold + len(want), hit + len(want & extra), added + len(extra)
    assert gold > 250 and hit / gold > 0.95 and hit / added > 0.97, (gold, hit, added)
    plain = [f"on page {digits(3)} of {rng.randrange(1900, 2030)} there were {digits(5)} lines; look at example.com or at noon" for _ in range(200)]
    assert sum(len(pii.find(t, field)[1]) for t in plain) <= 2
    whole = "mail jane.doe(at)example.com\nor jane at example dot com, bob [at] mail [dot] example.org"
    assert {(whole[s:e], k) for s, e, k in pii.find(whole, field)[1]} >= {("jane.doe(at)example.com", "email"), ("jane at example dot com", "email")}


def test_pairs_are_learned_that_no_line_separates(spark):
    """One of two words is toxic, both or none are not: no sum of a weight for each separates that."""
    rng = random.Random(14)
    plain = [f"word{i}" for i in range(200)]
    texts, marks, kinds = [], [], []
    for _ in range(1500):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        words = rng.choices(plain, k=25) + ["fool"] * a + ["martians"] * b
        rng.shuffle(words)
        texts.append(" ".join(words)), marks.append(int(a != b)), kinds.append(a and b)
    df = spark.createDataFrame([(i + 1, t, k) for i, (t, k) in enumerate(zip(texts, kinds, strict=True))], DOCS + ", both boolean")
    labels = spark.createDataFrame([(i + 1, m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    model = toxicity.train_on(df, labels.where(~toxicity.in_fold("doc_id")))

    def right(m):
        rows = toxicity.score(df, m).join(labels, "doc_id").join(df, "doc_id").where(toxicity.in_fold("doc_id")).select("score", "toxic", "both").collect()
        return sum((r.score >= 0.5) == bool(r.toxic) for r in rows) / len(rows), [r.score for r in rows if r.both]

    whole, both = right(model)
    linear, both_linear = right(toxicity.FactorizationMachine(model.bias, model.weight, np.zeros_like(model.factor)))
    assert whole > 0.95 and max(both) < 0.5, whole
    assert linear < 0.9 and min(both_linear) > 0.5, linear  # its weights alone call both toxic


def test_hot_cells_give_what_sorted_cells_give(spark, monkeypatch):
    rng = random.Random(15)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    texts = []
    for i in range(60):
        x = list(long)
        for _ in range(rng.randrange(1, 4)):
            x[rng.randrange(len(x))] = str(i % 10)
        texts.append("".join(x))
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    sorted_ = {tuple(r) for r in suffixes.report(suffixes.without_repeats(df, 400)).collect()}
    monkeypatch.setattr(suffixes, "HOT_CELL", 3)
    assert {tuple(r) for r in suffixes.report(suffixes.without_repeats(df, 400)).collect()} == sorted_


def test_near_duplicate_components_of_a_drifting_chain(spark):
    rng = random.Random(16)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(400):
        words = [*words[1:], f"w{60 + i}"]  # each is like its neighbours only
        texts.append(" ".join(words))
    ids = rng.sample(range(1, 5000), 400)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts, strict=True)), DOCS), words=2).collect()}
    assert set(got) == set(ids) and set(got.values()) == {min(ids)}
