"""The training-data operators against brute force, exact libraries and edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidewire.llm import bpe, chat, decontaminate, licenses, line_dedup, minhash, pii, queries, suffixes, toxicity, vptree

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, start=1):
    """With a column whose name clashes with one used inside."""
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or ""), i) for i, t in enumerate(texts)], DOCS + ", line int")


ODD = [None, "", " \n\t ", "a", "x" * 30_000, "same text of one two three four five six", "same text of one two three four five six", "naïve ünïcode 🙂 text", "1.2.3.4 +1 555 123 4567 a@b.co"]


def test_bpe_equals_tiktoken(spark):
    path, pattern = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab \n'stÀ×١½ 12_") for _ in range(200)) for _ in range(50)] + ["".join(chr(rng.randrange(32, 0x2FF)) for _ in range(300)) for _ in range(20)]
    codec = bpe.codec(path, pattern)
    exact = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    df = documents(spark, texts)
    encoded = bpe.encode(df, path, pattern)
    ids = {r.doc_id: list(r.ids) for r in encoded.collect()}
    assert ids == {i + 1: exact.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode(encoded, path, pattern).collect()}
    assert back == {i + 1: (t or "").encode() for i, t in enumerate(texts)}
    for r in bpe.round_trip_digests(df, path, pattern).collect():
        said = " ".join(map(str, ids[r.doc_id]))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids[r.doc_id]), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(back[r.doc_id]).hexdigest())


def brute_spans(t):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append((*m.span(), "card"))
    return out + [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_pii_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(5000):
        t = "".join(rng.choice("0123456789+. ()-@ab\n.1200") for _ in range(rng.randrange(70)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("9" * 100_000 + "@" + "a" * 100_000) == []


def test_pii_field_keeps_base_and_adds(spark):
    rng = random.Random(3)
    texts = [f"call +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} or 10.0.{rng.randrange(255)}.{rng.randrange(255)} or u{i}@mail{i}.example.com now" for i in range(150)]
    texts += ["order 123456 of 2024 for 12 items", "or (212) 555-1234 at noon"] + ODD
    df = documents(spark, texts)
    field = pii.train_on(df)
    found = {r.doc_id: r.spans for r in pii.find_spans(df, field).collect()}
    for i, t in enumerate(texts):
        assert {(s.start, s.end, s.kind) for s in found[i + 1] if s.base} == set(brute_spans(t or ""))
    assert [(s.kind, texts[151][s.start : s.end]) for s in found[152]] == [("phone", "(212) 555-1234")]
    assert found[151] == []
    row = pii.report(pii.find_spans(df, field)).where("doc_id = 1").first()
    assert (row.n_email, row.n_ip, row.n_phone) == (1, 1, 1)


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(300)]
    texts, marks = [], []
    for i in range(900):
        words = rng.choices(plain, k=rng.randrange(10, 60))
        # an insult alone or a group alone is harmless; together they are not
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["fool"] * insult + ["martians"] * group
        rng.shuffle(words)
        texts.append(" ".join(words)), marks.append(int(insult and group))
    df = documents(spark, texts)
    labels = spark.createDataFrame([(i + 1, m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    model = toxicity.train_on(df, labels.where(~toxicity.in_fold("doc_id")))
    rows = toxicity.score(df, model).join(labels, "doc_id").withColumn("held", toxicity.in_fold("doc_id")).where("held").collect()
    right = sum((r.score >= 0.5) == bool(r.toxic) for r in rows)
    assert right / len(rows) > 0.97
    odd = documents(spark, ODD)
    assert {r.doc_id for r in toxicity.score(odd, model).collect()} == set(range(1, len(ODD) + 1))
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    none = toxicity.train_on(df, labels.limit(0))
    assert toxicity.score(odd, none).agg(F.max("score")).first()[0] < 0.01


def test_license_units(spark):
    texts = ["Copyright (c) 2020 A\n" + licenses.MIT.replace("license", "licence"), "prose here\nReleased under the  MIT Licence!\nmore", "see the MIT License terms", *ODD]
    got = {(r.doc_id, r.license_id, r.unit, r.n_units) for r in licenses.license_report(documents(spark, texts)).collect()}
    assert got == {(1, "MIT", "text", 1), (2, "MIT", "line", 1)}


def test_licenses_over_any_number_of_paragraphs(spark):
    """A blank line after every line, and after every few words in a caller's own text; inside a file and not."""
    own = "\n".join(f"permission number {k} is granted to all who ask for it kindly" for k in range(14))
    known = [*licenses.KNOWN, ("Own", own)]
    wide = lambda t: t.replace("\n", "\n\n")
    texts = [f"# a file\n\n{wide(t)}\n\nint main() {{}}" for t in (licenses.BSD_HEAD + licenses.BSD_TAIL, licenses.UNLICENSE, own)]
    texts += [f"# a file\n\n{wide(own)[:-3]}\n\nmore", "only\n\n" + wide(own)]
    got = {(r.doc_id, r.license_id) for r in licenses.license_report(documents(spark, texts), known).collect()}
    assert got == {(1, "BSD-2-Clause"), (2, "Unlicense"), (3, "Own"), (5, "Own")}


def test_licenses_in_any_wrapping_and_inside_files(spark):
    import textwrap

    rng = random.Random(7)
    texts, want = [], set()
    for name, text in licenses.KNOWN:
        if len(text) > 200:
            for wide in (40, 72, 1000):
                lines = [x for p in text.replace(":\n", ":\n\n").split("\n\n") for x in (*textwrap.wrap(p, wide, initial_indent="  ", break_long_words=False), "")]
                body = f"{name} as a file\n\nCopyright (c) {rng.randrange(1990, 2030)} Someone\n\n" + "\n".join(lines) + "\n\nprint('code')\n"
                texts.append(body)
                want.add((len(texts), name))
    got = {(r.doc_id, r.license_id) for r in licenses.license_report(documents(spark, texts)).collect()}
    assert got == want and {"MIT", "BSD-3-Clause", "Zlib", "BSL-1.0", "Unlicense", "0BSD", "GPL-3.0"} <= {n for _, n in want}


def test_line_dedup(spark):
    block = "one two three four five\nOk.\nsix seven eight nine ten\neleven twelve thirteen fourteen"
    texts = [block, "my own opening line of words\n" + block + "\nmy own closing line of words", block, "Ok.\nYes.", "six seven eight nine ten\none two three four five", None, "", "solo line with four words\nsolo line with four words"]
    rows = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert rows[1] == (block, 0)
    assert rows[2] == ("my own opening line of words\nmy own closing line of words", 4)
    assert rows[3] == ("", 4)
    assert rows[4] == (texts[3], 0) and rows[6] == (None, 0) and rows[7] == ("", 0) and rows[8] == (texts[7], 0)
    assert rows[5][1] == 1  # crossed lines: one aligns
    assert line_dedup.dedup_lines(documents(spark, texts).limit(0)).count() == 0


def test_line_dedup_takes_repeated_lines_and_whole_copies(spark):
    a, b, c = "first line of five words", "second line of five words", "third line of five words"
    copied = f"{a}\nhm\n{b}\nyes\n{a}\nno\n{c}\nend"
    texts = [a, f"x\n{b}", copied, copied, "Ok.\nYes.", "Ok.\nYes.", f"{b}\n{b}", "\n", "\n", "一二三四五六七八九", "早\n一二三四五六七八九"]
    rows = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(documents(spark, texts)).collect()}
    assert rows[4] == ("", 8)  # its lines' first owners are three documents
    assert rows[3] == (f"hm\nyes\n{a}\nno\n{c}\nend", 2)
    assert rows[5] == ("Ok.\nYes.", 0) and rows[6] == ("", 2) and rows[7] == (b, 1)
    assert rows[8] == rows[9] == ("\n", 0) and rows[11] == ("早", 1)


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "How do I boil eggs?\nI like them soft."), (1, 1, "assistant", "> How do I boil eggs?\nSix minutes."),
        (1, 2, "user", "> > how do i boil eggs\n> Six minutes.\nThanks"), (1, 3, "user", "> never said\nhm"), (2, 0, "user", "> How do I boil eggs?\nelsewhere"), (2, None, None, None), (3, 0, "user", ""),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.reply_order(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert [(got[1, t].parent_turn, got[1, t].thread, got[1, t].body, got[1, t].n_quotes, got[1, t].n_linked, got[1, t].deepest) for t in range(4)] == [
        (None, 0, "How do I boil eggs?\nI like them soft.", 0, 0, 0), (0, 0, "Six minutes.", 1, 1, 1), (1, 0, "Thanks", 2, 2, 2), (None, 3, "hm", 1, 0, 1),
    ]
    assert got[2, 0].parent_turn is None and got[2, None].body == "" and got[3, 0].chat == "<|user|>\n\n"


def test_repeated_bytes_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long = text(120), text(300)
    texts = [text(60) + shared + text(50), shared[30:], text(20) + shared[:410], long, long[:700] + "X" + long[701:], long[100:900] + text(30), "ab" * 900, None, "", "short", text(200)]
    texts += [long[:900] + f"{i}" + long[900:] for i in range(6)] + [texts[3]]
    L = 400
    raws = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + L] for r in raws for i in range(len(r) - L + 1))
    got = {r.doc_id: r for r in suffixes.report(suffixes.without_repeats(documents(spark, texts), L)).collect()}
    for k, r in enumerate(raws):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - L + 1):
            if seen[r[i : i + L]] > 1:
                gone[i : i + L] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        row = got[k + 1]
        assert (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), k
    assert suffixes.without_repeats(documents(spark, texts).limit(0)).count() == 0


def test_long_texts_are_anchored_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    raw = rng.integers(97, 120, 9000, np.uint8).tobytes()
    whole = suffixes.anchors(raw, 400)
    monkeypatch.setattr(suffixes, "PIECE", 1500)
    cut = suffixes.anchors(raw, 400)
    windows = lambda a: {(int(g), int(p), i) for g, p, s, e in zip(*a, strict=True) for i in range(s, e + 1)}
    assert windows(whole) == windows(cut)


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(minhash.LOWER))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(sets)))
    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i + 1: (len(s), root(i) + 1) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("words", "cell"), [(2, 128), (5, 4), (2, 4)])
def test_near_duplicates_equal_all_pairs(spark, words, cell):
    rng = random.Random(words)
    base = [[f"w{rng.randrange(4000)}" for _ in range(80)] for _ in range(3)]
    texts = list(ODD)
    for k in range(60):
        w = list(base[k % 3])
        for _ in range(rng.choice((0, 1, 2, 4, 7))):
            w[rng.randrange(80)] = f"new{rng.randrange(9999)}"
        texts.append(" ".join(w) if k % 2 else " ".join(w).upper())
    got = minhash.near_duplicates(documents(spark, texts), words=words, cell=cell)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts, words, 80)


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(3)
    a, b = minhash.functions(400)
    x = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    s, t = minhash.min_max(x[:900], a, b), minhash.min_max(x[100:], a, b)
    assert abs((s == t).mean() - 0.8) < 0.06


def test_decontamination(spark):
    items = [(1, "Tom has 3 apples and Tom gives 2 apples to Ann so how many apples are left for him"), (2, "A train runs 40 km in 2 hours then how fast does it go on the way"), (3, None), (4, ""), (5, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [
        "intro. Tom has 3 apples and Tom gives 2 apples to Ann so how many apples are left for him? end", "yes. Sue has 7 apples and Sue gives 5 apples to Bob so how many apples are left for him",
        "no. Sue has 7 apples and Joe gives 5 apples to Bob so how many apples are left for him", "we saw that a train runs 90 miles in 7 minutes then how fast does it go on the way home", "a train may run fast", *ODD,
    ]
    got = {(r.doc_id, r.item_id, r.exact) for r in decontaminate.contaminated(documents(spark, texts), bench).collect()}
    assert got == {(1, 1, True), (2, 1, False), (4, 2, False)}
    blocks = {(r.doc_id, r.item_id, r.exact) for r in decontaminate.contaminated(documents(spark, texts), bench, block_windows=1).collect()}
    assert blocks == got
    kept = decontaminate.drop_contaminated(documents(spark, texts), bench)
    assert {r.doc_id for r in kept.collect()} == set(range(1, len(texts) + 1)) - {1, 2, 4} and kept.columns == documents(spark, texts).columns
    assert decontaminate.contaminated(documents(spark, texts), bench.limit(0)).count() == 0


def test_decontamination_in_any_case_and_with_longer_slots():
    item = "Tom Reed bought 12 apples at the market for Ann and gave 3 of them to Tom Reed before lunch. How many apples does Ann have left after that day?"
    index = decontaminate.Index([(7, item), (8, "5 7 9"), (9, "4 6 8 10 12"), (10, "42")], 5)
    longer = item.replace("Tom Reed", "Mary Jane van Holt").replace("van", "Van").replace("12", "1 200").replace("Ann", "Li Wei Chen")
    found = {
        name: [(x[0], x[4]) for x in index.hits(f"{before} {text} Some more words follow it here.", 0.8)]
        for name, before, text in [
            ("same", "So.", item), ("capitals", "So.", item.upper()), ("lower", "So.", item.lower()), ("title", "So.", item.title()),
            ("capitals, other number", "So.", item.upper().replace("12", "40")), ("longer", "So.", longer), ("inside a sentence", "so", longer),
            ("mixed up", "So.", longer.replace("Li Wei Chen have", "Mary Jane Van Holt have")), ("other", "So.", "5 8 9 and 6 7 9"), ("numbers", "So.", "4 5 7 9"), ("numbers in a line", "So.\n", "5 7, 9.\n"), ("long numbers", "1 2", "4 6 8 10 12 14 and 4 6 8 10 13"),
        ]
    }
    both = [(7, True)]
    assert found == {
        "same": both, "capitals": both, "lower": both, "title": both, "capitals, other number": [(7, False)], "longer": [(7, False)],
        "inside a sentence": [(7, False)], "mixed up": [], "other": [], "numbers": [], "numbers in a line": [(8, True)], "long numbers": [(9, True)],
    }
    assert [x[0] for x in index.hits("say 42 or 42.\n 42!\n", 0.8)] == [10]
    short = decontaminate.Index([(1, "Tom has 5 apples. How many apples remain?")], 5)
    assert [x[0] for x in short.hits("then Mary has 7 apples. How many apples remain?", 0.8)] == [1]
    assert [x[0] for x in short.hits("Mary Ann has 7 apples. How many apples remain?", 0.8)] == [1]
    assert [x[0] for x in short.hits("Tom has twenty five apples. How many apples remain?", 0.8)] == [1]
    assert [x[0] for x in short.hits("Tom has twenty-one apples. How many apples remain?", 0.8)] == [1]
    assert [x[0] for x in short.hits("Tom has forty-well apples. How many apples remain?", 0.8)] == []
    rope = decontaminate.Index([(1, "How many pieces of 12 cm can be cut from a rope of 3 m and how much is left")], 5)
    for text in ("How many pieces of 12cm can be cut from a rope of 3m and how much is left", "How many pieces of 40 mm can be cut from a rope of 2km and how much is left", "How many pieces of thirty-six cm can be cut from a rope of 3 m and how much is left"):
        assert [x[0] for x in rope.hits(text, 0.8)] == [1]
    assert [x[0] for x in short.hits("Tom has 7 apples. Where many apples remain?", 0.8)] == []


def test_vantage_point_trees(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(400)] + [(500 + i, [1.0] * 8) for i in range(9)]
    rows += [(600, None), (601, []), (602, [0.0] * 8), (603, [float("nan")] + [1.0] * 7), (604, [None] + [1.0] * 7), (605, [float("inf")] * 8), (50, rows[50][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = vptree.nearest(df, df.where("vec_id % 50 = 0"), 5, relax=1.0, shard_rows=100)
    got = collections.defaultdict(list)
    for r in exact.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {i: np.array(v) for i, v in rows if v and i not in (602, 603, 604, 605)}
    ids = np.array(sorted(good))
    m = np.stack([good[i] for i in ids.tolist()])
    assert set(got) == {i for i in ids.tolist() if i % 50 == 0}
    for q, found in got.items():
        s = m @ good[q] / np.linalg.norm(m, axis=1) / np.linalg.norm(good[q])
        others = ids != q
        order = np.lexsort((ids[others], -s[others].round(12)))[:5]
        assert [i for i, _ in found] == ids[others][order].tolist()
        assert np.allclose([x for _, x in found], s[others][order], atol=1e-12)
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0


def test_pipeline_keeps_columns_and_drops_what_it_should(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        assert out.count() <= seen, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == docs.dtypes, name
            docs = out
        seen = out.count()
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < seen < 200
