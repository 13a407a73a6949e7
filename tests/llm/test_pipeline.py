"""The pipeline on a small table against plain Python, stage by stage."""

import hashlib
import math
import random

import public_tokenizers
import tiktoken
from test_brute_force import plain_dedup
from test_llm import brute_components

import corpus_pipeline
from tidewire.llm import bpe, queries, toxicity


def plain_score(model, terms):
    """Every pair of terms, one by one."""
    out = model.bias + sum(model.weight[i] for i in terms)
    out += sum(float(model.factor[a] @ model.factor[b]) for n, a in enumerate(terms) for b in terms[:n])
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, out))))


def plain_line_dedup(docs):
    """Each key links to the first document that holds it and to the last one before."""
    ids = sorted(docs)
    cut = dict(zip(ids, plain_dedup([docs[i] or "" for i in ids]), strict=True))
    return {i: docs[i] if not docs[i] else cut[i] for i in ids if cut[i] == (docs[i] or "") or cut[i].strip()}


def test_pipeline_equals_plain_python(spark, tmp_path):
    rng = random.Random(30)
    vocabulary = [f"{a}{b}" for a in "bdfgklmn" for b in ("ar", "el", "im", "on", "ut", "ash")]
    line = lambda n=12: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    item = "how many small boats leave the old harbour when the morning bell rings for the third time"
    texts, toxic = [], []
    for _ in range(400):
        bad = rng.random() < 0.4
        texts.append("\n".join([line(), "you are a fool and a moron indeed" if bad else line(7), line()])), toxic.append(int(bad))
    texts += ["\n".join(line() for _ in range(4)) for _ in range(20)]
    texts += [texts[400] + "\nmore at the end here now.", texts[401].upper(), " ".join([*texts[402].split(), "end"]), "intro words\n" + item + "\n" + line(), line() + " " + item.upper() + " " + line(), texts[405], None, "", "short"]
    rows = [(i + 1, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i + 1, 1, x) for i, x in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    labels = spark.read.parquet(f"{tmp_path}/labels.parquet").where(~toxicity.in_fold("doc_id"))
    model = toxicity.train_on(spark.read.parquet(f"{tmp_path}/documents.parquet"), labels)
    terms = toxicity.Terms(toxicity.BUCKETS)
    kept = {i + 1: t for i, t in enumerate(texts) if plain_score(model, terms(t).tolist()) < 0.7}
    assert 200 < len(kept) < len(texts) - 100
    kept = plain_line_dedup(kept)
    ids = sorted(kept)
    groups = brute_components([kept[i] for i in ids], 5, 80)
    kept = {i: kept[i] for n, i in enumerate(ids) if groups[n + 1][1] == n + 1}
    kept = {i: t for i, t in kept.items() if item not in " ".join((t or "").lower().split())}
    path, pattern = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
    exact = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern).ranks, special_tokens={})
    want = {}
    for i, t in kept.items():
        tokens = exact.encode_ordinary(t or "")
        want[i] = (len(tokens), hashlib.sha256(" ".join(map(str, tokens)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert got == want
    assert 424 not in got and 425 not in got and 423 not in got and 426 not in got  # leaks, a near copy, an exact copy
