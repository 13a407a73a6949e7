"""Empty tables, nulls, repeated rows and columns with clashing names, for every training-data operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import bpe, chat, decontaminate, licenses, line_dedup, minhash, pii, queries, suffixes, toxicity, vptree

#: Names that operators use inside.
CLASHES = "id text2 n gone key kind place line lines n_removed __id __gone doc item_id bucket rep component node cell gram chunk first back windows ranges removed spans h c score size shard asks v thread conv words".split()
RANKS = public_tokenizers.path(queries.RANKS)


def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(CLASHES)])


ROWS = [
    (1, None), (2, ""), (3, " \n "), (4, "some text of a few words here"), (4, "some text of a few words here"), (None, "lost 1.2.3.4 row"), (5, "some text of a few words here"),
    (6, "y" * 50_000), (7, "word " * 20_000), (8, "\n".join(["a line that is long enough"] * 3_000)),
]
BENCH = "item_id long, text string, id int, n int"


def operators(spark):
    bench = spark.createDataFrame([(1, "a question of some more words than five in it", 0, 0), (None, "no id", 0, 0), (2, None, 0, 0)], BENCH)
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1)], "doc_id long, toxic int")
    return {
        "bpe": lambda d: bpe.round_trip_digests(d, RANKS, public_tokenizers.PATTERN), "pii": lambda d: pii.find_spans(d, pii.train_on(d)),
        "toxicity": lambda d: toxicity.score(d, toxicity.train_on(d, labels)), "licenses": licenses.license_report, "lines": line_dedup.dedup_lines,
        "suffixes": suffixes.without_repeats, "minhash": minhash.near_duplicates, "templates": lambda d: decontaminate.contaminated(d, bench),
    }


@pytest.mark.parametrize("name", ["bpe", "pii", "toxicity", "licenses", "lines", "suffixes", "minhash", "templates"])
def test_documents_of_every_kind(spark, name):
    run = operators(spark)[name]
    assert run(docs(spark, [])).count() == 0
    rows = run(docs(spark, ROWS)).collect()
    ids = sorted(str(r.doc_id) for r in rows)
    if name in ("suffixes", "minhash"):
        assert ids == [str(i) for i in range(1, 9)]
    elif name in ("licenses", "templates"):
        assert not rows
    else:
        assert ids == sorted(str(i) for i, _ in ROWS)


def test_vectors_of_every_kind(spark):
    schema = "vec_id long, embedding array<double>, id int, v int, shard int, size int, asks int, rank int, score int"
    assert vptree.nearest(spark.createDataFrame([], schema), spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (None, [1.0, 1.0]), (5, [1.0, 0.0]), (6, [2.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, 0, 0, 0, 0, 0, 0) for r in rows], schema)
    got = [(r.query_id, r["rank"], r.vec_id) for r in vptree.nearest(df, df.where("vec_id = 1")).orderBy("rank").collect()]
    assert got == [(1, 1, 5), (1, 2, 6), (1, 3, 2)]  # ties by id, fewer than five


def test_conversations_of_every_kind(spark):
    schema = "conv_id long, turn int, role string, text string, thread int, body string, lines int, level int, h int, origin int"
    assert chat.reply_order(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, 0, "user", "hello there"), (1, 1, None, "> hello there\nyes"), (1, 1, None, "> hello there\nyes"), (None, 0, "a", "> x"), (2, None, "a", "> x"), (3, 0, "a", None), (4, 0, "a", "z\n" * 20_000), (4, 1, "a", "> z\nok")]
    got = chat.reply_order(spark.createDataFrame([(*r, 9, "b", 0, 0, 0, 0) for r in rows], schema))
    assert sorted(str((r.conv_id, r.turn, r.thread, r.parent_turn, r.position)) for r in got.collect()) == sorted(
        str(x) for x in [(1, 0, 0, None, 1), (1, 1, 0, 0, 2), (1, 1, 0, 0, 2), (None, 0, None, None, None), (2, None, None, None, None), (3, 0, 0, None, 1), (4, 0, 0, None, 1), (4, 1, 0, 0, 2)]
    )


@pytest.mark.parametrize("rows", [[], ROWS])
def test_stages_of_every_kind(spark, tmp_path, rows):
    names = "lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "coalesce(length(text), 0) AS n_chars", *[f"{i} AS `{n}`" for i, n in enumerate(CLASHES)])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a question of some more words than five in it", 0, 0)], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert names
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id for r in out.collect()} == ({None, 1, 2, 3, 4, 6, 7, 8} if rows else set())
