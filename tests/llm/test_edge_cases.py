"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from glyphforge.llm import ann, chat, classify, jaccard, langid, media, mixing, pieces, queries, shards
from glyphforge.llm.subword import Config, fit

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, size long, cid long, n long, _text string"
LONG = "word " * 60_000
ROWS = [
    (1, "a b c d e f g h", "en", "s", 15, 0.5, "k", 1, 2, 3, "x"),
    (1, "a b c d e f g h", "en", "s", 15, 0.5, "k", 1, 2, 3, "x"),
    (2, None, None, None, None, None, None, None, None, None, None),
    (3, "", "en", None, 0, None, None, None, None, None, None),
    (None, "orphan text without an id", "fr", "s", 1, None, None, None, None, None, None),
    (4, "  \n\t ", "en", "t", 4, None, None, None, None, None, None),
    (5, LONG, "en", "t", 9, None, None, None, None, None, None),
    (6, "12345 !!", "de", "t", 9, None, None, None, None, None, None),
    (7, "ein zwei", "de", "t", 9, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load(queries.tokenizer_file())


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert [r["size"] for r in rows if r.doc_id in (2, 3, 4)] == [0, 0, 0]
    assert mixing.mix(none).count() == 0
    assert mixing.emit(docs).columns == docs.columns
    assert mixing.emit(none).count() == 0


CLASHING = "_row _nth _doc _taken _gone _size _share _share_of _copy _one _two _text key bucket draw rank".split()


def test_columns_of_any_name_and_type_stay(docs):
    """Columns named as the operators name theirs come back as they were, maps among them."""
    more = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", *[F.concat(F.lit(f"{c}/"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING], F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))
    for out in (mixing.emit(more), jaccard.keep(more)):
        assert out.columns == more.columns
        rows = out.collect()
        assert rows
        for r in rows:
            assert [r[c] for c in CLASHING] == [f"{c}/{r.doc_id}" for c in CLASHING] and r.m == {"k": r.doc_id}


def test_emit_takes_what_mix_says(docs):
    want = sum(r.taken for r in mixing.mix(docs).collect())
    got = mixing.emit(docs).select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert got == want


def test_jaccard(docs, none):
    rows = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()}
    assert (2, 0, 2) in rows and (3, 0, 3) in rows and (4, 0, 4) in rows and (1, 4, 1) in rows and (5, 1, 5) in rows
    assert (None, 1, None) in rows
    assert jaccard.join(docs).count() == len(ROWS)
    assert jaccard.join(none).count() == 0
    assert jaccard.keep(docs).count() == len(ROWS) - 1
    assert jaccard.keep(docs).columns == docs.columns


def test_rows_that_share_an_id(spark):
    a, b = "one two three four five six", "another text of some other words altogether"
    df = spark.createDataFrame([(1, a), (1, b), (2, b + " "), (3, "x y z"), (3, "z y x")], "doc_id long, text string")
    kept = [sorted(map(tuple, jaccard.keep(d).collect())) for d in (df, df.repartition(3), df.orderBy("text"))]
    assert [r[0] for r in kept[0]] == [1, 3] and kept[0] == kept[1] == kept[2]


def test_jaccard_without_any_words(spark):
    rows = jaccard.join(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(1, 1), (2, 2)}


def test_classifiers(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    model = classify.train(docs, labels, "quality", F.lit(True), classify.QUALITY)
    rows = classify.score(docs, model, ["doc_id"]).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.score == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert classify.score(none, model, ["doc_id"]).count() == 0
    assert classify.train(none, labels, "toxic", F.lit(True), classify.TOXICITY) is None
    assert [r.score for r in classify.score(docs, None, ["doc_id"]).collect()] == [0.0] * len(ROWS)
    assert classify.keep(docs, model, 0.0).count() == len(ROWS)
    assert classify.keep(docs, model, 0.0).columns == docs.columns


def test_language_id(docs, none):
    model = langid.train(docs, F.lit(True))
    rows = langid.predict(docs, model, ["doc_id"]).collect()
    assert len(rows) == len(ROWS)
    assert all(r.lang_pred == "und" and r.rejected for r in rows if r.doc_id in (2, 3, 4, 6))
    assert all(0 <= r.score <= 1 for r in rows)
    assert langid.predict(none, model, ["doc_id"]).count() == 0
    nothing = langid.train(none, F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.keep(docs, model).columns == docs.columns


def test_media(docs, none):
    rows = media.store(docs).collect()
    assert len(rows) == len(ROWS) and all(r.payload_bytes % 64 == 0 and r.payload_bytes > 0 for r in rows)
    assert len({tuple(r)[1:] for r in rows if r.doc_id == 1}) == 1
    assert media.store(none).count() == 0
    assert media.packets(media.encode(docs), "doc_id", "media").filter("error IS NOT NULL").count() == 0


def test_pieces(docs, none, vocabulary):
    rows = pieces.digests(docs, vocabulary).collect()
    assert len(rows) == len(ROWS) and all(r.round_trip for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0}
    assert pieces.digests(none, vocabulary).count() == 0


def test_shards(docs, none):
    rows = shards.materialise(docs).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    assert shards.materialise(none).count() == 0


def test_chat(spark):
    part = chat.PART
    turns = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{part}>, formatted string")
    assert chat.format_chat(turns).count() == 0
    rows = spark.createDataFrame([(1, 0, None, None, "z"), (1, 0, None, None, "z"), (None, None, "user", [("text", None, None, None, None, None, None)], "z")], turns.schema)
    out = {r.conv_id: r for r in chat.read_back(chat.format_chat(rows)).collect()}
    assert out[1].n_turns == 2 and out[None].n_turns == 1 and out[None].loss_chars == 0


def test_neighbours(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1))
    out = ann.search(df, F.col("vec_id") == 0, k=10).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [1, 9, 6]
    assert [r.score for r in out] == [0.0, 0.0, 2**0.5]
    assert ann.search(df.filter("vec_id > 100"), F.col("vec_id") == 0).count() == 0


def test_fit_is_the_same_twice():
    texts, y = [b"good text here", b"bad words there"] * 8, [0, 1] * 8
    a, b = (fit(texts, y, Config(steps=5)).predict([b"bad words"]) for _ in range(2))
    assert a[0] == b[0]
