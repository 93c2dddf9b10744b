"""Rules that texts attest, against counting by hand."""

import random
from collections import Counter

from pyspark.sql import functions as F

from glyphforge.functions.text import fold_confusables, nfc, nfd, normalize_str, normalize_text, normalized, pieces, word_pattern, words
from glyphforge.operators import attested as at
from glyphforge.operators.attested import attested_rules, key_counts
from glyphforge.sources import charts as ch

RULES = [("aa", "ch", "x"), ("bb", "CH", "k"), ("aa", "ñ", "ɲ"), ("aa", "schtz", "s"), ("bb", "q", "q"), ("bb", "", "-"), ("cc", "ñ", "n")]
TEXTS = [(1, "Schtz! chch"), (2, None), (3, ""), (4, "chch Ñan aña c h"), (5, "ch" * 4000), (5, "ch" * 4000), (None, "ach"), (6, "a" * 1021 + "schtz" + "b" * 3000 + "ñ")]


def test_counts_equal_counting_by_hand(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id int, text string").withColumn("key", F.lit("clash")).withColumn("n", F.lit(1))
    rules = spark.createDataFrame(RULES, "lang string, grapheme string, ipa string")
    want = Counter()
    for row in docs.select(F.explode(words(normalize_text(F.col("text")))).alias("w")).collect():
        for i in range(len(row.w)):
            for k in range(1, 6):
                if i + k <= len(row.w):
                    want[row.w[i : i + k]] += 1
    keys = spark.createDataFrame([("ch",), ("ñ",), ("schtz",), ("q",), ("",), ("ch",)], "key string")
    got = {r.key: r.n for r in key_counts(docs, F.col("text"), keys).collect()}
    assert got == {k: want[k] for k in ("ch", "ñ", "schtz")}
    assert got["ch"] == 8000 + 1 + 2 + 2 + 1 + 1 and got["ñ"] == 3

    rows = {(r.lang, r.grapheme): r.n for r in attested_rules(docs, F.col("text"), rules).collect()}
    assert rows == {("aa", "ch"): want["ch"], ("bb", "CH"): want["ch"], ("aa", "ñ"): 3, ("aa", "schtz"): 2, ("cc", "ñ"): 3}


def test_nothing_is_attested_by_no_texts(spark):
    rules = spark.createDataFrame(RULES, "lang string, grapheme string, ipa string")
    none = spark.createDataFrame([], "text string")
    assert attested_rules(none, F.col("text"), rules).count() == 0
    assert key_counts(none, F.col("text"), spark.createDataFrame([], "key string")).count() == 0


def test_texts_go_back_in_slices(spark, monkeypatch):
    """Running text is normalised by a UDF that returns slices, so that no worker holds a batch and its copy."""
    from glyphforge.functions import text as tx

    asked, plain = [], tx.per_row
    monkeypatch.setattr(tx, "per_row", lambda make, kind: asked.append(kind) or plain(make, kind))
    df = spark.createDataFrame([("Kɔ́kɔ " * 400_000,), (None,), ("",), ("K\u0301a",)] * 3, "text string").coalesce(1)
    keys = spark.createDataFrame([("kɔ",), ("ḱa",)], "key string")
    assert dict(map(tuple, key_counts(df, F.col("text"), keys).collect())) == {"kɔ": 2_400_000, "ḱa": 3}
    assert asked == ["string"]
    rows = df.select(tx.normalize_text(F.col("text")).alias("a"), tx.normalized(F.col("text")).alias("b"))
    assert rows.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


#: Final sigmas next to what they look past, marks after a break and after letters, look-alikes, letters that lower to several, apostrophes at ends.
ODD = list("ΣσAazİIı’ʼ'.:^`=<_-1 \t\n,;@가εɡↄ²Ⅷ") + ["\u0338", "\u0327", "\u0301", "\u0308", "\u0344", "\u0345", "\u00ad", "\u200d", "\u00a0", "\u212b", "\U00010400"]


def test_words_of_pieces_are_those_of_the_text(spark):
    rnd = random.Random(24)
    texts = ["".join(rnd.choices(ODD, k=rnd.randint(1, 14))) for _ in range(20_000)] + ["ΑΣ. x", "ΑΣ.x", "ΑΣ:Α", "a=\u0338b", "a.\u0301b", "don'. .'don", "", ".", "'" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    parts = df.select("i", F.explode(pieces(F.col("text"))).alias("piece")).select("i", F.explode(words(normalized(F.col("piece")))).alias("w"))
    got = {r.i: Counter(r.w) for r in parts.groupBy("i").agg(F.collect_list("w").alias("w")).collect()}
    for i, text in enumerate(texts):
        assert got.get(i, Counter()) == Counter(word_pattern().findall(normalize_str(text))), ascii(text)


def test_workers_get_pieces_and_no_texts(spark, monkeypatch):
    """What goes to a Python worker does not grow with texts: distinct pieces, each once."""
    asked = []

    def short(col):
        asked.append(col)
        return normalized(F.when(F.length(col) > 4, F.raise_error(F.lit("a whole text")).cast("string")).otherwise(col))

    monkeypatch.setattr(at, "normalized", short)
    df = spark.createDataFrame([("Ñan, ch 1CH. " * 5000,), (None,), ("",)], "text string")
    keys = spark.createDataFrame([("ch",), ("ñ",), ("q",)], "key string")
    assert dict(map(tuple, key_counts(df, F.col("text"), keys).collect())) == {"ch": 10_000, "ñ": 5000}
    assert len(asked) == 1


def test_keys_come_with_the_rules(spark):
    """Keys of rules need no UDF, and are what the functions over columns make of them."""
    rules = ch.keyed_rules(spark)
    assert "Python" not in rules._jdf.queryExecution().optimizedPlan().toString()
    plain = fold_confusables(F.lower("grapheme"))
    assert rules.count() > 10_000 and rules.filter(~(F.col("key").eqNullSafe(nfc(plain)) & F.col("key_nfd").eqNullSafe(nfd(plain)))).count() == 0
    assert ch.grapheme_rules(spark).columns == ["lang", "ord", "grapheme", "ipa", "ipa_tied", "key_nfd"]
    docs = spark.createDataFrame([("kɔ CH",)], "text string")
    assert attested_rules(docs, F.col("text"), rules).columns == ["lang", "ord", "grapheme", "ipa", "ipa_tied", "key_nfd", "n"]
