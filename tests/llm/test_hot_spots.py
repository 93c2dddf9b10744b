"""Long conversations, rows without ids, rows that repeat, languages of few ids: no task and no language is lost to them."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from glyphforge.llm import chat, langid, mixing


def turns_of(spark, n):
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text <| "), F.col("id")).alias("text"))
    return rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts"))


def test_a_conversation_of_many_turns(spark):
    n = 20_000
    chat.read_back(chat.format_chat(turns_of(spark, 50))).collect()
    began = time.perf_counter()
    (row,) = chat.read_back(chat.format_chat(turns_of(spark, n))).collect()
    assert time.perf_counter() - began < 15
    texts = [f"text <| {i}" for i in range(n)]
    said = "".join(f"{'user' if i % 2 == 0 else 'assistant'}\n{t}\n" for i, t in enumerate(texts))
    loss = "".join(texts[1::2])
    assert (row["n_turns"], row["turns_sha256"], row["loss_chars"], row["loss_sha256"]) == (n, hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_a_mask_that_does_not_fit_its_text_is_seen(spark):
    made = chat.format_chat(turns_of(spark, 4))
    off = made.withColumn("turns", F.transform("turns", lambda t, i: t.withField("start", t["start"] + F.when(i == 2, 1).otherwise(0)).withField("loss_start", t["loss_start"] + F.when(i == 2, 1).otherwise(0))))
    assert chat.read_back(off).first()["loss_sha256"] is None


def test_a_very_long_turn(spark):
    text = "ab<|\\" * 400_000
    rows = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string")
    row = chat.read_back(chat.format_chat(rows.select("conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))).first()
    assert (row["loss_chars"], row["loss_sha256"]) == (len(text), hashlib.sha256(text.encode()).hexdigest())


SCHEMA = "doc_id long, text string, source string"


def test_rows_without_ids_fall_into_many_ranges(spark):
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("some words here "), F.col("id") * 7).alias("text"), F.lit("s").alias("source"))
    draw = -F.log(mixing.uniform(F.col("doc_id"), F.md5("text"), F.lit(0))) / mixing.quality(F.col("text"), mixing.n_words(F.col("text")))
    most = rows.groupBy(F.floor(F.log2(draw) * mixing.STEPS)).count().agg(F.max("count")).first()[0]
    assert most < 400


def test_repeats_draw_each_for_itself(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 100)
    rows = spark.createDataFrame([(None, "one two three four", "a")] * 900 + [(i, f"word {i} more", "a") for i in range(100)] + [(i, "b c", "b") for i in range(50)], SCHEMA)
    out = mixing.mix(rows, share=0.4).collect()
    assert len(out) == 1050
    same = [r["taken"] for r in out if r["doc_id"] is None and r["size"] == 4]
    assert len(same) == 900 and 0 < sum(t == 4 for t in same) < 900
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(rows.repartition(7), share=0.4).collect()))


@pytest.mark.parametrize("hot", [None, 10])
def test_emitting_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(mixing, "RUN", 64)
    schema = "doc_id long, text string, source string, taken map<string,int>, row int, one string"
    rows = spark.createDataFrame([(None, "one two three four", None, {"a": 1}, 1, "x")] * 300 + [(i, f"word {i} more", "b", None, None, None) for i in range(200)], schema)
    want = sum(r["taken"] for r in mixing.mix(rows).collect())
    out = mixing.emit(rows, hot=hot)
    assert out.columns == rows.columns
    got = out.collect()
    assert sum(len((r["text"] or "").split()) for r in got) == want
    assert sorted(map(str, got)) == sorted(map(str, mixing.emit(rows.repartition(5), hot=hot).collect()))


def test_a_language_whose_rows_share_one_id_is_learned(spark):
    rows = spark.range(60_000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("uno dos tres "), F.col("id") % 7).alias("text"), F.lit("es").alias("lang"))
    rows = rows.unionByName(spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id")).alias("text"), F.lit("en").alias("lang")))
    rows = rows.unionByName(spark.createDataFrame([(None, "eins zwei", "de")] * 30, "doc_id long, text string, lang string"))
    texts, names = langid.sample(rows, F.lit(True))
    assert set(names) == {"es", "en", "de"} and names.count("es") == 7 and names.count("de") == 1
    assert langid.predict(rows, langid.fit(texts, names), ["lang"]).filter("lang_pred <> lang").count() == 0


def test_a_warning_names_languages_left_out(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = spark.createDataFrame([(i, f"text {i}", f"l{i % 3}") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.warns(UserWarning, match="not learned"):
        texts, names = langid.sample(rows, F.lit(True))
    assert len(set(names)) == 2


def test_ties_between_languages_go_to_the_first(spark):
    rows = spark.createDataFrame([(1, "same text", "b"), (2, "same text", "a")], "doc_id long, text string, lang string")
    model = langid.fit(*langid.sample(rows, F.lit(True)))
    assert [r[0] for r in langid.predict(rows, model, ["doc_id"]).select("lang_pred").collect()] == ["a", "a"]
