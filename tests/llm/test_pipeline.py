"""The pipeline's stages, each against a brute-force reading of its own input."""

import re

from pyspark.sql import functions as F
from test_operators import brute_components

import corpus_pipeline as cp
from glyphforge.llm import queries
from glyphforge.llm.common import table


def test_stages_follow_each_other(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns, rows = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "sentencepiece":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        rows[name] = (before, docs)
    before, after = rows["ngram_jaccard_join"]
    found = brute_components({r.doc_id: r.text for r in before.collect()})
    assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in found.items() if c == i}
    before, after = rows["mixing"]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(words(r.text) for r in before.collect())
    assert abs(sum(words(r.text) for r in after.collect()) - 1.5 * total) <= len({r.source for r in before.collect()})
    originals = {r.doc_id: r.text for r in before.collect()}
    assert all(originals[r.doc_id].startswith(r.text) for r in after.collect())
    before, after = rows["sentencepiece"]
    assert after.count() == before.count()
    assert after.filter(F.size("ids") != F.col("n_tokens")).count() == 0


def test_clean_documents_stay(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kept = cp.quality(spark, cp.language(spark, docs, sf_dir), sf_dir).select("doc_id")
    good = labels.filter("quality = 1 AND toxic = 0").select("doc_id")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.03 * good.count()


def test_run(spark, sf_dir):
    assert cp.run(spark, sf_dir).count() > 0
    assert set(dict(cp.STAGES)) == {"language_id", "quality_classifier", "ngram_jaccard_join", "mixing", "sentencepiece"}
    assert queries.QUERIES


CLASH = ["gone", "_gone", "_nth", "_row", "_taken", "score", "key", "rejected"]


def odd_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns named as stages name theirs."""
    text = table(spark, "/root/testdata/sf0.001", "documents").filter("lang = 'en' AND n_chars > 300").orderBy("doc_id").first().text
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (3, None, None, None, None), (4, "", "en", "s", 0), (5, " 12 !", "en", None, 1), (None, text, "en", None, 1), (6, f"{text} " * 300, "en", "t", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(c).alias(c) for c in CLASH])


def test_stages_on_odd_documents(spark, sf_dir, tmp_path):
    real = table(spark, sf_dir, "documents")
    docs = real.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit(c).alias(c) for c in CLASH]).withColumn("doc_id", F.col("doc_id") + 1000).unionByName(odd_documents(spark))
    columns = docs.columns
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "sentencepiece":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids = [r.doc_id for r in docs.filter("doc_id < 1000 OR doc_id IS NULL").collect()]
        if name == "language_id":
            assert sorted(i or 0 for i in ids) == [0, 1, 1, 2, 6]
        if name == "ngram_jaccard_join":
            assert ids.count(1) <= 1 and 2 not in ids and ids.count(None) <= 1
        if name != "sentencepiece":
            assert docs.filter(" OR ".join(f"`{c}` != '{c}'" for c in CLASH)).count() == 0


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = odd_documents(spark).filter("doc_id > 100")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        if name != "sentencepiece":
            assert out.columns == docs.columns
