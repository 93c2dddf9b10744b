"""The corpus pipeline: five stages over `documents`, each a function of its predecessor's rows.

Each stage takes (spark, docs, sf_dir); a stage's result is written and read again as the
next one's docs.  All but the last return the columns of `documents`, in their order, and
any further columns that docs has, whatever their names.  Models learn from the rows that a
stage is given, outside the held-out folds of their queries.

Defined cases, by stage.  Language: texts null, empty or without a letter go; without any
learned language all rows go.  Quality: texts that score below the threshold go, short ones
by the words they have; without labels of both classes a warning says so and all rows stay.
Near duplicates: rows that repeat an id, or a text, leave one; rows without an id stay;
empty texts are nobody's copies.  Mixing: documents without words, and those beyond their
source's target, go; a null source is a source; repeated rows are mixed one by one.
Tokens: every row comes back, with no ids where there is no text.  Very long texts go
through whole, ties are broken by id, then by text, and an empty table gives an empty table
at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphforge.llm import classify, jaccard, langid, mixing, pieces
from glyphforge.llm.common import cut, table
from glyphforge.llm.queries import held_out, tokenizer_file

QUALITY_THRESHOLD = 0.7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those far from every language."""
    return langid.keep(docs, langid.train(docs, ~held_out(5, 0)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score below the threshold."""
    model = classify.train(docs, table(spark, sf_dir, "labels"), "quality", ~held_out(4, 2), classify.QUALITY)
    return classify.keep(docs, model, QUALITY_THRESHOLD)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near-duplicates."""
    return jaccard.keep(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, cut and drop documents until every source has its share of words."""
    return mixing.emit(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and ids of every row."""
    coded = pieces.encode(docs, pieces.Vocabulary.load(tokenizer_file()), ["doc_id", "source"])
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language),
    ("quality_classifier", quality),
    ("ngram_jaccard_join", deduplicate),
    ("mixing", mix),
    ("sentencepiece", tokenize),
]

#: SQL can't express trained classifiers or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
