"""Charts seen through a corpus: which rules its words attest, and how often.

A rule is attested where its key, lower-cased and composed, is a run of letters within a word.
Texts are cut in pieces by JVM functions; only distinct pieces are normalised, so that a Python worker
never holds texts, and their words taken apart: what is shuffled grows with the vocabulary.
The keys of all charts are a relation of bounded size (charts, not texts); Catalyst broadcasts it
where it is small enough and joins by key otherwise.

Defined cases: null and empty texts attest nothing; a rule without text is never attested; keys
that several rules share are counted for each; an empty corpus attests no rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold_confusables, nfc, normalized, pieces, words

BLOCK = 1024  # letters of a word taken apart together


def key_counts(docs: DataFrame, text: Column, keys: DataFrame) -> DataFrame:
    """key, n: how often each of `keys` (key) occurs within the words of all texts."""
    parts = docs.select(F.explode(pieces(text)).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("times"))
    found = parts.select("times", F.explode(words(normalized(F.col("piece")))).alias("word"))
    wanted = keys.select("key").filter("key != ''").distinct()
    # runs as long as the longest key at most
    longest = wanted.agg(F.max(F.length("key")).alias("k")).first()["k"] or 0
    # long words in blocks that overlap by what a key needs, so that a row never holds all runs of one
    starts = F.sequence(F.lit(1), F.length("word"), F.lit(BLOCK))
    blocks = found.select("times", F.explode(F.transform(starts, lambda at: F.substring(F.col("word"), at, F.lit(BLOCK + max(longest, 1) - 1)))).alias("block"))
    cut = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("block") - i + 1)), lambda k: F.substring(F.col("block"), i, k))
    runs = blocks.select("times", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.length("block"))), cut))).alias("key"))
    return runs.join(wanted, "key", "left_semi").groupBy("key").agg(F.sum("times").alias("n"))


def attested_rules(docs: DataFrame, text: Column, rules: DataFrame) -> DataFrame:
    """The rows of `rules` (grapheme, ..., and its key where known) whose key the texts hold, with its occurrences `n`."""
    keyed = rules if "key" in rules.columns else rules.withColumn("key", nfc(fold_confusables(F.lower("grapheme"))))
    return keyed.join(key_counts(docs, text, keyed), "key").select(*[c for c in rules.columns if c != "key"], "n")
