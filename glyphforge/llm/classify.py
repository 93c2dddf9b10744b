"""Toxicity and quality classifiers: subword-bag embeddings with a linear softmax over DataFrames.

Both learn from a bounded sample of labelled rows: SAMPLE documents of each class that have
a text, short ones first (of equal kind, those first by a hash of their id), of each its
first LONGEST characters, until BYTES are full.  They score every whole text.  Toxicity
scores a document by its highest window of four words, so that a few toxic words in a long
text are not averaged away; quality averages the whole document.

Defined cases: null, empty and blank texts score 0; a null id has held_out false; very long
texts are scored whole; repeated rows score alike; ties in the sample's order go by id; an
empty table gives no rows; further columns are kept or ignored, whatever their names.
Without labels of both classes nothing can be learned: a warning says so, every score is 0
and `keep` keeps all rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .subword import Config, Model, fit

SAMPLE = 1200
LONGEST = 32 << 10
BYTES = 7 << 20

TOXICITY = Config(lower=True, window=4, steps=32, warm=6, span=64)
QUALITY = Config(lower=False, pairs=True, window=0, steps=24, warm=0, span=128)


def sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of the training sample; `allowed` is a condition on doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = docs.filter(F.length("text") > 0).select("doc_id", (F.octet_length("text") > LONGEST).alias("long")).groupBy("doc_id").agg(F.min("long").alias("long"))
    labels = labels.filter(allowed).select("doc_id", F.col(label).cast("int").alias("y"), F.xxhash64("doc_id").alias("h")).join(known, "doc_id")
    some = None
    for y in (0, 1):
        part = labels.filter(F.col("y") == y).orderBy("long", "h", "doc_id").limit(SAMPLE)
        some = part if some is None else some.unionByName(part)
    rows = docs.select("doc_id", F.substring(text, 1, LONGEST).alias("t")).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "h", "y", "long").agg(F.max("t").alias("t")).collect()  # rows that repeat an id meet first
    out, y, seen, total = [], [], set(), 0
    for r in sorted(rows, key=lambda r: (r["long"], r["h"], r["doc_id"], r["y"])):
        if r["doc_id"] in seen:
            continue
        b = r["t"].encode("utf-8", "replace")
        if (total := total + len(b)) > BYTES:
            break
        seen.add(r["doc_id"])
        out.append(b)
        y.append(r["y"])
    return out, np.asarray(y, dtype=int)


def train(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, config: Config) -> Model | None:
    texts, y = sample(docs, labels, label, allowed)
    if not (len(y) and 0 < y.sum() < len(y)):
        warnings.warn(f"no labels of both classes of {label!r}: nothing is learned", stacklevel=2)
        return None
    return fit(texts, y, config)


def score(docs: DataFrame, model: Model | None, columns: list[str]) -> DataFrame:
    """`columns` of docs and `score`, for every row."""
    if model is None:
        return docs.select(*columns, F.lit(0.0).alias("score"))
    model.prior = 0.0
    rows = docs.select(*columns, F.col("text").alias(fresh(columns, "text")))
    schema = docs.select(*columns).schema.add("score", "double")

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.predict(texts), pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(scores, schema)


def keep(docs: DataFrame, model: Model | None, threshold: float) -> DataFrame:
    """The rows of docs that score `threshold` or more, all their columns; all rows without a model."""
    if model is None:
        return docs
    model.prior = 0.0
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(model.predict(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
