"""Language identification by nearest centroid.

A text becomes a vector of hashed byte 1-, 2- and 3-grams of its lower-cased letters and the
marks on them (all else counts as a space), weighted sqrt(tf) * idf and normalised.  Each
language has several centroids from spherical k-means over a bounded sample; the prediction
is the language of the closest by cosine.  A text is rejected whose cosine is below REACH of
the LOW quantile that the language's samples reach when held back from the centroids.  Short
texts have low cosines in any language, so the quantile is that of samples cut to as many
letters, by the steps of SPANS.

The sample alone is bounded: the LANGUAGES values of `lang` with most texts, SAMPLE texts of
each and TEXTS of all together, of each text its first LONGEST characters, fewer where all
would exceed CHARACTERS (a warning names languages left out).  Prediction reads whole texts.

Defined cases: null texts and texts without a letter are `und`, score 0, rejected; a null id
has held_out false; very long texts are scored whole; ties go to the language first by code
point; repeated rows agree, and count once in the sample; an empty table gives no rows; a
sample without any language makes all rows `und`; further columns are kept or ignored
whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASE, chunks, fresh, joined

BITS = 13
SIZES = (1, 2, 3)
SAMPLE = 300
LONGEST = 64 << 10
CENTROIDS = 3
FOLDS = 5
LOW = 0.05
REACH = 0.5
SPANS = (1, 8, 16, 32, 64, 128)
LANGUAGES = 2000
TEXTS = 20_000
CHARACTERS = 64 << 20
UNDETERMINED = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
_KEEP = np.zeros(256, dtype=bool)
_KEEP[0x61:0x7B] = True
_KEEP[0x80:] = True


def counts(texts: list[bytes]) -> np.ndarray:
    """Gram counts, a row of 2 ** BITS for each (lower-cased) text."""
    n, d = len(texts), 1 << BITS
    b, offsets = joined(texts)
    code = np.where(_KEEP[b], b, np.uint8(0x20)).astype(np.uint64)
    base = np.repeat(np.arange(n, dtype=np.int64) * d, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(b))  # bytes to the end of the text
    out = np.zeros(n * d, dtype=np.int64)
    packed, blank = np.zeros(len(b), dtype=np.uint64), np.ones(len(b), dtype=bool)
    space = code == 0x20
    for size in range(1, max(SIZES) + 1):
        m = len(b) - size + 1
        if m <= 0:
            break
        packed = (packed[:m] << np.uint64(8)) | code[size - 1 :]
        blank = blank[:m] & space[size - 1 :]  # grams of spaces alone say nothing
        bucket = ((packed + np.uint64(size << 56)) * np.uint64(BASE) >> np.uint64(64 - BITS)).astype(np.int64)
        use = ~blank & (left[:m] >= size)
        out += np.bincount((bucket + base[:m])[use], minlength=n * d)
    return out.reshape(n, d)


def letters(text: bytes) -> np.ndarray:
    """Running count of the bytes of a lower-cased text that belong to letters."""
    return np.cumsum(_KEEP[np.frombuffer(text, dtype=np.uint8)])


@lru_cache(maxsize=None)
def kept(c: str) -> bool:
    """Letters and marks stay; ASCII is left to `counts`."""
    return c.isascii() or c.isalpha() or unicodedata.category(c)[0] == "M"


def has_letter(text: str) -> bool:
    """Whether a character of the general category L is in the text."""
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text))


def lowered(text: str) -> bytes:
    text = text.lower()
    if not text.isascii():
        for c in set(text):
            if not kept(c):
                text = text.replace(c, " ")
    return text.encode("utf-8", "replace")


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # unit rows
    idf: np.ndarray
    limit: np.ndarray  # least cosine of each centroid's language, a column for each of SPANS

    def vectors(self, texts: list[bytes]) -> np.ndarray:
        x = np.sqrt(counts(texts)).astype(np.float32) * self.idf
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.maximum(norm, 1e-12)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine, rejected, for each whole text."""
        names, score, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        if not self.languages:
            return names, score, rejected
        ready, index = [], []
        for i, t in enumerate(texts):
            if t is not None and has_letter(s := t.decode("utf-8", "replace")):
                ready.append(lowered(s))
                index.append(i)
        for lo, hi in chunks(ready):
            for at in range(lo, hi, 64):  # so many dense rows at once at most
                rows = ready[at : min(hi, at + 64)]
                near = self.vectors(rows) @ self.centroids.T
                best = near.argmax(axis=1)
                span = np.searchsorted(SPANS, [max(1, letters(t)[-1]) for t in rows], side="right") - 1
                for k, c in enumerate(best):
                    i = index[at + k]
                    names[i] = self.languages[c]
                    score[i] = min(1.0, max(0.0, float(near[k, c])))
                    rejected[i] = near[k, c] < self.limit[c, span[k]]
        return names, score, rejected


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means, seeded by the farthest points."""
    picked = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin((x @ x[picked].T).max(axis=1))))
    c = x[picked]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def reached(model: Model, texts: list[bytes], x: np.ndarray) -> list[float]:
    """For each of SPANS the LOW quantile of the cosines of one language's texts, held back in folds."""
    if len(texts) == 1:  # one half against the other
        half = letters(texts[0]).searchsorted(letters(texts[0])[-1] // 2, side="right")
        texts = [t for t in (texts[0][:half], texts[0][half:]) if t]
        x = model.vectors(texts)
    fold = np.arange(len(texts)) % FOLDS
    kept = [kmeans(x[fold != f], CENTROIDS) if (fold != f).any() else x for f in range(min(FOLDS, len(texts)))]
    runs, out = [letters(t) for t in texts], []
    for span in SPANS:
        found = []
        long = [i for i, r in enumerate(runs) if r[-1] >= span]
        for at in range(0, len(long), 64):
            some = long[at : at + 64]
            v = model.vectors([texts[i][: int(runs[i].searchsorted(span)) + 1] for i in some])
            found += [float((kept[fold[i]] @ v[j]).max()) for j, i in enumerate(some)]
        # longer texts than any sample: as the longest samples
        out.append(float(np.quantile(found, LOW)) if found else out[-1] if out else 0.0)
    return out


def fit(texts: list[str], languages: list[str]) -> Model:
    """Centroids and limits, language by language, so that dense rows are those of one language at most."""
    model = Model([], np.zeros((0, 1 << BITS), dtype=np.float32), np.ones(1 << BITS, dtype=np.float32), np.zeros((0, len(SPANS))))
    if not texts:
        return model
    own: dict[str, list[bytes]] = {}
    for t, language in zip(texts, languages, strict=True):
        own.setdefault(language, []).append(lowered(t))
    present = sum((counts(some[at : at + 64]) > 0).sum(axis=0) for some in own.values() for at in range(0, len(some), 64))
    model.idf = (np.log((1 + len(texts)) / (1 + present)) + 1).astype(np.float32)
    centroids, limits = [], []
    for language in sorted(own):
        mine = own[language]
        x = np.concatenate([model.vectors(mine[at : at + 64]) for at in range(0, len(mine), 64)])
        c = kmeans(x, CENTROIDS)
        centroids.append(c)
        model.languages += [language] * len(c)
        limits += [[REACH * low for low in reached(model, mine, x)]] * len(c)
    model.centroids, model.limit = np.concatenate(centroids), np.asarray(limits)
    return model


def sample(docs: DataFrame, allowed: Column) -> tuple[list[str], list[str]]:
    """A bounded sample of each language's texts, by a hash of id and text; of each language at least one."""
    rows = docs.filter(allowed & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    share = (F.xxhash64("doc_id", "text").cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    rows = rows.withColumn("h", share)
    # counts of distinct (id, text) by language, so that texts need not move to be sampled and repeats don't thin the rest;
    # the row with the least hash is always taken, so that no language is lost by chance
    found = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"), F.min("h").alias("least")).orderBy(F.col("n").desc(), "lang")
    counted = found.limit(LANGUAGES + 1).collect()
    if len(counted) > LANGUAGES:
        warnings.warn(f"more than {LANGUAGES} values of lang: those with the fewest texts are not learned", stacklevel=2)
        counted = counted[:LANGUAGES]
    if not counted:
        return [], []
    each = min(SAMPLE, max(2, TEXTS // len(counted)))
    longest = max(256, min(LONGEST, int(CHARACTERS / (1.5 * each * len(counted)))))
    rates = {r["lang"]: max(r["least"], min(1.0, 1.5 * each / max(1, r["n"]))) for r in counted}
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))
    some = rows.filter(F.col("h") <= rate).select("lang", "h", F.substring("text", 1, longest).alias("t"))
    # rows that repeat an id and text meet before they are collected
    some = some.groupBy("lang", "h").agg(F.min("t").alias("t")).collect()
    texts, names, taken = [], [], {}
    for r in sorted(some, key=lambda r: (r["lang"], r["h"])):
        if taken.get(r["lang"], 0) < each and has_letter(r["t"]):
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            texts.append(r["t"])
            names.append(r["lang"])
    return texts, names


def train(docs: DataFrame, allowed: Column) -> Model:
    return fit(*sample(docs, allowed))


def predict(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """`columns` of docs with lang_pred, score and rejected, for every row."""
    rows = docs.select(*columns, F.col("text").alias(fresh(columns, "text")))
    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, rejected = model.predict(batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist())
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, schema)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is not rejected, all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected = model.predict(batch.column(at).cast(pa.binary()).to_pylist())[2]
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
