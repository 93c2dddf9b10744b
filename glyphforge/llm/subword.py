"""Subword-bag embeddings with a linear softmax, trained jointly by numpy gradient descent.

A word owns its hashed character 3-, 4- and 5-grams (word edges included) and itself; with
`pairs`, also its bigram with the word before it in its text.  An instance averages the vectors of its
n-grams and goes through one linear softmax.  With two classes the softmax of an average is
the sigmoid of an average of per-n-gram scores, so a fitted model is one table of scores:
scoring gathers and adds, and a text of any length is read whole in bounded pieces.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .common import BASE, LOWER, PIECE, SEPARATOR, WordHasher, chunks, joined, mix

GRAMS = (3, 4, 5)


@dataclass
class Config:
    bits: int = 18  # buckets of the hash table: 2 ** bits
    dim: int = 8
    lower: bool = True
    pairs: bool = False
    window: int = 0  # words per instance; 0: the whole document
    steps: int = 60
    warm: int = 6  # first steps, in which an instance is a random span even if windowed
    span: int = 128  # words of the random span of a document that a step without windows takes
    rate: float = 0.5
    decay: float = 1e-4
    seed: int = 7


class Features:
    """n-gram buckets of the words of a buffer."""

    def __init__(self, config: Config) -> None:
        self.config = config
        self.words = WordHasher()

    def columns(self, b: np.ndarray, offsets: np.ndarray):
        """The starts of the words, then (offset, buckets) of each kind of n-gram.

        Buckets stand at the byte `offset` places after the first byte they cover, which
        lies in the word that owns them.  No n-gram spans two of the texts, which begin at
        the offsets.  Bucket 0 stands for nothing and always scores 0.
        """
        c = self.config
        hashes, starts = self.words(b, c.lower)
        yield starts
        shift, spread = np.uint64(64 - c.bits), np.uint64(BASE)
        sep = SEPARATOR[b]
        code = (LOWER[b] if c.lower else b).copy()
        code[sep] = 0x20
        code = code.astype(np.uint64)
        packed, inner = None, None
        for size in range(2, max(GRAMS) + 1):
            if len(b) < size:
                break
            # the gram has one byte before its owner's position and size - 2 after it
            if packed is None:
                packed, inner = (code[:-1] << np.uint64(8)) | code[1:], np.zeros(len(b) - 1, dtype=bool)
            else:
                packed = (packed[:-1] << np.uint64(8)) | code[size - 1 :]
                inner = inner[:-1] | sep[size - 2 : -1]
            if size in GRAMS:
                bucket = ((packed + np.uint64(size << 56)) * spread >> shift).astype(np.int32)
                bucket[inner] = 0
                yield 1, bucket
        whole = np.zeros(len(b), dtype=np.int32)
        whole[starts] = (hashes >> shift).astype(np.int32)
        yield 0, whole
        if c.pairs and len(hashes) > 1:
            pair = np.zeros(len(b), dtype=np.int32)
            same = hashes[1:] == hashes[:-1]
            both = mix(np.where(same, np.uint64(1), hashes[1:] * np.uint64(3) + hashes[:-1]))
            pair[starts[1:]] = (both >> shift).astype(np.int32)
            firsts = np.searchsorted(starts, offsets[:-1])
            pair[starts[firsts[firsts < len(starts)]]] = 0
            yield 0, pair

    def matrix(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the words, and a row of buckets for each byte."""
        kinds = self.columns(b, offsets)
        starts, rows = next(kinds), []
        for at, bucket in kinds:
            out = np.zeros(len(b), dtype=np.int32)
            out[at : at + len(bucket)] = bucket
            rows.append(out)
        return starts, np.stack(rows, axis=1)

    def sums(self, b: np.ndarray, offsets: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the words, the sums of their scores and the numbers of their n-grams."""
        kinds = self.columns(b, offsets)
        starts = next(kinds)
        if not len(starts):
            return starts, np.empty(0), np.empty(0)
        total, count = np.zeros(len(b), dtype=np.float32), np.zeros(len(b), dtype=np.uint8)
        for at, bucket in kinds:
            total[at : at + len(bucket)] += scores[bucket]
            count[at : at + len(bucket)] += bucket != 0
        return starts, np.add.reduceat(total, starts, dtype=float), np.add.reduceat(count, starts, dtype=float)


def opened(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """As `joined`, with a newline before the first text too, so that all words have both edges."""
    b, offsets = joined([b"", *texts])
    return b, offsets[1:]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Model:
    config: Config
    scores: np.ndarray  # a score for each bucket
    bias: float
    prior: float = 0.5  # the score of a text without words
    features: Features | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "features": None}

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Probability of class 1 for each whole text."""
        if self.features is None:
            self.features = Features(self.config)
        out = np.empty(len(texts))
        for lo, hi in chunks(texts):
            part = texts[lo:hi]
            if hi - lo == 1 and len(part[0]) > 2 * PIECE:
                out[lo] = self._long(part[0])
            else:
                out[lo:hi] = self._chunk(part)
        return out

    def _long(self, text: bytes) -> float:
        """A very long text, piece by piece; pieces end between words and windows span them by sums."""
        at, pieces, last = 0, [], b""
        while at < len(text):
            end = min(len(text), at + PIECE)
            while end < len(text) and not SEPARATOR[text[end]]:
                end += 1
            # the word before the piece leads it, for the bigram, and is not counted again
            b, offsets = opened([last + text[at:end]])
            starts, total, count = self.features.sums(b, offsets, self.scores)
            pieces.append((total[bool(last) :], count[bool(last) :]))
            if len(starts):
                last = b[starts[-1] :].tobytes().split(None, 1)[0]
            at = end
        total, count = np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces])
        return float(self._pool(total, count, np.array([0, len(total)]))[0])

    def _pool(self, total: np.ndarray, count: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Probabilities of documents whose words lie between the cuts."""
        z = pool(total, count, cuts, self.config.window)[0]
        return np.where(np.isnan(z), self.prior, _sigmoid(z + self.bias))

    def _chunk(self, texts: list[bytes]) -> np.ndarray:
        b, offsets = opened(texts)
        starts, total, count = self.features.sums(b, offsets, self.scores)
        return self._pool(total, count, np.searchsorted(starts, offsets))


def pool(total: np.ndarray, count: np.ndarray, cuts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the mean score of its highest window (NaN without words), and that window's first word."""
    n = len(cuts) - 1
    z, best = np.full(n, np.nan), cuts[:-1].copy()
    some = np.flatnonzero(np.diff(cuts) > 0)
    if not len(some):
        return z, best
    # added up within each document alone, so that no sum depends on its neighbours
    if not window:
        lo, end = cuts[some], cuts[some[-1] + 1]
        z[some] = np.add.reduceat(total[:end], lo) / np.maximum(1, np.add.reduceat(count[:end], lo))
        return z, best
    doc_end = np.repeat(cuts[1:][some], np.diff(cuts)[some])
    lo = np.arange(cuts[some[0]], cuts[some[0]] + len(doc_end))
    sums, counts = total[lo], count[lo]
    for j in range(1, window):
        at = np.flatnonzero(lo + j < doc_end)
        sums[at] += total[lo[at] + j]
        counts[at] += count[lo[at] + j]
    means = sums / np.maximum(1, counts)
    firsts = cuts[some] - lo[0]
    top = np.maximum.reduceat(means, firsts)
    z[some] = top
    hit = np.flatnonzero(means == np.repeat(top, np.diff(cuts)[some]))
    owner = np.searchsorted(firsts, hit, side="right") - 1
    first_hit = np.full(len(some), -1)
    first_hit[owner[::-1]] = hit[::-1]
    best[some] = lo[first_hit]
    return z, best


def fit(texts: list[bytes], labels: np.ndarray, config: Config) -> Model:
    """Embeddings and softmax, trained together with Adagrad steps on mini-batches of documents.

    With windows a document is scored by its highest window, and the step goes through that
    window alone (multiple-instance learning), after warm-up steps on random spans.
    """
    rng = np.random.default_rng(config.seed)
    feats = Features(config)
    # one buffer for all n-grams, of which only what is filled takes memory
    ids = np.empty((len(GRAMS) + 1 + config.pairs) * (sum(map(len, texts)) + len(texts)), dtype=np.int32)
    filled, counts, cuts = 0, [], [0]
    for lo, hi in chunks(texts):
        b, offsets = opened(texts[lo:hi])
        starts, g = feats.matrix(b, offsets)
        rows = np.flatnonzero(g.any(axis=1))
        owner = np.searchsorted(starts, rows, side="right") - 1
        flat = g[rows]
        keep = flat != 0
        kept = flat[keep]
        ids[filled : filled + len(kept)] = kept
        filled += len(kept)
        counts.append(np.bincount(np.repeat(owner, keep.sum(axis=1)), minlength=len(starts)))
        cuts.extend(cuts[-1] + np.searchsorted(starts, offsets[1:]))
    ids, per_word = ids[:filled], np.concatenate(counts)
    word_at = np.concatenate(([0], np.cumsum(per_word)))
    cuts = np.asarray(cuts)
    y = np.asarray(labels, dtype=float)
    buckets, d = 1 << config.bits, config.dim
    table = (rng.random((buckets, d)) - 0.5).astype(np.float32) / d
    table[0] = 0
    out = rng.standard_normal((d, 2)) / np.sqrt(d)
    bias = np.zeros(2)
    seen_t, seen_o = np.full(buckets, 1e-3, dtype=np.float32), np.full((d, 2), 1e-3)
    share = np.array([(y == 0).sum(), (y == 1).sum()], dtype=float)
    weight = np.where(y == 1, len(y) / (2 * max(1, share[1])), len(y) / (2 * max(1, share[0])))
    docs = np.flatnonzero(np.diff(cuts) > 0)
    for step in range(config.steps):
        window = 0 if step < config.warm else config.window
        if window:
            scores = table @ (out[:, 1] - out[:, 0]).astype(np.float32)
            by_word = np.add.reduceat(scores[ids], word_at[:-1], dtype=float)
            best = pool(by_word, per_word.astype(float), cuts, window)[1]
        for batch in np.array_split(rng.permutation(docs), max(1, len(docs) // 256)):
            if window:
                first, width = best[batch], window
            else:
                spare = np.maximum(0, cuts[batch + 1] - cuts[batch] - config.span)
                first, width = cuts[batch] + (rng.random(len(batch)) * (spare + 1)).astype(int), config.span
            lo, hi = word_at[first], word_at[np.minimum(first + width, cuts[batch + 1])]
            size = hi - lo
            take = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            g, inverse = np.unique(ids[take], return_inverse=True)
            edge = np.concatenate(([0], np.cumsum(size)[:-1]))
            mean = np.add.reduceat(table[g][inverse], edge, axis=0) / size[:, None]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch].astype(int)] -= 1
            p *= weight[batch, None]
            grad_out = mean.T @ p / len(batch) + config.decay * out
            pull = (p @ out.T) / size[:, None]
            doc = np.repeat(np.arange(len(batch)), size)
            order = np.argsort(inverse, kind="stable")
            grad = np.add.reduceat(pull[doc[order]], np.searchsorted(inverse[order], np.arange(len(g))), axis=0)
            seen_o += grad_out**2
            out -= config.rate * grad_out / np.sqrt(seen_o)
            bias -= 0.05 * p.mean(axis=0)
            seen_t[g] += (grad**2).mean(axis=1)
            table[g] -= (config.rate * grad / np.sqrt(seen_t[g])[:, None]).astype(np.float32)
    table[0] = 0
    scores = (table @ (out[:, 1] - out[:, 0]).astype(np.float32)).astype(np.float32)
    return Model(config, scores, float(bias[1] - bias[0]), float(y.mean()) if len(y) else 0.5)
