"""Embedding whitening by TSQR: no covariance matrix is ever formed to find the components.

Every entry c of a vector becomes the integer x = floor(64 * c) + 1000000.  The steps:

1. counts and exact integer sums S of every dimension, by partition, merged by a tree;
2. rows centred exactly: with S = n * q + r, x - S / n is (x - q) - r / n, whose first term
   is a small integer, so the shift of a million costs no digits;
3. a QR factorisation of each partition's centred rows, block by block, that keeps R alone;
   R factors are stacked and factorised again, up a tree;
4. the singular values s of the last R are those of all centred rows: eigenvalues of the
   covariance are s ** 2 / n, and its right vectors, divided by s / sqrt(n), whiten;
5. the covariance of what was whitened, again by partition and tree (each block centred by
   its own mean, merged pairwise), tells the identity error.

The driver and any task hold matrices of the dimension's size, never rows of all partitions.

Defined cases: vectors null or with null or non-finite entries take no part, nor do those
with an entry of 2 ** 46 or more in size, whose sums longs could not hold; vectors of
different lengths are fitted apart, each length with its own n; empty vectors have no
components; a null id is an id; repeated rows count each; components without variance
(eigenvalues that are rounding alone, so all of a single vector) are left out, as they
can't be whitened; equal eigenvalues leave their components' order and rotation open;
`deviation` is null where it exceeds a long; an empty table gives no rows; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ann import by_dimension
from .common import tree_merged

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LARGEST = 2.0**46
BLOCK = 1024  # rows worked on at once
_LONG = (1 << 63) - 1
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(vec: Column) -> Column:
    """Not null, all entries finite numbers that integers can stand for."""
    return F.coalesce(vec.isNotNull() & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST)), F.lit(False))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(dimension, ids, integers) of (id, vector) batches, BLOCK rows at most."""
    for batch in batches:
        for dim, rows, c in by_dimension(batch.column(1)):
            for at in range(0, len(rows) if dim else 0, BLOCK):
                x = np.floor(SCALE * c[at : at + BLOCK]).astype(np.int64) + SHIFT
                yield dim, batch.column(0).take(pa.array(rows[at : at + BLOCK])), x


# ---------------------------------------------------------------- states and how they merge


def summed(batches: Iterator[pa.RecordBatch]) -> bytes | None:
    found: dict[int, tuple[int, list[int]]] = {}
    for dim, _, x in blocks(batches):
        n, total = found.get(dim, (0, [0] * dim))
        found[dim] = n + len(x), [a + b for a, b in zip(total, x.sum(axis=0).tolist(), strict=True)]
    return pickle.dumps(found) if found else None


def _by_dimension(join):
    def both(a: bytes, b: bytes) -> bytes:
        out = pickle.loads(a)
        for dim, state in pickle.loads(b).items():
            out[dim] = join(out[dim], state) if dim in out else state
        return pickle.dumps(out)

    return both


def joined_sums(a: tuple[int, list[int]], b: tuple[int, list[int]]) -> tuple[int, list[int]]:
    return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)]


def stacked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """R of the rows that a and b are the R factors (or rows) of."""
    return np.linalg.qr(np.vstack((a, b)), mode="r")


def joined_moments(a: tuple[int, np.ndarray, np.ndarray], b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Counts, means and sums of centred products of two lots of rows as those of both."""
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


# ---------------------------------------------------------------- the basis


@dataclass(frozen=True)
class Basis:
    """What whitens the vectors of one length."""

    n: int
    quotient: np.ndarray  # S div n
    rest: np.ndarray  # S mod n
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a column each
    trace: float
    error: float = float("nan")

    @classmethod
    def centre(cls, n: int, sums: list[int]) -> Basis:
        q, r = zip(*(divmod(s, n) for s in sums), strict=True)
        return cls(n, np.array(q, dtype=np.int64), np.array(r, dtype=np.int64), np.zeros(0), np.zeros((len(sums), 0)), 0.0)

    def with_factor(self, r: np.ndarray, components: int) -> Basis:
        """`r`: the R factor of all centred rows."""
        _, s, vt = np.linalg.svd(r, full_matrices=False)
        rank = int((s > s[0] * max(self.n, r.shape[1]) * np.finfo(float).eps).sum()) if len(s) and s[0] > 0 else 0
        k = min(components, rank)
        v = vt[:k].T
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)  # one sign for all reruns
        return replace(self, values=s[:k] ** 2 / self.n, vectors=v, trace=float((s**2).sum()) / self.n)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.quotient) - self.rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n * x - S) ** 2 of each row, exact."""
        off = x - self.quotient
        if (self.n * (int(np.abs(off).max(initial=0)) + 1)) ** 2 * len(self.quotient) <= _LONG:
            off = self.n * off - self.rest
            return pa.array((off * off).sum(axis=1))
        rest = self.rest.tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in off.tolist()]
        return pa.array([e if e <= _LONG else None for e in exact], pa.int64())


def factored(bases: dict[int, Basis]):
    """The R factor of a partition's centred rows, by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        found: dict[int, np.ndarray] = {}
        for dim, _, x in blocks(batches):
            found[dim] = stacked(found.get(dim, np.zeros((0, dim))), bases[dim].centred(x))
        return pickle.dumps(found) if found else None

    return run


def moments(bases: dict[int, Basis]):
    """Count, mean and centred products of a partition's whitened rows, by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> bytes | None:
        found: dict[int, tuple] = {}
        for dim, _, x in blocks(batches):
            w = bases[dim].whitened(x)
            mean = w.mean(axis=0)
            own = len(w), mean, (w - mean).T @ (w - mean)
            found[dim] = joined_moments(found[dim], own) if dim in found else own
        return pickle.dumps(found) if found else None

    return run


def _rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.filter(usable(F.col("vec")))


def fit(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> dict[int, Basis]:
    """The basis of each length of vector, with its identity error measured over all of them."""
    rows = _rows(vectors, id_col, vec_col)
    load = lambda state: pickle.loads(state) if state else {}
    sums = load(tree_merged(rows, summed, _by_dimension(joined_sums)))
    bases = {dim: Basis.centre(n, total) for dim, (n, total) in sums.items()}
    for dim, r in load(tree_merged(rows, factored(bases), _by_dimension(stacked))).items():
        bases[dim] = bases[dim].with_factor(r, components)
    for dim, (n, _, products) in load(tree_merged(rows, moments(bases), _by_dimension(joined_moments))).items():
        error = np.abs(products / n - np.eye(len(products)))
        bases[dim] = replace(bases[dim], error=float(error.max(initial=0.0)))
    return bases


def whiten(vectors: DataFrame, bases: dict[int, Basis], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each vector and component; see SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, x in blocks(batches):
            b = bases[dim]
            n, k = len(x), len(b.values)
            each = pa.array(np.repeat(np.arange(n), k))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, b.n)),
                    b.deviation(x).take(each),
                    pa.array(b.whitened(x).ravel()),
                    pa.array(np.tile(b.values / b.trace if k else b.values, n)),
                    pa.array(np.full(n * k, b.error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return _rows(vectors, id_col, vec_col).mapInArrow(run, SCHEMA)
