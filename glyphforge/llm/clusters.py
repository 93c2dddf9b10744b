"""Centroid clustering: Lloyd's rounds in exact integers, made cheap by Drake's adaptive bounds.

Every component x becomes the integer floor(256 * x).  Each vector keeps its few nearest
centroids in order, and lower bounds: one for each place of that order, which holds for the
centroid there and all that come later, and one for the remainder.  When centroids move,
bounds fall by what theirs moved (the remainder's by the largest move) and the exact
distance to the vector's own centroid is taken anew.  Where it lies below the second
place's bound the vector stays; below a later place's, the listed centroids alone are
measured and ordered again; otherwise the order can't be certified and all centroids are
measured.  Bounds are rounded down, ties are never certified, distances are integers: the
assignment is that of a full search.  The list shrinks with the places that certified, from
a quarter of the centroids to an eighth.

Vectors stay in their partitions, in blocks with their bounds, cached on memory and disk;
a lost executor's blocks are made again from the table, narrowly, with the rounds'
centroids, which are constants.  A round sends sums and counts by a tree.

Defined cases: vectors that are null, of another length, or with null or non-finite
components take no part, nor do those with a component of 2 ** 19 or more in size, whose
distances longs could not hold; null ids are hashed as if empty; repeated ids are seeded in
order of their vectors, repeated rows count each; fewer vectors than centroids give as many
centroids as vectors; a centroid that nobody is nearest to stays; ties go to the smaller
number; inertias are null where they exceed a long; an empty table gives no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, tree_merged

SCALE = 256
CENTROIDS, ROUNDS, DIM = 40, 5, 64
LARGEST = 2.0**19
BLOCK = 4096
_EXACT = 1 << 53
_LONG = (1 << 63) - 1


def usable(vec: Column, dim: int) -> Column:
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    return F.coalesce((F.size(vec) == dim) & fine, F.lit(False))


def full(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centroids, exact."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < _EXACT:  # every sum of products is an exact double
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), dtype=np.int64)
    for j, centre in enumerate(c):
        d = x - centre
        out[:, j] = (d * d).sum(axis=1)
    return out


def listed(x: np.ndarray, c: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Squared distances of each row to its own list of centroids, exact."""
    out = np.empty(near.shape, dtype=np.int64)
    for j in range(near.shape[1]):
        d = x - c[near[:, j]]
        out[:, j] = (d * d).sum(axis=1)
    return out


def below(bound: np.ndarray) -> np.ndarray:
    """As single precision, rounded down."""
    return np.nextafter(bound.astype(np.float32), np.float32(-np.inf))


def ordered(d: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Order of each row's centroids by distance, ties by number."""
    return np.lexsort((numbers, d), axis=1)


@dataclass
class Bounds:
    """Of a block of vectors: centroids by nearness, and for places 1, 2, ... and the remainder the lower bounds."""

    near: np.ndarray  # (rows, listed) centroid numbers
    low: np.ndarray  # (rows, listed): of places 1 to listed - 1, then of the remainder

    @classmethod
    def scan(cls, x: np.ndarray, c: np.ndarray, keep: int) -> tuple[Bounds, np.ndarray]:
        """From all centroids; with the squared distance to the nearest."""
        d = full(x, c)
        order = ordered(d, np.broadcast_to(np.arange(len(c)), d.shape))
        d = np.take_along_axis(d, order, axis=1)
        after = np.sqrt(d[:, 1 : keep + 1].astype(np.float64))
        if after.shape[1] < keep:  # nothing remains
            after = np.hstack((after, np.full((len(x), keep - after.shape[1]), np.inf)))
        return cls(order[:, :keep].astype(np.uint16), below(after)), d[:, 0].copy()

    def shrink(self, keep: int) -> None:
        if keep < self.near.shape[1]:
            self.near, self.low = self.near[:, :keep], self.low[:, :keep]

    def move(self, x: np.ndarray, c: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """After centroids moved: squared distances to the nearest, and the places that certified each row (0: scanned)."""
        keep = self.near.shape[1]
        fall = np.full((len(x), keep), moved.max(initial=0.0))
        fall[:, :-1] = moved[self.near[:, 1:]]
        low = self.low.astype(np.float64) - fall
        # a place's bound holds for all later places too
        low = np.minimum.accumulate(low[:, ::-1], axis=1)[:, ::-1]
        own = listed(x, c, self.near[:, :1])[:, 0]
        certified = np.sqrt(own.astype(np.float64))[:, None] * (1 + 1e-9) < low
        place = np.where(certified.any(axis=1), certified.argmax(axis=1) + 1, 0)
        some = np.flatnonzero(place > 1)
        if len(some):
            numbers = self.near[some]
            d = listed(x[some], c, numbers)
            order = ordered(d, numbers)
            d = np.take_along_axis(d, order, axis=1)
            self.near[some] = np.take_along_axis(numbers, order, axis=1)
            own[some] = d[:, 0]
            low[some, :-1] = np.minimum(np.sqrt(d[:, 1:].astype(np.float64)), low[some, -1:])
        self.low = below(low)
        none = np.flatnonzero(place == 0)
        if len(none):
            fresh, own[none] = Bounds.scan(x[none], c, keep)
            self.near[none], self.low[none] = fresh.near, fresh.low
        return own, place


def sums_of(x: np.ndarray, cluster: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros((k, x.shape[1]), dtype=np.int64)
    for c in np.unique(cluster).tolist():
        total[c] = x[cluster == c].sum(axis=0)
    return total, np.bincount(cluster, minlength=k)


_STATE = pa.schema([("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("near", pa.binary()), ("low", pa.binary()), ("sums", pa.binary())])
_STATE_SQL = "ids array<long>, x binary, near binary, low binary, sums binary"


def _row(ids: pa.Array, x: np.ndarray, bounds: Bounds, own: np.ndarray, place: np.ndarray, k: int) -> pa.RecordBatch:
    total, count = sums_of(x, bounds.near[:, 0].astype(np.int64), k)
    state = pickle.dumps((total, count, int(place.max(initial=0)), int((place == 0).sum())))
    kind = np.int16 if np.abs(x).max(initial=0) < 1 << 15 else np.int32
    cells = (ids.to_pylist(), x.astype(kind).tobytes(), bounds.near.tobytes(), bounds.low.tobytes(), state)
    return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, _STATE, strict=True)], schema=_STATE)


def _unpacked(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.Array, np.ndarray, Bounds]]:
    for i in range(batch.num_rows):
        ids = batch.column(0)[i].values
        x, near, low = (batch.column(j)[i].as_py() for j in (1, 2, 3))
        x = np.frombuffer(x, dtype=np.int16 if len(x) == 2 * dim * len(ids) else np.int32).reshape(-1, dim).astype(np.int64)
        yield ids, x, Bounds(np.frombuffer(near, dtype=np.uint16).reshape(len(ids), -1).copy(), np.frombuffer(low, dtype=np.float32).reshape(len(ids), -1).copy())


def _moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centroid went, rounded up."""
    return np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)


def _added(a: bytes, b: bytes) -> bytes:
    (t1, n1, p1, s1), (t2, n2, p2, s2) = pickle.loads(a), pickle.loads(b)
    return pickle.dumps((t1 + t2, n1 + n2, max(p1, p2), s1 + s2))


def _of_partition(batches: Iterator[pa.RecordBatch]) -> bytes | None:
    out = None
    for batch in batches:
        for state in batch.column(0).to_pylist():
            out = state if out is None else _added(out, state)
    return out


@dataclass
class Round:
    """What a round saw: vectors assigned, those of them that all centroids were measured for, bounds kept."""

    vectors: int
    scanned: int
    listed: int


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, salt: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding", log: list[Round] | None = None
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector; see the module."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).filter(usable(F.col("vec"), dim))
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    seeds = rows.select(name.alias("h"), "vec").orderBy("h", "vec").limit(k).collect()
    centroids = np.floor(SCALE * np.array([r["vec"] for r in seeds])).astype(np.int64).reshape(-1, dim)
    k = len(centroids)
    keep = min(k, max(2, -(-k // 4)))
    fewest = min(k, max(2, -(-k // 8)))

    def begin(batches: Iterator[pa.RecordBatch], c: np.ndarray = centroids, keep: int = keep) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for at in range(0, len(values), BLOCK):
                x = np.floor(SCALE * values[at : at + BLOCK]).astype(np.int64)
                bounds, own = Bounds.scan(x, c, keep)
                yield _row(batch.column(0).slice(at, BLOCK), x, bounds, own, np.zeros(len(x), dtype=np.int64), k)

    def step(c: np.ndarray, moved: np.ndarray, keep: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, x, bounds in _unpacked(batch, dim):
                    bounds.shrink(keep)
                    yield _row(ids, x, bounds, *bounds.move(x, c, moved), k)

        return run

    def end(c: np.ndarray, moved: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, x, bounds in _unpacked(batch, dim):
                    own, _ = bounds.move(x, c, moved)
                    yield pa.RecordBatch.from_arrays([ids, pa.array(bounds.near[:, 0].astype(np.int32)), pa.array(own)], names=["vec_id", "cluster", "distance"])

        return run

    schema = "vec_id long, cluster int, distance long"
    if k:
        before, held, moved = None, rows.mapInArrow(begin, _STATE_SQL).persist(StorageLevel.MEMORY_AND_DISK), np.zeros(k)
        for at in range(rounds):
            total, count, place, scanned = pickle.loads(tree_merged(held.select("sums"), _of_partition, _added))
            if before is not None:
                before.unpersist()
            if log is not None:
                log.append(Round(int(count.sum()), scanned, keep))
            if at:  # as many places as certified a vector in this round
                keep = min(keep, max(fewest, place))
            new = np.where(count[:, None] > 0, np.floor_divide(total, np.maximum(count, 1)[:, None]), centroids)
            moved, centroids = _moved(centroids, new), new
            if at + 1 < rounds:
                before, held = held, held.mapInArrow(step(centroids, moved, keep), _STATE_SQL).persist(StorageLevel.MEMORY_AND_DISK)
        assigned = cut(held.mapInArrow(end(centroids, moved), schema))
        held.unpersist()
    else:
        assigned = vectors.sparkSession.createDataFrame([], schema)
    sums = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda v: v if v <= _LONG else None
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    found = [(c, fits(d), fits(sum(sums.values())), digest[c]) for c, d in sorted(sums.items())]
    about = vectors.sparkSession.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
