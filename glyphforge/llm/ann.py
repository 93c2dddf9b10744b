"""Nearest neighbours by vantage-point trees, one per shard of vectors.

An upper vantage-point tree, fitted on a sample of at most 2 * FIT vectors, deals all vectors
into leaves; a leaf of more than SHARD vectors is divided further by a hash of id and vector.
Each such shard builds a tree of its own, once, and keeps it for the second pass.  A query first
asks the shard it lies in, which bounds the distance of its k-th neighbour; then it goes to every
other shard that this bound reaches, and to no other.  What a leaf holds is known by rings: the
least and greatest distance to its own centre and to PIVOTS vantage points that all leaves share;
one ring out of reach rules the leaf out.  In a tree, a query skips the far side of a ball when
|d - radius| > relax * (its k-th best distance so far), and it skips leaves by the same factor;
relax 1 is the exact triangle inequality, smaller values prune more and may lose neighbours.
Where all distances are nearly equal, as between vectors without clusters in many dimensions, no
ring rules anything out, and an exact search asks every shard.

The table is read twice, for the sample and to deal it; dealt vectors, and shards with their
trees, are tables in the shared folder.  A task holds one shard and reads queries in blocks of
BLOCK or twice that; leaves (at most about FIT / ROUTE a dimension) with their centres, rings and sizes are all
that the driver sees.

Distances that decide are exact: candidates are ranked by sqrt(sum((a - b) ** 2)) in double
precision on the original vectors, summed in dimension order.  Bounds allow for rounding in
proportion to what they compare, so that vectors of any norm or offset lose nothing.

Defined cases: vectors null, empty, zero, or with null or non-finite components take no
part, nor do rows with a null id; vectors of another dimension than the query's are no
candidates; ties go to the smaller id; a row is no candidate of a query with its own id;
rows that repeat an id and its vector count once (within a batch before anything moves); an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, shared_folder

SHARD = 4096  # vectors in a shard, about
BLOCK = 1024  # queries in a block, at most
LEAF = 128
FIT = 16384  # vectors that the upper tree is fitted on, about, at most
ROUTE = 8  # of these, as many in one of its leaves at least
PIVOTS = 32  # vantage points that the rings of all leaves of a dimension share
RELAX = 1.0
_EPS = float(np.finfo(float).eps)


def slack(dim: int, *sizes: np.ndarray) -> np.ndarray:
    """What rounding may add to a comparison of distances of these sizes."""
    return 16 * (dim + 8) * _EPS * sum(sizes)


def reaches(gap: np.ndarray, best: np.ndarray, relax: float, margin: np.ndarray) -> np.ndarray:
    """Whether a ball of radius `best` about the query may hold something beyond `gap`."""
    return np.isinf(best) | (gap <= relax * np.where(np.isinf(best), 0.0, best) + margin)


def spread_point(x: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> int:
    """Of a few candidates, the row whose distances to some others spread most."""
    some = rng.choice(rows, size=min(len(rows), 64), replace=False)
    return int(some[int(np.argmax([np.var(distances(x[some], x[v])) for v in some[:5]]))])


def distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    diff = x - point
    return np.sqrt((diff * diff).sum(axis=1))


class Tree:
    """A vantage-point tree over the rows of `x`, held as nested tuples of row numbers."""

    def __init__(self, x: np.ndarray, seed: int = 11) -> None:
        self.x = x
        self.norm = (x * x).sum(axis=1)
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(x)))

    @classmethod
    def kept(cls, x: np.ndarray, root) -> Tree:
        """The tree over `x` that was built before, from its nodes."""
        tree = cls.__new__(cls)
        tree.x, tree.norm, tree.root = x, (x * x).sum(axis=1), root
        return tree

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        at = spread_point(self.x, rows, self.rng)
        rest = rows[rows != at]
        d = distances(self.x[rest], self.x[at])
        radius = float(np.median(d))
        inner = d <= radius
        if inner.all():  # all at one distance: nothing to divide by
            return rows
        return at, radius, self._build(rest[inner]), self._build(rest[~inner])

    def search(self, q: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, relax: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers (-1: none) and distances of each query's k nearest in this tree, those within `bound` alone."""
        self.q, self.qn, self.own, self.ids, self.k, self.relax = q, (q * q).sum(axis=1), own, ids, k, relax
        self.best = np.full((len(q), k), np.inf) if bound is None else np.repeat(bound[:, None], k, axis=1)
        self.rows = np.full((len(q), k), -1, dtype=np.int64)
        self._visit(self.root, np.arange(len(q)))
        return self.rows, self.best

    def _offer(self, asks: np.ndarray, rows: np.ndarray) -> None:
        """Let pairs of a query and a row compete with what these queries hold; ties go to the smaller id."""
        other = self.ids[rows] != self.own[asks]
        asks, rows = asks[other], rows[other]
        if not len(asks):
            return
        who = np.unique(asks)
        query = np.concatenate((np.repeat(who, self.k), asks))
        d = np.concatenate((self.best[who].ravel(), paired(self.q[asks], self.x[rows])))
        names = np.concatenate((self.rows[who].ravel(), rows))
        order = np.lexsort((np.where(names >= 0, self.ids[names], np.iinfo(np.int64).max), d, query))
        first = np.searchsorted(query[order], who)[:, None] + np.arange(self.k)
        self.best[who], self.rows[who] = d[order][first], names[order][first]

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            if len(node):
                # a cheap bound first, then exact differences for the pairs that may enter
                # (of squares, whose rounding errors grow with the norms and dimensions)
                norms = self.qn[active][:, None] + self.norm[node][None, :]
                rough = norms - 2 * self.q[active] @ self.x[node].T
                near = rough <= self.best[active, -1][:, None] ** 2 * (1 + slack(self.x.shape[1], 1.0)) + slack(self.x.shape[1], norms)
                asks, rows = np.nonzero(near)
                self._offer(active[asks], node[rows])
            return
        at, radius, inner, outer = node
        d = exact(self.q[active], self.x[[at]])[:, 0]
        asks = active[d <= self.best[active, -1]]
        self._offer(asks, np.full(len(asks), at))
        inside = d <= radius
        self._visit(inner, active[inside])
        self._visit(outer, active[~inside])
        # the other side, where the ball of the k-th best still reaches over the border
        best = self.best[active, -1]
        reach = reaches(np.abs(d - radius), best, self.relax, slack(self.x.shape[1], d, radius))
        self._visit(outer, active[inside & reach])
        self._visit(inner, active[~inside & reach])


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b, summed in dimension order."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        diff = a[:, j][:, None] - b[:, j][None, :]
        total += diff * diff
    return np.sqrt(total)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to those of b at the same places, as `exact` sums them."""
    total = np.zeros(len(a))
    for column in (a - b).T:
        total += column * column
    return np.sqrt(total)


def usable(vec: Column) -> Column:
    """Not null or empty, all components finite numbers, not all zero."""
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & fine & F.exists(vec, lambda v: v != 0), F.lit(False))


def by_dimension(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, matrix) of a list column without nulls."""
    ends = column.offsets.to_numpy()
    values, size = column.values.to_numpy(zero_copy_only=False), np.diff(ends)
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        yield dim, rows, values[ends[rows][:, None] + np.arange(dim)]


class Router:
    """The upper tree of one dimension: numbers the leaves that vectors fall into."""

    def __init__(self, x: np.ndarray, share: float) -> None:
        """`share`: the part of the sample that may stay together in a leaf."""
        self.centres: list[np.ndarray] = []
        self.least, self.rng = max(ROUTE, int(share * len(x))), np.random.default_rng(7)
        self.root = self._build(x)
        self.centre = np.stack(self.centres)
        self.pivots = self.rng.permutation(x)[:PIVOTS]

    def _build(self, x: np.ndarray):
        if len(x) > self.least:
            point = x[spread_point(x, np.arange(len(x)), self.rng)]
            d = distances(x, point)
            inner = d <= (radius := float(np.median(d)))
            if not inner.all():
                return point, radius, self._build(x[inner]), self._build(x[~inner])
        self.centres.append(x.mean(axis=0))
        return len(self.centres) - 1

    def rings(self, leaf: int, x: np.ndarray) -> np.ndarray:
        """Distances of the rows of x, all in one leaf, to its centre and to the pivots."""
        return exact(x, np.concatenate((self.centre[leaf : leaf + 1], self.pivots)))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(x), dtype=np.int64), [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            if isinstance(node, int):
                out[rows] = node
                continue
            inner = distances(x[rows], node[0]) <= node[1]
            stack += [(node[2], rows[inner]), (node[3], rows[~inner])]
        return out


class Plan:
    """Leaves by dimension, with the shards they are divided into and the rings that hold them."""

    def __init__(self, sample: list[np.ndarray], total: int, shard: int) -> None:
        kinds: dict[int, list[np.ndarray]] = {}
        for v in sample:
            kinds.setdefault(len(v), []).append(v)
        self.shard, share = shard, shard / max(1, total)
        self.routers = {dim: Router(np.stack(rows), share * len(sample) / len(rows)) for dim, rows in kinds.items()}

    def router(self, dim: int) -> Router:
        """Dimensions that the sample lacks have one leaf."""
        if dim not in self.routers:
            self.routers[dim] = Router(np.zeros((1, dim)), 1.0)
        return self.routers[dim]

    def number(self, leaves: list[tuple[int, int, int, list[tuple[float, float]]]]) -> int:
        """Shard numbers for (dimension, leaf, vectors, rings) of all leaves; how many there are."""
        self.first: dict[int, np.ndarray] = {}
        self.subs: dict[int, np.ndarray] = {}
        self.low: dict[int, np.ndarray] = {}
        self.high: dict[int, np.ndarray] = {}
        total = 0
        for dim, leaf, n, rings in sorted(leaves):
            router = self.router(dim)
            if dim not in self.first:
                size, kinds = len(router.centre), 1 + len(router.pivots)
                self.first[dim], self.subs[dim] = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
                self.low[dim], self.high[dim] = np.zeros((size, kinds)), np.full((size, kinds), np.inf)
            self.first[dim][leaf], self.subs[dim][leaf] = total, max(1, -(-n // self.shard))
            self.low[dim][leaf], self.high[dim][leaf] = np.array(rings).T
            total += int(self.subs[dim][leaf])
        return total

    def part(self, dim: int, leaf: int, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Shards of vectors of one leaf; rows of the same id and vector meet."""
        first, subs = self.first[dim][leaf], self.subs[dim][leaf]
        if subs == 1:
            return np.full(len(x), first)
        odd = 2 * np.arange(dim, dtype=np.uint64) + np.uint64(1)
        bits = (np.ascontiguousarray(x).view(np.uint64) >> np.uint64(20)) * odd
        spread = mix(ids.astype(np.uint64) + bits.sum(axis=1, dtype=np.uint64))
        return first + (spread % np.uint64(subs)).astype(np.int64)

    def reached(self, dim: int, q: np.ndarray, bound: np.ndarray, relax: float) -> np.ndarray:
        """Queries by leaves: whether the leaf may hold something within the query's bound."""
        router, low, high = self.router(dim), self.low[dim], self.high[dim]
        kinds = np.concatenate((exact(q, router.centre)[:, :, None], np.broadcast_to(exact(q, router.pivots)[:, None, :], (len(q), len(low), len(router.pivots)))), axis=2)
        gap = np.maximum(0.0, np.maximum(kinds - high, low - kinds))
        margin = slack(dim, kinds, np.where(np.isinf(high), 0.0, high))
        return reaches(gap, bound[:, None, None], relax, margin).all(axis=2) & (self.subs[dim] > 0)

    def others(self, dim: int, q: np.ndarray, bound: np.ndarray, relax: float, home: int) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, queries) for each shard but the home that may hold something within the bounds."""
        reach = self.reached(dim, q, bound, relax)
        for leaf in np.flatnonzero(reach.any(axis=0)).tolist():
            asks = np.flatnonzero(reach[:, leaf])
            for part in range(int(self.first[dim][leaf]), int(self.first[dim][leaf] + self.subs[dim][leaf])):
                if part != home:
                    yield part, asks


_LEAVES = pa.schema([("dim", pa.int32()), ("leaf", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.binary()), ("vecs", pa.binary())])
_LEAVES_SQL = "dim int, leaf int, kind int, n long, low array<double>, high array<double>, ids binary, vecs binary"
_DEALT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("vecs", pa.binary()), ("more", pa.binary())])
_DEALT_SQL = "part int, kind int, dim int, ids binary, vecs binary, more binary"  # more: the tree of a shard, the bounds of queries
_FIRST = pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("shard_ids", pa.binary()), ("shard_vecs", pa.binary()), ("tree", pa.binary()), ("ids", pa.binary()), ("vecs", pa.binary()), ("bound", pa.binary()), ("hits", pa.binary()), ("scores", pa.binary())])
_FIRST_SQL = "part int, dim int, shard_ids binary, shard_vecs binary, tree binary, ids binary, vecs binary, bound binary, hits binary, scores binary"
_HITS_SQL = "query_id long, vec_id long, score double"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder, so that a later pass reads only the columns it needs."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def once(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In order of id; of rows that repeat an id and its vector one."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    if (ids[1:] != ids[:-1]).all():
        return ids, x
    seen, keep = set(), []
    for i, (own, v) in enumerate(zip(ids.tolist(), x, strict=True)):
        if (key := (own, v.tobytes())) not in seen:
            seen.add(key)
            keep.append(i)
    return ids[keep], x[keep]


def unpacked(rows: list[tuple[bytes, bytes]], dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids, x = (np.frombuffer(b"".join(r[k] for r in rows), dtype=kind) for k, kind in ((0, np.int64), (1, np.float64)))
    return once(ids, x.reshape(-1, dim))


def search(vectors: DataFrame, queries: Column, k: int = 10, relax: float = RELAX, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row for which `queries` holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("vec")))
    total = vectors.count()
    share = F.xxhash64("id", "vec", F.lit(3)).cast("double") / F.lit(2.0**64) + F.lit(0.5)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, _, x in by_dimension(b.column(0)):
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "vecs": pa.array([x.tobytes()], pa.binary())})

    fitted = rows.filter(share < min(1.0, FIT / max(1, total))).select("vec").limit(2 * FIT).mapInArrow(packed, "dim int, vecs binary").collect()
    plan = Plan([v for r in fitted for v in np.frombuffer(r["vecs"]).reshape(-1, r["dim"])], total, shard)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a batch by leaf, with the rings that hold them."""
        for b in batches:
            ids, asks, out = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), []
            for dim, at, x in by_dimension(b.column(1)):
                router = plan.router(dim)
                leaf = router.leaf(x)
                for one in np.unique(leaf).tolist():
                    here = np.flatnonzero(leaf == one)
                    own, v = once(ids[at[here]], x[here])
                    rings = router.rings(one, v)
                    out.append((dim, one, 0, len(own), rings.min(axis=0), rings.max(axis=0), own.tobytes(), v.tobytes()))
                    if (some := here[asks[at[here]]]).size:
                        own, v = once(ids[at[some]], x[some])
                        out.append((dim, one, 1, 0, None, None, own.tobytes(), v.tobytes()))
            if out:
                yield batch(out, _LEAVES)

    dealt = stored(rows.mapInArrow(deal, _LEAVES_SQL), "leaves")
    rings = dealt.filter("kind = 0").select("dim", "leaf", "n", F.posexplode(F.arrays_zip("low", "high")).alias("ring", "r"))
    found: dict[tuple[int, int], tuple[int, list[tuple[float, float]]]] = {}
    for r in rings.groupBy("dim", "leaf", "ring").agg(F.sum("n").alias("n"), F.min("r.low").alias("low"), F.max("r.high").alias("high")).orderBy("dim", "leaf", "ring").collect():
        found.setdefault((r["dim"], r["leaf"]), (r["n"], []))[1].append((r["low"], r["high"]))
    shards = max(1, plan.number([(*key, n, ring) for key, (n, ring) in found.items()]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of leaves by shard."""
        for b in batches:
            out = []
            for dim, leaf, kind, names, vecs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, x = np.frombuffer(names, dtype=np.int64), np.frombuffer(vecs).reshape(-1, dim)
                part = plan.part(dim, leaf, x, ids)
                out += [(one, kind, dim, ids[part == one].tobytes(), x[part == one].tobytes(), None) for one in np.unique(part).tolist()]
            if out:
                yield batch(out, _DEALT)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards with their trees, and each query's neighbours in its own shard."""
        at, held, asking = None, {}, {}

        def close():
            for dim, own in held.items():
                ids, x = unpacked(own, dim)
                tree = Tree(x)
                if shards > 1:
                    yield batch([(at, dim, ids.tobytes(), x.tobytes(), pickle.dumps(tree.root), None, None, None, None, None)], _FIRST)
                if dim not in asking:
                    continue
                q_ids, q = unpacked(asking[dim], dim)
                for i in range(0, len(q), BLOCK):
                    part, names = q[i : i + BLOCK], q_ids[i : i + BLOCK]
                    rows_of, d = tree.search(part, names, ids, k, relax)
                    hits = np.where(rows_of >= 0, ids[rows_of], 0)
                    yield batch([(at, dim, None, None, None, names.tobytes(), part.tobytes(), d[:, -1].tobytes(), hits.tobytes(), d.tobytes())], _FIRST)

        for b in batches:
            for part, kind, dim, ids, vecs, _ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != at:
                    yield from close()
                    at, held, asking = part, {}, {}
                (asking if kind else held).setdefault(dim, []).append((ids, vecs))
        yield from close()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to the other shards within their bounds."""
        for b in batches:
            for at, dim, ids, vecs, bound in zip(*(c.to_pylist() for c in b.columns), strict=True):
                names, q, most = np.frombuffer(ids, dtype=np.int64), np.frombuffer(vecs).reshape(-1, dim), np.frombuffer(bound)
                for part, asks in plan.others(dim, q, most, relax, at):
                    yield batch([(part, 1, dim, names[asks].tobytes(), q[asks].tobytes(), most[asks].tobytes())], _DEALT)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, trees, waiting, size = None, {}, {}, 0

        def close():
            """Ask for the queries that wait, together."""
            for dim, asks in waiting.items():
                if dim not in trees:
                    continue
                (own, tree), names = trees[dim], np.concatenate([a[0] for a in asks])
                rows_of, d = tree.search(np.concatenate([a[1] for a in asks]), names, own, k, relax, np.concatenate([a[2] for a in asks]))
                some = rows_of >= 0
                yield pa.RecordBatch.from_pydict({"query_id": np.broadcast_to(names[:, None], rows_of.shape)[some], "vec_id": own[rows_of[some]], "score": d[some]})

        for b in batches:
            for part, kind, dim, ids, vecs, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part != at or size >= BLOCK:
                    yield from close()
                    waiting, size = {}, 0
                    at, trees = part, trees if part == at else {}
                names, x = np.frombuffer(ids, dtype=np.int64), np.frombuffer(vecs).reshape(-1, dim)
                if kind == 0:
                    trees[dim] = names, Tree.kept(x, pickle.loads(more))
                else:
                    waiting.setdefault(dim, []).append((names, x, np.frombuffer(more)))
                    size += len(names)
        yield from close()

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, hits, scores in zip(*(c.to_pylist() for c in b.columns), strict=True):
                names, d = np.frombuffer(ids, dtype=np.int64), np.frombuffer(scores).reshape(-1, k)
                some = np.isfinite(d)
                yield pa.RecordBatch.from_pydict({"query_id": np.broadcast_to(names[:, None], d.shape)[some], "vec_id": np.frombuffer(hits, dtype=np.int64).reshape(-1, k)[some], "score": d[some]})

    together = lambda df: df.repartitionById(shards, F.col("part")).sortWithinPartitions("part", "kind")
    parted = dealt.select("dim", "leaf", "kind", "ids", "vecs").mapInArrow(split, _DEALT_SQL)
    first = stored(together(parted).mapInArrow(home, _FIRST_SQL), "shards")
    asked = first.filter("ids IS NOT NULL")
    near = asked.select("ids", "hits", "scores").mapInArrow(told, _HITS_SQL)
    if shards > 1:
        kept = first.filter("tree IS NOT NULL").select("part", F.lit(0).alias("kind"), "dim", F.col("shard_ids").alias("ids"), F.col("shard_vecs").alias("vecs"), F.col("tree").alias("more"))
        sent = asked.select("part", "dim", "ids", "vecs", "bound").mapInArrow(send, _DEALT_SQL)
        near = near.unionByName(together(kept.unionByName(sent)).mapInArrow(visit, _HITS_SQL))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
