"""N-gram Jaccard join by signature trees.

A document is the set of its distinct 5-word shingles (64-bit hashes of the words, A-Z
lower-cased); two link when 9 * overlap >= 4 * (size + size), that is at a Jaccard
similarity of 0.8.  The result has a row per document with its set size, its number of
links' component and nothing per pair.

1. Equal sets collapse into one class, named by a 64-bit digest of the set.  A second digest
   travels along; where it shows that two sets share a name, these get other names and the
   pass is repeated, so classes are told apart by 128 bits.
2. A link needs a common shingle among the first size - ceil(0.8 size) + 1 of both sets in
   any order that all share.  The order puts shingles whose hash cell is crowded last: a
   sketch of CELLS counters over all shingles of all documents, of fixed size, tells which.
   Order decides cost alone, never the result.
3. Within a shingle's list of classes, the smallest digest is its anchor; every class joins
   the groups of its anchors.  Two classes that share a prefix shingle share its anchor's
   group, and a list adds one row per member, not one per pair.  Groups are dealt into parts
   of GROUP members.
4. Each part is a signature tree: leaves hold bitmaps of two bits or more a shingle, nodes
   the OR of their members' bitmaps, their size range and their largest number of shingles
   beyond one per bit.  A dual traversal drops node pairs whose largest possible overlap is
   too small.  A first pass over bitmaps alone finds the members that have any possible
   partner; only their sets are fetched, and a second pass over the trees intersects them,
   leaving out node pairs whose members are already connected.
5. Parts of one group then meet.  A few heads of each component that a part found go through
   trees of their own, in levels of a part's size; that connects groups of near copies, with
   rows in proportion to the parts.  Members that are in another component than most of
   their group even so, and only they, meet every other part in a dual traversal of both
   trees.  All pairs whose members are not connected have then been compared.
6. Links become components by alternating large-star and small-star rounds.  A node that
   holds more than a HUBS-th of all edges is dealt over SALTS tasks; there are fewer than
   HUBS of those.

Defined cases: null, empty and blank texts have size 0 and link with nothing; with fewer
than five words the whole sequence is one shingle; a very long text is hashed in pieces;
repeated rows are copies; rows that share an id are one document, with the links of all; a
null doc_id keeps its row, with a null component; an empty table gives no rows; further
columns are ignored by `join` and kept by `keep`.  Shingles are compared by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHasher, chunks, cut, fresh, joined, mix

WIDTH = 5
CELL_BITS = 20
BLOCKS = 64  # the sketch travels in so many pieces
LEAF = 24
FAN = 4
GROUP = 512
HEADS = 4  # of a component, where parts of a group meet
FAN_OUT = 16  # links of a document to a task's other documents, but one
FILTER_BITS = 23
HELD = 1 << 20  # postings of a bucket and pairs of a home, about; what a task keeps at once
HUBS, SALTS, LEAST_HUB = 2000, 64, 256
_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


# ---------------------------------------------------------------- shingles


class Shingler:
    """Shingle hashes of whole texts."""

    def __init__(self) -> None:
        self.words = WordHasher()

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """For each text its shingles in order, repeats included."""
        for lo, hi in chunks(texts):
            b, offsets = joined(texts[lo:hi])
            w, starts = self.words(b)
            cuts = np.searchsorted(starts, offsets)
            run = np.zeros(max(0, len(w) - WIDTH + 1), dtype=np.uint64)
            for k in range(WIDTH):
                run += w[k : k + len(run)] * _FACTORS[k]
            run = mix(run)
            for i in range(hi - lo):
                a, e = int(cuts[i]), int(cuts[i + 1])
                if e - a >= WIDTH:
                    yield run[a : e - WIDTH + 1]
                elif e > a:
                    short = np.full(1, (e - a) * 0x2545F4914F6CDD1D & (1 << 64) - 1, dtype=np.uint64)
                    yield mix((w[a:e] * np.array(_FACTORS[: e - a])).sum() + short)
                else:
                    yield run[:0]


@dataclass(frozen=True)
class Namer:
    """Names of sets of hashes: a digest, and a second one that checks it, as signed 64-bit numbers."""

    shared: frozenset[int] = frozenset()  # names that two sets were found to share
    bits: int = 64  # of the first digest; fewer in tests

    def __call__(self, u: np.ndarray) -> tuple[int, int]:
        n = np.uint64(len(u))
        both = mix(np.array([mix(u.copy()).sum() + n, mix(u * _FACTORS[2] + _FACTORS[3]).sum() + n], dtype=np.uint64))
        first, check = both.view(np.int64).tolist()
        name, more = first >> (64 - self.bits), 0
        while name in self.shared:
            more += 1
            name = int(mix(both[:1] + both[1:] * np.uint64(2 * more + 1)).view(np.int64)[0])
        return name, check


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def pack5(x: np.ndarray) -> bytes:
    """The upper 40 bits of each hash; keeps their order."""
    return np.ascontiguousarray((x >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def unpack5(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 5)
    return out.view(np.uint64).reshape(-1)


def bitmap(u: np.ndarray) -> np.ndarray:
    """A bitmap over the upper 40 bits of the hashes, a power of two of 64-bit words, at least two bits a hash."""
    words = 1 << max(0, (len(u) - 1) // 32).bit_length()
    spot = (((u & np.uint64(0xFFFFFFFFFF000000)) * _FACTORS[1]) >> np.uint64(32)).astype(np.int64) & (64 * words - 1)
    return np.packbits(np.bincount(spot, minlength=64 * words).astype(bool), bitorder="little").view(np.uint64)


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def crowding(docs: DataFrame) -> tuple[np.ndarray, int]:
    """log2 of the number of shingles in each of 2 ** CELL_BITS cells, over all documents, and their sum."""
    each = (1 << CELL_BITS) // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, cells = Shingler(), np.zeros(1 << CELL_BITS, dtype=np.uint32)
        for batch in batches:
            for h in shingle(_texts(batch, 0)):
                np.add.at(cells, (h >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
        if cells.any():
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(BLOCKS), pa.int32()), "cells": [cells[i * each : (i + 1) * each].tobytes() for i in range(BLOCKS)]})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums.setdefault(block, np.zeros(each, dtype=np.uint64))[:] += np.frombuffer(cells.as_buffer(), dtype=np.uint32)
        for block, cells in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "cells": [np.log2(1 + cells).astype(np.uint8).tobytes()], "n": [int(cells.sum())]})

    out, n = np.zeros(1 << CELL_BITS, dtype=np.uint8), 0
    schema = "block int, cells binary"
    for r in docs.select("text").mapInArrow(count, schema).repartition(BLOCKS, "block").mapInArrow(total, f"{schema}, n long").collect():
        out[r["block"] * each : (r["block"] + 1) * each] = np.frombuffer(r["cells"], dtype=np.uint8)
        n += r["n"]
    return out, n


# ---------------------------------------------------------------- candidates

_POSTS = "bucket int, doc_id long, n long, cid long, check long, bits binary, tokens binary, cids binary"
_MET = "doc_id long, n long, cid long, check long, bits binary, home int, anchors binary, members binary"


def postings(docs: DataFrame, crowd: np.ndarray, buckets: int, namer: Namer) -> DataFrame:
    """A row per document, and packed prefix postings, a row per bucket and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(), set()
        schema = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("check", pa.int64()), ("bits", pa.binary()), ("tokens", pa.binary()), ("cids", pa.binary())])
        for batch in batches:
            ids, sizes, cids, checks, bits, tokens, owners = batch.column(0), [], [], [], [], [], []
            if len(seen) > HELD // 4:
                seen.clear()
            for h in shingle(_texts(batch, 1)):
                u = np.unique(h)
                sizes.append(len(u))
                if not len(u):
                    cids.append(None)
                    checks.append(None)
                    bits.append(None)
                    continue
                name, check = namer(u)
                cids.append(name)
                checks.append(check)
                bits.append(bitmap(u).tobytes())
                if name not in seen:
                    seen.add(name)
                    by_crowd = np.argsort(crowd[(u >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")
                    first = u[by_crowd[: prefix_size(len(u))]]
                    tokens.append(first)
                    owners.append(np.full(len(first), name, dtype=np.int64))
            n = len(sizes)
            if not n:
                continue
            home = [((c or 0) + i) % buckets for i, c in enumerate(cids)]  # copies need not meet
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), ids.cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(cids, pa.int64()), pa.array(checks, pa.int64()), pa.array(bits, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=schema)
            if tokens:
                t, c = np.concatenate(tokens), np.concatenate(owners)
                where = ((t & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                t, c, where = t[order], c[order], where[order]
                used = np.unique(where)
                edges = np.concatenate((np.searchsorted(where, used), [len(where)]))
                parts = list(zip(edges[:-1], edges[1:], strict=True))
                null = pa.nulls(len(used), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), null, null, null, null, pa.nulls(len(used), pa.binary()), pa.array([pack5(t[a:e]) for a, e in parts], pa.binary()), pa.array([c[a:e].tobytes() for a, e in parts], pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, _POSTS)


def unique_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def stars(tokens: list[bytes], cids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, member) of all classes that share a token, from one bucket's postings."""
    t, c = unpack5(b"".join(tokens)), np.frombuffer(b"".join(cids), dtype=np.int64)
    order = np.lexsort((c, t))
    t, c = t[order], c[order]
    first = np.ones(len(t), dtype=bool)
    first[1:] = t[1:] != t[:-1]
    anchor = c[np.flatnonzero(first)[np.cumsum(first) - 1]]
    other = c != anchor
    return unique_pairs(anchor[other], c[other])


def meet(posts: DataFrame, partitions: int, homes: int) -> DataFrame:
    """The document rows, and (anchor, member) pairs of classes that share a prefix shingle, packed by the anchor's home.

    A task holds the postings of one bucket and at most about HELD pairs.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("check", pa.int64()), ("bits", pa.binary()), ("home", pa.int32()), ("anchors", pa.binary()), ("members", pa.binary())])

    def packed(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        a, b = unique_pairs(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
        if not len(a):
            return
        # what other tasks find of the same anchor meets at its home
        home = (mix(a.view(np.uint64).copy()) % np.uint64(homes)).astype(np.int32)
        order = np.argsort(home, kind="stable")
        a, b, home = a[order], b[order], home[order]
        used = np.unique(home)
        parts = list(zip(np.searchsorted(home, used), np.append(np.searchsorted(home, used[1:]), len(home)), strict=True))
        null, none = pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary())
        pack = lambda x: pa.array([x[i:e].tobytes() for i, e in parts], pa.binary())
        yield pa.RecordBatch.from_arrays([null, null, null, null, none, pa.array(used), pack(a), pack(b)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tokens, cids, found = None, [], [], []
        for batch in batches:
            post = batch.column(6).is_valid()
            rows = batch.filter(pa.compute.invert(post))
            if rows.num_rows:
                null = pa.nulls(rows.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in range(1, 6)), pa.nulls(rows.num_rows, pa.int32()), null, null], schema=schema)
            rows = batch.filter(post)
            for bucket, t, c in zip(rows.column(0).to_pylist(), rows.column(6).to_pylist(), rows.column(7).to_pylist(), strict=True):
                if bucket != at and tokens:
                    found.append(stars(tokens, cids))
                    tokens, cids = [], []
                    if sum(len(x[0]) for x in found) > HELD:
                        yield from packed(found)
                        found = []
                at = bucket
                tokens.append(t)
                cids.append(c)
        if tokens:
            found.append(stars(tokens, cids))
        if found:
            yield from packed(found)

    return posts.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _MET)


def distinct_pairs(met: DataFrame, partitions: int, group: int) -> DataFrame:
    """(anchor, part, parts, cid): each pair that the tasks of `meet` found once, and each anchor with itself.

    An anchor's members are dealt into even parts of at most `group`; a task holds one home at a time.
    """

    def dealt(anchors: list[bytes], members: list[bytes]) -> Iterator[pa.RecordBatch]:
        a, b = (np.frombuffer(b"".join(x), dtype=np.int64) for x in (anchors, members))
        own = np.unique(a)
        a, b = unique_pairs(np.concatenate((a, own)), np.concatenate((b, own)))
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        size = np.diff(np.append(first, len(a)))
        nth, parts = np.arange(len(a)) - np.repeat(first, size), np.repeat(-(-size // group), size)
        columns = {"anchor": a, "part": (nth % parts).astype(np.int32), "parts": parts.astype(np.int32), "cid": b}
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_pydict({k: x[i : i + (1 << 16)] for k, x in columns.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchors, members = None, [], []
        for batch in batches:
            for home, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if home != at and anchors:
                    yield from dealt(anchors, members)
                    anchors, members = [], []
                at = home
                anchors.append(a)
                members.append(b)
        if anchors:
            yield from dealt(anchors, members)

    packed = met.filter("anchors IS NOT NULL").select("home", "anchors", "members").repartition(partitions, "home").sortWithinPartitions("home")
    return packed.mapInArrow(run, "anchor long, part int, parts int, cid long")


def filter_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over hashes of the ids; it may admit others, never lose one."""
    each = (1 << FILTER_BITS) // BLOCKS
    bit = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - FILTER_BITS)
    rows = ids.select(F.floor(bit / each).cast("int").alias("block"), (bit % each).cast("int").alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for b in np.unique(block):
                bits.setdefault(int(b), np.zeros(each, dtype=bool))[bit[block == b]] = True
        for b, own in bits.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "cells": [np.packbits(own).tobytes()]})

    out = np.zeros(1 << FILTER_BITS, dtype=bool)
    for r in rows.repartition(BLOCKS, "block").mapInArrow(run, "block int, cells binary").collect():
        out[r["block"] * each : (r["block"] + 1) * each] |= np.unpackbits(np.frombuffer(r["cells"], dtype=np.uint8)).astype(bool)
    return np.packbits(out)


def sets_of(docs: DataFrame, admitted: np.ndarray, namer: Namer) -> DataFrame:
    """doc_id, cid, members: the sets of the documents that the filter admits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        for batch in batches:
            bit = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)
            keep = np.flatnonzero(admitted[(bit >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8) & 1)
            if not len(keep):
                continue
            some = batch.take(pa.array(keep))
            doc, cid, members = [], [], []
            for i, h in zip(some.column(1).to_pylist(), shingle(_texts(some, 2)), strict=True):
                u = np.unique(h)
                if len(u):
                    doc.append(i)
                    cid.append(namer(u)[0])
                    members.append(u.tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "cid": pa.array(cid, pa.int64()), "members": pa.array(members, pa.binary())})

    return docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull()).mapInArrow(run, "doc_id long, cid long, members binary")


# ---------------------------------------------------------------- signature trees


class Node:
    __slots__ = ("bits", "least", "most", "excess", "kids", "rows", "each", "beyond")

    def __init__(self, rows, size, each, beyond, kids=None):
        self.rows, self.each, self.beyond, self.kids = rows, each, beyond, kids
        self.least, self.most = int(size.min()), int(size.max())
        if kids is None:
            self.bits, self.excess = np.bitwise_or.reduce(each, axis=0), int(beyond.max())
        else:
            self.bits, self.excess = np.bitwise_or.reduce([k.bits for k in kids], axis=0), max(k.excess for k in kids)


class Forest:
    """One group's bitmaps and sizes, its sets if they are there, and what is known of its members.

    Without sets, members with a possible partner are flagged; with sets, members that link
    are connected.
    """

    def __init__(self, sizes: list[int], bits: list[np.ndarray], sets: list[np.ndarray] | None = None) -> None:
        self.size, self.bits, self.sets = np.asarray(sizes), bits, sets
        self.words = np.array([len(b) for b in bits])
        self.root = np.arange(len(bits))
        self.flag = np.zeros(len(bits), dtype=bool)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def tree(self, rows: np.ndarray, words: int) -> Node:
        """Over rows whose bitmaps have `words` words, or twice as many and are folded."""
        rows = rows[np.argsort(self.size[rows], kind="stable")]
        each = np.stack([b if len(b) == words else b[:words] | b[words:] for b in (self.bits[r] for r in rows)])
        beyond = self.size[rows] - np.bitwise_count(each).sum(axis=1, dtype=np.int64)
        cut_at = range(0, len(rows), LEAF)
        level = [Node(rows[i : i + LEAF], self.size[rows[i : i + LEAF]], each[i : i + LEAF], beyond[i : i + LEAF]) for i in cut_at]
        while len(level) > 1:
            level = [self._over(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        return level[0]

    def _over(self, kids: list[Node]) -> Node:
        rows = np.concatenate([k.rows for k in kids])
        return Node(rows, self.size[rows], None, None, kids)

    def within(self, rows: np.ndarray) -> None:
        """All pairs of rows. Sizes of a link differ by a quarter at most, and so widths by a factor of two."""
        for w in np.unique(self.words[rows]).tolist():
            own = rows[self.words[rows] == w]
            tree = self.tree(own, w)
            if len(own) > 1:
                self.join(tree, tree)
            wider = rows[(self.words[rows] == 2 * w) & (4 * self.size[rows] <= 5 * self.size[own].max())]
            if len(wider):
                self.join(tree, self.tree(wider, w))

    def between(self, left: np.ndarray, right: np.ndarray) -> None:
        for w in np.unique(self.words[left]).tolist():
            own = left[self.words[left] == w]
            for other, at in ((w, w), (2 * w, w), (w // 2, w // 2)):
                theirs = right[self.words[right] == other]
                if at and len(theirs):
                    self.join(self.tree(own, at), self.tree(theirs, at))

    def settled(self, a: Node, b: Node) -> bool:
        """Whether no pair of these nodes can tell anything new."""
        if self.sets is None:
            return bool(self.flag[a.rows].all() and self.flag[b.rows].all())
        first = self.find(int(a.rows[0]))
        return all(self.find(int(r)) == first for r in b.rows) and all(self.find(int(r)) == first for r in a.rows)

    def join(self, a: Node, b: Node) -> None:
        """Dual traversal of two trees, or of a tree with itself."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            if 5 * a.most < 4 * b.least or 5 * b.most < 4 * a.least:
                continue
            if a is not b:
                shared = int(np.bitwise_count(a.bits & b.bits).sum(dtype=np.int64)) + min(a.excess, b.excess)
                if 9 * min(a.most, b.most, shared) < 4 * (a.least + b.least):
                    continue
            if self.settled(a, b):
                continue
            if a.kids is None and b.kids is None:
                self._leaves(a, b)
            elif a is b:
                stack += [(a.kids[i], a.kids[j]) for i in range(len(a.kids)) for j in range(i, len(a.kids))]
            elif b.kids is None or (a.kids is not None and len(a.rows) >= len(b.rows)):
                stack += [(k, b) for k in a.kids]
            else:
                stack += [(a, k) for k in b.kids]

    def _leaves(self, a: Node, b: Node) -> None:
        if a is b:
            i, j = np.triu_indices(len(a.rows), 1)
        else:
            i, j = (x.ravel() for x in np.indices((len(a.rows), len(b.rows))))
        m, n = self.size[a.rows[i]], self.size[b.rows[j]]
        near = (4 * m <= 5 * n) & (4 * n <= 5 * m)
        i, j, m, n = i[near], j[near], m[near], n[near]
        shared = np.bitwise_count(a.each[i] & b.each[j]).sum(axis=1, dtype=np.int64) + np.minimum(a.beyond[i], b.beyond[j])
        able = 9 * np.minimum(np.minimum(m, n), shared) >= 4 * (m + n)
        i, j = a.rows[i[able]], b.rows[j[able]]
        if self.sets is None:
            self.flag[i] = True
            self.flag[j] = True
            return
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if (p := self.find(x)) != (q := self.find(y)) and self.linked(x, y):
                self.root[max(p, q)] = min(p, q)

    def linked(self, x: int, y: int) -> bool:
        s, t = self.sets[x], self.sets[y]
        if len(s) > len(t):
            s, t = t, s
        at = np.searchsorted(t, s)
        at[at == len(t)] = 0
        return 9 * int((t[at] == s).sum()) >= 4 * (len(s) + len(t))


# ---------------------------------------------------------------- tasks

#: A task is all rows of one (anchor, i, j).  With j below 0 they meet one another, and with
#: j PART heads are left for other parts; else those of side 0 meet those of side 1.  Rows of
#: one component are connected beforehand.
KEY = ("anchor", "i", "j")
WHOLE, PART = -1, -2
_ABLE = pa.schema([("anchor", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("cid", pa.int64()), ("comp", pa.int64())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("anchor", pa.int64()), ("cid", pa.int64()), ("comp", pa.int64()), ("rep", pa.int64()), ("members", pa.binary())])


def _by_task(solve, schema: pa.Schema):
    """Runs of rows that share (anchor, i, j) go to `solve`, whose columns are returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], [[] for _ in schema]

        def close():
            if len(rows) > 1:
                for column, values in zip(out, solve(at, rows), strict=True):
                    column.extend(values)
            rows.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(batch.num_columns)]
            for row in zip(*columns, strict=True):
                if row[:3] != at:
                    close()
                    at = row[:3]
                rows.append(row[3:])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                out = [[] for _ in schema]
        close()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _traverse(forest: Forest, at: tuple, sides: list[int]) -> None:
    if at[2] < 0:
        forest.within(np.arange(len(sides)))
    else:
        side = np.asarray(sides)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(left) and len(right):
            forest.between(left, right)


def possible(tasks: DataFrame) -> DataFrame:
    """The rows of (anchor, i, j, side, cid, comp, n, bits) that may link with another of their task, without n and bits."""

    def solve(at: tuple, rows: list[tuple]) -> list[list]:
        forest = Forest([r[3] for r in rows], [np.frombuffer(r[4], dtype=np.uint64) for r in rows])
        _traverse(forest, at, [r[0] for r in rows])
        kept = [rows[k] for k in np.flatnonzero(forest.flag).tolist()]
        return [*([x] * len(kept) for x in at), *([r[c] for r in kept] for c in range(3))]

    return tasks.mapInArrow(_by_task(solve, _ABLE), "anchor long, i int, j int, side int, cid long, comp long")


def links(tasks: DataFrame) -> DataFrame:
    """What each task of (anchor, i, j, side, cid, comp, rep, members) connects.

    Rows (a, b) are links between representatives, as trees of FAN_OUT, so that no document
    gets many from a task.  Rows with an anchor are the heads of a part's components.
    """

    def solve(at: tuple, rows: list[tuple]) -> list[list]:
        sets = [np.frombuffer(r[4], dtype=np.uint64) for r in rows]
        forest, known = Forest([len(s) for s in sets], [bitmap(s) for s in sets], sets), {}
        for k, r in enumerate(rows):
            if r[2] is not None:
                forest.root[k] = known.setdefault(r[2], k)
        _traverse(forest, at, [r[0] for r in rows])
        found: dict[int, dict] = {}  # root -> component known before, or row -> rows
        for k, r in enumerate(rows):
            found.setdefault(forest.find(k), {}).setdefault(k if r[2] is None else ("of", r[2]), []).append(k)
        out = []
        for parts in found.values():
            reps = [rows[own[0]][3] for own in parts.values()]
            out += [(reps[(n - 1) // FAN_OUT], reps[n], None, None, None, None, None) for n in range(1, len(reps))]
            if at[2] == PART:
                own = [k for some in parts.values() for k in some]
                for k in sorted({own[n * (len(own) - 1) // max(1, HEADS - 1)] for n in range(HEADS)}):
                    out.append((None, None, at[0], rows[k][1], reps[0], rows[k][3], rows[k][4]))
        return list(zip(*out, strict=True)) if out else [[] for _ in _FOUND]

    return tasks.mapInArrow(_by_task(solve, _FOUND), "a long, b long, anchor long, cid long, comp long, rep long, members binary")


# ---------------------------------------------------------------- components


def attach(rows: DataFrame, key: str, spread: str, table: DataFrame, of: str, hubs: list[int]) -> DataFrame:
    """rows left-joined with `table` on key = of, one table row a key; rows of the hubs are dealt over SALTS tasks by `spread`."""
    if not hubs:
        return rows.join(table, F.col(key) == F.col(of), "left")
    salt, salt_of = fresh([*rows.columns, *table.columns], "salt", "salt_of")
    salted = rows.withColumn(salt, F.when(F.col(key).isin(hubs), F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    every = F.when(F.col(of).isin(hubs), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(table.withColumn(salt_of, F.explode(every)), (F.col(key) == F.col(of)) & (F.col(salt) == F.col(salt_of)), "left").drop(salt, salt_of)


def hubs_of(counted: DataFrame, key: str, n: str, total: int) -> list[int]:
    """Keys with more than a HUBS-th of all rows; fewer than HUBS by their definition."""
    return [r[0] for r in counted.filter(F.col(n) > hub_size(total)).select(key).collect()]


def hub_size(total: int) -> int:
    return max(LEAST_HUB, total // HUBS)


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node of its component, by alternating stars; nodes without edges are left out."""

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), "m")

    def settled(e: DataFrame) -> bool:
        """Whether every node has one smaller neighbour at most, and that one none: then it is the least of the component."""
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up + down > 1").isEmpty()

    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    total, hubs = e.count(), set()
    while not settled(e):
        if total > LEAST_HUB:
            # a node has no more smaller neighbours than it had larger ones, so no u is a hub before a v is
            hubs |= set(hubs_of(e.groupBy("v").count(), "v", "count", total))
        # large star: larger neighbours of v go to the least about v; small star: smaller ones of u, and u, to the least
        large = attach(e, "v", "u", least(e), "of", sorted(hubs)).select("u", F.coalesce("m", "v").alias("v"))
        low = least(large)
        small = attach(large, "u", "v", low, "of", sorted(hubs)).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select(F.col("of").alias("u"), F.col("m").alias("v"))).filter("u != v").distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))


# ---------------------------------------------------------------- the join


class Linker:
    """Classes of one table and the tasks that link them."""

    def __init__(self, docs: DataFrame, namer: Namer, classes: DataFrame, partitions: int, group: int) -> None:
        self.docs, self.namer, self.classes, self.partitions, self.group = docs, namer, classes, partitions, group

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.partitions, *KEY).sortWithinPartitions(*KEY)

    def solve(self, tasks: DataFrame) -> DataFrame:
        """What tasks of (anchor, i, j, side, cid, comp) find, as `links` says it."""
        signed = self.classes.select("cid", "n", "bits")
        able = cut(possible(self.dealt(tasks.join(signed, "cid").select(*KEY, "side", "cid", "comp", "n", "bits"))))
        involved = cut(able.select("cid").distinct().join(self.classes.select("cid", "rep"), "cid"))
        sets = sets_of(self.docs, filter_of(involved.select(F.col("rep").alias("doc_id"))), self.namer)
        sets = sets.join(involved, "cid").filter("doc_id = rep").select("cid", "rep", "members").dropDuplicates(["cid"])
        return cut(links(self.dealt(able.join(sets, "cid").select(*KEY, "side", "cid", "comp", "rep", "members"))))

    def within(self, pairs: DataFrame) -> DataFrame:
        kind = F.when(F.col("parts") > 1, F.lit(PART)).otherwise(F.lit(WHOLE))
        return self.solve(pairs.select("anchor", F.col("part").alias("i"), kind.alias("j"), F.lit(0).alias("side"), "cid", F.lit(None).cast("long").alias("comp")))

    def meeting(self, found: DataFrame) -> DataFrame:
        """The links among the heads in `found`, level by level as long as these grow fewer."""
        heads, out = found.filter("anchor IS NOT NULL"), found.filter("b IS NOT NULL").select("a", "b")
        n = heads.count()
        while n:
            sizes = heads.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / F.lit(HEADS * self.group)).cast("int").alias("parts"))
            kind = F.when(F.col("parts") > 1, F.lit(PART)).otherwise(F.lit(WHOLE))
            tasks = heads.join(sizes, "anchor").select("anchor", F.pmod(F.xxhash64("comp"), F.col("parts")).cast("int").alias("i"), kind.alias("j"), F.lit(0).alias("side"), "cid", "comp", "rep", "members")
            found = cut(links(self.dealt(tasks)))
            out, heads = out.unionByName(found.filter("b IS NOT NULL").select("a", "b")), found.filter("anchor IS NOT NULL")
            before, n = n, heads.count()
            if n > before // 2:
                break
        return out

    def across(self, big: DataFrame, labels: DataFrame) -> DataFrame | None:
        """The links that members outside the largest component of their group have in other parts."""
        known = big.join(self.classes.select("cid", "rep"), "cid").join(labels, F.col("rep") == F.col("node"), "left")
        rows = cut(known.select("anchor", "part", "parts", "cid", F.coalesce("component", "rep").alias("comp")))
        sizes = rows.groupBy("anchor", "comp").agg(F.count(F.lit(1)).alias("n"))
        tops = sizes.groupBy("anchor").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), (F.sum("n") - F.max("n")).alias("others")).filter("comps > 1")
        chunks_of = F.ceil(F.col("others") / F.lit(self.group)).cast("int")
        left_open = cut(rows.join(tops.select("anchor", "top", chunks_of.alias("chunks")), "anchor"))
        if left_open.isEmpty():
            return None
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = left_open.select("anchor", F.col("part").alias("i"), every("chunks").alias("j"), F.lit(0).alias("side"), "cid", "comp")
        right = left_open.filter("comp != top").withColumn("i", every("parts")).filter("i != part")
        right = right.select("anchor", "i", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int").alias("j"), F.lit(1).alias("side"), "cid", "comp")
        return self.solve(left.unionByName(right)).filter("b IS NOT NULL").select("a", "b")


def join(docs: DataFrame, group: int = GROUP, name_bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of `docs`."""
    spark: SparkSession = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    crowd, total = crowding(docs)
    # a fifth of the shingles are prefix postings; what one bucket or home holds is bounded
    buckets = max(4 * partitions, total // (5 * HELD))
    shared: frozenset[int] = frozenset()
    while True:
        namer = Namer(shared, name_bits)
        met = cut(meet(postings(docs, crowd, buckets, namer), partitions, buckets))
        rows = met.filter("anchors IS NULL").select("doc_id", "n", "cid", "check", "bits")
        one = rows.filter("cid IS NOT NULL AND doc_id IS NOT NULL").groupBy("cid")
        classes = cut(one.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("check").alias("low"), F.max("check").alias("high")))
        clash = {r["cid"] for r in classes.filter("low != high").select("cid").collect()}
        if not clash:
            break
        shared |= clash
    pairs = cut(distinct_pairs(met, partitions, group))
    linker = Linker(docs, namer, classes, partitions, group)
    found = linker.within(pairs)
    labels = components(linker.meeting(found))
    big = pairs.filter("parts > 1")
    if not big.isEmpty() and (more := linker.across(big, labels)) is not None and not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    best = classes.join(labels, F.col("rep") == F.col("node"), "left").select(F.col("cid").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    n_rows, most = classes.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    hubs = hubs_of(classes, "cid", "copies", n_rows) if most > hub_size(n_rows) else []
    out = attach(rows.select("doc_id", "n", "cid"), "cid", "doc_id", best, "of", hubs)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the smallest id; all columns. Rows with a null id stay.

    Of rows that share an id, that with the least (hash of the text, text) stays.
    """
    gone, nth = fresh(docs.columns, "gone", "nth")
    found = join(docs)
    lost = found.filter("doc_id IS NOT NULL AND component_id != doc_id").select(F.col("doc_id").alias(gone)).distinct()
    left = docs.join(lost, F.col("doc_id").cast("long") == F.col(gone), "left_anti").filter(F.col("doc_id").isNotNull())
    first = left.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))).filter(F.col(nth) == 1).drop(nth)
    return first.unionByName(docs.filter(F.col("doc_id").isNull()))
