"""Training-order materialisation: a keyed permutation gives every sequence its global slot.

Documents of tokens are cut into sequences of at most `seq_len` tokens.  Sequences are
numbered 0 .. N-1 in the order (bucket of id and tokens, id, hash of the tokens, place in
the document), so the numbering depends on the data alone.  A Feistel network over the smallest
even-width binary domain that holds N, walked until it lands below N, maps the number to a
slot; it is a bijection, so slots are exactly 0 .. N-1 and no two workers need to agree on
anything but the key.  Slots are dealt by range: shard s holds slots s * per_shard and on,
each as one record of fixed stride, so record r of a shard starts at r * stride, and a
reader resumes at any slot by arithmetic.

Tokens travel once by document, to number them, and once by shard.  Bucket totals (BUCKETS
numbers, or one for each BUCKET_TOKENS tokens where these are more: 1.5 million at 100 TB) are
the only thing that the driver sees; documents without an id, or that share
one, spread over buckets by their tokens.

Tokens are bytes (a binary column, ids 0 to 255) or ids of a tokenizer (an array of int, as
`pieces.encode` returns them, with a layout that names its end and padding).

Defined cases: null and empty token strings make one sequence with the end token alone;
repeated rows are sequences of their own; null ids sort first and are marked in the record;
an empty table gives no rows; further columns are ignored, whatever their names; very long
documents make many sequences.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix

BUCKETS = 1 << 15  # at least
BUCKET_TOKENS = 1 << 26  # in a bucket, about, at most: larger inputs get more buckets
ROUNDS = 4
END, PAD = 256, 257  # after the 256 byte values


def feistel(x: np.ndarray, half: int, key: int) -> np.ndarray:
    """A keyed bijection of 0 .. 4 ** half - 1."""
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for r in range(ROUNDS):
        salt = np.uint64((key + (r + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
        left, right = right, left ^ (mix(right + salt) & mask)
    return left << np.uint64(half) | right


def permute(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Slots of the sequence numbers x, all below n: the network, walked along its cycle back into range."""
    half = max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
    out = feistel(x.astype(np.uint64), half, key)
    outside = np.flatnonzero(out >= np.uint64(n))
    while len(outside):
        out[outside] = feistel(out[outside], half, key)
        outside = outside[out[outside] >= np.uint64(n)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Records: doc_id (8 bytes), place (4), number of tokens (4, the top bit set where the id is null), then seq_len ids of `width` bytes, little-endian."""

    seq_len: int = 1024
    per_shard: int = 16384
    key: int = 20240229
    width: int = 2  # 4 for vocabularies of more than 65,536 ids
    end: int = END
    pad: int = PAD

    @property
    def stride(self) -> int:
        return 16 + self.width * self.seq_len

    def record(self, doc_id: int | None, place: int, tokens: np.ndarray) -> bytes:
        head = np.array([doc_id or 0], dtype="<i8").tobytes() + np.array([place, len(tokens) | (doc_id is None) << 31], dtype="<u4").tobytes()
        return head + tokens.astype(f"<u{self.width}").tobytes() + np.full(self.seq_len - len(tokens), self.pad, dtype=f"<u{self.width}").tobytes()

    def read(self, shard: bytes, first_slot: int, slot: int) -> tuple[int | None, int, np.ndarray]:
        """doc_id, place and tokens of a slot of a shard."""
        at = (slot - first_slot) * self.stride
        doc_id = int(np.frombuffer(shard, "<i8", 1, at)[0])
        place, n = np.frombuffer(shard, "<u4", 2, at + 8).tolist()
        return None if n >> 31 else doc_id, place, np.frombuffer(shard, f"<u{self.width}", n & 0x7FFFFFFF, at + 16)


def sequences(rows: DataFrame, layout: Layout, tokens: Column, id_col: str = "doc_id") -> tuple[DataFrame, int]:
    """(slot, shard, doc_id, place, n_tokens, tokens) in no order, and the number of slots.

    `tokens` is a binary column of byte tokens, or an array of ids; the end token follows the last.
    """
    session = rows.sparkSession
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), tokens.alias("tokens"))
    if rows.schema["tokens"].dataType.typeName() == "array":
        rows = rows.select("doc_id", F.coalesce("tokens", F.array().cast("array<int>")).cast("array<int>").alias("tokens"))
        length = F.size("tokens")
    else:
        rows = rows.select("doc_id", F.coalesce("tokens", F.lit(b"")).alias("tokens"))
        length = F.octet_length("tokens")
    n = F.floor(length / F.lit(layout.seq_len)) + 1  # with the end token

    def counted(buckets: int) -> tuple[Column, np.ndarray]:
        bucket, out = F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(buckets)).cast("int"), np.zeros(buckets, dtype=np.int64)
        for r in rows.groupBy(bucket.alias("bucket")).agg(F.sum(n.cast("long")).alias("n")).collect():
            out[r["bucket"]] = r["n"]
        return bucket, out

    bucket, counts = counted(BUCKETS)
    if (wanted := 1 << (int(counts.sum()) * layout.seq_len // BUCKET_TOKENS).bit_length()) > BUCKETS:
        bucket, counts = counted(wanted)
    starts, total = np.cumsum(counts) - counts, int(counts.sum())
    # a task numbers about 128 MB of tokens at most
    partitions = max(int(session.conf.get("spark.sql.shuffle.partitions")), total * layout.seq_len >> 27)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = 0, None
        for batch in batches:
            texts = batch.column(2).to_pylist()
            size = np.array([len(t) for t in texts], dtype=np.int64) // layout.seq_len + 1
            buckets = batch.column(0).to_numpy()
            number = np.empty(int(size.sum()), dtype=np.int64)
            owner = np.repeat(np.arange(len(size)), size)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            first = np.empty(len(size), dtype=np.int64)
            for i, (k, s) in enumerate(zip(buckets.tolist(), size.tolist(), strict=True)):
                if k != last:
                    at, last = int(starts[k]), k
                first[i] = at
                at += s
            number = first[owner] + place
            slot = permute(number, total, layout.key)
            cuts = [texts[o][p * layout.seq_len : (p + 1) * layout.seq_len] for o, p in zip(owner.tolist(), place.tolist(), strict=True)]
            if texts and isinstance(texts[0], list):
                cuts = [np.asarray(c, dtype="<u4").tobytes() for c in cuts]
            step = 4096
            for i in range(0, len(owner), step):
                part = slice(i, i + step)
                end = place[part] == size[owner[part]] - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slot[part]),
                        pa.array(slot[part] // layout.per_shard),
                        batch.column(1).take(pa.array(owner[part])),
                        pa.array(place[part].astype(np.int32)),
                        pa.array(end),
                        pa.array(cuts[part], pa.binary()),
                    ],
                    names=["slot", "shard", "doc_id", "place", "last", "tokens"],
                )

    placed = rows.select(bucket.alias("bucket"), "doc_id", "tokens").repartition(partitions, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), F.xxhash64("tokens"), "tokens")
    return placed.mapInArrow(number, "slot long, shard long, doc_id long, place int, last boolean, tokens binary"), total


def materialise(rows: DataFrame, layout: Layout = Layout(), tokens: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """slot, shard, byte_offset, doc_id, place, n_tokens, record: all slots, a task holding whole shards in slot order."""
    tokens = F.encode(F.col("text"), "UTF-8") if tokens is None else tokens
    as_ids = rows.select(tokens.alias("t")).schema["t"].dataType.typeName() == "array"
    placed, total = sequences(rows, layout, tokens, id_col)
    shards = max(1, -(-total // layout.per_shard))
    partitions = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total * layout.stride >> 28)
    # shard numbers are dealt in ranges: task t holds shards t * per_task and on
    per_task = max(1, -(-shards // partitions))
    tasks = max(1, -(-shards // per_task))
    dealt = placed.withColumn("_task", F.floor(F.col("shard") / per_task).cast("int")).repartitionById(tasks, F.col("_task")).drop("_task").sortWithinPartitions("slot")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, place, last, cut = (batch.column(k).to_pylist() for k in (2, 3, 4, 5))
            size, out = [], []
            for d, p, e, t in zip(doc, place, last, cut, strict=True):
                ids = np.frombuffer(t, dtype="<u4") if as_ids else np.frombuffer(t, dtype=np.uint8).astype(np.uint16)
                if e:
                    ids = np.append(ids, ids.dtype.type(layout.end))
                size.append(len(ids))
                out.append(layout.record(d, p, ids))
            slot = batch.column(0).to_numpy()
            offset = slot % layout.per_shard * layout.stride
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(offset), batch.column(2), batch.column(3), pa.array(size, pa.int32()), pa.array(out, pa.binary())], names=["slot", "shard", "byte_offset", "doc_id", "place", "n_tokens", "record"])

    return dealt.mapInArrow(records, "slot long, shard long, byte_offset long, doc_id long, place int, n_tokens int, record binary")


def write_shards(ordered: DataFrame, folder: str) -> DataFrame:
    """Write each shard of `materialise` as a file of records, and return (shard, path, records, bytes, crc32).

    `folder` is a URI that pyarrow knows; a plain path is taken on a single machine alone, since
    elsewhere each executor would keep its own shards (name a shared mount as file:///...).  A shard is written under a name of its attempt and renamed, so a retry of a lost
    task writes the same bytes again and readers never see half a shard.
    """

    if "://" not in folder and not ordered.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError(f"{folder!r} is a path of one machine: name a folder that all executors share, with its scheme")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        at, out, n, size, crc, name = None, None, 0, 0, 0, ""

        def close():
            out.close()
            store.move(name, f"{root}/shard-{at:08d}.bin")
            return pa.RecordBatch.from_pydict({"shard": [at], "path": [f"{root}/shard-{at:08d}.bin"], "records": [n], "bytes": [size], "crc32": [crc]})

        try:
            for batch in batches:
                for shard, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if shard != at:
                        if out is not None:
                            yield close()
                        at, n, size, crc, name = shard, 0, 0, 0, f"{root}/.shard-{shard:08d}.{os.getpid()}.{os.urandom(4).hex()}"
                        out = store.open_output_stream(name)
                    out.write(record)
                    n, size, crc = n + 1, size + len(record), zlib.crc32(record, crc)
            if out is not None:
                yield close()
        finally:  # a failed attempt leaves nothing half written
            if out is not None and not out.closed:
                out.close()
                store.delete_file(name)

    return ordered.select("shard", "record").mapInArrow(run, "shard long, path string, records long, bytes long, crc32 long")
