"""Reading, checkpoints and byte-level text helpers shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define words: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> str | list[str]:
    """Names made of `names` that none of the columns has, in any case; one name alone as a string."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out[0] if len(out) == 1 else out


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder.

    Where none is named, a single machine gets one of its own (tests); a cluster must name one.
    """
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="glyphforge-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    return f"{re.sub('^file:/+', 'file:///', root)}/{name}-{uuid.uuid4().hex}"


def tree_merged(rows: DataFrame, start: Callable[[Iterator[pa.RecordBatch]], bytes | None], join: Callable[[bytes, bytes], bytes], fan: int = 16) -> bytes | None:
    """One state over all rows: `start` makes one of each partition, `join` merges them by a tree.

    No task and not the driver ever holds more than `fan` states; they merge in the order of
    their partitions, so reruns agree.  None where no partition has a state.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (state := start(batches)) is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "state": pa.array([state], pa.binary())})

    def some(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        states = [r["state"] for r in sorted(table.to_pylist(), key=lambda r: r["part"])]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "state": pa.array([reduce(join, states)], pa.binary())})

    states = cut(rows.mapInArrow(first, "part long, state binary"))
    top = states.rdd.getNumPartitions()  # of what is written: nothing runs for it
    while top > fan:
        states = states.groupBy(F.expr(f"part div {fan}")).applyInArrow(some, "part long, state binary")
        top = -(-top // fan)
    last = [r["state"] for r in sorted(states.collect(), key=lambda r: r["part"])]
    return reduce(join, last) if last else None


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo `mod`."""
    return F.crc32(F.col(id_col).cast("string")) % mod


# ---------------------------------------------------------------- byte-level text

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: An odd multiplier and its inverse modulo 2**64 for the prefix hash below.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Texts are hashed in pieces of about this many bytes, cut between words.
PIECE = 1 << 17


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    factor = base & ((1 << 64) - 1)
    while done < n:
        step = min(done, n - done)
        np.multiply(out[:step], np.uint64(pow(factor, done, 1 << 64)), out=out[done : done + step])
        done += step
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), applied in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separators."""
    sep = SEPARATOR[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sep, [True])).view(np.int8)))
    return edge[0::2], edge[1::2]


class WordHasher:
    """64-bit hashes of the words of a byte buffer, without a Python loop over words."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = self.up

    def __call__(self, b: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and start offsets of all words in `b`."""
        hashes, starts, at, n = [], [], 0, len(b)
        while at < n:
            end = min(n, at + PIECE)
            if end < n:
                gap = np.flatnonzero(SEPARATOR[b[at:end]])
                if len(gap):
                    end = at + int(gap[-1]) + 1
                else:  # one word longer than a piece: take all of it
                    later = np.flatnonzero(SEPARATOR[b[end:]])
                    end = end + int(later[0]) + 1 if len(later) else n
            h, s = self._piece(b[at:end], lower)
            hashes.append(h)
            starts.append(s + at)
            at = end
        if not hashes:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        return np.concatenate(hashes), np.concatenate(starts)

    def _piece(self, b: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= len(b):
            self.up, self.down = powers(BASE, len(b) + 1), powers(BASE_INVERSE, len(b) + 1)
        s, e = word_bounds(b)
        total = np.empty(len(b) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(((LOWER[b] if lower else b).astype(np.uint64) + np.uint64(1)) * self.up[: len(b)], out=total[1:])
        return mix((total[e] - total[s]) * self.down[s]), s


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer of all texts with a newline after each, and the offsets of the texts in it."""
    buffer = b"\n".join(texts) + b"\n" if texts else b""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return np.frombuffer(buffer, dtype=np.uint8), offsets


def chunks(texts: list[bytes], limit: int = PIECE):
    """(from, to) ranges of texts of about `limit` bytes together; a longer text stands alone."""
    at = 0
    while at < len(texts):
        end, n = at + 1, len(texts[at])
        while end < len(texts) and n + len(texts[end]) <= limit:
            n += len(texts[end])
            end += 1
        yield at, end
        at = end
