"""WARC records in seekable Zstandard bundles.

Writing: records are grouped into independent frames of about FRAME bytes; a bundle is a
file of such frames, then a skippable frame that maps record identifiers to (frame, offset
in the frame's plain bytes, length), then the seek table of the public seekable format, a
skippable frame whose footer is read from the end of the file.  Plain Zstandard tools
decompress a bundle as one WARC file; readers that know the footer fetch one frame for one
record.  A task writes its own bundles, each under a name of its attempt; the manifest, one
checkpointed row a bundle, names those of the attempts that won, so a retry leaves at worst
a file that nobody reads.

Which records are responses: of pages with equal payloads (SHA-256, SHA-1 and size) that
with the smallest id; the others revisit it and carry no payload.  Pages move once, to the
task of their payload.  Payloads that more than a 1,024th of all pages share (so at most
1,024 of them) are not moved: their pages are counted as (id, url) with copies, dealt over
all tasks in runs of at most RUN copies, and the one payload joins the one response.

Reading: a task takes a range of frames of a bundle, seeks to each, parses its records and
verifies the digest of every payload.

Defined cases: a null html is empty; payloads below `least` bytes are always responses;
null ids come last and are written as nothing; a null url leaves its header out, control
characters and blanks in urls are percent-encoded; rows that repeat an id and a payload are
records of their own, one of them the response; a record larger than a frame has one of its
own; an empty table writes no bundle and gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FRAME = 1 << 20  # plain bytes of a frame, about
BUNDLE = 1 << 29  # compressed bytes of a bundle, about
RUN = 4096
HOT_SHARE = 1024
LEVEL = 3
READ = 64  # frames in a reader's range
TASKS = 100_000  # readers, at most
#: Fixed values of the seekable format: skippable frame, seek table footer.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, frames int, records long, plain_bytes long, bytes long"


# ---------------------------------------------------------------- bundles


class Bundle(NamedTuple):
    path: str
    frames: int
    records: int
    plain: int
    size: int


class Writer:
    """One bundle, written frame by frame to an open stream."""

    def __init__(self, out, level: int = LEVEL, frame: int = FRAME) -> None:
        self.out, self.frame, self.packer = out, frame, zstandard.ZstdCompressor(level=level)
        self.held, self.filled = [], 0
        self.sizes: list[tuple[int, int]] = []  # compressed and plain size of each frame
        self.names: list[str] = []
        self.places: list[tuple[int, int, int]] = []
        self.written = 0

    def add(self, name: str, record: bytes) -> None:
        if self.held and self.filled + len(record) > self.frame:
            self.flush()
        self.names.append(name)
        self.places.append((len(self.sizes), self.filled, len(record)))
        self.held.append(record)
        self.filled += len(record)

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.sizes.append((len(packed), self.filled))
            self.written += len(packed)
            self.held, self.filled = [], 0

    def close(self) -> int:
        """Index and seek table; the size of all."""
        self.flush()
        index = self.packer.compress("\n".join(self.names).encode() + b"\0" + b"".join(struct.pack("<IQQ", *p) for p in self.places))
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()
        return self.written + len(index) + len(table) + 16


class Reader:
    """Random access to a bundle by its footer; `source` is an open seekable file of `size` bytes."""

    def __init__(self, source, size: int) -> None:
        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        frames, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        table = self._at(size - 9 - 8 * frames, 8 * frames)
        self.sizes = list(struct.iter_unpack("<II", table))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        packed, plain = self.sizes[k]
        return self.unpacker.decompress(self._at(self.starts[k], packed), max_output_size=plain)

    def index(self) -> Iterator[tuple[str, int, int, int]]:
        """Identifier, frame, offset in it, length, of every record."""
        magic, n = struct.unpack("<II", self._at(self.starts[-1], 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no record index")
        names, _, places = self.unpacker.decompress(self._at(self.starts[-1] + 8, n)).partition(b"\0")
        yield from ((name, *place) for name, place in zip(names.decode().split("\n"), struct.iter_unpack("<IQQ", places), strict=True) if place[2])


def opened(path: str) -> Reader:
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return Reader(store.open_input_file(inner), store.get_file_info(inner).size)


# ---------------------------------------------------------------- records


def safe_url(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record(name: str, url: str | None, sha1_hex: str, n_bytes: int, payload: bytes | None, refers_to: str | None) -> bytes:
    """A response with its payload, or a revisit (payload None) of the record `refers_to`."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {safe_url(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base32(sha1_hex)}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Parsed(NamedTuple):
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _headers(lines: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.strip().decode() for k, _, v in (x.partition(b":") for x in lines.split(b"\r\n")[1:])}


def parse(plain: bytes, at: int = 0) -> Iterator[Parsed]:
    """The records of a frame's plain bytes."""
    while at < len(plain):
        end = plain.index(b"\r\n\r\n", at)
        headers = _headers(plain[at:end])
        start, size = end + 4, int(headers["content-length"])
        split = plain.index(b"\r\n\r\n", start)
        yield Parsed(headers, _headers(plain[start:split]), plain[split + 4 : start + size])
        at = start + size + 4


# ---------------------------------------------------------------- on Spark


def plan(pages: DataFrame, least: int = 0, hot: int | None = None) -> DataFrame:
    """The records to write: name, url, sha1, n_bytes, payload (of responses), refers_to, copies.

    A row of several copies stands for as many records, the first as the row says, all
    others revisits.  `hot`: payloads of more pages than this are dealt as counts.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n_bytes"), "payload")
    kind = ["sha256", "sha1", "n_bytes"]
    name = lambda nth: F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(":"), F.substring(F.md5(F.concat_ws("|", "sha256", F.coalesce(F.concat(F.lit("="), "url"), F.lit("")), nth.cast("string"))), 1, 16))
    out = ["name", "url", "sha1", "n_bytes", "payload", "refers_to", "copies"]
    none, one = F.lit(None).cast("string"), F.lit(1).cast("long")
    first = [F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_first()]

    shared = rows.filter(F.col("n_bytes") >= least)
    counted = shared.groupBy(*kind).agg(F.count(F.lit(1)).alias("pages"))
    if hot is None:
        hot = max(RUN, pages.count() // HOT_SHARE)
    common = counted.filter(F.col("pages") > hot).select("sha256").collect()  # at most 1,024 by default
    often = F.col("sha256").isin(*[r[0] for r in common]) if common else F.lit(False)

    by_payload = Window.partitionBy(*kind).orderBy(*first)
    cold = shared.filter(~often).withColumn("nth", F.row_number().over(by_payload)).withColumn("name", name(F.col("nth")))
    cold = cold.withColumn("refers_to", F.when(F.col("nth") > 1, F.first("name").over(by_payload)))
    # of a response too small to share, a number that no other record of its id, url and payload has
    lone = Window.partitionBy("page_id", "url", *kind).orderBy(F.col("page_id"))
    small = rows.filter(F.col("n_bytes") < least).withColumn("name", name(F.row_number().over(lone))).withColumn("refers_to", none)
    records = cold.withColumn("payload", F.when(F.col("nth") == 1, F.col("payload"))).withColumn("copies", one).select(*out)
    if least > 0:
        records = records.unionByName(small.withColumn("copies", one).select(*out))
    if not common:
        return records
    many = shared.filter(often)
    ids = many.groupBy("page_id", "url", *kind).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.col("page_id").isNull(), "page_id", F.col("url").isNotNull(), "url")
    firsts = ids.groupBy("sha256").agg(F.min(order).alias("least"))
    dealt = ids.join(F.broadcast(firsts), "sha256").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))))
    dealt = dealt.repartition("sha256", "page_id", "url", "run").withColumn("copies", F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("run") * RUN))
    dealt = dealt.withColumn("leads", (F.col("run") == 0) & (order == F.col("least"))).withColumn("name", name(F.col("run") * RUN + 1))
    leaders = F.broadcast(dealt.filter("leads").select("sha256", F.col("name").alias("leader")))
    payloads = many.join(F.broadcast(firsts), "sha256").filter(order == F.col("least")).groupBy("sha256").agg(F.min("payload").alias("payload"))
    led = dealt.filter("leads").join(payloads, "sha256").withColumn("refers_to", none)
    rest = dealt.filter(~F.col("leads")).join(leaders, "sha256").withColumn("payload", F.lit(None).cast("binary")).withColumn("refers_to", F.col("leader"))
    return records.unionByName(led.select(*out)).unionByName(rest.select(*out))


def write(records: DataFrame, folder: str, frame: int = FRAME, bundle: int = BUNDLE, level: int = LEVEL) -> DataFrame:
    """Write `plan`'s records as bundles below the URI `folder`, at once; the manifest of the bundles.

    `folder` must be reached by all executors: a URI that pyarrow knows (file:// on a
    single machine or a shared mount).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        writer, name, plain = None, "", 0

        def close() -> pa.RecordBatch:
            size = writer.close()
            row = Bundle(f"{folder}/{name}", len(writer.sizes), len(writer.names), plain, size)
            return pa.RecordBatch.from_pydict({"path": [row.path], "frames": pa.array([row.frames], pa.int32()), "records": [row.records], "plain_bytes": [row.plain], "bytes": [row.size]})

        try:
            for batch in batches:
                for at in range(batch.num_rows):
                    own, url, sha1, n, payload, refers_to, copies = (batch.column(j)[at].as_py() for j in range(7))
                    for copy in range(copies):
                        if writer is None:
                            name, plain = f"part-{uuid.uuid4().hex}.warc.zst", 0
                            writer = Writer(store.open_output_stream(f"{root}/{name}", compression=None), level, frame)
                        data = record(own if not copy else f"{own}.{copy}", url, sha1, n, None if copy else payload, (refers_to or own) if copy else refers_to)
                        writer.add(own if not copy else f"{own}.{copy}", data)
                        plain += len(data)
                        if writer.written >= bundle:
                            yield close()
                            writer = None
            if writer is not None:
                yield close()
                writer = None
        finally:  # a failed attempt leaves nothing half written
            if writer is not None:
                writer.out.close()
                store.delete_file(f"{root}/{name}")

    return cut(records.mapInArrow(run, MANIFEST))


def _ranges(manifest: DataFrame, frames: int = READ) -> DataFrame:
    parts = manifest.select("path", F.explode(F.sequence(F.lit(0), F.col("frames") - 1, F.lit(frames))).alias("lo"), "frames")
    # rows are few and small but stand for much: their number, not their bytes, says how many tasks read
    return parts.select("path", "lo", F.least(F.col("lo") + frames, F.col("frames")).alias("hi")).repartition(_tasks(manifest, F.ceil(F.col("frames") / frames)), "path", "lo")


def _tasks(manifest: DataFrame, units: F.Column) -> int:
    return int(min(TASKS, max(1, manifest.agg(F.sum(units)).first()[0] or 1)))


def read(manifest: DataFrame) -> DataFrame:
    """record_id, url, record_type, payload_bytes, payload_digest, refers_to, payload of all records of the bundles.

    payload is null for revisits, whose size and digest are those of the payload they refer
    to.  A payload that its digest or size does not fit is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = opened(path)
                for k in range(lo, hi):
                    rows = []
                    for head, http, payload in parse(reader.frame(k)):
                        digest, kind, n = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], int(http["content-length"])
                        if kind == "response" and (base32(hashlib.sha1(payload).hexdigest()) != digest or len(payload) != n):
                            raise ValueError(f"{head['warc-record-id']}: the payload is not that of its digest")
                        rows.append((head["warc-record-id"][1:-1], head.get("warc-target-uri"), kind, n, digest, head.get("warc-refers-to", "<>")[1:-1] or None, payload if kind == "response" else None))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _READ, strict=True)], names=[f"c{j}" for j in range(len(_READ))])

    text = "record_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"
    return _ranges(manifest).mapInArrow(run, text)


_READ = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]


def index(manifest: DataFrame) -> DataFrame:
    """record_id, path, frame, offset, length of every record, from the bundles' footers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                names, frames, offsets, lengths = zip(*opened(path).index(), strict=True)
                yield pa.RecordBatch.from_pydict({"record_id": names, "path": [path] * len(names), "frame": pa.array(frames, pa.int32()), "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64())})

    return manifest.filter("records > 0").select("path").repartition(_tasks(manifest, F.lit(1)), "path").mapInArrow(run, "record_id string, path string, frame int, offset long, length long")


def fetch(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """record_id, record (its bytes) of the records that `ids` (record_id) names: their frames alone are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, reader, plain = (None, None), None, b""
        for batch in batches:
            names, out = batch.column(0), []
            for path, k, offset, length in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if path != last[0]:
                    reader = opened(path)
                if (path, k) != last:
                    last, plain = (path, k), reader.frame(k)
                out.append(plain[offset : offset + length])
            yield pa.RecordBatch.from_arrays([names, pa.array(out, pa.binary())], names=["record_id", "record"])

    found = index(manifest).join(ids.select("record_id").distinct(), "record_id")
    return found.select("record_id", "path", "frame", "offset", "length").repartition(_tasks(manifest, F.ceil(F.col("frames") / READ)), "path", "frame").sortWithinPartitions("path", "frame", "offset").mapInArrow(run, "record_id string, record binary")


def page_of(name: str) -> F.Column:
    """The page id within a record identifier, null if it has none."""
    return F.nullif(F.element_at(F.split(F.col(name), ":"), 3), F.lit("")).cast("long")


def digests(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives written to `folder`."""
    back = read(write(plan(pages, least), folder))
    return back.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))
