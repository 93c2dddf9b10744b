"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

`parse` reads any Matroska byte string into tracks, packets and cues: variable-length ids
and sizes, unknown sizes, SimpleBlocks and BlockGroups, and no, Xiph, fixed-size and EBML
lacing.  Every packet has its track, timestamp and byte range.  `packets` is the same over
a binary column.  `write_pcm` stores bytes losslessly as 8-bit mono PCM samples.

Defined cases: null text is empty; an empty payload is padded like any other; equal inputs
give equal bytes; null media has no packets; media that is cut short or malformed gives one
row with `error` and no packet; very long texts are stored whole; repeated rows agree; an
empty table gives no rows; further columns are ignored, or kept by `encode`.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element ids of the Matroska specification.
EBML, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

#: What may follow a cluster of unknown size and so ends it.
TOP = frozenset((CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367))
LACINGS = ("none", "xiph", "fixed", "ebml")

RATE = 8000  # samples a second; one timestamp tick is one sample
FRAME = 1024  # samples in a frame
LACE = 8  # frames in a block at most


@dataclass
class Media:
    scale: int = 1_000_000  # nanoseconds a tick
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple] = field(default_factory=list)  # (track, ticks, offset, size, keyframe, cluster, block, lacing)
    cues: list[tuple] = field(default_factory=list)  # (ticks, track, offset of the cluster)


def vint(b: bytes, at: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """The number at `at` and where it ends; None for the reserved unknown size."""
    first = b[at]
    if not first:
        raise ValueError("a variable-length number is longer than 8 bytes")
    n = 9 - first.bit_length()
    if at + n > len(b):
        raise ValueError("the data end within a number")
    value = int.from_bytes(b[at : at + n], "big")
    if keep_marker:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def elements(b: bytes, at: int, end: int, stop: frozenset = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the content of each element; unknown sizes reach to the end or to a `stop` id."""
    while at < end:
        ident, start = vint(b, at, keep_marker=True)
        if ident in stop:
            return
        size, start = vint(b, start)
        if size is None:
            finish = end
            if ident == CLUSTER:
                finish = start
                for _, _, finish in elements(b, start, end, TOP):
                    pass
        else:
            finish = start + size
            if finish > end:
                raise ValueError("an element reaches past its parent")
        yield ident, start, finish
        at = finish


def unsigned(b: bytes, start: int, end: int) -> int:
    return int.from_bytes(b[start:end], "big")


def lace(b: bytes, start: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the frames of a block whose header ends at `start`."""
    if kind == 0:
        return [(start, end - start)]
    if start >= end:
        raise ValueError("a laced block has no frame count")
    n, at, sizes = b[start] + 1, start + 1, []
    if kind == 2:
        size, rest = divmod(end - at, n)
        if rest:
            raise ValueError("fixed-size lacing does not divide the block")
        sizes = [size] * n
    elif kind == 1:
        for _ in range(n - 1):
            size = 0
            while b[at] == 255:
                size += 255
                at += 1
            sizes.append(size + b[at])
            at += 1
    elif n > 1:
        size, at = vint(b, at)
        sizes.append(size)
        for _ in range(n - 2):
            width = 9 - b[at].bit_length()
            step, at = vint(b, at)
            # the difference is stored above the middle of its range
            if step is None:
                step = (1 << 7 * width) - 1
            size += step - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
    if kind != 2:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _block(out: Media, b: bytes, start: int, end: int, cluster: int, base: int, number: int, simple: bool, keyframe: bool) -> None:
    track, at = vint(b, start)
    if at + 3 > end:
        raise ValueError("a block is shorter than its header")
    ticks, flags = base + int.from_bytes(b[at : at + 2], "big", signed=True), b[at + 2]
    kind = flags >> 1 & 3
    step = next((t["ticks"] for t in out.tracks if t.get("number") == track and t.get("ticks")), 0)
    for k, (offset, size) in enumerate(lace(b, at + 3, end, kind)):
        out.packets.append((track, ticks + k * step, offset, size, bool(flags & 0x80) if simple else keyframe, cluster, number, LACINGS[kind]))


def parse(b: bytes) -> Media:
    """Tracks, packets and cues of a Matroska byte string; ValueError if it is malformed."""
    try:
        return _parse(b)
    except IndexError:
        raise ValueError("the data end within an element") from None


def _parse(b: bytes) -> Media:
    out, clusters, segment_at = Media(), 0, 0
    top = list(elements(b, 0, len(b)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for ident, start, end in top:
        if ident != SEGMENT:
            continue
        segment_at = start
        for ident, start, end in elements(b, start, end):
            if ident == INFO:
                for i, s, e in elements(b, start, end):
                    if i == TIMESTAMP_SCALE:
                        out.scale = unsigned(b, s, e)
            elif ident == TRACKS:
                for i, s, e in elements(b, start, end):
                    if i == TRACK_ENTRY:
                        out.tracks.append(_track(b, s, e, out.scale))
            elif ident == CLUSTER:
                base, number = 0, 0
                for i, s, e in elements(b, start, end, TOP):
                    if i == TIMESTAMP:
                        base = unsigned(b, s, e)
                    elif i == SIMPLE_BLOCK:
                        _block(out, b, s, e, clusters, base, number, True, False)
                        number += 1
                    elif i == BLOCK_GROUP:
                        inner = list(elements(b, s, e))
                        alone = all(x[0] != REFERENCE_BLOCK for x in inner)
                        for j, s2, e2 in inner:
                            if j == BLOCK:
                                _block(out, b, s2, e2, clusters, base, number, False, alone)
                                number += 1
                clusters += 1
            elif ident == CUES:
                for i, s, e in elements(b, start, end):
                    if i == CUE_POINT:
                        time, places = 0, []
                        for j, s2, e2 in elements(b, s, e):
                            if j == CUE_TIME:
                                time = unsigned(b, s2, e2)
                            elif j == CUE_TRACK_POSITIONS:
                                places.append({x: unsigned(b, s3, e3) for x, s3, e3 in elements(b, s2, e2)})
                        out.cues += [(time, p.get(CUE_TRACK), segment_at + p.get(CUE_CLUSTER_POSITION, 0)) for p in places]
    return out


def _track(b: bytes, start: int, end: int, scale: int) -> dict:
    t: dict = {}
    for i, s, e in elements(b, start, end):
        if i == TRACK_NUMBER:
            t["number"] = unsigned(b, s, e)
        elif i == TRACK_TYPE:
            t["type"] = unsigned(b, s, e)
        elif i == CODEC_ID:
            t["codec"] = b[s:e].decode("ascii", "replace")
        elif i == DEFAULT_DURATION:
            t["ticks"] = unsigned(b, s, e) // max(1, scale)
        elif i == AUDIO:
            for j, s2, e2 in elements(b, s, e):
                if j == BIT_DEPTH:
                    t["bits"] = unsigned(b, s2, e2)
                elif j == CHANNELS:
                    t["channels"] = unsigned(b, s2, e2)
    return t


# ---------------------------------------------------------------- writing


def _size(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def _element(ident: int, content: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(content)) + content


def _number(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _head() -> tuple[bytes, bytes]:
    scale = 1_000_000_000 // RATE
    ebml = _element(EBML, _element(DOC_TYPE, b"matroska") + _number(DOC_TYPE_VERSION, 4) + _number(DOC_TYPE_READ_VERSION, 2))
    info = _element(INFO, _number(TIMESTAMP_SCALE, scale) + _element(MUXING_APP, b"glyphforge") + _element(WRITING_APP, b"glyphforge"))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, np.float64(RATE).astype(">f8").tobytes()) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    entry = _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _number(DEFAULT_DURATION, FRAME * scale) + audio
    return ebml, info + _element(TRACKS, _element(TRACK_ENTRY, entry))


_HEAD = _head()


def laced_block(frames: list[bytes], ticks: int, kind: int | None = None) -> bytes:
    """A SimpleBlock of track 1; `kind` forces a lacing, else fixed sizes are used where frames allow, EBML lacing otherwise."""
    if kind is None:
        kind = 0 if len(frames) == 1 else 2 if len({len(f) for f in frames}) == 1 else 3
    sizes = [len(f) for f in frames]
    lace_head = b"" if kind == 0 else bytes([len(frames) - 1])
    if kind == 1:
        lace_head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == 3 and len(sizes) > 1:
        lace_head += _size(sizes[0])
        for a, n in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(n - a) < (1 << 7 * w - 1) - 1)
            lace_head += ((1 << 7 * width) | (n - a + (1 << 7 * width - 1) - 1)).to_bytes(width, "big")
    return _element(SIMPLE_BLOCK, b"\x81" + ticks.to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1]) + lace_head + b"".join(frames))


def write_pcm(payload: bytes) -> bytes:
    """`payload` as the samples of an 8-bit mono Matroska file with a cue for each cluster."""
    ebml, head = _HEAD
    body, cues, at = [head], [], len(head)
    step = FRAME * LACE
    per_cluster = 32768 // step * step
    for base in range(0, len(payload), per_cluster):
        blocks = [_number(TIMESTAMP, base)]
        for start in range(base, min(base + per_cluster, len(payload)), step):
            part = payload[start : start + step]
            blocks.append(laced_block([part[i : i + FRAME] for i in range(0, len(part), FRAME)], start - base))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, base) + _element(CUE_TRACK_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return ebml + _element(SEGMENT, b"".join(body))


def read_pcm(media: bytes) -> tuple[bytes, Media]:
    """The samples of track 1, taken from the byte ranges of its packets."""
    parsed = parse(media)
    return b"".join(media[p[2] : p[2] + p[3]] for p in parsed.packets if p[0] == 1), parsed


def feature(samples: bytes, parsed: Media) -> str:
    """Shape of the packet table, and level, energy and sign changes of the samples about the middle."""
    x = np.frombuffer(samples, dtype=np.uint8)
    centred = x.astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(x > 127)))
    kinds = "".join(sorted({p[7][0] for p in parsed.packets}))
    last = max((p[1] for p in parsed.packets), default=0)
    return f"packets={len(parsed.packets)};clusters={1 + max((p[5] for p in parsed.packets), default=-1)};cues={len(parsed.cues)};lacing={kinds};last={last * parsed.scale};sum={int(centred.sum())};energy={int((centred * centred).sum())};crossings={crossings}"


def padded(text: bytes, to: int = 64) -> bytes:
    return text + bytes(-len(text) % to if text else to)


_STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame) -> DataFrame:
    """Digests of each text's payload as read back from its stored form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in _STORED.split(", ")}
            out["doc_id"] = batch.column(0)
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                text = text or b""
                media = write_pcm(padded(text))
                payload, parsed = read_pcm(media)
                for name, value in zip(list(out)[1:], (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload, parsed)), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _STORED)


def encode(docs: DataFrame, column: str = "text", media: str = "media") -> DataFrame:
    """`docs` with a binary column, new or replaced, holding the padded UTF-8 text as Matroska PCM."""
    if media == column:
        raise ValueError("the media column needs a name of its own")
    docs = docs.drop(media)
    at = docs.columns.index(column)
    schema = T.StructType([*docs.schema, T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = [write_pcm(padded(t or b"")) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stored, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


_PACKET = "packet integer, track long, timestamp_ns long, byte_offset long, byte_size long, keyframe boolean, cluster integer, block integer, lacing string, error string"
_CUE = "cue integer, timestamp_ns long, track long, cluster_offset long, error string"


def _table(media: DataFrame, id_col: str, column: str, fields: str, rows_of) -> DataFrame:
    """A row for each of `rows_of` a parsed media value, with the id of its row; errors in the last field."""
    schema = media.select(id_col).schema
    for part in fields.split(", "):
        schema = schema.add(*part.split())
    width = len(fields.split(", "))
    types = {"integer": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    names, kinds = zip(*((n, types[k]) for n, k in (part.split() for part in fields.split(", "))), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for i, b in enumerate(batch.column(1).to_pylist()):
                if b is None:
                    continue
                try:
                    found = rows_of(parse(b))
                except ValueError as e:
                    found = [(None,) * (width - 1) + (str(e),)]
                owner += [i] * len(found)
                rows += found
            ids = batch.column(0).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=[id_col, *names])

    return media.select(id_col, column).mapInArrow(run, schema)


def packets(media: DataFrame, id_col: str, column: str) -> DataFrame:
    """A row per packet of each media value, with the id of its row."""
    return _table(media, id_col, column, _PACKET, lambda m: [(k, p[0], p[1] * m.scale, *p[2:], None) for k, p in enumerate(m.packets)])


def cues(media: DataFrame, id_col: str, column: str) -> DataFrame:
    """A row per cue of each media value: time, track, and the byte at which its cluster begins."""
    return _table(media, id_col, column, _CUE, lambda m: [(k, c[0] * m.scale, c[1], c[2], None) for k, c in enumerate(m.cues)])
