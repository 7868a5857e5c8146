"""Matroska media columns: bytes to packet tables, and byte payloads to Matroska.

``parse`` walks variable-length EBML elements, clusters, block groups, lacing (none, Xiph, fixed, EBML) and cues.
Elements of unknown size end where an element of an upper level starts. ``mux`` stores bytes as 8-bit PCM samples.

Results for odd input: a null blob has no packets; bytes that are not Matroska raise ValueError in ``parse`` and give a
row with the error in ``packets``; a cut-off file gives the packets before the cut; unknown elements are skipped; a
null or empty text becomes 192 spaces, a long one is stored whole; equal texts give equal bytes; rows repeat as they come; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, arrow_schema, bound_batches

UNIT = 192
RATE = 8000
FRAME_NS = UNIT * 1_000_000_000 // RATE
LACED = 8
CLUSTER_BLOCKS = 16

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, ENTRY, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, CUES, POINT, POSITIONS = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x1C53BB6B, 0xBB, 0xB7
REFERENCE, SCALE, DURATION, NUMBER, KIND, CODEC, DEFAULT = 0xFB, 0x2AD7B1, 0x4489, 0xD7, 0x83, 0x86, 0x23E383
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
SEEK, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
_TOP = {INFO, TRACKS, CLUSTER, CUES, SEEK, TAGS, CHAPTERS, ATTACHMENTS}


def vint(data, at: int) -> tuple[int, int]:
    """Value and length of a variable-length integer; value -1 if all its bits are set (unknown)."""
    first = data[at]
    if not first:
        raise ValueError("variable-length integer of over 8 bytes")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise IndexError("cut off")
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (-1 if value == (1 << 7 * n) - 1 else value), n


def element_id(data, at: int) -> tuple[int, int]:
    first = data[at]
    n = 9 - first.bit_length()
    if not first or n > 4:
        raise ValueError("bad element id")
    return int.from_bytes(data[at : at + n], "big"), n


def size_bytes(value: int) -> bytes:
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    default_ns: int = 0
    rate: float = 0.0
    channels: int = 1
    bits: int = 0


@dataclass
class Media:
    """Tracks, cues (time, track, cluster position) and packets as parallel lists."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, Track] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    track: list[int] = field(default_factory=list)
    time_ns: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    key: list[bool] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    blocks: int = 0
    whole: bool = True


def lace(data, at: int, end: int, kind: int) -> tuple[int, list[int]]:
    """Start of the first frame of a laced block and the sizes of all its frames. kind: 1 Xiph, 2 fixed, 3 EBML."""
    count = data[at] + 1
    at += 1
    if kind == 2:
        total = end - at
        if total % count:
            raise ValueError("fixed lacing doesn't divide the block")
        return at, [total // count] * count
    sizes: list[int] = []
    if kind == 1:
        for _ in range(count - 1):
            n = 0
            while True:
                b = data[at]
                at += 1
                n += b
                if b != 255:
                    break
            sizes.append(n)
    else:
        for k in range(count - 1):
            value, n = vint(data, at)
            if value < 0:
                value = (1 << 7 * n) - 1
            at += n
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * n - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing exceeds the block")
    return at, sizes


def _block(m: Media, data, at: int, end: int, cluster_time: int, key: bool | None) -> None:
    number, n = vint(data, at)
    relative = int.from_bytes(data[at + n : at + n + 2], "big", signed=True)
    flags = data[at + n + 2]
    at += n + 3
    kind = flags >> 1 & 3
    first, sizes = lace(data, at, end, kind) if kind else (at, [end - at])
    step = m.tracks[number].default_ns if number in m.tracks else 0
    time = (cluster_time + relative) * m.scale
    count = len(sizes)
    m.track += [number] * count
    m.time_ns += [time + k * step for k in range(count)] if step else [time] * count
    for s in sizes:
        m.offset.append(first)
        first += s
    m.size += sizes
    m.key += [bool(flags & 0x80) if key is None else key] * count
    m.block += [m.blocks] * count
    m.blocks += 1


def parse(data: bytes) -> Media:
    """Packets of a Matroska file with track, time, byte range and key flag."""
    m = Media()
    end = len(data)

    def children(at: int, stop: int, upper: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int]]:
        """(id, start, end) of each element; one of unknown size lasts until an id of upper or the end."""
        while at < stop:
            kind, n = element_id(data, at)
            if kind in upper:
                return
            size, k = vint(data, at + n)
            begin = at + n + k
            if size < 0:
                at = begin
                if kind == CLUSTER:
                    for _, _, at in children(begin, stop, _TOP):
                        pass
                else:
                    at = stop
                yield kind, begin, at
            else:
                if begin + size > stop:
                    m.whole = False
                    if kind in (SIMPLE, BLOCK):
                        return
                at = min(begin + size, stop)
                yield kind, begin, at

    number_of = lambda a, b: int.from_bytes(data[a:b], "big")
    real_of = lambda a, b: struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b - a in (4, 8) else 0.0
    if element_id(data, 0)[0] != EBML:
        raise ValueError("no EBML header")
    try:
        for top, a, b in children(0, end):
            if top == EBML:
                for kind, c, d in children(a, b):
                    if kind == 0x4282:
                        m.doc_type = data[c:d].decode("ascii", "replace")
            elif top == SEGMENT:
                base = a
                for kind, c, d in children(a, b):
                    if kind == INFO:
                        for k, e, f in children(c, d):
                            if k == SCALE:
                                m.scale = number_of(e, f)
                            elif k == DURATION:
                                m.duration = real_of(e, f)
                    elif kind == TRACKS:
                        for k, e, f in children(c, d):
                            if k == ENTRY:
                                t = Track()
                                for x, g, h in children(e, f):
                                    if x == NUMBER:
                                        t.number = number_of(g, h)
                                    elif x == KIND:
                                        t.kind = number_of(g, h)
                                    elif x == CODEC:
                                        t.codec = data[g:h].rstrip(b"\0").decode("ascii", "replace")
                                    elif x == DEFAULT:
                                        t.default_ns = number_of(g, h)
                                    elif x == AUDIO:
                                        for y, i, j in children(g, h):
                                            if y == 0xB5:
                                                t.rate = real_of(i, j)
                                            elif y == 0x9F:
                                                t.channels = number_of(i, j)
                                            elif y == 0x6264:
                                                t.bits = number_of(i, j)
                                m.tracks[t.number] = t
                    elif kind == CLUSTER:
                        m.clusters.append(c - base)
                        time = 0
                        for k, e, f in children(c, d):
                            if k == SIMPLE:
                                _block(m, data, e, f, time, None)
                            elif k == TIME:
                                time = number_of(e, f)
                            elif k == GROUP:
                                inner = list(children(e, f))
                                key = all(x != REFERENCE for x, _, _ in inner)
                                for x, g, h in inner:
                                    if x == BLOCK:
                                        _block(m, data, g, h, time, key)
                    elif kind == CUES:
                        for k, e, f in children(c, d):
                            if k == POINT:
                                t, found = 0, []
                                for x, g, h in children(e, f):
                                    if x == CUE_TIME:
                                        t = number_of(g, h)
                                    elif x == POSITIONS:
                                        got = {y: number_of(i, j) for y, i, j in children(g, h)}
                                        found.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0)))
                                m.cues += [(t, *x) for x in found]
    except IndexError:
        m.whole = False
    return m


_HEADER = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
_TRACKS = element(
    TRACKS,
    element(ENTRY, uint(NUMBER, 1) + uint(0x73C5, 1) + uint(KIND, 2) + uint(0x9C, 1) + uint(DEFAULT, FRAME_NS) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(0xB5, struct.pack(">d", RATE)) + uint(0x9F, 1) + uint(0x6264, 8))),
)


def mux(payload: bytes) -> bytes:
    """A Matroska file of a payload whose length UNIT divides: one PCM track, laced blocks, clusters and cues."""
    frames = len(payload) // UNIT
    info = element(INFO, uint(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", frames * FRAME_NS / 1e6)) + element(0x4D80, b"lakequill") + element(0x5741, b"lakequill"))
    body, cues = [info, _TRACKS], []
    at, step = len(info) + len(_TRACKS), LACED * CLUSTER_BLOCKS
    for first in range(0, frames, step):
        time = first * FRAME_NS // 1_000_000
        parts = [uint(TIME, time)]
        for k in range(first, min(first + step, frames), LACED):
            n = min(LACED, frames - k)
            relative = k * FRAME_NS // 1_000_000 - time
            head = b"\x81" + relative.to_bytes(2, "big") + (b"\x84" + bytes([n - 1]) if n > 1 else b"\x80")
            parts.append(element(SIMPLE, head + payload[k * UNIT : (k + n) * UNIT]))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(POINT, uint(CUE_TIME, time) + element(POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEADER + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text and the payload that is stored for it."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def demux(data: bytes, m: Media) -> bytes:
    """The frames of all packets, in order."""
    return b"".join([data[a : a + n] for a, n in zip(m.offset, m.size)])


def features(m: Media, payload: bytes) -> str:
    """What the packet table and the samples show, as one line."""
    x = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    signs = x >= 0
    end = max(m.time_ns) + FRAME_NS if m.time_ns else 0
    return (
        f"packets={len(m.size)};blocks={m.blocks};clusters={len(m.clusters)};cues={len(m.cues)};tracks={len(m.tracks)};end_ms={end // 1_000_000};"
        f"mean={x.mean():.4f};rms={np.sqrt((x.astype(np.float64) ** 2).mean()):.4f};crossings={int((signs[1:] != signs[:-1]).sum())};peak={int(np.abs(x).max())}"
    )


_MEDIA, _MEDIA_ARROW = arrow_schema("doc_id long, n_bytes long, media binary")
_READ, _READ_ARROW = arrow_schema("doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, whole boolean")
_PACKETS, _PACKETS_ARROW = arrow_schema("id long, track int, codec string, time_ns long, offset long, size long, key boolean, error string")


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and a Matroska column with each text's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for i in range(0, len(texts), 1000):
                got = [payload_of(t) for t in texts[i : i + 1000]]
                yield arrow_batch(_MEDIA_ARROW, ids.slice(i, len(got)), [n for n, _ in got], [mux(p) for _, p in got])

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _MEDIA)


def read_media(media: DataFrame) -> DataFrame:
    """Parses column media and returns sizes, digests and features of what it holds.

    Media that are null or can't be read have a null payload and null features; null ones have no media size either.
    Those that end early have what is there, and ``whole`` is false.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for scalar in batch.column("media"):
                data = scalar.as_py()
                if data is None:
                    out.append((None,) * 7)
                    continue
                try:
                    m = parse(data)
                    payload = demux(data, m)
                    shown = features(m, payload)
                except (ValueError, IndexError):
                    out.append((None, None, None, len(data), hashlib.sha256(data).hexdigest(), None, False))
                    continue
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), shown, m.whole))
            yield arrow_batch(_READ_ARROW, batch.column("doc_id"), batch.column("n_bytes"), *([x[k] for x in out] for k in range(7)))

    return media.mapInArrow(run, _READ)


def packets(media: DataFrame, id_column: str, column: str) -> DataFrame:
    """The packet table of a binary column: id, track, codec, time_ns, offset, size, key; error for what can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, scalar in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = scalar.as_py()
                if data is None:
                    continue
                try:
                    m = parse(data)
                except (ValueError, IndexError) as e:
                    yield arrow_batch(_PACKETS_ARROW, [i], [None], [None], [None], [None], [None], [None], [str(e)])
                    continue
                codec = {n: t.codec for n, t in m.tracks.items()}
                yield arrow_batch(_PACKETS_ARROW, [i] * len(m.size), m.track, [codec.get(t) for t in m.track], m.time_ns, m.offset, m.size, m.key, pa.nulls(len(m.size), pa.string()))
                if not m.whole:
                    yield arrow_batch(_PACKETS_ARROW, [i], [None], [None], [None], [None], [None], [None], ["ends early"])

    return media.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("media")).mapInArrow(run, _PACKETS)
