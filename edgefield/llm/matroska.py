"""Media columns: payloads as Matroska files, and Matroska files as packet tables.

A payload is stored as the samples of one uncompressed audio track (A_PCM/INT/LIT, 8 bits, one channel). Samples go into frames,
frames are laced into blocks, blocks into clusters, and cues tell where clusters begin. Reading parses the elements by their
variable-length ids and sizes: a packet has its track, timestamp and byte range whatever the lacing of its block is.

Identifiers and layouts are those of the EBML and Matroska specifications (RFC 8794, RFC 9559).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgefield.llm._common import lean

# fixed values: element ids of the two specifications
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_NO_LACING, _XIPH, _FIXED, _EBML = 0, 1, 2, 3


class Layout(NamedTuple):
    rate: int = 8000  # samples a second: a frame of 64 lasts 8 ms
    frame: int = 1024  # samples
    laced: int = 8  # frames in a block
    blocks: int = 16  # in a cluster
    lacing: int = _EBML


def _size(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones are reserved."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(id_: int, body: bytes) -> bytes:
    return id_.to_bytes((id_.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(id_: int, n: int) -> bytes:
    return _element(id_, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _float(id_: int, x: float) -> bytes:
    return _element(id_, np.array(x, ">f8").tobytes())


def _laced(sizes: list[int], lacing: int) -> bytes:
    """The lacing head of a block: number of frames less one, then sizes of all but the last."""
    head = bytes([len(sizes) - 1])
    if lacing == _FIXED:
        return head
    if lacing == _XIPH:
        return head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    out = head + _size(sizes[0]) if len(sizes) > 1 else head
    for before, n in zip(sizes, sizes[1:-1]):  # differences are signed: shifted by half the range
        d = n - before
        width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
        out += _size(d + (1 << 7 * width - 1) - 1, width)
    return out


def write(payload: bytes, layout: Layout = Layout()) -> bytes:
    """payload as a Matroska file. Equal payloads give equal files."""
    head = _element(EBML, b"".join([_uint(EBML_VERSION, 1), _uint(EBML_READ_VERSION, 1), _uint(EBML_MAX_ID, 4), _uint(EBML_MAX_SIZE, 8), _element(DOC_TYPE, b"matroska"), _uint(DOC_TYPE_VERSION, 4), _uint(DOC_TYPE_READ_VERSION, 2)]))
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"edgefield") + _element(WRITING_APP, b"edgefield"))
    audio = _element(AUDIO, _float(SAMPLING_FREQUENCY, layout.rate) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    parts = [info, _element(TRACKS, entry)]
    at = sum(map(len, parts))
    cues = []
    step = layout.frame * layout.laced
    ms = lambda sample: sample * 1000 // layout.rate
    for lo in range(0, len(payload), step * layout.blocks):
        begin = ms(lo)
        blocks = []
        for a in range(lo, min(lo + step * layout.blocks, len(payload)), step):
            data = payload[a : a + step]
            sizes = [min(layout.frame, len(data) - i) for i in range(0, len(data), layout.frame)]
            lacing = layout.lacing if len(sizes) > 1 else _NO_LACING
            if lacing == _FIXED and len(set(sizes)) > 1:
                lacing = _EBML
            lace = _laced(sizes, lacing) if lacing else b""
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + (ms(a) - begin).to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1]) + lace + data))
        cluster = _element(CLUSTER, _uint(TIMESTAMP, begin) + b"".join(blocks))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, begin) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return head + _element(SEGMENT, b"".join(parts))


class Packet(NamedTuple):
    track: int
    timestamp: int  # ticks of the file's scale
    start: int  # bytes of the file
    size: int
    cued: bool  # it is the first of a cluster that a cue points to


def _vint(data: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A variable-length integer and where it ends; keep: with its length mark, as ids are. -1: a size that is not known."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError(f"no element at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start of body, end of body) of the elements side by side in a range; a body of unknown size reaches to the end."""
    while at < end:
        id_, at = _vint(data, at, True)
        n, at = _vint(data, at, False)
        stop = end if n < 0 else at + n
        if stop > end:
            raise ValueError(f"element {id_:x} ends after its parent")
        yield id_, at, stop
        at = stop


def _frames(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(track, relative timestamp, start, size) of a block's frames."""
    track, at = _vint(data, at, False)
    when = int.from_bytes(data[at : at + 2], "big", signed=True)
    lacing = data[at + 2] >> 1 & 3
    at += 3
    if lacing == _NO_LACING:
        yield track, when, at, end - at
        return
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == _FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * (n - 1)
    for i in range(n - 1) if lacing != _FIXED else ():
        if lacing == _XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            begin = at
            size, at = _vint(data, at, False)
            if i:
                size = sizes[-1] + size - ((1 << 7 * (at - begin) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    for size in sizes:
        yield track, when, at, size
        at += size


def packets(data: bytes) -> list[Packet]:
    """The packets of a Matroska file, in the order of the file."""
    out: list[Packet] = []
    uint = lambda a, b: int.from_bytes(data[a:b], "big")
    for top, begin, end in _elements(data, 0, len(data)):
        if top != SEGMENT:
            continue
        cued: set[int] = set()
        clusters = []
        for id_, a, b in _elements(data, begin, end):
            if id_ == CUES:
                for _, c, d in _elements(data, a, b):
                    for kind, e, f in _elements(data, c, d):
                        if kind == CUE_TRACK_POSITIONS:
                            cued |= {uint(g, h) for k, g, h in _elements(data, e, f) if k == CUE_CLUSTER_POSITION}
            elif id_ == CLUSTER:
                clusters.append((a, b))
        for a, b in clusters:
            # the cluster's id begins before its size and body: 4 bytes and the size's own
            width = next(w for w in range(1, 9) if data[a - w] >> (8 - w) == 1 and _vint(data, a - w, False)[1] == a and uint(a - w - 4, a - w) == CLUSTER)
            first = a - width - 4 - begin in cued
            base = 0
            for id_, c, d in _elements(data, a, b):
                found: list = []
                if id_ == TIMESTAMP:
                    base = uint(c, d)
                elif id_ == SIMPLE_BLOCK:
                    found = list(_frames(data, c, d))
                elif id_ == BLOCK_GROUP:
                    found = [x for k, e, f in _elements(data, c, d) if k == BLOCK for x in _frames(data, e, f)]
                for track, when, start, size in found:
                    out.append(Packet(track, base + when, start, size, first))
                    first = False
    return out


def feature(samples: np.ndarray, n_packets: int, last: int) -> str:
    """Figures of 8-bit samples: count, packets, last timestamp, mean, power, crossings of the middle, entropy in bits."""
    x = samples.astype(np.int64)
    n = max(1, len(x))
    share = np.bincount(samples, minlength=256) / n
    share = share[share > 0]
    crossings = int(((x[1:] >= 128) != (x[:-1] >= 128)).sum())
    return f"samples={len(x)};packets={n_packets};last_ms={last};mean={x.sum() / n:.6f};power={(x * x).sum() / n:.6f};crossings={crossings};entropy={-(share * np.log2(share)).sum() + 0.0:.6f}"


_PACKETS = pa.list_(pa.struct([("track", pa.int32()), ("timestamp", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("cued", pa.bool_())]))
_STORED = "doc_id long, n_bytes long, media binary, packets array<struct<track:int,timestamp:long,start:long,size:long,cued:boolean>>, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def _padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 if text else 64)


def stored(docs: DataFrame, layout: Layout = Layout(), batch_bytes: int = 4 << 20) -> DataFrame:
    """docs: doc_id, text. One row for each row: the text's bytes as media, its packets, and what reading the media back gives.

    A null text is empty; the payload is the UTF-8 bytes and zeros up to a positive multiple of 64. Equal texts give equal
    media and figures. doc_id is carried as it is, null or repeated. Columns besides doc_id and text are not looked at. No
    rows give no rows."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                raw = text or b""
                media = write(_padded(raw), layout)
                found = packets(media)
                back = b"".join([media[p.start : p.start + p.size] for p in found])
                rows.append((doc_id, len(raw), media, [p._asdict() for p in found], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), feature(np.frombuffer(back, np.uint8), len(found), found[-1].timestamp)))
                held += len(media)
                if held >= batch_bytes:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    def _batch(rows):
        c = list(zip(*rows))
        types = (pa.int64(), pa.int64(), pa.binary(), _PACKETS, pa.int64(), pa.string(), pa.int64(), pa.string())
        names = [x.strip().split(" ")[0] for x in ("doc_id", "n_bytes", "media", "packets", "payload_bytes", "payload_sha256", "tail_crc32", "feature")]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(c, types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text")).mapInArrow(lean(run), _STORED)


def packet_table(media: DataFrame, id_: str = "doc_id") -> DataFrame:
    """One row for each packet of stored(): id, packet number, track, timestamp, start, size, cued."""
    return media.select(id_, F.posexplode("packets").alias("packet", "p")).select(id_, "packet", "p.*")


def digests(media: DataFrame) -> DataFrame:
    return media.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.size("packets").cast("long").alias("n_packets")
    )
