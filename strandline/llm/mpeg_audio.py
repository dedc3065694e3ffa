"""Media columns: MPEG audio streams, written to carry bytes and parsed for tags, frames, checksums and seek tables.

The parser reads any MPEG-1/2/2.5 stream of layers I-III: ID3v2 and ID3v1 tags, Xing/Info and VBRI tables with their seek
points, and frame headers, resynchronising after damage on the next header that another header (or the end) follows. The
checksums of all three layers are verified. The last 128 bytes are an ID3v1 tag only where no frame goes through
them that the end of the stream, or a further header, follows. Durations are exact: samples over the sampling rate. The writer stores bytes losslessly as the bodies of layer III frames with checksums,
with a variable bitrate: full frames at 320 kbit/s and one smaller frame for the rest, behind an ID3v2 tag that holds
the length and a Xing frame with the counts and the seek table.

Defined results: a null text is empty and its payload is 64 zero bytes; bytes that hold no frame give zero frames and a
zero duration; equal texts give equal streams. Extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.scratch import keep

#: Fixed values of the MPEG audio frame header, by (version 1 or 2, layer): kbit/s of bitrate index 1-14.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Sampling rates of MPEG-1; MPEG-2 has half, MPEG-2.5 a quarter.
RATES = (44100, 48000, 32000)
#: Fixed values of layer II: (subbands, bits of their allocation fields) runs of the five allocation tables.
ALLOCATION = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}
RATE, PADDED = 48000, 64


@dataclass(frozen=True)
class Header:
    size: int
    samples: int
    rate: int
    kbps: int
    side: int  # bytes of side information that a checksum covers (layer III)
    crc: bool
    layer: int
    channels: int
    bound: int  # the first subband that both channels share (layers I and II)
    table: str  # of ALLOCATION (layer II)


@lru_cache(maxsize=4096)
def frame_header(four: bytes) -> Header | None:
    """The frame that these four bytes announce, or None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = {3: 1.0, 2: 2.0, 0: 2.5}.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    bitrate, rate, pad, mono = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1, four[3] >> 6 == 3
    if version is None or layer == 4 or bitrate in (0, 15) or rate == 3:
        return None
    kbps = BITRATES[1 if version == 1 else 2, layer][bitrate - 1]
    hertz = RATES[rate] // {1.0: 1, 2.0: 2, 2.5: 4}[version]
    samples = {1: 384, 2: 1152, 3: 1152 if version == 1 else 576}[layer]
    size = (12 * kbps * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hertz + pad
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    channels, joint = 1 if mono else 2, four[3] >> 6 == 1
    bound = 4 * (four[3] >> 4 & 3) + 4 if joint else 32
    each = kbps // channels
    table = "lsf" if version != 1 else ("d" if hertz == 32000 else "c") if each <= 48 else "a" if hertz == 48000 or each <= 80 else "b"
    return Header(size, samples, hertz, kbps, side, not four[1] & 1, layer, channels, bound, table)


@cache
def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
        out.append(crc)
    return out


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005 from 0xFFFF."""
    crc, table = 0xFFFF, _crc_table()
    for byte in data:
        crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ byte]
    return crc


def _crc_bits(bits: str) -> int:
    """The same checksum over a number of bits that need not fill bytes."""
    crc = 0xFFFF
    for bit in bits:
        crc = (crc << 1 ^ 0x8005 * ((crc >> 15) ^ int(bit))) & 0xFFFF
    return crc


def checksum(data: bytes, at: int, h: Header) -> int:
    """What the checksum of the frame at ``at`` should be: of the last two header bytes and the fields that it protects."""
    body = at + 6
    if h.layer == 3:
        return crc16(data[at + 2 : at + 4] + data[body : body + h.side])
    raw = data[body : at + h.size][:128]
    bits = "".join(f"{b:08b}" for b in raw)
    if h.layer == 1:
        used = 4 * (32 * h.channels if h.channels == 1 else 32 + h.bound)
    else:
        used, chosen = 0, 0
        widths = [w for n, w in ALLOCATION[h.table] for _ in range(n)]
        for band, width in enumerate(widths):
            shared = h.channels == 2 and band >= h.bound
            for _ in range(1 if shared else h.channels):
                chosen += ("1" in bits[used : used + width]) * (h.channels if shared else 1)
                used += width
        used += 2 * chosen  # the scale factor selection of each allocated subband and channel
    return _crc_bits("".join(f"{b:08b}" for b in data[at + 2 : at + 4]) + bits[:used])


@dataclass
class Stream:
    offsets: list[int] = field(default_factory=list)  # where each frame begins: the exact seek table
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bits: int = 0
    checked: int = 0
    broken: int = 0
    resyncs: int = 0
    tags: dict = field(default_factory=dict)
    table: dict = field(default_factory=dict)  # of Xing, Info or VBRI
    bodies: list[bytes] = field(default_factory=list)


def _id3v2(data: bytes, at: int, tags: dict) -> int:
    """Reads a tag at ``at`` and returns where it ends; text frames by name, TXXX by description."""
    syncsafe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    major, end = data[at + 3], at + 10 + syncsafe(data[at + 6 : at + 10])
    p = at + 10
    while p + 10 <= min(end, len(data)) and data[p] and major in (3, 4):
        name, raw = data[p : p + 4].decode("latin-1"), data[p + 4 : p + 8]
        size = syncsafe(raw) if major == 4 else int.from_bytes(raw, "big")
        body = data[p + 10 : p + 10 + size]
        if name[0] == "T" and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value.rstrip("\0")
        p += 10 + size
    return end + 10 * (data[at + 5] >> 4 & 1)


def _rate_table(data: bytes, at: int, h: Header) -> dict:
    """The Xing, Info or VBRI table of the frame at ``at``, if it has one."""
    for p in (at + 4 + h.side, at + 6 + h.side):
        if data[p : p + 4] in (b"Xing", b"Info"):
            out, flags, q = {"kind": data[p : p + 4].decode()}, int.from_bytes(data[p + 4 : p + 8], "big"), p + 8
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[key], q = int.from_bytes(data[q : q + 4], "big"), q + 4
            if flags & 4:
                out["seek"] = list(data[q : q + 100])
            return out
    if data[at + 36 : at + 40] == b"VBRI":
        total, frames, entries, scale, wide, step = struct.unpack(">IIHHHH", data[at + 46 : at + 62].ljust(16, b"\0"))
        raw = [data[at + 62 + wide * i : at + 62 + wide * (i + 1)] for i in range(entries)]
        seek = [scale * int.from_bytes(x, "big") for x in raw if len(x) == wide]
        return {"kind": "VBRI", "bytes": total, "frames": frames, "seek": seek, "step": step}
    return {}


def _resync(data: bytes, at: int, end: int) -> int:
    """The next header that a second header, or the end, follows; ``end`` if none."""
    view = np.frombuffer(data, np.uint8)
    for p in (np.flatnonzero((view[at : end - 3] == 0xFF) & (view[at + 1 : end - 2] & 0xE0 == 0xE0)) + at).tolist():
        h = frame_header(data[p : p + 4])
        if h and (p + h.size == end or p + h.size + 4 <= end and frame_header(data[p + h.size : p + h.size + 4])):
            return p
    return end


def parse(data: bytes, with_bodies: bool = False) -> Stream:
    out, at, end = Stream(), 0, len(data)
    tail = end - 128 if end >= 128 and data[-128:-125] == b"TAG" else end  # an ID3v1 tag, unless a frame goes through it
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at = _id3v2(data, at, out.tags)
    first = True
    while at + 4 <= end:
        if at == tail < end:
            out.tags["id3v1_title"] = data[tail + 3 : tail + 33].rstrip(b"\0 ").decode("latin-1")
            break
        h = frame_header(data[at : at + 4])
        stop = tail if at < tail else end
        goes_on = h and (at + h.size == end or at + h.size + 4 <= end and frame_header(data[at + h.size : at + h.size + 4]))
        if h is None or at + h.size > stop and not goes_on:
            to = _resync(data, at + 1, stop) if at + 1 < stop - 3 else stop
            out.resyncs += to < stop
            at = to
            continue
        if first:
            first = False
            if found := _rate_table(data, at, h):
                out.table = found
                at += h.size
                continue
        body = at + 4
        if h.crc:
            body += 2
            out.checked += 1
            out.broken += checksum(data, at, h) != int.from_bytes(data[at + 4 : at + 6], "big")
        out.offsets.append(at)
        out.sizes.append(h.size)
        out.samples += h.samples
        out.rate = out.rate or h.rate
        out.bits += 8 * h.size
        if with_bodies:
            out.bodies.append(data[body + h.side : at + h.size])
        at += h.size
    return out


def _head(kbps: int) -> tuple[bytes, int]:
    """(header, checksum and empty side information; room for bytes) of a mono frame at 48 kHz."""
    four = bytes((0xFF, 0xFA, (BITRATES[1, 3].index(kbps) + 1) << 4 | 1 << 2, 0xC0))
    side = bytes(17)
    return four + crc16(four[2:] + side).to_bytes(2, "big") + side, 3 * kbps - 23


@cache
def _heads() -> list[tuple[int, bytes]]:
    return [(room, head) for head, room in map(_head, BITRATES[1, 3])]


def write(payload: bytes) -> bytes:
    """An MPEG-1 layer III stream whose frame bodies are ``payload``."""
    room, head = _heads()[-1]
    frames = [head + payload[i : i + room] for i in range(0, len(payload) // room * room, room)]
    if rest := payload[len(frames) * room :]:
        room, head = next(x for x in _heads() if x[0] >= len(rest))
        frames.append(head + rest.ljust(room, b"\0"))
    text = b"\x03payload_bytes\0" + str(len(payload)).encode()
    safe = lambda n: bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    frame = b"TXXX" + safe(len(text)) + b"\0\0" + text
    tag = b"ID3\x04\0\0" + safe(len(frame)) + frame
    total = 144 + sum(map(len, frames))
    big = len(frames[0])  # all frames but the last have this size
    seek = bytes(min(255, (144 + len(frames) * k // 100 * big) * 256 // total) for k in range(100))
    xing = (bytes((0xFF, 0xFB, 3 << 4 | 1 << 2, 0xC0)) + bytes(17) + b"Xing" + struct.pack(">III", 7, len(frames), total) + seek).ljust(144, b"\0")
    return tag + xing + b"".join(frames)


def read(media: bytes) -> tuple[bytes, Stream]:
    """The bytes that ``write`` stored, and what the parser found."""
    stream = parse(media, with_bodies=True)
    said = re.fullmatch(r"\d+", stream.tags.get("payload_bytes", ""))
    body = b"".join(stream.bodies)
    return body[: int(said[0])] if said else body, stream


def padded(data: bytes) -> bytes:
    return data.ljust(max(PADDED, -(-len(data) // PADDED) * PADDED), b"\0")


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 512):
            rows = batch.slice(at, 512)
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in rows.column(1)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([write(padded(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])


def feature(s: Stream) -> str:
    """Counts, exact duration and every tenth of the seek table, as text."""
    n = len(s.offsets)
    seek = ",".join(str(s.offsets[n * k // 10]) for k in range(10)) if n else ""
    return f"frames={n};duration={s.samples}/{s.rate or 1};kbps={s.bits * s.rate // (1000 * s.samples) if s.samples else 0};crc={s.checked - s.broken}/{s.checked};resyncs={s.resyncs};table={s.table.get('kind', '-')}:{s.table.get('frames', '-')};seek={seek}"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for batch in batches:
        for at in range(0, len(batch), 512):
            rows = batch.slice(at, 512)
            out = []
            for doc_id, n_bytes, media in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist()):
                payload, s = read(media)
                out.append((doc_id, n_bytes, len(payload), sha(payload), zlib.crc32(payload[-PADDED:]), len(media), sha(media), feature(s), s.samples / s.rate if s.rate else 0.0, s.offsets))
            kinds = [rows.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seconds", "frame_offsets"])


def store(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text as a stream, written to a shared table and read back from it."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return keep(rows.mapInArrow(_encode, f"doc_id {kind}, n_bytes long, media binary"), "mpeg-audio")


def features(media: DataFrame) -> DataFrame:
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        _decode,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, frame_offsets array<long>",
    )


def digest(docs: DataFrame) -> DataFrame:
    return features(store(docs)).drop("frame_offsets")
