"""Vectorised words and hashes over Arrow string columns.

A word is a maximal run of UTF-8 bytes outside 0x20 and 0x09-0x0D; those bytes never occur inside a multi-byte
character, so everything here works on the raw UTF-8 buffer without decoding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CHUNK = 1 << 17
_BASE = 0x9E3779B97F4A7C13  # odd, and 3 modulo 4
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTE_CODES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits (the public splitmix64 constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and the index of each row's first word (length rows + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    sep = _SEP[data]
    before, after = np.empty(len(sep), bool), np.empty(len(sep), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = sep[:-1], sep[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts] = True
    after[cuts - 1] = True
    word = ~sep
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _INV = _powers(_CHUNK, _BASE), _powers(_CHUNK, _BASE_INV)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit polynomial hash of each byte span (spans ascend); in chunks, so memory stays bounded."""
    out = np.empty(len(starts), np.uint64)
    codes = _BYTE_CODES[_LOWER] if lower else _BYTE_CODES
    i, n = 0, len(starts)
    while i < n:
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _CHUNK - 1, side="right")))
        stop = ends[j - 1]
        size = int(stop - at)
        pow_, inv = (_POW, _INV) if size <= _CHUNK else (_powers(size, _BASE), _powers(size, _BASE_INV))
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(codes[data[at:stop]] * pow_[:size], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64))
        i = j
    return out


def gram_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of every window of ``width`` consecutive word hashes, by doubling; len(words) - width + 1 of them."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    n = len(words) - width + 1
    out, done, power, step, size = None, 0, _BASE, words, 1
    rest = width
    while rest:
        if rest & 1:
            part = step[done : done + n]
            out = part if out is None else out * U64(pow(power, 1, 1 << 64)) + part
            done += size
        rest >>= 1
        if rest:
            step = step[:-size] * U64(power) + step[size:]
            power, size = power * power % (1 << 64), size * 2
    return mix(out)


def row_of(first: np.ndarray, count: int) -> np.ndarray:
    """The row of each word, from ``first`` of word_spans."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


@dataclass
class Planes:
    """Integers as a compressed blob: byte planes of (optionally delta-coded) values, so that small values cost little."""

    @staticmethod
    def pack(values: np.ndarray, width: int = 8, delta: bool = False) -> bytes:
        v = np.ascontiguousarray(values).astype(np.uint64, copy=False) if values.dtype != np.int64 else np.ascontiguousarray(values).view(np.uint64)
        if delta and len(v):
            v = np.concatenate([v[:1], v[1:] - v[:-1]])
            v = (v << U64(1)) ^ (U64(0) - (v >> U64(63)))  # zigzag
        planes = v.view(np.uint8).reshape(-1, 8)[:, :width].T
        return pa.compress(np.ascontiguousarray(planes).tobytes(), "lz4", asbytes=True) if len(v) else b""

    @staticmethod
    def unpack(blob: bytes, count: int, width: int = 8, delta: bool = False) -> np.ndarray:
        if not count:
            return np.zeros(0, np.uint64)
        raw = np.frombuffer(pa.decompress(blob, count * width, "lz4", asbytes=True), np.uint8).reshape(width, count)
        out = np.zeros((count, 8), np.uint8)
        out[:, :width] = raw.T
        v = out.reshape(-1).view(np.uint64)
        if delta:
            v = (v >> U64(1)) ^ (U64(0) - (v & U64(1)))
            v = np.cumsum(v, dtype=np.uint64)
        return v
