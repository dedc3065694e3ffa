"""Byte-level BPE encoding and decoding, pre-tokenised without regular expressions.

Boundaries of a whole batch of texts come from arrays over code points: each has one of four classes (letter, number,
white space, other), tokens begin where the class changes, and a single space joins the token after it. Contractions
need a left-to-right automaton; it runs as an associative scan: the transition function of each code point is a byte
(four states, two bits each), functions are composed through a 256 x 256 table, in blocks whose totals are scanned in
turn. The byte slices between boundaries feed a bounded cache of finished pair merges.

Token ids travel as little-endian unsigned 32-bit integers in a binary column; ``ends`` holds each token's end in the
text's UTF-8 bytes, so a token range maps back to a text range without decoding the rest.

Defined results: a null text counts as empty and has no tokens; texts that hold special-token strings get ordinary
tokens; every other column is left out. Rows never depend on each other.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.tokens import utf8

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Code points with the Unicode property White_Space.
WHITE_SPACE = (0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Merged pieces that one worker remembers; beyond that it starts again.
CACHE_PIECES = 150_000
#: UTF-8 bytes of texts whose boundaries are found together (a longer text alone).
SLICE_BYTES = 1 << 20
_BLOCK = 64


@cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            out[cp] = LETTER
        elif major == "N":
            out[cp] = NUMBER
    out[list(WHITE_SPACE)] = SPACE
    return out


def _function(images: tuple[int, int, int, int]) -> int:
    return sum(state << (2 * i) for i, state in enumerate(images))


_IDENTITY = _function((0, 1, 2, 3))
_IDLE, _ARM = _function((0, 0, 0, 0)), _function((1, 1, 1, 1))
#: States: 0 idle, 1 after an apostrophe that may begin a contraction, 2 after 'r or 'v (wants e), 3 after 'l (wants l).
_R_OR_V, _L = _function((0, 2, 0, 0)), _function((0, 3, 0, 0))


@cache
def _composition() -> np.ndarray:
    """Entry [f * 256 + g] is the function "first f, then g"."""
    f, g = np.divmod(np.arange(1 << 16), 256)
    out = np.zeros(1 << 16, np.int64)
    for state in range(4):
        out |= ((g >> (2 * ((f >> (2 * state)) & 3))) & 3) << (2 * state)
    return out.astype(np.uint8)


def scan_states(functions: np.ndarray) -> np.ndarray:
    """State before each position, from state 0, by an associative scan over transition functions (inclusive in blocks)."""
    n, then = len(functions), _composition()
    rows = -(-n // _BLOCK)
    padded = np.full(rows * _BLOCK, _IDENTITY, np.uint8)
    padded[:n] = functions
    columns = np.ascontiguousarray(padded.reshape(rows, _BLOCK).T)
    for j in range(1, _BLOCK):
        columns[j] = then[(columns[j - 1].astype(np.uint16) << 8) | columns[j]]
    entry = scan_states(columns[-1]) if rows > 1 else np.zeros(1, np.uint8)
    after = ((columns >> (2 * entry)) & 3).T.reshape(-1)[:n]
    before = np.empty(n, np.uint8)
    before[0] = 0
    before[1:] = after[:-1]
    return before


def boundaries(cps: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """True where a token begins; ``firsts`` are the positions at which texts begin."""
    n = len(cps)
    cls = _classes()[cps]
    head = np.zeros(n, bool)
    head[firsts] = True
    run = head.copy()
    run[1:] |= cls[1:] != cls[:-1]
    begin = run.copy()
    # of white space before other text, the last code point stands alone, or joins what follows if it is a space
    joint = np.flatnonzero(run & ~head & (cls != SPACE))
    joint = joint[cls[joint - 1] == SPACE]
    begin[joint - 1] = True
    spaced = joint[cps[joint - 1] == 0x20]
    begin[spaced] = False
    quote = run & (cps == 0x27)
    quote[spaced] = False
    if quote.any():
        function = np.full(n, _IDLE, np.uint8)
        function[(cps == ord("r")) | (cps == ord("v"))] = _R_OR_V
        function[cps == ord("l")] = _L
        function[head] = _IDLE
        function[quote] = _ARM
        state = scan_states(function)
        short = (state == 1) & np.isin(cps, [ord(c) for c in "stmd"])
        long = ((state == 2) & (cps == ord("e"))) | ((state == 3) & (cps == ord("l")))
        for at, size in ((np.flatnonzero(short & ~head), 2), (np.flatnonzero(long & ~head), 3)):
            begin[at - size + 2] = False
            after = at + 1
            begin[after[after < n]] = True
    return begin


def load_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}


def _merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Lowest rank first, leftmost among equals."""
    if piece in ranks:
        return [ranks[piece]]
    none = 1 << 60
    if len(piece) > 200:
        return _merge_long(piece, ranks)
    at = list(range(len(piece) + 1))
    pair = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pair and (low := min(pair)) < none:
        i = pair.index(low)
        del at[i + 1], pair[i]
        if i < len(pair):
            pair[i] = ranks.get(piece[at[i] : at[i + 2]], none)
        if i:
            pair[i - 1] = ranks.get(piece[at[i - 1] : at[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(at, at[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap over a linked list, for pieces of any length."""
    n = len(piece)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class _Pieces(dict):
    """Piece to its ids as little-endian bytes; bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        ids = array("I", _merge(piece, self.ranks)).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


_TABLES: dict[str, tuple] = {}


def _tables(spec: tuple[str, bytes]) -> tuple[_Pieces, list[bytes]]:
    key, lines = spec
    if key not in _TABLES:
        ranks = load_ranks(lines)
        vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            vocabulary[rank] = token
        _TABLES[key] = (_Pieces(ranks), vocabulary)
    return _TABLES[key]


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
        yield row, stop
        row = stop


def split_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Pieces of all texts in order, and the index of each text's first piece (length texts + 1)."""
    if not len(data):
        return [], np.zeros(len(offsets), np.int64)
    raw = data.tobytes()
    cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    byte_at = np.flatnonzero((data & 0xC0) != 0x80)
    heads = np.searchsorted(byte_at, np.unique(offsets[:-1][offsets[:-1] < len(data)]))
    begin = byte_at[boundaries(cps, heads)]
    stops = begin.tolist()
    stops.append(len(raw))
    return [raw[a:b] for a, b in zip(stops, stops[1:])], np.searchsorted(begin, offsets)


def _encode(shared, with_ends: bool, verify: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of, vocabulary = _tables(shared.value)
        lengths = np.array([len(v) for v in vocabulary], np.int64)
        get = pieces_of.__getitem__
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in _slices(offsets):
                pieces, first = split_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                coded = list(map(get, pieces))
                ids = [b"".join(coded[i:j]) for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
                columns = [batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if with_ends:
                    columns.append(pa.array([np.cumsum(lengths[np.frombuffer(x, "<u4")]).astype("<u4").tobytes() for x in ids], pa.binary()))
                if verify:
                    raw = data[offsets[a] : offsets[b]].tobytes()
                    at = (offsets[a : b + 1] - offsets[a]).tolist()
                    columns.append(pa.array([b"".join(map(vocabulary.__getitem__, np.frombuffer(x, "<u4").tolist())) == raw[i:j] for x, i, j in zip(ids, at, at[1:])], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids"] + ["ends"] * with_ends + ["round_trip"] * verify)

    return run


def _decode(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, vocabulary = _tables(shared.value)
        get = vocabulary.__getitem__
        for batch in batches:
            raw, offsets = utf8(batch.column(batch.schema.get_field_index("ids")))
            raw = np.ascontiguousarray(raw)
            for a, b in _slices(offsets):
                texts = [b"".join(map(get, np.frombuffer(raw[offsets[i] : offsets[i + 1]].tobytes(), "<u4").tolist())) for i in range(a, b)]
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, "decoded"])

    return run


def _spec(docs: DataFrame, path: str):
    """The rank file, at most a few MB, read on the driver and broadcast."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast((path, f.read()))


def encode(docs: DataFrame, path: str, with_ends: bool = True, verify: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids, ends)`` of each row; ``path`` names a rank file of base64 tokens and ranks.

    ``verify`` decodes the ids on the spot and adds ``round_trip``: they give the text back.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encode(_spec(docs, path), with_ends, verify), f"doc_id {kind}, n_tokens long, ids binary" + ", ends binary" * with_ends + ", round_trip boolean" * verify)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` with a binary column ``decoded``: the UTF-8 bytes that the ids stand for."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema)
    return tokens.mapInArrow(_decode(_spec(tokens, path)), f"{columns}, decoded binary")


def digest(docs: DataFrame, path: str) -> DataFrame:
    done = decode(encode(docs, path, with_ends=False), path)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
