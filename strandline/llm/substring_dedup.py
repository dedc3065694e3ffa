"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark, merged into removal intervals.

Rows travel as packed blocks, never one row per window:

1. each task hashes its windows, keeps for every hash only the earliest occurrence in a bounded block (the map-side
   pre-aggregation: a window that a third of all documents share is one entry a block) and deals the rest by hash
   bucket; there are as many buckets as the counted size of the text asks for (``scratch.BUCKET_BYTES``);
2. each bucket finds the hashes that occur again and sends the later starts back, dealt by document;
3. the starts of a document merge into maximal intervals, which join the documents once.

Hashes have 64 bits and are never compared with text: among n windows a false repeat is expected n*n / 2**65 times
(0.0005 over 10**8 windows).

Defined results: a null or empty text has no words; a text shorter than a window loses nothing; a null ``doc_id``
sorts after all others and counts as one document; rows that repeat a ``doc_id`` are that one document: a start that
counts as repeated in one of them is removed in all. Extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.scratch import buckets
from strandline.llm.tokens import Planes, gram_hashes, mix, span_hashes, utf8, word_spans

#: Windows that one map-side block holds at most (a single longer document makes a block of its own).
BLOCK_WINDOWS = 2_000_000
NULL_ID = (1 << 63) - 1
_BLOCK = "key long, flagged boolean, n int, hashes binary, docs binary, starts binary"
_SCHEMA = pa.schema([("key", pa.int64()), ("flagged", pa.bool_()), ("n", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary())])


def _block(key: int, flagged: bool, hashes: np.ndarray | None, docs: np.ndarray, starts: np.ndarray) -> dict:
    return {"key": key, "flagged": flagged, "n": len(docs), "hashes": Planes.pack(hashes) if hashes is not None else None, "docs": Planes.pack(docs, delta=True), "starts": Planes.pack(starts, 4, delta=True)}


def _unblock(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return Planes.unpack(row["docs"], row["n"], delta=True).view(np.int64), Planes.unpack(row["starts"], row["n"], 4, delta=True).view(np.int64)


def _table(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _dealt(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(key, indices in their old order) for keys in [0, n)."""
    order = np.argsort(keys.astype(np.uint16) if n <= 1 << 16 else keys, kind="stable")
    held = keys[order]
    cuts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(held)]):
        yield int(held[a]), order[a:b]


def _flag_rows(docs: np.ndarray, starts: np.ndarray, parts: int) -> Iterator[dict]:
    """Repeated starts, dealt by document."""
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    for part, at in _dealt((mix(docs.view(np.uint64)) % np.uint64(parts)).astype(np.int64), parts):
        yield _block(part, True, None, docs[at], starts[at])


def _earliest(hashes: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True where no equal hash has a smaller (doc, start); equal pairs of both count alike."""
    keep = np.ones(len(hashes), bool)
    order = np.argsort(hashes)
    held = hashes[order]
    same = np.flatnonzero(held[1:] == held[:-1])
    if not len(same):
        return keep
    member = np.zeros(len(held), bool)
    member[same] = member[same + 1] = True
    at = order[member]
    at = at[np.lexsort((starts[at], docs[at], hashes[at]))]
    h, d, s = hashes[at], docs[at], starts[at]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    keep[at] = (d == d[first]) & (s == s[first])
    return keep


def _hash_blocks(width: int, buckets: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashes, docs, starts = (np.concatenate(x) for x in zip(*held))
            first = _earliest(hashes, docs, starts)
            again = ~first
            if again.any():
                for row in _flag_rows(docs[again], starts[again], parts):
                    row["key"] = -1 - row["key"]
                    yield _table([row])
                hashes, docs, starts = hashes[first], docs[first], starts[first]
            out = []
            for bucket, at in _dealt((hashes >> np.uint64(40)).astype(np.int64) % buckets, buckets):
                out.append(_block(bucket, False, hashes[at], docs[at], starts[at]))
                if len(out) == 256:
                    yield _table(out)
                    out = []
            if out:
                yield _table(out)

        for batch in batches:
            ids = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = utf8(batch.column(1))
            row = 0
            while row < len(ids):
                # a slice of rows with about half a block's words, so that hashing holds little at once
                stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + 4_000_000, side="right")) - 1)
                at = offsets[row : stop + 1]
                s, e, first = word_spans(data[at[0] : at[-1]], at - at[0])
                n = np.diff(first)
                grams = gram_hashes(span_hashes(data[at[0] : at[-1]], s, e), width)
                if len(grams):
                    start = np.arange(len(s)) - np.repeat(first[:-1], n)
                    whole = (start + width <= np.repeat(n, n))[: len(grams)]
                    held.append((grams[whole], np.repeat(ids[row:stop], n)[: len(grams)][whole], start[: len(grams)][whole]))
                    count += int(whole.sum())
                if count >= BLOCK_WINDOWS:
                    yield from flush()
                    held, count = [], 0
                row = stop
        if count:
            yield from flush()

    return run


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each key; the rows come sorted by key. Only one key's rows are copied out of Arrow at a time."""
    key, rows = None, []
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
            if row["key"] != key and rows:
                yield key, rows
                rows = []
            key = row["key"]
            rows.append(row)
    if rows:
        yield key, rows


def _repeats(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _by_key(batches):
            if key < 0:  # known from the map side; they only pass through
                yield _table([r | {"key": -1 - key} for r in rows])
                continue
            pairs = [_unblock(r) for r in rows]
            docs, starts = (np.concatenate(x) for x in zip(*pairs))
            hashes = np.concatenate([Planes.unpack(r["hashes"], r["n"]) for r in rows])
            again = ~_earliest(hashes, docs, starts)
            if again.any():
                yield _table(list(_flag_rows(docs[again], starts[again], parts)))

    return run


_SPANS = "doc_id long, begins array<int>, ends array<int>"
_SPANS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def _intervals(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            docs, starts = (np.concatenate(x) for x in zip(*[_unblock(r) for r in rows]))
            order = np.lexsort((starts, docs))
            docs, starts = docs[order], starts[order]
            new_doc = np.concatenate([[True], docs[1:] != docs[:-1]])
            opens = new_doc | np.concatenate([[True], starts[1:] - starts[:-1] > width])
            first = np.flatnonzero(opens)
            last = np.concatenate([first[1:], [len(docs)]]) - 1
            owner = np.flatnonzero(new_doc[first])
            cuts = pa.array(np.concatenate([owner, [len(first)]]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(docs[first][owner]), pa.ListArray.from_arrays(cuts, pa.array(starts[first], pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(starts[last] + width, pa.int32()))], schema=_SPANS_SCHEMA)

    return run


def removal_intervals(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, begins, ends)``: maximal word intervals of each document covered by windows seen earlier.

    A null id comes back as 2**63 - 1. Documents without such windows have no row.
    """
    parts = buckets(docs, text_col)
    blocks = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(_hash_blocks(width, parts, parts), _BLOCK)
    found = blocks.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_repeats(parts), _BLOCK)
    return found.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_intervals(width), _SPANS)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, texts = [], [], []
        for text, begins, ends in zip(batch.column(1), batch.column(2), batch.column(3)):
            words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
            n_words.append(len(words))
            if begins.is_valid:
                kept, at = [], 0
                for b, e in zip(begins.as_py(), ends.as_py()):
                    kept += words[at:b]
                    at = e
                kept += words[at:]
            else:
                kept = words
            n_removed.append(len(words) - len(kept))
            texts.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)`` per row: the words left, joined by one space."""
    spans = removal_intervals(docs, width, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("at"))
    joined = rows.join(spans.withColumnRenamed("doc_id", "at"), "at", "left").select("doc_id", "text", "begins", "ends")
    return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(docs: DataFrame, width: int = 20) -> DataFrame:
    out = remove_repeats(docs, width)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
