"""Suffix-array dedup: sparse suffix arrays over content-selected positions.

Of every ``least - 7`` consecutive 8-word grams the one with the smallest hash is selected; so any passage of ``least``
words holds a selected position, and equal passages select at equal places. Only suffixes that begin at selected
positions are kept (about two in ``least - 6`` positions):

1. their 8-grams travel as packed blocks by hash bucket; those that occur once have no partner and go;
2. the others come back to their documents and leave again with the words around them: ``least`` to the right and
   ``least - 8`` to the left, as 32-bit word codes; within a block, of suffixes with the same surroundings only the first
   stays (the pre-aggregation of passages that many documents share);
3. each bucket sorts its suffixes, and sorts them again by the words to their left read backwards; the common lengths of
   sorted neighbours say how far any two match right and left. A suffix whose match with an earlier one (smaller
   ``doc_id``, or same document and earlier place) reaches ``least`` words over both sides is a repeat;
4. the repeats of a document merge into maximal intervals, which join the documents.

The removed words are exactly those covered by a run of ``least`` words that also starts earlier (as far as 64-bit hashes
of the 8-grams and 32-bit codes of all words of the run tell runs apart).

Defined results: as for substring dedup: a null or empty text has no words, short texts lose nothing, a null ``doc_id``
sorts last, rows that repeat a ``doc_id`` are one document, extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.scratch import buckets
from strandline.llm.substring_dedup import _BLOCK, _SPANS, NULL_ID, _block, _by_key, _dealt, _flag_rows, _intervals, _kept, _table, _unblock
from strandline.llm.tokens import Planes, gram_hashes, mix, span_hashes, utf8, word_spans

GRAM = 8
BLOCK_SUFFIXES = 400_000
BLOCK_CONTEXTS = 60_000


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each run of ``width`` values, by doubling; len(values) - width + 1 of them."""
    step, size = values, 1
    while size * 2 <= width:
        step = pick(step[:-size], step[size:])
        size *= 2
    rest = width - size
    return pick(step[: len(step) - rest], step[rest:]) if rest else step


def select(grams: np.ndarray, inside: np.ndarray, width: int) -> np.ndarray:
    """Positions that hold the smallest value of some run of ``width`` grams; ``inside`` says where such runs begin."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    low = np.where(inside[: len(grams) - width + 1], _sliding(grams, width, np.minimum), np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero((_sliding(padded, width, np.maximum) == grams) & (grams > 0))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, first word of each row) of stretches of about 4 MB of text."""
    data, offsets = utf8(batch.column(1))
    row = 0
    while row < len(batch):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + 4_000_000, side="right")) - 1)
        part, at = data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        s, e, first = word_spans(part, at)
        yield row, stop, span_hashes(part, s, e), first
        row = stop


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def _suffixes(least: int, parts: int):
    width = least - GRAM + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> pa.RecordBatch:
            hashes, docs, places = (np.concatenate(x) for x in zip(*held))
            return _table([_block(key, False, hashes[at], docs[at], places[at]) for key, at in _dealt((hashes >> np.uint64(40)).astype(np.int64) % parts, parts)])

        for batch in batches:
            ids = _ids(batch)
            for row, stop, words, first in _slices(batch):
                grams = gram_hashes(words, GRAM)
                n = np.diff(first)
                left = (np.repeat(first[1:], n) - np.arange(len(words)))[: len(grams)]  # words from here to the end of the row
                at = select(grams, left >= least, width)
                at = at[left[at] >= GRAM]
                owner = np.searchsorted(first, at, side="right") - 1
                held.append((grams[at], ids[row:stop][owner], at - first[owner]))
                count += len(at)
                if count >= BLOCK_SUFFIXES:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()

    return run


def _meeting(parts: int):
    """Places of suffixes whose first words occur again, dealt by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            docs, places = (np.concatenate(x) for x in zip(*[_unblock(r) for r in rows]))
            hashes = np.concatenate([Planes.unpack(r["hashes"], r["n"]) for r in rows])
            order = np.argsort(hashes)
            held = hashes[order]
            same = held[1:] == held[:-1]
            again = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            if len(again):
                yield _table(list(_flag_rows(docs[again], places[again], parts)))

    return run


_PLACES = "at long, places array<int>"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, rows in _by_key(batches):
        docs, places = (np.concatenate(x) for x in zip(*[_unblock(r) for r in rows]))
        order = np.lexsort((places, docs))
        docs, places = docs[order], places[order]
        first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        cuts = pa.array(np.append(first, len(docs)), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(docs[first]), pa.ListArray.from_arrays(cuts, pa.array(places, pa.int32()))], names=["at", "places"])


def _surroundings(words: np.ndarray, places: np.ndarray, least: int) -> np.ndarray:
    """(places, 2 * least - GRAM): codes of the words to the left, read backwards, then to the right; 0 beyond the text."""
    reach = least - GRAM
    codes = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    padded = np.concatenate([np.zeros(reach, np.uint32), codes, np.zeros(least, np.uint32)])
    offsets = np.concatenate([np.arange(-1, -reach - 1, -1), np.arange(least)])
    return padded[reach + places[:, None] + offsets]


_CONTEXT = "key long, n int, docs binary, starts binary, around binary, flagged boolean"
_CONTEXT_SCHEMA = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("docs", pa.binary()), ("starts", pa.binary()), ("around", pa.binary()), ("flagged", pa.bool_())])


def _windows(row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many words stand left, right) of each suffix, up to the reach."""
    reach = least - GRAM
    return (row[:, :reach] > 0).sum(axis=1), (row[:, reach:] > 0).sum(axis=1)


def _contexts(least: int, parts: int):
    reach = least - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            docs, places, around = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((places, docs))
            docs, places, around = docs[order], places[order], around[order]
            # the first of equal surroundings stays; all runs around the others are repeats of runs around it
            odd = mix(np.arange(around.shape[1], dtype=np.uint64)) | np.uint64(1)
            name = mix((around.astype(np.uint64) * odd).sum(axis=1, dtype=np.uint64))
            _, first, which = np.unique(name, return_index=True, return_inverse=True)
            keep = np.zeros(len(docs), bool)
            keep[first] = True
            head = first[which]
            later = np.flatnonzero((docs[head] != docs) | (places[head] != places))  # rows that repeat a document just go
            out = []
            if len(later):
                left, right = _windows(around[later], least)
                back = [np.flatnonzero((left >= o) & (right >= least - o)) for o in range(reach + 1)]
                d = np.concatenate([docs[later[b]] for b in back])
                s = np.concatenate([places[later[b]] - o for o, b in enumerate(back)])
                out = [{k: r[k] for k in ("n", "docs", "starts")} | {"key": -1 - r["key"], "around": None, "flagged": True} for r in _flag_rows(d, s, parts)]
            docs, places, around = docs[keep], places[keep], around[keep]
            grams = around[:, reach : reach + GRAM].astype(np.uint64)
            bucket = (mix((grams * odd[:GRAM]).sum(axis=1, dtype=np.uint64)) % np.uint64(parts)).astype(np.int64)
            for key, at in _dealt(bucket, parts):
                block = _block(key, False, None, docs[at], places[at])
                out.append({k: block[k] for k in ("key", "n", "docs", "starts")} | {"around": pa.compress(np.ascontiguousarray(around[at]).tobytes(), "lz4", asbytes=True), "flagged": False})
            yield pa.RecordBatch.from_pylist(out, schema=_CONTEXT_SCHEMA)

        for batch in batches:
            ids = _ids(batch)
            places = batch.column(2)
            for row, stop, words, first in _slices(batch):
                for i in range(row, stop):
                    at = places[i].values.to_numpy().astype(np.int64)
                    mine = words[first[i - row] : first[i - row + 1]]
                    at = at[at + GRAM <= len(mine)]
                    held.append((np.full(len(at), ids[i]), at, _surroundings(mine, at, least)))
                    count += len(at)
                    if count >= BLOCK_CONTEXTS:
                        yield from flush()
                        held, count = [], 0
        if count:
            yield from flush()

    return run


def _neighbours(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted order of the rows, common length of each with the one before it)."""
    text = np.ascontiguousarray(codes.astype(">u4")).view(f"S{4 * codes.shape[1]}").ravel()
    order = np.argsort(text, kind="stable")
    held = codes[order]
    differ = held[1:] != held[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), codes.shape[1])
    return order, np.concatenate([[0], common])


def repeats(docs: np.ndarray, places: np.ndarray, around: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of every run of ``least`` words around a suffix that also lies around an earlier one."""
    reach = least - GRAM
    order = np.lexsort((places, docs))
    docs, places, around = docs[order], places[order], around[order]
    once = np.ones(len(docs), bool)
    once[1:] = (docs[1:] != docs[:-1]) | (places[1:] != places[:-1]) | (around[1:] != around[:-1]).any(axis=1)
    docs, places, around = docs[once], places[once], around[once]
    left, right = _windows(around, least)
    back_order, back_common = _neighbours(around[:, :reach])
    order, common = _neighbours(around[:, reach:])
    found_docs, found_starts = [], []
    group_left, group_right = np.empty(len(docs), np.int64), np.empty(len(docs), np.int64)
    for o in range(reach + 1):
        fits = np.flatnonzero((left >= o) & (right >= least - o))
        if len(fits) < 2:
            continue
        # neighbours that share at least so many words fall into one group
        group_left[back_order] = np.cumsum(back_common < o)
        group_right[order] = np.cumsum(common < least - o)
        pair = group_left[fits] * (len(docs) + 1) + group_right[fits]
        _, first, which = np.unique(pair, return_index=True, return_inverse=True)
        head = fits[first[which]]
        again = fits[(docs[head] != docs[fits]) | (places[head] != places[fits])]
        found_docs.append(docs[again])
        found_starts.append(places[again] - o)
    if not found_docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_docs), np.concatenate(found_starts)


def _matches(least: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _by_key(batches):
            if key < 0:
                yield _table([{"key": -1 - key, "flagged": True, "n": r["n"], "hashes": None, "docs": r["docs"], "starts": r["starts"]} for r in rows])
                continue
            docs, places = (np.concatenate(x) for x in zip(*[_unblock(r) for r in rows]))
            span = 2 * least - GRAM
            around = np.concatenate([np.frombuffer(pa.decompress(r["around"], 4 * span * r["n"], "lz4", asbytes=True), np.uint32).reshape(-1, span) for r in rows])
            d, s = repeats(docs, places, around, least)
            if len(d):
                yield _table(list(_flag_rows(d, s, parts)))

    return run


def removal_intervals(docs: DataFrame, least: int = 50) -> DataFrame:
    """``(doc_id, begins, ends)``: maximal word intervals covered by repeats of at least ``least`` words."""
    parts = buckets(docs, "text")
    dealt = lambda df: df.repartition(parts, "key").sortWithinPartitions("key")
    rows = _rows(docs)
    suffixes = rows.select("at", "text").mapInArrow(_suffixes(least, parts), _BLOCK)
    places = dealt(dealt(suffixes).mapInArrow(_meeting(parts), _BLOCK)).mapInArrow(_places, _PLACES)
    contexts = rows.join(places, "at").select("at", "text", "places").mapInArrow(_contexts(least, parts), _CONTEXT)
    found = dealt(contexts).mapInArrow(_matches(least, parts), _BLOCK)
    return dealt(found).mapInArrow(_intervals(least), _SPANS)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("at"))


def remove_repeats(docs: DataFrame, least: int = 50) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_text)`` per row."""
    spans = removal_intervals(docs, least).withColumnRenamed("doc_id", "at")
    joined = _rows(docs).join(spans, "at", "left").select("doc_id", "text", "begins", "ends")
    return joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(docs: DataFrame, least: int = 50) -> DataFrame:
    out = remove_repeats(docs, least)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
