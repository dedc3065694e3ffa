"""Document fingerprints: a randomised edit embedding, sampled bits of it, banding and verification.

The embedding is the shared random walk of Chakraborty, Goldenberg and Koucky (2016): at step ``j`` a text shows the
character at its position ``i`` and moves on by a random bit that depends only on ``j`` and that character. Two texts
walk alike while they agree, and fall back into step soon after an edit, so their edit distance becomes a Hamming
distance. A fingerprint is a sample of the walk at steps chosen alike for all texts: step ``j`` has a random level, and a
text is sampled at the steps of its own level and above, the level growing with its length so that some hundred
characters stay. Each sampled character is stored as four hashed bits. Fingerprints of different levels are compared at
the steps they share.

Texts of a batch walk together, longest first; when few are left, each finishes on its own. A walk ends with its text or
after three steps a character, counted from the start, in either way.

Near copies: fingerprints that agree on a band (8 of their digits, drawn over the whole sample; 24 bands a level) are
compared, and those of likeness 0.8 or more are linked. A class is what links connect; ``near_class`` is its smallest
``doc_id`` and ``near_rows`` its rows. A pair of likeness 0.8 shares a band with chance 0.97 or more; a class then holds every two
alike fingerprints that share one.

Defined results: a null text is empty and has the fingerprint ``0:``; two empty texts are alike (1), an empty and another
are not (0); equal texts have equal fingerprints. Rows are ordered by ``doc_id`` (null last), then by a hash of their text,
then by the text; so repeated ids have a next document too, and the last row's is the first. A single row is its own next
document. Texts must be valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.ngram_join import components
from strandline.llm.scratch import forget, keep, shuffle_partitions
from strandline.llm.tokens import U64, mix

#: Sampled steps of a text, about: half as many to as many (all of a shorter text).
SAMPLES = 512
BANDS, BAND_DIGITS = 24, 8
#: Fingerprints of fewer digits also have bands of SHORT_DIGITS.
SHORT, SHORT_DIGITS = 40, 3
#: Least digits at the next level with which a text can be like one of that level, which has 256 there, give or take 17.
REACH = 120
#: Likeness of a link; members of a band whose pairs are all rows, no more rows than members; members of a block in larger bands.
LEAST, CROWDED, BLOCK = 0.8, 3, 256
_SEED = U64(0x5DEECE66D)
_MOST = (1 << 63) - 1
_FEW = 24
_BATCH_CHARS = 4_000_000
_END = 16  # code of the place after a text's end, where a walk stays
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _step_moves(first: int, count: int) -> np.ndarray:
    """(count, 64): whether a character of each class moves on at each step; class 63, the end, never does."""
    words = mix((np.arange(first, first + count, dtype=np.uint64) + U64(1)) * U64(0x9E3779B97F4A7C15) ^ _SEED)
    bits = np.unpackbits(words.view(np.uint8).reshape(count, 8), axis=1)
    bits[:, 63] = 0
    return bits


def _step_levels(first: int, count: int) -> np.ndarray:
    """Level l with probability 2**-(l+1): trailing zeros of a hash."""
    h = mix((np.arange(first, first + count, dtype=np.uint64) + U64(7)) * U64(0xD1B54A32D192ED03))
    low = h & (U64(0) - h)
    return np.log2(np.maximum(low, U64(1)).astype(np.float64)).astype(np.int64)


def _codes(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of 63 for the walk, four bits to store) of each code point."""
    h = mix(cps.astype(np.uint64) * U64(0xA24BAED4963EE407) + U64(3))
    return (h % U64(63)).astype(np.uint8), ((h >> U64(20)) & U64(15)).astype(np.uint8)


def level_of(n_chars: int) -> int:
    """A walk takes about two steps a character; sampling at level l keeps one step in 2**l."""
    level = 0
    while 2 * n_chars >> level > SAMPLES:
        level += 1
    return level


def _alone(moves: np.ndarray, codes: np.ndarray, at: int, stop: int, level: int, step: int, limit: int) -> bytearray:
    """The rest of one walk, a stretch of steps at a time, up to step ``limit``."""
    out = bytearray()
    while at < stop and step < limit:
        n = min(4096, limit - step)
        bits, levels = _step_moves(step, n).ravel().tolist(), _step_levels(step, n).tolist()
        span, shown = moves[at : at + n + 1].tolist(), codes[at : at + n + 1].tolist()
        k, row, room = 0, 0, stop - at
        for lev in levels:
            if lev >= level:
                out.append(shown[k])
            k += bits[row + span[k]]
            if k >= room:
                break
            row += 64
        at, step = at + k, step + n
    return out


def _walk(texts: list[str]) -> list[bytes]:
    """Sampled codes of each text; the texts should be of similar length."""
    sizes = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    out: list[bytes] = [b""] * len(texts)
    if not len(order):
        return out
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])  # a place for the end after each
    moves, codes = _codes(np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
    ends = begin + sizes
    moves[ends[ends < len(moves)]], codes[ends[ends < len(moves)]] = 63, _END
    moves, codes = np.append(moves, np.uint8(63)), np.append(codes, np.uint8(_END))

    level = np.array([level_of(n) for n in sizes[order].tolist()])
    rows = [bytearray() for _ in order]
    live, at, stop, lev, limit = np.arange(len(order)), begin[order].copy(), ends[order], level, 3 * sizes[order]
    # rows come longest first, so their levels and limits fall: those that sample a step of level l, or have had all their
    # steps, are the last ones
    step, shown = 0, 64
    while len(live) > _FEW:
        bits, levels = _step_moves(step, shown), _step_levels(step, shown)
        begins = np.searchsorted(-lev, -np.minimum(levels, lev[0]), side="left").tolist()
        due = np.searchsorted(-limit, -np.arange(step, step + shown), side="left").tolist()
        seen: list[tuple[int, np.ndarray]] = []
        for j in range(shown):
            if due[j] < len(at):
                at[due[j] :] = stop[due[j] :]
            if begins[j] < len(at):
                seen.append((begins[j], codes[at[begins[j] :]]))
            at += bits[j][moves[at]]
        table = np.full((len(seen), len(live)), 255, np.uint8)
        for j, (b, row) in enumerate(seen):
            table[j, b:] = row
        for column, k in enumerate(live.tolist()):
            rows[k] += table[:, column].tobytes()
        step += shown
        shown = min(2 * shown, 4096)
        held = at < stop
        live, at, stop, lev, limit = live[held], at[held], stop[held], lev[held], limit[held]
    for k, i, e, l, m in zip(live.tolist(), at.tolist(), stop.tolist(), lev.tolist(), limit.tolist()):
        rows[k] += _alone(moves, codes, i, e, l, step, m)
    for k, i in enumerate(order.tolist()):
        # drop the steps of other levels and those after the end; a walk lasts three steps a character at most
        sampled = rows[k].translate(None, b"\xff")
        cut = sampled.find(_END)
        out[i] = bytes(sampled if cut < 0 else sampled[:cut])
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """``level:hex digits`` of each text."""
    out = [""] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    at = 0
    while at < len(order):
        stop, chars = at, 0
        while stop < len(order) and (stop == at or chars + len(texts[order[stop]]) <= _BATCH_CHARS):
            chars += len(texts[order[stop]])
            stop += 1
        part = order[at:stop]
        for i, sampled in zip(part, _walk([texts[i] for i in part])):
            out[i] = f"{level_of(len(texts[i]))}:" + _HEX[np.frombuffer(sampled, np.uint8)].tobytes().decode()
        at = stop
    return out


@cache
def _sample_levels(level: int, count: int) -> np.ndarray:
    """Levels of the first ``count`` steps that a text of this level samples, in order."""
    found, first, missing = [], 0, count
    while missing > 0:
        levels = _step_levels(first, 1 << 20)
        found.append(levels[levels >= level])
        first, missing = first + len(levels), missing - len(found[-1])
    return np.concatenate(found or [np.zeros(0, np.int64)])[:count]


def at_level(fingerprint: str, level: int) -> np.ndarray:
    """Digits at the steps of ``level`` and above; ``level`` is the fingerprint's own or a higher one."""
    own, digits = fingerprint.split(":")
    row = np.frombuffer(digits.encode(), np.uint8)
    return row if int(own) == level else row[_sample_levels(int(own), -(-len(row) // SAMPLES) * SAMPLES)[: len(row)] >= level]


def likeness(a: str, b: str) -> float:
    """Share of equal digits at common steps, over the longer of the two."""
    if a == b:
        return 1.0
    level = max(int(a.split(":")[0]), int(b.split(":")[0]))
    x, y = at_level(a, level), at_level(b, level)
    n = min(len(x), len(y))
    return float((x[:n] == y[:n]).sum() / max(len(x), len(y))) if n else 0.0


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OUT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Results for all rows that are no guards and have the next row in the same part behind them."""
    texts = [r[3] for r in rows]
    done = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
    edited = [edit(texts[i], texts[i + 1]) for i in done]
    both = fingerprints(texts + edited)
    own, changed = both[: len(texts)], both[len(texts) :]
    out = [(rows[i][2], len(texts[i]), hashlib.sha256(e.encode()).hexdigest(), own[i], c, likeness(own[i], c), likeness(own[i], own[i + 1])) for i, e, c in zip(done, edited, changed)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT_SCHEMA)] if out else [pa.array([], f.type) for f in _OUT_SCHEMA], schema=_OUT_SCHEMA)


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    chars = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            held.append(row)
            chars += len(row[3])
            if chars > _BATCH_CHARS:
                yield _rows(held)
                held, chars = [row], len(row[3])
    if held:
        yield _rows(held)


def next_to_each_other(docs: DataFrame) -> DataFrame:
    """``(part, guard, doc_id, text)`` in order within partitions; a part's guard is the first row of the part after it.

    Cut points come from approximate quantiles of the ids; a few numbers a partition reach the driver, and the texts
    are shuffled once. An id that is several quantiles, and a null one, has parts of its own, cut by the hash of the text.
    """
    spark = docs.sparkSession
    parts = 2 * shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found, nulls, total = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts), F.count_if(F.col("doc_id").isNull()), F.count("*")).first()
    times = Counter(found or [])
    hot = {c: n for c, n in times.items() if n > 1}
    cuts = sorted(set(times) | {c + 1 for c in hot if c < _MOST})
    widths = [1, *(hot.get(c, 1) for c in cuts), 1 + parts * nulls // max(total, 1)]  # parts of each stretch between cuts; nulls last
    size = 1
    while size <= len(cuts):
        size *= 2
    padded = F.array(*[F.lit(c).cast("long") for c in cuts], *[F.lit(None).cast("long")] * (size - len(cuts)))
    strides = F.array(*[F.lit(1 << k) for k in reversed(range(size.bit_length() - 1))]) if size > 1 else F.array().cast("array<int>")
    search = F.aggregate(strides, F.lit(0), lambda at, by: F.when(F.get(padded, at + by - 1) <= F.col("doc_id"), at + by).otherwise(at))
    stretch = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(search)
    table = lambda values: F.array(*[F.lit(v) for v in values])
    begins = [sum(widths[:i]) for i in range(len(widths))]
    share = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-1 << 63)), 33)  # the upper 31 bits, in the order of the hash
    inner = F.shiftright(share * F.get(table(widths), F.col("stretch")), 31)
    placed = rows.withColumn("stretch", stretch).withColumn("part", (F.get(table(begins), F.col("stretch")) + inner).cast("int"))
    # the first row of each part, of which there may be copies, guards the end of the part before it
    heads = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("head")).select("part", "head.doc_id", "head.h").collect()
    heads = sorted(tuple(r) for r in heads)
    known = table([h for _, _, h in heads]).cast("array<bigint>")
    before = {p: heads[i - 1][0] for i, (p, _, _) in enumerate(heads)}
    previous = F.get(table([before.get(p, 0) for p in range(sum(widths))]), F.col("part"))
    first = placed.filter(F.array_contains(known, F.col("h"))).groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h", "text")).alias("r"))
    heads_of = {p: h for p, _, h in heads}
    own = F.get(table([heads_of.get(p, 0) for p in range(sum(widths))]).cast("array<bigint>"), F.col("part"))
    guards = first.filter(F.col("r.h") == own).select(previous.cast("int").alias("part"), F.lit(True).alias("guard"), "r.doc_id", "r.h", "r.text")
    dealt = placed.select("part", F.lit(False).alias("guard"), "doc_id", "h", "text").unionByName(guards).repartition(shuffle_partitions(spark), "part")
    return dealt.sortWithinPartitions("part", "guard", F.col("doc_id").asc_nulls_last(), "h", "text").select("part", "guard", "doc_id", "text")


def digest(docs: DataFrame) -> DataFrame:
    """Fingerprints and likenesses of each row, the smallest ``doc_id`` of its near-copy class and the class's rows."""
    rows = keep(next_to_each_other(docs).mapInArrow(_with_next, _OUT), "edit-rows")
    marks = keep(rows.groupBy(F.xxhash64("fingerprint").alias("id")).agg(F.first("fingerprint").alias("fingerprint"), F.min("doc_id").alias("least"), F.count("*").alias("n")), "edit-marks")
    links = _links(marks.select("id", "fingerprint"), LEAST)
    roots = components(links, "edit-roots")
    named = marks.join(roots, F.col("id") == F.col("v"), "left").filter("v is not null or n > 1").select("id", "least", "n", F.coalesce("root", "id").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("near_class"), F.sum("n").alias("near_rows"))
    shared = keep(named.join(best, "root").select("id", "near_class", "near_rows"), "edit-classes")
    forget(marks, links, roots)
    done = rows.withColumn("id", F.xxhash64("fingerprint")).join(shared, "id", "left")
    single = F.col("near_rows").isNull()
    return done.select(*rows.columns, F.when(single, F.col("doc_id")).otherwise(F.col("near_class")).alias("near_class"), F.coalesce("near_rows", F.lit(1)).cast("long").alias("near_rows"))


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(batch.column(1).to_pylist()), pa.string())], names=["doc_id", "fingerprint"])


def fingerprint(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(_fingerprint, "doc_id long, fingerprint string")


@lru_cache(maxsize=4096)
def _picks(n: int, width: int) -> np.ndarray:
    """(BANDS, width): places of each band's digits among ``n``, those of least rank.

    A band ranks all places once, for every ``n``; so two rows of ``x <= y`` digits, ``k`` of them equal, have a band in
    common with chance C(k, width) / C(y, width), wherever the others lie.
    """
    ranks = mix((np.arange(BANDS, dtype=np.uint64)[:, None] << U64(40)) + np.arange(n, dtype=np.uint64)[None, :] + (U64(width) << U64(50)) + U64(11))
    return np.sort(np.argsort(ranks, axis=1, kind="stable")[:, :width], axis=1)


def band_keys(mark: str) -> np.ndarray:
    """The bands of a fingerprint: level, band, width and digits packed into one number each."""
    own, out = int(mark.split(":")[0]), []
    for level in (own, own + 1):  # a text just below the next level meets those just above it
        digits = at_level(mark, level)
        n = len(digits)
        if n < (1 if level == own else REACH):
            continue
        values = np.where(digits > 57, digits - 86, digits - 47).astype(np.int64)  # 1-16
        for width in (BAND_DIGITS, SHORT_DIGITS) if n < SHORT else (BAND_DIGITS,):
            picks = _picks(n, width)
            packed = values[picks] @ (17 ** np.arange(picks.shape[1], dtype=np.int64))
            out.append(((level * BANDS + np.arange(BANDS)) * 2 + (width == SHORT_DIGITS) << 33) + packed)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for at in range(0, len(ids), 2048):
            keys = [band_keys(m) for m in batch.column(1).slice(at, 2048).to_pylist()]
            owners = np.repeat(ids[at : at + 2048], [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(owners)], names=["band", "id"])


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by band: all pairs of a band of up to CROWDED members, the pairs with its first of a larger one."""

    def met(bands: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.append(True, bands[1:] != bands[:-1])) if len(bands) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(cuts, len(bands)))
        out: list[tuple] = []
        for b, n in zip(cuts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            i, j = np.triu_indices(n, 1) if n <= CROWDED else (np.zeros(n - 1, np.int64), np.arange(1, n))
            out.append((np.full(len(i), bands[b]), ids[b + i], ids[b + j], np.full(len(i), n > CROWDED)))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["band", "a", "b", "crowded"])

    bands, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        bands, ids = np.append(bands, batch.column(0).to_numpy()), np.append(ids, batch.column(1).to_numpy())
        whole = int(np.searchsorted(bands, bands[-1])) if len(bands) else 0
        if whole:
            yield met(bands[:whole], ids[:whole])
            bands, ids = bands[whole:], ids[whole:]
    yield met(bands, ids)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [likeness(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["a", "b", "likeness"])


def _likenesses(left: list[str], right: list[str]) -> np.ndarray:
    """``likeness`` of each fingerprint on the left with each on the right."""
    owns = [np.array([int(m.split(":")[0]) for m in side]) for side in (left, right)]
    level_by = np.maximum(owns[0][:, None], owns[1][None, :])
    out = np.zeros(level_by.shape)
    for level in np.unique(level_by).tolist():
        at = [np.flatnonzero(o <= level) for o in owns]
        rows = [[at_level(side[i], level) for i in a.tolist()] for side, a in zip((left, right), at)]
        sizes = [np.array([len(r) for r in side]) for side in rows]
        width = int(max(s.max() for s in sizes))
        tables = [np.full((len(side), width), pad, np.uint8) for side, pad in zip(rows, (0, 1))]
        for table, side in zip(tables, rows):
            for i, r in enumerate(side):
                table[i, : len(r)] = r
        for i, row in enumerate(tables[0]):
            same = np.count_nonzero(tables[1] == row, axis=1) / np.maximum(np.maximum(sizes[1], sizes[0][i]), 1)
            here = level_by[at[0][i], at[1]] == level
            out[at[0][i], at[1][here]] = same[here]
    return out


def _compare(least: float):
    """Rows come sorted by unit: all of one or two blocks of a band; a link for each two components that meet."""

    def links(rows: list[tuple]) -> list[tuple[int, int, float]]:
        left = [r for r in rows if r[3] == rows[0][1]]
        right = left if rows[0][1] == rows[0][2] else [r for r in rows if r[3] == rows[0][2]]
        if not left or not right:
            return []
        roots = [np.array([r[5] for r in side]) for side in (left, right)]
        share = _likenesses(*[[r[6] for r in side] for side in (left, right)])
        found, parent = [], {}

        def top(v: int) -> int:
            while parent.get(v, v) != v:
                v = parent[v]
            return v

        for i, j in zip(*(x.tolist() for x in np.nonzero((share >= least) & (roots[0][:, None] != roots[1][None, :])))):
            p, q = top(int(roots[0][i])), top(int(roots[1][j]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                found.append((left[i][4], right[j][4], float(share[i, j])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            found = links(rows)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "likeness"])

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[:3] != held[0][:3]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    return run


def _second_round(crowded: DataFrame, roots: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """Links between members of crowded bands that the first round left in different components, all of them compared.

    A band's largest component needs no look inside; the other members meet it and one another, block by block.
    """
    members = crowded.select("band", F.col("b").alias("id")).unionByName(crowded.select("band", F.col("a").alias("id")).distinct())
    named = members.join(roots, F.col("id") == F.col("v"), "left").select("band", "id", F.coalesce("root", "id").alias("root"))
    held = named.groupBy("band", "root").agg(F.count("*").alias("size"))
    mixed = held.groupBy("band").agg(F.sum("size").alias("all"), F.max(F.struct("size", "root")).alias("most"), F.count("*").alias("roots")).filter("roots > 1")
    blocks = mixed.select("band", F.col("most.root").alias("most"), F.ceil((F.col("all") - F.col("most.size")) / BLOCK).alias("others"), F.ceil(F.col("most.size") / BLOCK).alias("mosts"))
    own = F.when(F.col("root") == F.col("most"), F.col("others") + F.pmod(F.xxhash64("id"), F.col("mosts"))).otherwise(F.pmod(F.xxhash64("id"), F.col("others")))
    placed = named.join(blocks, "band").withColumn("block", own)
    met = F.when(F.col("root") == F.col("most"), F.col("others")).otherwise(F.col("others") + F.col("mosts"))
    units = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), met - 1))).select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "root")
    dealt = units.join(marks, "id").select("band", "lo", "hi", "block", "id", "root", "fingerprint")
    return dealt.repartition(shuffle_partitions(marks.sparkSession), "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "id").mapInArrow(_compare(least), "a long, b long, likeness double")


def _links(marks: DataFrame, least: float) -> DataFrame:
    """``(a, b, likeness)`` of ids of ``marks`` (id, fingerprint), whose fingerprints are distinct."""
    spark = marks.sparkSession
    banded = marks.select("id", "fingerprint").mapInArrow(_bands, "band long, id long")
    dealt = banded.repartition(shuffle_partitions(spark), "band").sortWithinPartitions("band", "id")
    meetings = keep(dealt.mapInArrow(_meetings, "band long, a long, b long, crowded boolean"), "edit-bands")
    side = lambda name: marks.select(F.col("id").alias(name), F.col("fingerprint").alias(f"{name}_mark"))
    pairs = meetings.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_mark", "b_mark")
    links = keep(pairs.mapInArrow(_alike, "a long, b long, likeness double").filter(F.col("likeness") >= least), "edit-links")
    crowded = meetings.filter("crowded")
    if crowded.limit(1).count():
        roots = components(links, "edit-roots")
        old, links = links, keep(links.unionByName(_second_round(crowded, roots, marks, least)), "edit-links")
        forget(old, roots)
    forget(meetings)
    return links


def near_links(marks: DataFrame, least: float = LEAST) -> DataFrame:
    """``(a, b, likeness)``: verified links of distinct fingerprints, by bit-sampled banding.

    Equal fingerprints collapse first. In a band of up to CROWDED members every two are compared. In a larger one each is
    compared with the first, and then with every member in another component; links within a component are left out
    there, so any two alike fingerprints that share a band are connected, and no pair list is quadratic.
    """
    named = keep(marks.select("fingerprint").distinct().select(F.xxhash64("fingerprint").alias("id"), "fingerprint"), "edit-marks")
    links = _links(named, least)
    return links.toDF("x", "y", "likeness").join(named.toDF("x", "a"), "x").join(named.toDF("y", "b"), "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
