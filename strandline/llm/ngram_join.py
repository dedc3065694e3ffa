"""N-gram Jaccard self-join by multiple-global-order prefix filtering, and the groups that its links form.

Documents are sets of word shingles; two link when ``100 * common >= percent * union``. Equal sets count as one class
throughout, named by the hash of the set, so copies cost nothing after the first step.

1. Of each class a prefix in the order of the hashes travels first: two linked classes have in common at least as many
   shingles of their prefixes as these are longer than the part that either may have alone. A class that shares fewer with
   all others together links with none and goes, before most of its shingles are ever sent.
2. The shingle hashes of the others travel as packed blocks by hash bucket; each bucket counts in how many classes a shingle
   occurs and sends those that occur in two or more back to their classes. A class whose shared shingles can't reach the threshold has no partner and goes. The others order their shared
   shingles in three global orders (rare first, and two by hash; unshared ones come before all) and keep of each the
   prefix that any partner must meet.
3. Candidates share a rare-first prefix shingle; before verification they must also share one in each other order.
   Verification counts common shingles exactly.
4. Pairs within a list of classes that share a shingle are not all made. First each class meets a few pivots of the
   list; then, of lists that still hold a few components, the classes outside the list's largest component meet the
   members of the others, and lists that hold many are compared block by block, as products of incidence matrices, split by
   set size, beyond which no two link. Every pair that could link is either verified or already within one component.

A shingle is a 56-bit hash and a class a 64-bit one; they are not compared with text.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; a text with
fewer words than a shingle has one shingle, its whole sequence; rows that repeat a ``doc_id`` are documents of their
own; a group's id is its smallest ``doc_id`` (nulls only if all are null). Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.scratch import BUCKET_BYTES, buckets, forget, keep, shuffle_partitions
from strandline.llm.substring_dedup import _by_key
from strandline.llm.tokens import Planes, gram_hashes, mix, span_hashes, utf8, word_spans

BLOCK_TOKENS = 750_000
PIVOTS = 4
#: A prefix is longer by one shingle in so many than the part that a class may have alone.
PREFIX_SHARE = 8
#: Partners that are compared with one copy of a class's shingles.
PARTNERS = 256
#: Rows that go, or stay, which are sent to every task.
BROADCAST_ROWS = 2_000_000
#: Components in a list beyond which its classes are compared in blocks.
CROWDED = 32
_SALTS = (0x51ED2701, 0x2545F491)
_BLOCK = "key long, n int, tokens binary, counts binary, classes binary, sizes binary, dfs binary, k int"
_SCHEMA = pa.schema([("key", pa.int64()), ("n", pa.int32()), ("tokens", pa.binary()), ("counts", pa.binary()), ("classes", pa.binary()), ("sizes", pa.binary()), ("dfs", pa.binary()), ("k", pa.int32())])


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each row, ascending."""
    data, offsets = utf8(texts)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + 1_000_000, side="right")) - 1)
        part, at = data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        s, e, first = word_spans(part, at)
        words = span_hashes(part, s, e, lower=True)
        grams = gram_hashes(words, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1] >> np.uint64(8))
            elif b > a:
                yield mix(gram_hashes(words[a:b], b - a) + np.uint64(b - a)) >> np.uint64(8)
            else:
                yield np.zeros(0, np.uint64)
        row = stop


def _class_of(tokens: np.ndarray) -> int:
    """A hash of the whole set, as a signed 64-bit integer."""
    with np.errstate(over="ignore"):
        total = mix(tokens ^ np.uint64(0xC0FFEE)).sum(dtype=np.uint64) + np.uint64(len(tokens))
        return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(t), _class_of(t) if len(t) else 0) for t in _sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in sets], pa.int64()), pa.array([c for _, c in sets], pa.int64())], names=["doc_id", "n_shingles", "class"])

    return run


def _pack(key: int, tokens: np.ndarray, owner: np.ndarray, classes: np.ndarray, sizes: np.ndarray, dfs: np.ndarray | None = None) -> dict:
    """One block; ``owner`` ascends and numbers the rows of ``classes`` and ``sizes``."""
    used, counts = np.unique(owner, return_counts=True)
    return {
        "key": key, "n": len(tokens), "k": len(used), "tokens": Planes.pack(tokens, 7), "counts": Planes.pack(counts.astype(np.uint64), 4),
        "classes": Planes.pack(classes[used].astype(np.int64)), "sizes": Planes.pack(sizes[used].astype(np.uint64), 4), "dfs": Planes.pack(dfs.astype(np.uint64), 6) if dfs is not None else None,
    }


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, class of each, set size of each)."""
    counts = Planes.unpack(row["counts"], row["k"], 4).astype(np.int64)
    classes, sizes = Planes.unpack(row["classes"], row["k"]).view(np.int64), Planes.unpack(row["sizes"], row["k"], 4).astype(np.int64)
    return Planes.unpack(row["tokens"], row["n"], 7), np.repeat(classes, counts), np.repeat(sizes, counts)


def _dealt(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    cuts = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])).tolist() if len(held) else []
    for a, b in zip(cuts, [*cuts[1:], len(held)]):
        yield int(held[a]), order[a:b]


def _in_blocks(sets: Iterator[tuple[int, int, np.ndarray]], parts: int) -> Iterator[pa.RecordBatch]:
    """Blocks by hash bucket of (class, size of its set, shingles to send); classes that repeat within a block go once."""
    held: dict[int, tuple[int, np.ndarray]] = {}
    count = 0

    def flush() -> pa.RecordBatch:
        classes = np.array(list(held), np.int64)
        sizes = np.array([n for n, _ in held.values()], np.int64)
        tokens, owner = np.concatenate([t for _, t in held.values()]), np.repeat(np.arange(len(held)), [len(t) for _, t in held.values()])
        bucket = ((tokens >> np.uint64(24)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
        return pa.RecordBatch.from_pylist([_pack(key, tokens[at], owner[at], classes, sizes) for key, at in _dealt(bucket)], schema=_SCHEMA)

    for name, n, tokens in sets:
        if name not in held:
            held[name] = n, tokens
            count += len(tokens)
            if count >= BLOCK_TOKENS:
                yield flush()
                held, count = {}, 0
    if count:
        yield flush()


def _least_common(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` has in common with any that it links with, at least."""
    return -(-percent * n // 100)


def _met(n: int, percent: int) -> int:
    """Common shingles that the prefix of a set of ``n`` is sure to hold; it never falls as ``n`` grows."""
    return max(1, min(_least_common(n, percent), 1 + n // PREFIX_SHARE))


def _prefix_blocks(width: int, percent: int, parts: int):
    """Blocks of each set's least hashes: those that it may have alone, and ``_met`` more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = (t for batch in batches for t in _sets(batch.column(0), width) if len(t))
        return _in_blocks(((_class_of(t), len(t), t[: len(t) - _least_common(len(t), percent) + _met(len(t), percent)].copy()) for t in sets), parts)

    return run


def _likely(percent: int):
    """Classes of which enough prefix shingles are in other classes' prefixes.

    Linked sets both have their least common shingles in their prefixes, as many as the lesser ``_met`` of the two; the
    other set has ``_least_common`` shingles at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            _, classes, sizes = (np.concatenate(x) for x in zip(*map(_unpack, rows)))
            names, first, counts = np.unique(classes, return_index=True, return_counts=True)
            enough = [m >= _met(_least_common(n, percent), percent) for m, n in zip(counts.tolist(), sizes[first].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(names[np.array(enough, bool)])], names=["class"])

    return run


def _named_sets(width: int):
    """``(class, tokens)`` of the rows that have words; classes that repeat within a million shingles go once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([t.tobytes() for t in held.values()], pa.binary())], names=["class", "tokens"])

        held: dict[int, np.ndarray] = {}
        count = 0
        for batch in batches:
            for tokens in _sets(batch.column(0), width):
                if len(tokens) and (name := _class_of(tokens)) not in held:
                    held[name] = tokens
                    count += len(tokens)
                    if count >= BLOCK_TOKENS:
                        yield flush()
                        held, count = {}, 0
        if held:
            yield flush()

    return run


def _blocks(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets() -> Iterator[tuple[int, int, np.ndarray]]:
            for batch in batches:
                raw, offsets = utf8(batch.column(1))
                for i, name in enumerate(batch.column(0).to_pylist()):
                    tokens = np.frombuffer(raw[offsets[i] : offsets[i + 1]].tobytes(), np.uint64)
                    yield name, len(tokens), tokens

        return _in_blocks(sets(), parts)

    return run


def _shared(parts: int):
    """Of each bucket: the shingles that two or more classes have, with the number of classes, dealt by class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            tokens, classes, sizes = (np.concatenate(x) for x in zip(*map(_unpack, rows)))
            order = np.argsort(tokens)
            held = tokens[order]
            same = np.flatnonzero(held[1:] == held[:-1])
            member = np.zeros(len(held), bool)
            member[same] = member[same + 1] = True
            at = order[member]
            at = at[np.lexsort((classes[at], tokens[at]))]
            t, c, n = tokens[at], classes[at], sizes[at]
            once = np.ones(len(t), bool)
            once[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            t, c, n = t[once], c[once], n[once]
            if not len(t):
                continue
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            df = np.repeat(np.diff(np.append(first, len(t))), np.diff(np.append(first, len(t))))
            often = df > 1
            t, c, n, df = t[often], c[often], n[often], df[often]
            if not len(t):
                continue
            order = np.argsort(c, kind="stable")
            t, c, n, df = t[order], c[order], n[order], df[order]
            new = np.concatenate([[True], c[1:] != c[:-1]])
            owner, names, size = np.cumsum(new) - 1, c[new], n[new]
            part = (mix(c.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            yield pa.RecordBatch.from_pylist([_pack(key, t[x], owner[x], names, size, df[x]) for key, x in _dealt(part)], schema=_SCHEMA)

    return run


_CLASSES = "class long, n long, tokens binary, first array<long>, second array<int>, third array<int>"


def _prefixes(percent: int):
    """Of each class that can have a partner: its shared shingles and its prefix in each order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["class", "n", "tokens", "first", "second", "third"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for _, rows in _by_key(batches):
            tokens, classes, sizes = (np.concatenate(x) for x in zip(*map(_unpack, rows)))
            dfs = np.concatenate([Planes.unpack(r["dfs"], r["n"], 6) for r in rows])
            out = []
            for name, at in _dealt(classes):
                n = int(sizes[at[0]])
                extra = len(at) - _least_common(n, percent) + 1
                if extra < 1:
                    continue
                t, df = tokens[at], dfs[at]
                low = lambda salt: np.sort(mix(t + np.uint64(salt)) >> np.uint64(33))[:extra].astype(np.int32)  # noqa: B023, E731
                out.append((name, n, np.sort(t).tobytes(), t[np.lexsort((t, df))][:extra].astype(np.int64), low(_SALTS[0]), low(_SALTS[1])))
                if len(out) == 512:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def describe(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, n_shingles, class)`` of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_describe(width), "doc_id long, n_shingles long, class long")


def candidates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Classes that can have a partner, with their shared shingles and prefixes, as a table of the shared folder."""
    least, parts = shuffle_partitions(docs.sparkSession), buckets(docs, "text")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    by_key = lambda blocks, n: blocks.repartition(n, "key").sortWithinPartitions("key")
    few = max(least, math.ceil(parts * (1 - percent / 100 + 1 / PREFIX_SHARE)))
    starts = by_key(texts.mapInArrow(_prefix_blocks(width, percent, 2 * few), _BLOCK), few).mapInArrow(_shared(few), _BLOCK)
    likely = keep(by_key(starts, few).mapInArrow(_likely(percent), "class long"), "ngram-likely")
    # numbers of eight bytes; beyond the bound both sides are shuffled
    side = F.broadcast(likely) if likely.count() <= BROADCAST_ROWS else likely
    # kept, so that no stage has two Python workers a task
    sets = keep(texts.mapInArrow(_named_sets(width), "class long, tokens binary").join(side, "class", "left_semi"), "ngram-sets")
    size = sets.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    parts = max(least, -(-size // BUCKET_BYTES))
    shared = by_key(sets.mapInArrow(_blocks(2 * parts), _BLOCK), parts).mapInArrow(_shared(parts), _BLOCK)
    out = keep(by_key(shared, parts).mapInArrow(_prefixes(percent), _CLASSES), "ngram-classes")
    forget(likely, sets)
    return out


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _verify(percent: int):
    """Rows come sorted: the shingles of ``a`` (no ``b``), then those of each ``b`` to compare with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, size, mine = None, 0, np.zeros(0, np.uint64)
        for batch in batches:
            raw, offsets = utf8(batch.column(3))
            found: list[tuple[int, int]] = []
            for i, (a, b, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                tokens = np.frombuffer(raw[offsets[i] : offsets[i + 1]].tobytes(), np.uint64)
                if b is None:
                    name, size, mine = a, n, tokens
                    continue
                assert a == name, "the shingles of a class must come before its partners"
                both = np.concatenate([mine, tokens])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if 100 * common >= percent * (size + n - common):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links among ``pairs`` (a, b): first the other orders' filters, then exact counts."""
    light = classes.select("class", "second", "third")
    passed = (
        pairs.join(light.toDF("a", "a2", "a3"), "a").join(light.toDF("b", "b2", "b3"), "b")
        .filter(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b")
    )
    full = classes.select(F.col("class"), "n", "tokens")
    # partners of one class come in groups of bounded size, each behind a copy of that class's shingles
    counts = passed.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("groups"))
    grouped = passed.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("part"))
    heads = grouped.select("a", "part").distinct().join(full.withColumnRenamed("class", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "n", "tokens")
    partners = grouped.join(full.withColumnRenamed("class", "b"), "b").select("a", "part", "b", "n", "tokens")
    rows = heads.unionByName(partners).repartition(shuffle_partitions(classes.sparkSession), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "n", "tokens").mapInArrow(_verify(percent), "a long, b long")


def components(links: DataFrame, label: str) -> DataFrame:
    """``(v, root)`` for every vertex of ``links`` (a, b): the smallest vertex reachable, by hooking and pointer jumps.

    Every round keeps its tables in the shared folder and empties those before them; only counts reach the driver.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi != lo").distinct(), label)
    roots = None
    while edges.count():
        jump = keep(edges.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "v"), label)
        while True:
            far = jump.select(F.col("v").alias("root"), F.col("root").alias("next"))
            moved = jump.join(far, "root", "left")
            if not moved.filter(F.col("next").isNotNull()).limit(1).count():
                break
            old, jump = jump, keep(moved.select("v", F.coalesce("next", "root").alias("root")), label)
            forget(old)
        if roots is None:
            merged = None
        else:
            step = jump.toDF("root", "next")
            moved = roots.join(step, "root", "left").select("v", F.coalesce("next", "root").alias("root"))
            merged = keep(moved.unionByName(jump.join(roots, "v", "left_anti")), label)
        hop = lambda side, edges: edges.join(jump.toDF(side, f"{side}_root"), side, "left").withColumn(side, F.coalesce(f"{side}_root", side)).drop(f"{side}_root")  # noqa: B023, E731
        moved = hop("lo", hop("hi", edges)).filter("hi != lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()
        old, edges = edges, keep(moved, label)
        forget(old, *([] if merged is None else [roots, jump]))
        roots = jump if merged is None else merged
    if roots is None:
        return links.sparkSession.createDataFrame([], "v long, root long")
    tops = roots.select(F.col("root").alias("v")).distinct().join(roots, "v", "left_anti").select("v", F.col("v").alias("root"))
    out = keep(roots.unionByName(tops), label)
    forget(edges, roots)
    return out


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def class_roots(classes: DataFrame, percent: int) -> DataFrame:
    """``(v, root)`` of all linked classes."""
    entries = classes.select("class", "n", F.explode("first").alias("token"))

    # each class meets a few pivots of every list it is in
    chosen = [F.min(F.struct(F.xxhash64("class", F.lit(i)).alias("h"), "class", "n")).alias(f"p{i}") for i in range(PIVOTS)]
    lists = entries.groupBy("token").agg(F.count("*").alias("size"), *chosen).filter("size > 1")
    pivots = lists.select("token", F.array_distinct(F.array(*[F.struct(F.col(f"p{i}.class"), F.col(f"p{i}.n")) for i in range(PIVOTS)])).alias("pivots"))
    met = entries.join(pivots, "token").select("class", "n", F.explode("pivots").alias("p"))
    near = met.filter((F.col("class") != F.col("p.class")) & _sizes_fit(F.col("n"), F.col("p.n"), percent))
    pairs = keep(near.select(*_ordered("class", "p.class")).distinct(), "ngram-pairs")
    links = keep(verified(pairs, classes, percent), "ngram-links")
    roots = components(links, "ngram-roots")

    # what is left: classes of lists with several components, and the other components that they meet there
    owned = classes.select("class", "n").join(roots, F.col("class") == roots["v"], "left").withColumn("root", F.coalesce("root", "class")).select("class", "n", "root")
    owned = keep(owned, "ngram-owned")
    named = entries.select("class", "token").join(owned.select("class", "root"), "class")
    held = named.groupBy("token", "root").agg(F.count("*").alias("size"))
    mixed = keep(held.groupBy("token").agg(F.count("*").alias("roots"), F.max(F.struct("size", "root"))["root"].alias("most")).filter("roots > 1"), "ngram-lists")
    clusters = _clusters(named.join(mixed.filter(F.col("roots") > CROWDED).select("token"), "token"))
    within_blocks = keep(_block_links(classes, owned, clusters, percent), "ngram-links")

    few = named.join(mixed.filter(F.col("roots") <= CROWDED), "token").filter("root != most").select("token", "most", "class", F.col("root").alias("own"))
    with_most = few.select("class", F.col("most").alias("root"))
    # of the smaller components of a list, sets of bounded size meet each class; a class unites them before they are rows
    small = few.select("token", "own").distinct()
    parts = small.groupBy("token").agg(F.count("*").alias("own_count")).filter("own_count > 1").select("token", F.ceil(F.col("own_count") / PARTNERS).alias("parts"))
    sets = small.join(parts, "token").groupBy("token", F.pmod(F.xxhash64("own"), F.col("parts"))).agg(F.collect_set("own").alias("roots")).select("token", "roots")
    united = few.join(sets, "token").groupBy("class", "own").agg(F.array_distinct(F.flatten(F.collect_list("roots"))).alias("roots"))
    with_small = united.select("class", "own", F.explode("roots").alias("root")).filter("root > own").select("class", "root")
    meet = with_most.unionByName(with_small).distinct()
    light = owned.join(classes.select("class", "first", "second", "third"), "class").join(clusters, "class", "left")
    x = meet.join(light.select("class", *[F.col(c).alias(f"x_{c}") for c in ("n", "first", "second", "third", "cluster")]), "class")
    apart = ~F.coalesce(F.col("x_cluster") == F.col("cluster"), F.lit(False))  # a cluster's classes have met in blocks
    shares = [F.arrays_overlap(f"x_{c}", c) for c in ("first", "second", "third")]
    unmet = x.withColumnRenamed("class", "x").join(light, "root").filter(apart & _sizes_fit(F.col("n"), F.col("x_n"), percent) & shares[0] & shares[1] & shares[2])
    rest = keep(unmet.select(*_ordered("x", "class")).distinct().join(pairs, ["a", "b"], "left_anti"), "ngram-pairs")
    late = keep(verified(rest, classes, percent), "ngram-links")
    done = components(links.unionByName(within_blocks).unionByName(late), "ngram-roots")
    forget(pairs, links, roots, owned, mixed, within_blocks, rest, late)
    return done


def _incidence(rows: list[np.ndarray], names: np.ndarray) -> np.ndarray:
    """Rows of 0 and 1 over the values ``names`` (ascending)."""
    out = np.zeros((len(rows), len(names)), np.float32)
    for i, row in enumerate(rows):
        at = np.minimum(np.searchsorted(names, row), len(names) - 1)
        out[i, at[names[at] == row]] = 1
    return out


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common values of each row on the left with each on the right, by products of incidence matrices."""
    names = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(names), 8192):
        part = names[at : at + 8192]
        out += _incidence(left, part) @ _incidence(right, part).T
    return out.astype(np.int64)


def _compare_blocks(percent: int):
    """Rows come sorted by unit: all of one or two blocks of classes; gives links that join different components."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        lo, hi = rows[0][1], rows[0][2]
        left = [r for r in rows if r[3] == lo]
        right = left if lo == hi else [r for r in rows if r[3] == hi]
        if not left or not right:
            return []
        arrays = lambda side, k: [np.asarray(r[k]) for r in side]
        root = [np.array([r[6] for r in side]) for side in (left, right)]
        n = [np.array([r[5] for r in side]) for side in (left, right)]
        wanted = root[0][:, None] != root[1][None, :]
        for k in (8, 9, 10):  # the prefix filters of all orders, intersected
            wanted &= _common(arrays(left, k), arrays(right, k)) > 0
            if not wanted.any():
                return []
        tokens = [[np.frombuffer(r[7], np.uint64) for r in side] for side in (left, right)]
        common = _common(*tokens)
        i, j = np.nonzero(wanted & (100 * common >= percent * (n[0][:, None] + n[1][None, :] - common)))
        found, parent = [], {}

        def top(v: int) -> int:
            while parent.get(v, v) != v:
                v = parent[v]
            return v

        for x, y in zip(i.tolist(), j.tolist()):
            p, q = top(int(root[0][x])), top(int(root[1][y]))
            if p != q:  # one link for each two components that meet is enough
                parent[max(p, q)] = min(p, q)
                found.append((left[x][4], right[y][4]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> pa.RecordBatch:
            found = links(rows)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            for i in range(len(batch)):
                row = tuple(c[i].as_py() for c in batch.columns)
                if held and row[:3] != held[0][:3]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    return run


def _clusters(entries: DataFrame) -> DataFrame:
    """``(class, cluster)``: classes that the lists of ``entries`` (class, token) connect."""
    heads = entries.groupBy("token").agg(F.min("class").alias("b"))
    edges = entries.join(heads, "token").select(F.col("class").alias("a"), "b").filter("a != b").distinct()
    return components(edges, "ngram-clusters").toDF("class", "cluster")


def _block_links(classes: DataFrame, owned: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """Links among the classes of a cluster, without a row a pair.

    A cluster is split by set size into bands, a factor of ``100 / percent`` each, and a band into blocks of about
    ``PARTNERS`` classes. Only blocks of one band or of two that adjoin can link; a task of its own compares two blocks
    as matrices.
    """
    unit = F.lit(math.log(100 / percent) * (1 + 1e-9)) if percent < 100 else F.lit(1e-9)
    sized = clusters.join(owned, "class").withColumn("band", F.floor(F.log("n") / unit))
    order = W.partitionBy("cluster").orderBy("band")  # a few dozen bands a cluster
    bands = sized.groupBy("cluster", "band").agg(F.ceil(F.count("*") / PARTNERS).alias("blocks"))
    bands = bands.withColumn("begin", F.sum("blocks").over(order) - F.col("blocks"))
    below = F.when(F.lag("band").over(order) == F.col("band") - 1, F.lag("blocks").over(order)).otherwise(0)
    above = F.when(F.lead("band").over(order) == F.col("band") + 1, F.lead("blocks").over(order)).otherwise(0)
    bands = bands.withColumn("least", F.col("begin") - below).withColumn("most", F.col("begin") + F.col("blocks") + above - 1)
    placed = sized.join(bands, ["cluster", "band"]).withColumn("block", F.col("begin") + F.pmod(F.xxhash64("class"), F.col("blocks")))
    units = placed.withColumn("other", F.explode(F.sequence("least", "most"))).select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "class", "n", "root")
    rows = units.join(classes.select("class", "tokens", "first", "second", "third"), "class").select("cluster", "lo", "hi", "block", "class", "n", "root", "tokens", "first", "second", "third")
    dealt = rows.repartition(shuffle_partitions(classes.sparkSession), "cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi", "class")
    return dealt.mapInArrow(_compare_blocks(percent), "a long, b long")


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of each row."""
    described = keep(describe(docs, width), "ngram-documents")
    classes = candidates(docs, width, percent)
    roots = class_roots(classes, percent)
    least = described.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    named = least.join(roots, least["class"] == roots["v"], "left").select("class", "doc_id", F.coalesce("root", "class").alias("root"))
    best = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    final = keep(named.join(best, "root").select("class", "component_id"), "ngram-final")
    forget(classes, roots)
    return described.join(final, "class", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _describe_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(t), _class_of(t) if len(t) else 0) for t in _sets(batch.column(2), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in sets], pa.int64()), pa.array([c for _, c in sets], pa.int64())], names=["row", "doc_id", "n", "class"])

    return run


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without all but one row of each group that links form: the one of the smallest ``doc_id`` (null last).

    Rows are told apart by a number of their own and not by their ids: a row goes only if its own text is in a group that
    another row of the group represents. Of rows that repeat the smallest id the one of the least text hash stays. Rows
    without words stay. Columns of any name stay.
    """
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("class", T.LongType())])
    rows = keep(given.mapInArrow(_describe_rows(width), schema).withColumn("rid", F.monotonically_increasing_id()), "ngram-rows")
    classes = candidates(rows.select(F.col("row.text").cast("string").alias("text")), width, percent)
    roots = class_roots(classes, percent)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("row.text"), "rid")).alias("first")
    least = rows.filter("n > 0").groupBy("class").agg(first).join(roots, F.col("class") == F.col("v"), "left").groupBy(F.coalesce("root", "class")).agg(F.min("first")["rid"].alias("rid"))
    gone = keep(rows.filter("n > 0").select("rid").join(least.select("rid"), "rid", "left_anti"), "ngram-gone")
    forget(classes, roots)
    # numbers of eight bytes; beyond the bound both sides are shuffled
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return rows.join(side, "rid", "left_anti").select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    return groups(docs, 4, 85)
