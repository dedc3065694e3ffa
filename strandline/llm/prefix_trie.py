"""A trie of conversation prefixes in preorder intervals, built by sorts, prefix sums and joins.

A turn is a 128-bit digest of (role, text) and the text's length. A prefix of a conversation is its depth and a polynomial
hash of its digests modulo the prime 2**127 - 1, which is associative: turns are sorted by range over (conversation,
place), every task scans its stretch, and the one conversation that goes on from an earlier stretch is continued from a
small table of carries, one row a partition. So a conversation may spread over any number of tasks.

Distinct (depth, hash) are the nodes; counts are aggregated before they shuffle. A node's rank in preorder comes from a
lexicographic sort of paths that hold digests only where a parent has several children: nodes of an unbranched run share
one path and sort by depth. A conversation with b branching ancestors needs b others that part from it at b depths, so a
path has fewer than sqrt(2 * turns) digests, however long the conversation. A second kind of row, the path followed by a
code above all digests, marks where the path's subtree ends. One distributed prefix sum over this sequence gives each
node's preorder rank, the leaves and the savings before it; at the mark it gives those up to its subtree's end, and the
difference is the subtree's.

Two prefixes that differ get one hash with a chance of about depth / 2**127.

Defined results: rows without a conv_id belong to no conversation and go; turns sort with null first; turns of equal
number sort by digest, and repeated rows are turns of their own; null role or text is empty. Only the columns conv_id,
turn, role and text are read. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from strandline.llm.scratch import forget, keep, shuffle_partitions

PRIME = (1 << 127) - 1
#: Fixed base of the polynomial: 126 random bits.
BASE = 0x2F3A9C51D6E8B7041C95A2E37F60D18B % PRIME
#: Ids that are joined to one string before the streams of ids meet.
ID_BLOCK = 512
_EMPTY = hashlib.sha256(b"").hexdigest()
_ROOT = bytes(16)
_AFTER = b"\xff" * 17


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, turn, digest, size, tie) of every row with an id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    # the scan's own row number lets repeated rows lie on both sides of a cut
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("tie")
    )


def _sorted(rows: DataFrame, *keys: Column | str) -> DataFrame:
    """Dealt by range over ``keys``, so a conversation or path of any length lies in as many tasks as it needs."""
    return rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def _number(hashed: bool):
    """Adds part, n (place of a row in its conversation, within the task), and prefix and parent hashes up to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n, h = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            conv = batch.column(batch.schema.get_field_index("conv")).to_pylist()
            digest = batch.column(batch.schema.get_field_index("digest")).to_pylist() if hashed else [b""] * len(conv)
            places, hashes, parents = [], [], []
            for c, d in zip(conv, digest):
                if c != last:
                    last, n, h = c, 0, 0
                n += 1
                places.append(n)
                if hashed:
                    parents.append(h.to_bytes(16, "big"))
                    h = (h * BASE + int.from_bytes(d, "big") + 1) % PRIME
                    hashes.append(h.to_bytes(16, "big"))
            more = [pa.array([part] * len(conv), pa.int32()), pa.array(places, pa.int64())] + ([pa.array(hashes, pa.binary()), pa.array(parents, pa.binary())] if hashed else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "n", "hash", "parent"][: len(batch.columns) + len(more)])

    return run


def _carries(rows: DataFrame, hashed: bool) -> dict[int, tuple[int, int, int]]:
    """Partition -> (conversation that goes on there, its turns before, their hash); one row a partition reaches the driver."""
    end = F.struct("conv", "n", *(["hash"] if hashed else []))
    found = rows.groupBy("part").agg(F.min("conv").alias("first"), F.max(end).alias("end")).collect()
    out, conv, n, h = {}, None, 0, 0
    for r in sorted(found, key=lambda r: r["part"]):
        carried, end = r["first"] == conv, r["end"]
        if carried:
            out[r["part"]] = (conv, n, h)
        own = int.from_bytes(end["hash"], "big") if hashed else 0
        goes_on = carried and end["conv"] == conv
        h = (h * pow(BASE, end["n"], PRIME) + own) % PRIME if goes_on else own
        conv, n = end["conv"], end["n"] + (n if goes_on else 0)
    return out


def _carry_on(carries: dict[int, tuple[int, int, int]], hashed: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            columns = dict(zip(names, batch.columns))
            parts, convs, places = (columns[c].to_pylist() for c in ("part", "conv", "n"))
            mine = [i for i, (p, c) in enumerate(zip(parts, convs)) if p in carries and carries[p][0] == c]
            if mine:
                changed = {"n": places} | ({c: columns[c].to_pylist() for c in ("hash", "parent")} if hashed else {})
                for i in mine:
                    _, before, h = carries[parts[i]]
                    if hashed:
                        power = pow(BASE, places[i] - 1, PRIME)
                        for c, step in (("parent", power), ("hash", power * BASE)):
                            changed[c][i] = ((h * step + int.from_bytes(changed[c][i], "big")) % PRIME).to_bytes(16, "big")
                    places[i] += before
                columns |= {c: pa.array(v, columns[c].type) for c, v in changed.items()}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return run


def scan(rows: DataFrame, order: list[Column | str], hashed: bool, label: str) -> DataFrame:
    """``rows`` with n, the place in their conversation under ``order``, and, if ``hashed``, the hashes of the prefix up to them and before them."""
    more = [StructField("part", IntegerType()), StructField("n", LongType())] + ([StructField("hash", BinaryType()), StructField("parent", BinaryType())] if hashed else [])
    schema = StructType([*rows.schema, *more])
    done = keep(_sorted(rows, "conv", *order).mapInArrow(_number(hashed), schema), label)
    return done.mapInArrow(_carry_on(_carries(done, hashed), hashed), schema).drop("part")


def rebuilt(turns: DataFrame, family: int = 5, shares: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conv) of every conversation, and its turns (conv, at, digest, size): of its family's first one, then its own.

    Conversation c takes h = crc32(decimal c) % ``shares`` turns of conversation c - c % ``family``, then its own after h.
    """
    numbered = keep(scan(turns, [F.col("turn").asc_nulls_first(), "digest", "tie"], False, "trie-order").drop("turn", "tie"), "trie-turns")
    share = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(shares))
    ids = numbered.filter("n = 1").select("conv")
    heads = numbered.filter(F.col("n") < shares).select(F.col("conv").alias("base"), F.col("n").alias("at"), "digest", "size")
    lent = ids.withColumn("base", F.col("conv") - F.col("conv") % family).withColumn("h", share(F.col("conv"))).join(heads, "base").filter("at <= h")
    own = numbered.filter(F.col("n") > share(F.col("conv"))).select("conv", F.col("n").alias("at"), "digest", "size")
    return ids, lent.select(*own.columns).unionByName(own)


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds part and the sums of nodes, leaves and savings before each row, within the task."""
    part, nodes, leaves, saved = TaskContext.get().partitionId(), 0, 0, 0
    for batch in batches:
        before = [[], [], []]
        for is_node, is_leaf, save in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("is_node", "is_leaf", "saved"))):
            for out, x in zip(before, (nodes, leaves, saved)):
                out.append(x)
            nodes, leaves, saved = nodes + is_node, leaves + is_leaf, saved + save
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), *[pa.array(b, pa.int64()) for b in before]], names=[*batch.schema.names, "part", "nodes_before", "leaves_before", "saved_before"])


def _prefix_sums(rows: DataFrame) -> DataFrame:
    schema = StructType([*rows.schema, StructField("part", IntegerType()), *[StructField(c, LongType()) for c in ("nodes_before", "leaves_before", "saved_before")]])
    done = keep(_sorted(rows, "path", "depth").mapInArrow(_total, schema), "trie-sums")
    sums, offsets = [0, 0, 0], []
    for r in sorted(done.groupBy("part").agg(F.sum("is_node"), F.sum("is_leaf"), F.sum("saved")).collect()):
        offsets.append((r[0], *sums))
        sums = [a + b for a, b in zip(sums, r[1:])]
    carried = F.broadcast(rows.sparkSession.createDataFrame(offsets, "part int, a long, b long, c long"))  # one row a partition
    added = [(F.col(c) + F.col(x)).alias(c) for c, x in zip(("nodes_before", "leaves_before", "saved_before"), "abc")]
    return done.join(carried, "part").select(*rows.columns, *added)


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's blocks of ids; rows come in order of (hash, depth, block), a block at a time is in memory."""
    key, state, schema = None, None, pa.schema([("hash", pa.binary()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    one = lambda k, s: ([k[0]], [k[1]], [s.hexdigest()])
    for batch in batches:
        rows = []
        for h, depth, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("hash", "depth", "ids"))):
            if (h, depth) == key:
                state.update(b"," + ids.encode())
            else:
                if key is not None:
                    rows.append((*key, state.hexdigest()))
                key, state = (h, depth), hashlib.sha256(ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(one(key, state), schema)], schema=schema)


def _ends(last: DataFrame) -> DataFrame:
    """(hash, depth, ends_sha256) of the nodes at which conversations end.

    Ids join to strings in blocks first; a SHA-256 is sequential, so one task streams a node's blocks, but holds none.
    """
    block = F.floor(F.col("conv") / ID_BLOCK)
    packed = last.groupBy("hash", "depth", block.alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return packed.repartition("hash", "depth").sortWithinPartitions("hash", "depth", "block").mapInArrow(_stream_hashes, "hash binary, depth long, ends_sha256 string")


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations ``ids`` (conv) with ``turns`` (conv, at, digest, size), ordered by ``at``."""
    members = keep(scan(turns, ["at"], True, "trie-scan").withColumnRenamed("n", "depth").drop("at"), "trie-members")
    spark = ids.sparkSession
    ends = members.groupBy("conv").agg(F.max(F.struct("depth", "hash")).alias("end"))
    last = keep(ids.join(ends, "conv", "left").select("conv", F.coalesce("end.hash", F.lit(_ROOT)).alias("hash"), F.coalesce("end.depth", F.lit(0)).cast("long").alias("depth")), "trie-ends")

    counted = members.groupBy("hash", "depth").agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.first("parent").alias("parent"), F.first("digest").alias("digest"), F.first("size").alias("size"))
    root = last.agg(F.lit(_ROOT).alias("hash"), F.lit(0).cast("long").alias("depth"), F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.lit(None).cast("binary").alias("parent"), F.lit(_ROOT).alias("digest"), F.lit(0).cast("long").alias("size")).filter("n_convs > 0")
    alone = keep(counted.unionByName(root), "trie-counted")
    children = alone.filter("depth > 0").groupBy(F.col("parent").alias("hash"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = alone.join(children, ["hash", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = keep(nodes, "trie-nodes")
    of_parent = nodes.select(F.col("hash").alias("parent"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > 1).alias("branches"))
    tree = keep(nodes.join(of_parent, ["parent", "depth"], "left"), "trie-tree")
    forget(alone, nodes)

    # paths: digests below branching nodes, gathered for each node's smallest member
    owners = tree.filter("depth > 0").select("conv_id").distinct().withColumnRenamed("conv_id", "conv")
    turning = tree.filter("branches").select("hash", "depth")
    steps = members.join(owners, "conv", "left_semi").join(turning, ["hash", "depth"]).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "digest"))).alias("steps"))
    placed = tree.join(steps.withColumnRenamed("conv", "conv_id"), "conv_id", "left")
    passed = F.filter("steps", lambda s: s["depth"] <= F.col("depth"))
    path = F.coalesce(F.aggregate(passed, F.lit(b""), lambda a, s: F.concat(a, s["digest"])), F.lit(b""))
    saved = (F.greatest(F.col("n_convs") - 1, F.lit(0)) * F.col("size")).alias("saved")
    paths = keep(placed.select("hash", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", path.alias("path"), saved), "trie-paths")
    forget(tree, members)

    starts = paths.select("path", "depth", "hash", F.lit(1).cast("long").alias("is_node"), (F.col("n_children") == 0).cast("long").alias("is_leaf"), "saved")
    zero = F.lit(0).cast("long")
    marks = paths.select("path").distinct().select(F.concat("path", F.lit(_AFTER)).alias("path"), F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("binary").alias("hash"), zero.alias("is_node"), zero.alias("is_leaf"), zero.alias("saved"))
    sums = keep(_prefix_sums(starts.unionByName(marks)), "trie-summed")
    until = sums.filter("is_node = 0").select(F.expr(f"substring(path, 1, octet_length(path) - {len(_AFTER)})").alias("path"), *[F.col(f"{c}_before").alias(f"{c}_until") for c in ("nodes", "leaves", "saved")])
    spans = sums.filter("is_node = 1").join(until, "path").select("hash", "depth", F.col("nodes_before").alias("preorder"), (F.col("nodes_until") - 1).alias("subtree_end"), (F.col("leaves_until") - F.col("leaves_before")).alias("n_leaves"), (F.col("saved_until") - F.col("saved_before")).alias("saved_tokens"))
    out = paths.drop("path", "saved").join(spans, ["hash", "depth"]).join(_ends(last), ["hash", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"), "preorder", "subtree_end")


def digest(conversations: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    ids, turns = rebuilt(turns_of(conversations))
    return trie(ids, turns)
