"""Mixing sources to target weights: a low-discrepancy schedule of equal-word blocks, with DataFrame functions only.

The mix is a schedule of slots, one block each. Slot ``j`` takes the point ``frac(j * golden ratio)`` (computed exactly in
integers modulo 2**32), which falls into the interval of one source among the cumulative targets; the slots of a source
are ranked, and its rank ``q`` takes block ``q`` of that source's shuffled word stream. The stream holds every document
once an epoch, in an order of its own for each epoch, so that no document is used more often than there are epochs.

The number of slots is that of all targets' blocks; how many of them a source gets, and where, is up to the points. The
sequence's discrepancy (a few slots at any length) is how far a source's words may be from its target, besides what a
slot beyond the end of a stream leaves out, where the target is all of it. Blocks have ``block_words`` words, or fewer in
a small mix, so that there are about ``MIN_SLOTS`` slots or more.

Nothing meets in one task that grows with a source: word offsets and slot ranks are two-level prefix sums over
(source, hash chunk) and (source, slot chunk); cumulative targets are joined by equal cells of the unit interval. Only
``sources``, a few numbers each, pass through windows without partitions (millions of sources are too many).

Defined results: a null or empty text has size 0 and is never taken; the null source is a source of its own, after all
others; rows that repeat a ``doc_id`` are documents of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.scratch import keep

WORD = r"[^\x20\x09-\x0D]+"
_GOLDEN = 2654435769  # 2**32 over the golden ratio, rounded
_CELLS = 4096
_CHUNK_DOCS = 4096
_CHUNK_SLOTS = 1 << 13
MIN_SLOTS = 1 << 16


@dataclass
class Mix:
    """The parts of a mix; every frame is lazy over tables already written to the shared folder."""

    documents: DataFrame  # rid, doc_id, source, size
    sources: DataFrame  # source_no, source, source_size, chunks, weight, target
    schedule: DataFrame  # slot, source_no, block
    pieces: DataFrame  # source_no, block, rid, epoch, taken (words of this document in this block)
    block_words: int


def _targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Water-filling over sources: cap ``most`` x size, the rest by weight; one row a source."""
    by_source = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_no"), F.lit(len(weights))) + 1).cast("int"))
    rows = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.greatest(F.ceil(F.count_if(F.col("size") > 0) / _CHUNK_DOCS), F.lit(1)).cast("long").alias("chunks"))
        .withColumn("source_no", F.row_number().over(by_source) - 1)
        .withColumn("weight", w.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(most))
    )
    order = W.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    onward = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(share)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
    # the first source, by cap over weight, that stays under its cap sets the level of all from there on
    final = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "source_no", "level"))).over(W.partitionBy())["level"]
    return rows.withColumn("target", F.least("cap", F.coalesce(final * F.col("weight"), F.col("cap")))).select("source_no", "source", "source_size", "chunks", "weight", "target")


def _chunked_sum(rows: DataFrame, keys: list[str], chunk: str, order: list[Column | str], value: Column) -> DataFrame:
    """Adds ``before``: the exclusive running sum of ``value`` over (chunk, order) within ``keys``, by two-level prefix sums."""
    rows = rows.withColumn("_v", value)
    chunks = rows.groupBy(*keys, chunk).agg(F.sum("_v").alias("_c"))
    base = chunks.withColumn("_base", F.sum("_c").over(W.partitionBy(*keys).orderBy(chunk)) - F.col("_c")).drop("_c")
    inner = F.sum("_v").over(W.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_v")
    return rows.withColumn("_inner", inner).join(base, [*keys, chunk]).withColumn("before", F.col("_base") + F.col("_inner")).drop("_v", "_inner", "_base")


def points(spark: SparkSession, slots: int) -> DataFrame:
    """``(slot, u)``: the golden-ratio sequence in [0, 1)."""
    u = F.pmod((F.col("slot") % (1 << 31)) * F.lit(_GOLDEN), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return spark.range(slots).withColumnRenamed("id", "slot").withColumn("u", u)


def schedule(spark: SparkSession, sources: DataFrame, slots: int, total: float) -> DataFrame:
    """``(slot, source_no, block)``: each point's source among the cumulative targets, and its rank among that source's."""
    upto = F.sum("target").over(W.orderBy("source_no"))
    lines = sources.filter("target > 0").withColumn("hi", upto / F.lit(total)).withColumn("lo", (upto - F.col("target")) / F.lit(total))
    # a sum of floats may end just under 1: the last interval does not
    lines = lines.withColumn("hi", F.when(F.lead("source_no").over(W.orderBy("source_no")).isNull(), F.lit(1.0)).otherwise(F.col("hi")))
    cells = lines.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * _CELLS), F.floor(F.col("hi") * _CELLS)))).select("cell", "lo", "hi", "source_no")
    hits = points(spark, slots).withColumn("cell", F.floor(F.col("u") * _CELLS)).join(cells, "cell").filter("u >= lo and u < hi").select("slot", "source_no")
    ranked = _chunked_sum(hits.withColumn("chunk", F.floor(F.col("slot") / _CHUNK_SLOTS)), ["source_no"], "chunk", ["slot"], F.lit(1))
    return ranked.select("slot", "source_no", F.col("before").alias("block"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, epochs: int = 2, block_words: int = 64, seed: int = 17, carry: tuple[str, ...] = ()) -> Mix:
    """Plan the mix of ``docs`` (doc_id, text, source); see the module for the method. ``carry`` names columns to keep."""
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source", *carry, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    documents = keep(sized.select(F.monotonically_increasing_id().alias("rid"), "*"), "mix-documents")
    sources = keep(_targets(documents, weights, share, float(epochs)), "mix-sources")
    total = float(sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0])
    size = max(1, min(block_words, int(total) // MIN_SLOTS))
    slots, b = round(total / size), F.lit(size)

    # streams: every document once an epoch, by hash within the source
    owner = documents.select("rid", "doc_id", "source", "size").filter("size > 0")
    owner = owner.join(sources.select("source_no", "source", "source_size", "chunks", "target"), owner["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    placed = (
        owner.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
        .withColumn("key", F.xxhash64("doc_id", "epoch", F.lit(seed)))
        .withColumn("chunk", F.pmod("key", F.col("chunks")))
    )
    placed = _chunked_sum(placed, ["source_no", "epoch"], "chunk", ["key", "doc_id", "size", "rid"], F.col("size"))
    begin = F.col("epoch") * F.col("source_size") + F.col("before")
    # blocks far beyond a target meet no slot: a source has no more than its share of all slots and the discrepancy
    reach = F.col("target") + F.lit(1024) * b
    placed = placed.withColumn("begin", begin).withColumn("end", F.col("begin") + F.col("size")).filter(F.col("begin") < reach)
    pieces = (
        placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / b), F.floor((F.col("end") - 1) / b))))
        .withColumn("taken", F.least("end", (F.col("block") + 1) * b) - F.greatest("begin", F.col("block") * b))
        .select("source_no", "block", "rid", "epoch", "taken")
    )
    return Mix(documents, sources, schedule(spark, sources, slots, total), pieces, size)


def scheduled(plan: Mix) -> DataFrame:
    """``(rid, epoch, taken, first_slot)``: the words of each document's copies in scheduled blocks, and where they begin.

    A document's pieces are summed before they are dealt by document, a block of one document being the most a row adds.
    """
    return plan.schedule.join(plan.pieces, ["source_no", "block"]).groupBy("rid", "epoch").agg(F.sum("taken").alias("taken"), F.min("slot").alias("first_slot"))


def taken_words(plan: Mix) -> DataFrame:
    """``(rid, doc_id, source, size, source_size, target, taken, first_slot)`` of each document (no slot: null)."""
    used = scheduled(plan).groupBy("rid").agg(F.sum("taken").alias("taken"), F.min("first_slot").alias("first_slot"))
    owned = plan.documents.join(plan.sources.select("source", "source_size", "target"), plan.documents["source"].eqNullSafe(plan.sources["source"])).drop(plan.sources["source"])
    return owned.join(used, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)))


def digest(docs: DataFrame) -> DataFrame:
    longs = [F.col(c).cast("long").alias(c) for c in ("source_size", "taken")]
    return taken_words(mix(docs)).select("doc_id", "size", longs[0], F.col("target").cast("double").alias("target"), longs[1], "source", "first_slot")
