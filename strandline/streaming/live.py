"""The timeline's batch aggregates over unbounded input: tumbling, sliding and session windows, first-seen values, counts that new files add to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.coerce import text_of


def live_histogram(stream: DataFrame, time: str, size: str, stack: str | None = None, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """``(start, end, key, n)`` of event-time windows; rows later than ``late`` are dropped and their state is freed."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    key = F.coalesce(F.col(stack).cast("string"), F.lit("")) if stack else F.lit("")
    counts = stream.withWatermark(time, late).groupBy(window.alias("w"), key.alias("key")).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n")


def live_sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``(key, start, end, n)`` of bursts that a gap of silence ends."""
    counts = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; a key may come again only after its state has expired."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def live_alerts(stream: DataFrame, query: str) -> DataFrame:
    """Rows that match a timeline query, as they come."""
    from strandline.plans.query import where

    return where(stream, query)


def with_source(stream: DataFrame) -> DataFrame:
    """Adds ``__source``, the name of the file that a row came from: files that join the folder later are new sources."""
    return stream.withColumn("__source", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1))


_COUNTS = "kind string, name string, value string, n bigint, lo bigint, hi bigint"


def counts(df: DataFrame, names: list[str], time: str | None = None, size: int = 3_600_000) -> DataFrame:
    """``(kind, name, value, n, lo, hi)``: counts of each column's values, and of buckets of ``size`` ms with their first and last time.

    Rows of kind ``facet`` and ``time``; empty text and null are alike, rows without a time are in no bucket. One shuffle of
    partial counts. Counts of several sets of rows merge by ``merged``.
    """
    no = F.lit(None).cast("long")
    cells = [F.struct(F.lit("facet").alias("kind"), F.lit(n).alias("name"), text_of(df, n).alias("value"), no.alias("at")) for n in names]
    if time:
        at = F.unix_millis(F.col(time).cast("timestamp"))
        bucket = (F.floor(at / F.lit(size)) * size).cast("long").cast("string")
        cells.append(F.struct(F.lit("time").alias("kind"), F.lit(time).alias("name"), bucket.alias("value"), at.alias("at")))
    rows = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("value is not null")
    return rows.groupBy("kind", "name", "value").agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))


def merged(parts: DataFrame) -> DataFrame:
    """Counts of all rows from counts of some."""
    return parts.groupBy("kind", "name", "value").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def keep_counts(folder: str, names: list[str], time: str | None = None, size: int = 3_600_000) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the counts of a batch replace what its number wrote before, so a batch that runs twice counts once.

    ``folder`` must be shared by the executors. What a batch writes is as large as its distinct values, not its rows.
    """

    def keep(batch: DataFrame, number: int) -> None:
        counts(batch, names, time, size).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return keep


def kept_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts over all batches so far; no row of a source is read again."""
    return merged(spark.read.schema(_COUNTS).parquet(folder))
