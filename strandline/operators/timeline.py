"""Time axis, windows, marks and time-bucket aggregation."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.coerce import text_of
from strandline.functions.timeparse import column_millis, relative_millis
from strandline.plans.pushdown import window
from strandline.sources.folder import work_path

#: Bucket sizes in milliseconds.
BUCKETS = {"1s": 1_000, "10s": 10_000, "1m": 60_000, "5m": 300_000, "15m": 900_000, "1h": 3_600_000, "6h": 21_600_000, "1d": 86_400_000, "1w": 604_800_000}
TARGET_BUCKETS = 80


def with_time(df: DataFrame, name: str) -> DataFrame:
    """Adds ``_t``: the row's time in UTC milliseconds (or a plain number), null where there is none."""
    return df.withColumn("_t", column_millis(df, name))


def with_row_id(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``_row_id``, which only orders rows: by the given columns if any (as one struct), else as they were read."""
    return df.withColumn("_row_id", F.struct(*order) if order else F.monotonically_increasing_id())


def data_range(df: DataFrame) -> tuple[float, float] | None:
    """Smallest and largest time; a single time becomes a second around it."""
    lo, hi = df.agg(F.min("_t"), F.max("_t")).first()
    if lo is None:
        return None
    return (lo - 500, hi + 500) if lo == hi else (lo, hi)


def auto_bucket(span: float, target: int = TARGET_BUCKETS) -> int:
    if span <= 0:
        return 60_000
    return next((b for b in BUCKETS.values() if b >= span / target), BUCKETS["1w"])


def auto_bucket_number(span: float, target: int = TARGET_BUCKETS) -> float:
    """A step of 1, 2, 2.5, 5 or 10 times a power of ten."""
    if span <= 0 or not math.isfinite(span):
        return 1
    ideal = span / target
    power = 10 ** math.floor(math.log10(ideal))
    return next(n for n in (1, 2, 2.5, 5, 10) if ideal / power <= n) * power


def clip(df: DataFrame, lo: float | None = None, hi: float | None = None, on: str | None = None) -> DataFrame:
    """Rows in the inclusive window; rows without a time go only if a window is set.

    ``on`` names the column that ``_t`` was made of; its bounds then reach the scan.
    """
    if lo is None and hi is None:
        return df
    raw = window(df, on, lo, hi) if on else None
    df = df if raw is None else df.filter(raw)
    low, high = F.lit(float("-inf") if lo is None else float(lo)), F.lit(float("inf") if hi is None else float(hi))
    return df.filter(F.col("_t").between(low, high))


def preset_window(span: tuple[float, float], preset: str) -> tuple[float, float]:
    """A window that ends at the latest time: ``24h``, ``today``, ``week`` (from Monday), ``first_half``, ``full``."""
    lo, hi = span
    day = 86_400_000
    if preset == "full":
        return lo, hi
    if preset in ("first_half", "second_half"):
        return (lo, (lo + hi) / 2) if preset == "first_half" else ((lo + hi) / 2, hi)
    if preset == "today":
        begin = hi // day * day
    elif preset == "week":
        begin = ((hi // day + 3) // 7 * 7 - 3) * day
    else:
        size = relative_millis(preset)
        if size is None:
            raise ValueError(f"unknown preset {preset!r}")
        begin = hi - size
    return max(lo, begin), hi


def with_sus(df: DataFrame, marks: Iterable[tuple[str | None, str]]) -> DataFrame:
    """Adds ``_sus``: some mark (column or None for any, text) occurs, letter case ignored. Marks tint, they never filter."""
    names = {c.lower(): c for c in df.columns}
    hits = F.lit(False)
    for column, needle in marks:
        if column is None:
            hay = F.concat_ws("\n", *[text_of(df, c) for c in df.columns if not c.startswith("_")])
        elif column.lower() in names:
            hay = text_of(df, names[column.lower()])
        else:
            continue
        hits = hits | F.contains(F.lower(hay), F.lit(needle.lower()))
    return df.withColumn("_sus", hits)


def with_detection(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Adds ``_detection``: the row's ``key`` is among ``ids`` (one column of the same name)."""
    known = ids.select(F.col(key)).distinct().withColumn("_hit", F.lit(True))
    return df.join(known, key, "left").withColumn("_detection", F.coalesce("_hit", F.lit(False))).drop("_hit")


def bucket_of(lo: float, hi: float, size: float) -> tuple[Column, int]:
    """(bucket number of ``_t``, count of buckets): counted from the window's start; the last takes the end too."""
    count = max(1, math.ceil((hi - lo) / size))
    return F.least(F.floor((F.col("_t") - F.lit(float(lo))) / F.lit(float(size))), F.lit(count - 1)).cast("int"), count


def histogram(df: DataFrame, lo: float, hi: float, size: float, stack: str | None = None, on: str | None = None) -> DataFrame:
    """``(bucket, start, key, n, sus)``, zero-filled over all buckets and stack keys; one shuffle of partial counts."""
    number, count = bucket_of(lo, hi, size)
    key = text_of(df, stack) if stack else F.lit("")
    sus = F.count_if("_sus") if "_sus" in df.columns else F.lit(0)
    counts = clip(df, lo, hi, on).select(number.alias("bucket"), key.alias("key"), *(["_sus"] if "_sus" in df.columns else [])).groupBy("bucket", "key").agg(F.count("*").alias("n"), sus.cast("long").alias("sus"))
    keys = counts.select("key").distinct() if stack else df.sparkSession.range(1).select(F.lit("").alias("key"))
    spine = keys.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    filled = spine.join(counts, ["bucket", "key"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return filled.select("bucket", (F.lit(float(lo)) + F.col("bucket") * F.lit(float(size))).cast("long").alias("start"), "key", zero("n"), zero("sus"))


def histogram_table(hist: DataFrame, size: float) -> DataFrame:
    """The histogram as it is exported: bucket start and end in UTC, and one column a key, zero buckets included."""
    wide = hist.groupBy("bucket", "start").pivot("key").agg(F.sum("n"))
    stamp = lambda c: F.date_format(F.timestamp_millis(c), "yyyy-MM-dd HH:mm:ss")
    return wide.select("bucket", stamp(F.col("start")).alias("begin"), stamp(F.col("start") + F.lit(int(size))).alias("end"), *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in wide.columns[2:]])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(n, n + batch.num_rows))], names=[*batch.schema.names, "_part", "_at"])
        n += batch.num_rows


def with_position(df: DataFrame, *order: Column | str) -> tuple[DataFrame, int]:
    """``df`` with ``_pos``, the place of each row from 0 under ``order``, and the number of rows; no window over all rows.

    Rows are dealt by range, numbered where they lie and written once; one count a partition moves the numbers of each.
    Rows that are equal under ``order`` stand in any order, so end it with a unique column.
    """
    spark = df.sparkSession
    path = work_path(spark, "positions")
    schema = T.StructType([*df.schema, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType())])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_numbered, schema).write.parquet(path)
    kept = spark.read.schema(schema).parquet(path)
    offsets, total = [], 0
    for r in sorted(kept.groupBy("_part").count().collect()):  # one row a partition
        offsets.append((r["_part"], total))
        total += r["count"]
    moved = F.broadcast(spark.createDataFrame(offsets, "_part int, _before long"))
    return kept.join(moved, "_part").withColumn("_pos", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before"), total


def grid_strips(df: DataFrame, order: list[str], buckets: int, stack: str | None = None) -> DataFrame:
    """``(strip, bucket, key, n, sus)`` for a grid sorted by ``order``: equal shares of its rows (``position``), and equal spans of ``_t`` (``time``).

    Both strips come from one aggregate. Rows without a time are in the first strip alone; buckets without rows are left out.
    """
    sus = F.col("_sus") if "_sus" in df.columns else F.lit(False)
    needed = df.select(*order, F.col("_t") if "_t" in df.columns else F.lit(None).cast("double").alias("_t"), (text_of(df, stack) if stack else F.lit("")).alias("_key"), sus.alias("_sus"))
    placed, total = with_position(needed, *order)
    span = data_range(placed) or (0.0, 1.0)
    by_position = F.struct(F.lit("position").alias("strip"), F.floor(F.col("_pos") * buckets / F.lit(max(total, 1))).cast("int").alias("bucket"))
    share = F.least(F.floor((F.col("_t") - F.lit(float(span[0]))) * buckets / F.lit(float(span[1] - span[0]))), F.lit(buckets - 1))
    by_time = F.struct(F.lit("time").alias("strip"), F.when(F.col("_t").isNotNull(), share.cast("int")).alias("bucket"))
    each = placed.select(F.explode(F.array(by_position, by_time)).alias("s"), "_key", "_sus").filter("s.bucket is not null")
    return each.groupBy(F.col("s.strip").alias("strip"), F.col("s.bucket").alias("bucket"), F.col("_key").alias("key")).agg(F.count("*").alias("n"), F.count_if("_sus").alias("sus"))


def max_total(hist: DataFrame, *within: str) -> DataFrame:
    """``max_total``: rows of the fullest bucket over all of its stack keys, for each value of ``within``."""
    return hist.groupBy(*within, "bucket").agg(F.sum("n").alias("n")).groupBy(*within).agg(F.max("n").alias("max_total"))


def stack_ranks(df: DataFrame, stack: str) -> DataFrame:
    """``(key, n, rank)`` of stack keys by their count over the unfiltered table, ties in text order."""
    counts = df.groupBy(text_of(df, stack).alias("key")).agg(F.count("*").alias("n"))
    placed, _ = with_position(counts, F.desc("n"), F.asc("key"))
    return placed.select("key", "n", (F.col("_pos") + 1).cast("int").alias("rank"))


def clusters(df: DataFrame, buckets: int = 24, top: int = 5) -> DataFrame:
    """The fullest of equal buckets between the first and the last time; earlier ones win ties."""
    span = data_range(df)
    if span is None:
        return df.sparkSession.createDataFrame([], "bucket int, start long, n long")
    lo, hi = span
    size = (hi - lo) / buckets
    number = F.least(F.floor((F.col("_t") - F.lit(lo)) / F.lit(size)), F.lit(buckets - 1)).cast("int")
    counts = df.filter("_t is not null").groupBy(number.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "bucket").limit(top).select("bucket", F.floor(F.lit(lo) + F.col("bucket") * F.lit(size)).alias("start"), "n")


def nearest_row(df: DataFrame, time: float, order: str) -> DataFrame:
    """The row whose time is nearest; the first of equals. A top-1, so no full sort."""
    return df.filter("_t is not null").orderBy(F.abs(F.col("_t") - F.lit(float(time))), order).limit(1)
