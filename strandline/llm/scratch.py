"""Shared-folder tables: cut lineage in a place that every executor and the driver can read.

A table's job deletes its shuffle files when it ends, and ``forget`` empties tables that no later step reads any more.
Tables that a returned DataFrame reads stay in the folder, since it is lazy; they go when the folder is cleared.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text whose hashes meet in one bucket, about a million words.
BUCKET_BYTES = 8_000_000
#: Spark's own setting: a query's shuffle files go at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where it is unset and all tasks run in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later steps never recompute it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Empty those of ``tables`` that ``keep`` made: only once everything that was computed from them is itself kept."""
    for table in tables:
        if hasattr(table, "_kept_at"):
            table.sparkSession.createDataFrame([], table.schema).write.mode("overwrite").parquet(table._kept_at)


def buckets(docs: DataFrame, text_col: str) -> int:
    """Partitions for hashes of all words of ``docs``: a bounded share of the text each, so a task's share does not grow.

    One extra scan counts the bytes; at least as many as the session's shuffle partitions.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // BUCKET_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
