"""A folder that the driver and all executors share, for files that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``, or under a temporary folder where that is unset and the master local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandline-files-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_lines(lines: DataFrame, label: str, head: str | None = None) -> str:
    """Writes the one text column of ``lines`` as text files and returns the folder; ``head`` begins each file."""

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    path = work_path(lines.sparkSession, label)
    (lines if head is None else lines.mapInArrow(headed, "value string")).write.text(path)
    return path
