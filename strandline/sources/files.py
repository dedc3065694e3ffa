"""Container files by Spark's binary reader: SQLite tables and archive listings, one file a task row."""

from __future__ import annotations

import io
import sqlite3
import tarfile
import tempfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, length, content)`` of all files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def sqlite_table(files: DataFrame, table: str, schema: str) -> DataFrame:
    """Rows of one table of every database; ``schema`` names the wanted columns and their types."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with tempfile.NamedTemporaryFile(suffix=".db") as f:
                    f.write(content)
                    f.flush()
                    base = sqlite3.connect(f"file:{f.name}?mode=ro", uri=True)
                    cursor = base.execute("SELECT " + ", ".join(f'"{n}"' for n in names) + f' FROM "{table}"')
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=names)
                    base.close()

    return files.select("content").mapInPandas(run, schema)


def archive_entries(files: DataFrame) -> DataFrame:
    """``(path, entry, size, warning)`` of ZIP and TAR archives; warnings: traversal and double extension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                data = io.BytesIO(content)
                if zipfile.is_zipfile(data):
                    rows = [(path, i.filename, i.file_size) for i in zipfile.ZipFile(data).infolist()]
                else:
                    data.seek(0)
                    try:
                        rows = [(path, m.name, m.size) for m in tarfile.open(fileobj=data)]
                    except tarfile.TarError:
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "entry", "size"])

    listed = files.select("path", "content").mapInPandas(run, "path string, entry string, size long")
    traversal = F.col("entry").rlike(r"(?:^|[/\\])\.\.(?:[/\\]|$)|^[/\\]|^[A-Za-z]:")
    double = F.col("entry").rlike(r"(?i)\.(?:pdf|docx?|xlsx?|jpe?g|png|txt)\s*\.(?:exe|scr|js|vbs|bat|cmd|com|lnk|ps1)$")
    return listed.withColumn("warning", F.when(traversal, "traversal").when(double, "double extension").otherwise(""))
