"""A folder of files of many formats: a format a file, a reader a format, one table or one a format."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import merge
from strandline.sources import documents, logs, packets

#: Formats that the ending of a name decides; other names, ``.log`` and ``.txt`` too, are judged by their first lines.
BY_ENDING = {"csv": "csv", "tsv": "csv", "jsonl": "jsonl", "ndjson": "jsonl", "cef": "cef", "leef": "leef"}
BINARY = {"pcap": "packets", "cap": "packets", "pcapng": "unread", "evtx": "unread", "sqlite": "unread", "db": "unread"}
HEAD_LINES = 5


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first lines of each file; a task meets the begin of a file in one piece."""
    seen: dict[str, int] = {}
    for batch in batches:
        names = batch.column(0).to_pylist()
        taken = []
        for i, name in enumerate(names):
            if seen.get(name, 0) < HEAD_LINES:
                seen[name] = seen.get(name, 0) + 1
                taken.append((name, seen[name], batch.column(1)[i].as_py()[:4096]))
        if taken:
            file, n, line = zip(*taken)
            yield pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(n, pa.int32()), pa.array(line, pa.string())], names=["file", "n", "line"])


def formats(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(file, format, sep)`` of every file under ``path``: by its ending, or by a vote of its first lines, as ``logs.sniff``.

    Of text files only lines of the first split are looked at. Empty files have no format and are left out; ``unread`` are
    binary files without a reader here, ``json`` arrays that run over lines.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter("length > 0").select(F.col("path").alias("file"))
    ending = F.lower(F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in BINARY.items() for x in kv])
    binary = listed.select("file", known[ending].alias("format"), F.lit("").alias("sep")).filter("format is not null")

    text = spark.read.option("recursiveFileLookup", True).text(path)
    file = F.col("_metadata.file_path")
    first = text.filter((F.col("_metadata.file_block_start") == 0) & ~F.lower(F.regexp_extract(file, r"\.([A-Za-z0-9]+)$", 1)).isin(*BINARY))
    lines = first.select(file.alias("file"), F.regexp_replace("value", "^﻿|\r$", "").alias("value")).filter(F.trim("value") != "")
    heads = lines.mapInArrow(_heads, "file string, n int, line string")
    votes = [F.count_if(F.col("line").rlike(p)).alias(f"_{name}") for name, p in logs.PROBES]
    voted = heads.groupBy("file").agg(F.count("*").alias("_n"), F.min_by("line", "n").alias("_first"), *votes)
    enough = [F.when((F.col(f"_{name}") > 0) & (F.lit(name in ("w3c", "zeek")) | (F.col(f"_{name}") >= 0.6 * F.col("_n"))), name) for name, _ in logs.PROBES]
    array = F.when(F.col("_first").rlike(r"^\s*\["), F.when(ending == "json", "json"))
    by_ending = F.create_map(*[F.lit(x) for kv in BY_ENDING.items() for x in kv])[ending]
    sniffed = F.coalesce(array, *enough, F.lit("csv"))
    # audit records are JSON lines with a schema of their own
    chosen = F.when((by_ending == "jsonl") & (F.coalesce(*enough) == "cloudtrail"), "cloudtrail").otherwise(F.coalesce(by_ending, sniffed))
    bare = F.regexp_replace("_first", '"[^"]*"', "")
    count = lambda s: F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit("")))
    most = F.greatest(*[F.struct(count(s).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(",;\t|")])["s"]
    sep = F.when(chosen == "csv", F.when(ending == "tsv", "\t").otherwise(most)).otherwise("")
    return voted.select("file", chosen.alias("format"), sep.alias("sep")).unionByName(binary)


def load_folder(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """A table a format (and delimiter: ``csv ;``) of all files under ``path``; names of files are what the driver holds."""
    groups = formats(spark, path).groupBy("format", "sep").agg(F.array_sort(F.collect_list("file")).alias("files")).orderBy("format", "sep").collect()
    out: dict[str, DataFrame] = {}
    for r in groups:
        kind, names = r["format"], [n.replace("%20", " ") for n in r["files"]]
        if kind == "csv":
            out[f"csv {r['sep']}"] = logs.read_csv(spark, names, r["sep"])
        elif kind == "json":
            out["json"] = documents.read_json_grid(spark, names)
        elif kind == "packets":
            out["packets"] = packets.read_packets(spark.read.format("binaryFile").load(names).select("path", "content"))
        elif kind != "unread":
            out[kind] = logs.FORMATS[kind](logs.read_lines(spark, names))
    return out


def merge_folder(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All rows of a folder on the canonical columns, with the format as the source's label."""
    return merge.merge([merge.Source(label, df.drop("_file", "_time", "_line"), kind=label.split()[0]) for label, df in load_folder(spark, path).items()])
