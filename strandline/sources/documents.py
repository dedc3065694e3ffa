"""Mail, spreadsheets and JSON arrays as tables."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.coerce import text_of


def read_mail(files: DataFrame) -> DataFrame:
    """``(path, name, address, subject, date, text, attachments)`` of message files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                m = email.message_from_bytes(bytes(content), policy=email.policy.default)
                sender = m["from"].addresses[0] if m["from"] and m["from"].addresses else None
                body = m.get_body(("plain", "html"))
                rows.append((path, sender.display_name if sender else "", sender.addr_spec if sender else "", str(m["subject"] or ""), str(m["date"] or ""), body.get_content() if body else "", [a.get_filename() or "" for a in m.iter_attachments()]))
            yield pd.DataFrame(rows, columns=["path", "name", "address", "subject", "date", "text", "attachments"])

    return files.select("path", "content").mapInPandas(run, "path string, name string, address string, subject string, date string, text string, attachments array<string>")


def _cells(sheet: bytes, shared: list[str]) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    for _, row in ElementTree.iterparse(io.BytesIO(sheet)):
        if row.tag.endswith("}row"):
            cells = []
            for c in row:
                value = "".join(t.text or "" for t in c.iter() if t.tag.endswith(("}v", "}t")))
                cells.append((re.sub(r"\d", "", c.get("r", "")), shared[int(value)] if c.get("t") == "s" and value else value))
            yield int(row.get("r", 0)), cells
            row.clear()


def read_workbooks(files: DataFrame) -> DataFrame:
    """``(path, sheet, row, cells map<column letters, text>)`` of XLSX files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = z.namelist()
                    shared: list[str] = []
                    if "xl/sharedStrings.xml" in names:
                        root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
                        shared = ["".join(t.text or "" for t in item.iter() if t.tag.endswith("}t")) for item in root]
                    for sheet in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
                        rows = [(path, sheet.rpartition("/")[2][:-4], r, dict(cells)) for r, cells in _cells(z.read(sheet), shared)]
                        yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])

    return files.select("path", "content").mapInPandas(run, "path string, sheet string, row long, cells map<string, string>")


#: ``]`` and ``[`` with nothing between them, outside strings: one array ends and another begins.
_SEVERAL = r"\]\s*\["


def read_json_grid(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON arrays of objects: the union of their keys, every cell text, nested values as JSON.

    Files whose lines are whole arrays (or objects) are read line by line, in splits. In other files an array runs over
    lines; such a file is one task and must hold one array, several are an error.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")
    whole = F.col("value").rlike(r"^\s*[\[{]") & F.col("value").rlike(r"[\]}]\s*,?\s*$") & (F.json_array_length("value").isNotNull() | F.json_object_keys("value").isNotNull())
    kinds = lines.groupBy("file").agg(F.bool_and(whole & ~F.col("value").rlike(r",\s*$")).alias("by_line"))
    files = {r["by_line"]: r["files"] for r in kinds.groupBy("by_line").agg(F.array_sort(F.collect_list("file")).alias("files")).collect()}  # names of files, as Spark lists them
    if False in files:
        bare = F.regexp_replace("value", r'"(?:[^"\\]|\\.)*"', "")
        if not spark.read.text(files[False], wholetext=True).filter(bare.rlike(_SEVERAL)).isEmpty():
            raise ValueError("a file has several arrays that run over lines; write each array on a line, or in a file, of its own")
    reader = lambda by_line: spark.read.option("multiLine", not by_line).option("primitivesAsString", True).json(files[by_line])
    shown = [df.select(*[text_of(df, c).alias(c) for c in df.columns]) for df in map(reader, sorted(files))]
    if not shown:
        return spark.createDataFrame([], "_empty string").drop("_empty")
    both = shown[0] if len(shown) == 1 else shown[0].unionByName(shown[1], allowMissingColumns=True)
    return both.na.fill("")


def malformed(lines: DataFrame, cells: int, sep: str = ",") -> DataFrame:
    """Lines with another number of cells, or with an odd number of quotes."""
    bare = F.regexp_replace("value", r'"(?:[^"]|"")*"', "")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.filter((F.size(F.split(bare, re.escape(sep))) != cells) | (quotes % 2 == 1))
