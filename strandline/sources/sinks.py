"""Exports: CSV grids, indicator lists, STIX bundles and MISP events."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.coerce import text_of
from strandline.functions.text import csv_cell


def write_csv(df: DataFrame, path: str) -> None:
    """RFC 4180: a header, CRLF between rows, quotes doubled; many files of one folder, written in parallel.

    Spark's own writer takes one character as the row's end, so the cells are put in a line here; a file's header comes
    from its task.
    """
    cells = [F.coalesce(csv_cell(text_of(df, c)), F.lit("")) for c in df.columns]
    head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in df.columns)

    def headed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([head + "\r"])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    lines = df.select(F.concat(F.concat_ws(",", *cells), F.lit("\r")).alias("value"))
    lines.mapInArrow(headed, "value string").write.text(path)


RANKS = ("info", "low", "medium", "high", "critical")


def indicator_list(iocs: DataFrame) -> DataFrame:
    """What an analyst exports: no mere patterns, one row a type and value (case ignored, its least spelling), worst severity."""
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("severity"))
    rows = iocs.filter(~F.col("type").isin("Pattern", "Info", "YARA")).groupBy("type", F.lower("value").alias("_v")).agg(F.min("value").alias("value"), F.max(rank).alias("_r"))
    return rows.select("type", "value", F.try_element_at(F.array(*map(F.lit, RANKS)), F.nullif(F.col("_r"), F.lit(0)).cast("int")).alias("severity"))


#: Pattern templates and attribute types of the exchange formats, by indicator type.
STIX_PATTERNS = {"URL": "[url:value = '%s']", "Email": "[email-addr:value = '%s']", "IP": "[ipv4-addr:value = '%s']", "Domain": "[domain-name:value = '%s']", "Hash": "[file:hashes.'UNKNOWN' = '%s']", "File path": "[file:name = '%s']", "Registry key": "[windows-registry-key:key = '%s']", "MAC": "[mac-addr:value = '%s']"}
MISP_TYPES = {"URL": ("Network activity", "url"), "Email": ("Payload delivery", "email-src"), "IP": ("Network activity", "ip-dst"), "Domain": ("Network activity", "domain"), "Hash": ("Payload delivery", "other"), "File path": ("Artifacts dropped", "filename"), "Registry key": ("Artifacts dropped", "regkey"), "MAC": ("Network activity", "mac-address")}


def _uuid(*parts: Column) -> Column:
    """A version-5-shaped id from a hash of the parts, the same in every run."""
    h = F.sha1(F.concat_ws("|", *parts))
    at = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", at(1, 8), at(9, 4), F.concat(F.lit("5"), at(14, 3)), F.concat(F.lit("8"), at(18, 3)), at(21, 12))


def stix_objects(iocs: DataFrame) -> DataFrame:
    """``(id, object)``: one STIX 2.1 indicator a value, as JSON; types without a pattern are left out."""
    table = F.create_map(*[F.lit(x) for kv in STIX_PATTERNS.items() for x in kv])
    escaped = F.replace(F.replace(F.col("value"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    rows = indicator_list(iocs).withColumn("_p", F.try_element_at(table, F.col("type"))).filter("_p is not null")
    ident = F.concat(F.lit("indicator--"), _uuid(F.lit("stix"), "type", "value"))
    body = F.to_json(F.struct(F.lit("indicator").alias("type"), F.lit("2.1").alias("spec_version"), ident.alias("id"), F.lit("stix").alias("pattern_type"), F.replace("_p", F.lit("%s"), escaped).alias("pattern"), F.array(F.lit("malicious-activity")).alias("indicator_types")))
    return rows.select(ident.alias("id"), body.alias("object"))


def misp_attributes(iocs: DataFrame) -> DataFrame:
    """``(uuid, attribute)``: one MISP attribute a value, as JSON."""
    category = F.create_map(*[F.lit(x) for k, v in MISP_TYPES.items() for x in (k, v[0])])
    kind = F.create_map(*[F.lit(x) for k, v in MISP_TYPES.items() for x in (k, v[1])])
    rows = indicator_list(iocs).withColumn("_c", F.try_element_at(category, F.col("type"))).filter("_c is not null")
    ident = _uuid(F.lit("misp"), "type", "value")
    ids = F.col("severity").isin("high", "critical")
    body = F.to_json(F.struct(ident.alias("uuid"), F.col("_c").alias("category"), F.try_element_at(kind, F.col("type")).alias("type"), "value", ids.alias("to_ids")))
    return rows.select(ident.alias("uuid"), body.alias("attribute"))


def write_bundle(objects: DataFrame, column: str, path: str, kind: str = "bundle") -> None:
    """A STIX ``bundle`` or a MISP ``event`` as one JSON document over the files of a folder, in the order of their names.

    The first file opens the document and the last closes it; all between are objects with a comma before each, so a
    bundle of any size never passes through one task. ``read_bundle`` reads it back; joined, the files are valid JSON.
    """
    spark = objects.sparkSession
    ident = F.sha1(F.lit(path))
    uuid = F.concat_ws("-", F.substring(ident, 1, 8), F.substring(ident, 9, 4), F.concat(F.lit("5"), F.substring(ident, 14, 3)), F.concat(F.lit("8"), F.substring(ident, 18, 3)), F.substring(ident, 21, 12))
    opened = F.concat(F.lit('{"type":"bundle","id":"bundle--'), uuid, F.lit('","objects":[')) if kind == "bundle" else F.concat(F.lit('{"Event":{"uuid":"'), uuid, F.lit('","info":"indicators","Attribute":['))
    first = objects.select(F.min(column).alias("least")).select(F.concat(opened, F.lit("\n"), F.coalesce("least", F.lit(""))).alias("value"))
    least = objects.select(F.min(column).alias("_least"))
    rest = objects.join(F.broadcast(least), F.col(column) > F.col("_least")).select(F.concat(F.lit(","), F.col(column)).alias("value"))
    first.coalesce(1).write.text(f"{path}/0-begin")
    rest.write.text(f"{path}/1-objects")
    spark.range(1).select(F.lit("]}" if kind == "bundle" else "]}}").alias("value")).coalesce(1).write.text(f"{path}/2-end")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the objects of a document that ``write_bundle`` made, one a row."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.regexp_replace("value", "^,", "").alias("value"))
    return lines.filter(F.col("value").startswith("{") & ~F.col("value").endswith("[") & ~F.col("value").rlike(r"^\]"))


def summary(sections: list[tuple[str, DataFrame]], budget: int = 64 << 10) -> str:
    """Markdown of small aggregates, with ever fewer rows each until it fits ``budget`` characters."""
    held = [(title, df.columns, [tuple(r) for r in df.limit(50).collect()]) for title, df in sections]
    for rows in (50, 25, 10, 5, 1, 0):
        parts = []
        for title, columns, data in held:
            lines = ["| " + " | ".join(map(str, r)).replace("\n", " ") + " |" for r in [columns, ["---"] * len(columns), *data[:rows]]]
            parts.append(f"## {title}\n\n" + "\n".join(lines))
        text = "\n\n".join(parts)
        if len(text) <= budget:
            return text
    return text[:budget]
