"""Structured log formats as tables of text: one row a line, every cell text, nothing null.

Readers take a path (or any DataFrame with ``value`` and, for order, ``_file`` and ``_line``) and parse with expressions,
so a split of a file is parsed where it lies. Formats whose schema stands in the file (JSON lines, CEF, logfmt, W3C, Zeek)
find their columns by a first pass over keys or header lines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.jsonpaths import flat_map
from strandline.functions.text import priority
from strandline.functions.timeparse import syslog_year
from strandline.sources.delimited import read_delimited

#: Columns that a format without a schema of its own may open at most; the rest goes to ``_extra``.
MAX_COLUMNS = 256
#: Header lines of all files that are sent to every task; more are joined by file.
BROADCAST_HEADERS = 20_000
#: Lines, in order, in which the first record is looked for before all are parsed for it.
FIRST_LINES = 100


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(value, _file, _time, _line)`` of each line; ``_line`` only orders lines of a file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_time"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_line"))
    return lines.withColumn("value", F.regexp_replace("value", "^﻿|\r$", "")).filter(F.trim("value") != "")


def _cells(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Lines that match, one column a group, with dashes as empty text."""
    kept = df.filter(F.col("value").rlike(pattern))
    return kept.select(*[c for c in ("_file", "_time", "_line") if c in df.columns], *[F.regexp_extract("value", pattern, i + 1).alias(n) for i, n in enumerate(names)])


def _dash(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "-", "").otherwise(c)


def access_log(lines: DataFrame) -> DataFrame:
    """Common and combined access logs; escaped quotes inside fields are undone."""
    quoted = r'"((?:\\.|[^"\\])*)"'
    pattern = rf'^(\S+) (\S+) (\S+) \[([^\]]+)\] {quoted} (\d{{3}}|-) (\d+|-)(?: {quoted} {quoted})?'
    names = ["ip", "ident", "user", "time", "request", "status", "bytes", "referer", "user_agent"]
    out = _cells(lines, pattern, names)
    plain = lambda c: F.regexp_replace(c, r'\\(["\\])', "$1").alias(c)
    return out.select(*[c for c in out.columns if c not in names], *[plain(c) if c in ("request", "referer", "user_agent") else c for c in names])


_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def syslog_3164(lines: DataFrame, file_time: Column | None = None) -> DataFrame:
    """BSD syslog; the year comes from the file's time, one earlier if the date lies over 30 days ahead of it."""
    pattern = r"^(?:<(\d{1,3})>)?([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\S+) ([^:\[\s]+)(?:\[(\d+)\])?: ?(.*)$"
    out = _cells(lines, pattern, ["pri", "month", "day", "clock", "host", "app", "pid", "message"])
    when = file_time if file_time is not None else F.col("_time")
    month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.col("month")).cast("int")
    day = F.col("day").try_cast("int")
    year = F.when((month > 0) & day.between(1, 28) | F.expr("try_to_date(concat('2024 ', month, ' ', day), 'yyyy MMM d')").isNotNull(), syslog_year(month, F.least(day, F.lit(28)), when))
    time = F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad("day", 2, "0"), F.lit(" "), "clock")
    p = priority(F.col("pri"))
    text = lambda c: F.coalesce(c, F.lit(""))
    return out.select(text(time).alias("time"), text(p["severity"]).alias("severity"), text(p["facility"]).alias("facility"), "host", "app", "pid", "message")


def syslog_5424(lines: DataFrame) -> DataFrame:
    """IETF syslog; ``-`` is empty, structured data stays as written."""
    pattern = r"^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[(?:\\.|[^\]\\])*\])+) ?(.*)$"
    out = _cells(lines, pattern, ["pri", "time", "host", "app", "pid", "message_id", "data", "message"])
    p = priority(F.col("pri"))
    return out.filter(p["severity"].isNotNull()).select(*[_dash(c).alias(c) for c in ("time",)], p["severity"].alias("severity"), p["facility"].alias("facility"), *[_dash(c).alias(c) for c in ("host", "app", "pid", "message_id", "data")], F.regexp_replace("message", "^﻿", "").alias("message"))


def apache_error(lines: DataFrame) -> DataFrame:
    pattern = r"^\[([^\]]+)\] \[(?:([^:\]]*):)?([^\]]+)\](?: \[pid (\d+)(?::tid (\d+))?\])?(?: \[client ([^\]]+)\])? ?(?:(AH\d{5}): )?(.*)$"
    return _cells(lines, pattern, ["time", "module", "level", "pid", "tid", "client", "code", "message"])


def timed_log(lines: DataFrame, most: int = 8) -> DataFrame:
    """Logs that begin with a time: the time, then fields split at runs of spaces outside quotes, those after the first ``most`` in ``rest``."""
    pattern = r"^\[?(\d{4}-\d{2}-\d{2}(?:[ T]|--)\d{2}[:-]\d{2}[:-]\d{2}(?:[.,]\d+)?(?:Z|\s?[+-]\d{2}:?\d{2})?)\]?\s+(.*)$"
    parts = F.regexp_extract_all(F.regexp_extract("value", pattern, 2), F.lit(r'"([^"]*)"|(\S+)'), F.lit(0))
    kept = lines.filter(F.col("value").rlike(pattern))
    return kept.select(F.regexp_extract("value", pattern, 1).alias("time"), *[F.coalesce(F.trim(F.get(parts, F.lit(i)), F.lit('"')), F.lit("")).alias(f"field_{i + 2}") for i in range(most)], F.array_join(F.slice(parts, most + 1, F.greatest(F.size(parts), F.lit(1))), " ").alias("rest"))


def _locked(maps: DataFrame, first: list[str], fixed: list[str] = ()) -> DataFrame:
    """Columns of the first record, everything else as JSON in ``_extra``; ``maps`` has ``m`` and the ``fixed`` columns."""
    names = [c for c in first if c not in fixed][:MAX_COLUMNS]
    known = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    rest = F.map_filter("m", lambda k, v: ~F.array_contains(known, k))
    return maps.select(*fixed, *[F.coalesce(F.try_element_at("m", F.lit(c)), F.lit("")).alias(c) for c in names], F.when(F.size(rest) > 0, F.to_json(rest)).otherwise("").alias("_extra"))


def _first_keys(lines: DataFrame, read: Callable[[DataFrame], DataFrame]) -> list[str]:
    """The keys of the first record that ``read`` finds; all lines are parsed for it only if none of the first ones is one."""
    in_order = lambda rows: rows.orderBy("_file", "_line") if "_line" in lines.columns else rows
    first = lines.sparkSession.createDataFrame(in_order(lines).limit(FIRST_LINES).collect(), lines.schema)
    for some in (first.coalesce(1), lines):
        row = in_order(read(some)).select(F.map_keys("m").alias("k")).first()
        if row:
            return row["k"]
    return []


def json_lines(lines: DataFrame, most: int = MAX_COLUMNS, depth: int = 8) -> DataFrame:
    """JSON lines flattened to dotted columns; the first record sets the columns, at most ``most`` of them.

    What lies deeper than ``depth`` stays JSON in its column. Every leaf of a record is in a column or, under its dotted
    path, in ``_extra``: leaves that the first record lacks, those past ``most``, and those inside its own objects.
    """
    # an explode, as a filter on the map would parse every line twice
    read = lambda some: some.select("*", F.explode(F.filter(F.array(flat_map(F.col("value"), depth)), F.isnotnull)).alias("m"))
    return _locked(read(lines), _first_keys(lines, read)[:most])


#: The columns of a cloud audit record.
CLOUDTRAIL = ("eventTime", "eventName", "eventSource", "awsRegion", "sourceIPAddress", "userAgent", "userIdentity.type", "userIdentity.arn", "userIdentity.userName", "userIdentity.accountId", "errorCode", "errorMessage", "requestParameters", "responseElements", "eventID", "eventType", "readOnly", "recipientAccountId")


def cloudtrail(lines: DataFrame) -> DataFrame:
    """Audit records, one a line or inside ``{"Records": [...]}``; leaves without a column go to ``_extra`` by their dotted paths."""
    records = F.from_json(F.get_json_object("value", "$.Records"), "array<string>")
    each = lines.select(F.explode(F.coalesce(records, F.array("value"))).alias("value")).filter(F.json_object_keys("value").isNotNull())
    maps = each.select(F.explode(F.filter(F.array(flat_map(F.col("value"), whole=("requestParameters", "responseElements"))), F.isnotnull)).alias("m"))
    return _locked(maps, list(CLOUDTRAIL))


def _pairs(text: Column, pattern: str, clean: Callable[[Column], Column]) -> Column:
    """A map from all (key, value) matches of ``pattern`` (groups 1 and 2); the last of equal keys wins."""
    backwards = lambda group: F.reverse(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    return _last_of(backwards(1), backwards(2), clean)


def _last_of(keys: Column, values: Column, clean: Callable[[Column], Column] = lambda v: v) -> Column:
    """A map of keys and values that are listed backwards, so that the last of equal keys wins; keys in their first order.

    Both lists are bound by a lambda: they would be computed anew for every key otherwise.
    """
    value = lambda x, k: F.transform(F.array(F.get(x["v"], F.array_position(x["k"], k).cast("int") - 1)), clean)[0]
    entries = lambda x: F.transform(F.array_distinct(F.reverse(x["k"])), lambda k: F.struct(k.alias("k"), value(x, k).alias("v")))
    return F.map_from_entries(F.get(F.transform(F.array(F.struct(keys.alias("k"), values.alias("v"))), entries), F.lit(0)))


_CEF = ["version", "vendor", "product", "device_version", "signature", "name", "severity", "ext"]


def _cef_maps(lines: DataFrame) -> DataFrame:
    field = r"((?:\\.|[^|\\])*)"
    pattern = r"CEF:\s*(\d+)\|" + r"\|".join([field] * 6) + r"\|(.*)$"
    out = _cells(lines, pattern, _CEF)
    plain = lambda c: F.regexp_replace(c, r"\\([|\\=])", "$1")
    value = lambda v: F.trim(F.regexp_replace(F.regexp_replace(v, r"\\n", "\n"), r"\\([|\\=])", "$1"))
    return out.withColumns({c: plain(F.col(c)) for c in _CEF[:-1]}).withColumn("m", _pairs(F.col("ext"), r"(?:^|\s)([\w.\[\]-]+)=((?:\\.|(?!\s+[\w.\[\]-]+=)[^\\])*)", value))


def cef(lines: DataFrame) -> DataFrame:
    """Common Event Format: seven header columns, then the keys of the first record, the rest in ``_extra``."""
    return _locked(_cef_maps(lines), _first_keys(lines, _cef_maps), _CEF[:-1])


def _leef_maps(lines: DataFrame) -> DataFrame:
    pattern = r"LEEF:\s*([12])(?:\.0)?\|([^|]*)\|([^|]*)\|([^|]*)\|([^|]*)\|(?:((?:0?[xX][0-9a-fA-F]{1,4}|[^|\t=])?)\|)?(.*)$"
    out = _cells(lines, pattern, ["version", "vendor", "product", "device_version", "event_id", "delimiter", "ext"])
    code = F.conv(F.regexp_extract("delimiter", r"(?i)^0?x([0-9a-f]+)$", 1), 16, 10)
    delimiter = F.when((F.col("version") == "1") | (F.col("delimiter") == ""), "\t").when(code.isNotNull(), F.char(code.try_cast("int"))).otherwise(F.col("delimiter"))
    parts = F.filter(F.split(F.col("ext"), F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E"))), lambda p: p.contains("="))
    keys, values = F.transform(parts, lambda p: F.trim(F.substring_index(p, "=", 1))), F.transform(parts, lambda p: F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1))
    return out.withColumn("m", _last_of(F.reverse(keys), F.reverse(values)))


def leef(lines: DataFrame) -> DataFrame:
    """LEEF 1.0 and 2.0; version 2 may name its delimiter, as a character or ``x09``."""
    return _locked(_leef_maps(lines), _first_keys(lines, _leef_maps), ["version", "vendor", "product", "device_version", "event_id"])


def _logfmt_maps(lines: DataFrame) -> DataFrame:
    unquote = lambda v: F.when(v.startswith('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_extract(v, r'(?s)^"(.*)"$', 1), r"\\n", "\n"), r"\\t", "\t"), r"\\r", "\r"), r'\\(["\\])', "$1")).otherwise(v)
    return lines.withColumn("m", _pairs(F.col("value"), r'(?:^|\s)([^\s="]+)(?:=("(?:\\.|[^"\\])*"|[^\s"]*))?', unquote)).filter(F.col("value").rlike(r"(?:^|\s)[^\s=]+="))


def logfmt(lines: DataFrame) -> DataFrame:
    """``key=value key="quoted"``; lines without a pair go."""
    return _locked(_logfmt_maps(lines), _first_keys(lines, _logfmt_maps))


def _under_header(lines: DataFrame, head: Column) -> DataFrame:
    """``lines`` with ``_head``: the value of ``head`` on the last line at or before each that has one, in its file.

    Header lines are few: each file's are listed once with their places, and every line looks its own up; no window
    orders a whole file.
    """
    marks = lines.select("_file", "_line", head.alias("_h")).filter("_h is not null")
    listed = marks.groupBy("_file").agg(F.array_sort(F.collect_list(F.struct("_line", "_h"))).alias("_marks"))
    side = F.broadcast(listed) if marks.limit(BROADCAST_HEADERS + 1).count() <= BROADCAST_HEADERS else listed
    before = F.filter("_marks", lambda m: m["_line"] <= F.col("_line"))
    return lines.join(side, "_file").withColumn("_head", F.try_element_at(before, F.lit(-1))["_h"]).drop("_marks")


def w3c(lines: DataFrame, most: int = MAX_COLUMNS) -> DataFrame:
    """W3C extended logs: ``#Fields:`` lines may change the schema within a file, and carry forward to their rows.

    ``-`` is empty and ``+`` a space; ``date`` and ``time`` together give a first column ``Timestamp``. Columns beyond the
    first ``most`` go to ``_extra`` as JSON.
    """
    header = F.when(F.col("value").startswith("#Fields:"), F.trim(F.regexp_replace("value", r"^#Fields:\s*", "")))
    names = [n for r in lines.select(header.alias("h")).filter("h is not null").distinct().orderBy("h").collect() for n in r["h"].split()]
    names = list(dict.fromkeys(names))
    carried = _under_header(lines, header)
    rows = carried.filter(~F.col("value").startswith("#") & F.col("_head").isNotNull()).withColumn("_names", F.split("_head", r"\s+")).withColumn("_cells", F.split("value", r"\t| +"))
    cell = lambda n: F.get("_cells", F.array_position("_names", n).cast("int") - 1)
    shown = {n: F.coalesce(F.replace(_dash(F.when(F.array_contains("_names", n), cell(n))), F.lit("+"), F.lit(" ")), F.lit("")) for n in names[:most]}
    time = [F.when((shown["date"] != "") & (shown["time"] != ""), F.concat(shown["date"], F.lit("T"), shown["time"], F.lit("Z"))).otherwise("").alias("Timestamp")] if {"date", "time"} <= set(shown) else []
    known = F.array(*map(F.lit, shown)) if shown else F.array().cast("array<string>")
    pairs = F.map_from_entries(F.filter(F.arrays_zip(F.col("_names").alias("k"), F.slice("_cells", 1, F.size("_names")).alias("v")), lambda p: ~F.array_contains(known, p["k"]) & p["v"].isNotNull()))
    extra = [F.when(F.size(pairs) > 0, F.to_json(pairs)).otherwise("").alias("_extra")] if len(names) > most else []
    return rows.select(*time, *[c.alias(n) for n, c in shown.items()], *extra)


def zeek(lines: DataFrame) -> DataFrame:
    """Zeek TSV: columns of the ``#fields`` line above each row in its own file, unset and empty marks as empty text.

    A folder of several logs has all their columns, empty where a log lacks one, and a first column ``_path`` with the
    log's name.
    """
    word = F.regexp_extract("value", r"^#(fields|path|unset_field|empty_field)\t", 1)
    rest = F.regexp_extract("value", r"^#\w+\t(.*)$", 1)
    marked = lines.withColumn("_k", word)
    heads = marked.filter("_k != ''").select("_k", rest.alias("_v")).distinct().orderBy("_k", "_v").collect()
    names = list(dict.fromkeys(n for r in heads if r["_k"] == "fields" for n in r["_v"].split("\t")))
    several = len({r["_v"] for r in heads if r["_k"] == "path"}) > 1
    # of each file its marks and path; of each row the fields above it
    files = marked.filter("_k != ''").groupBy("_file").agg(*[F.coalesce(F.max(F.when(F.col("_k") == k, rest)), F.lit(d)).alias(n) for k, n, d in (("unset_field", "_unset", "-"), ("empty_field", "_empty", "(empty)"), ("path", "_path", ""))])
    rows = _under_header(lines, F.when(lines["value"].startswith("#fields\t"), F.regexp_extract("value", r"^#fields\t(.*)$", 1))).filter(~F.col("value").startswith("#") & F.col("_head").isNotNull()).join(files, "_file")
    rows = rows.withColumn("_names", F.split("_head", "\t")).withColumn("_cells", F.split("value", "\t"))
    cell = lambda n: F.when(F.array_contains("_names", n), F.get("_cells", F.array_position("_names", n).cast("int") - 1))
    shown = [F.coalesce(F.when((cell(n) != F.col("_unset")) & (cell(n) != F.col("_empty")), cell(n)), F.lit("")).alias(n) for n in names]
    return rows.select(*(["_path"] if several else []), *shown)


FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"access": access_log, "syslog3164": syslog_3164, "syslog5424": syslog_5424, "apache_error": apache_error, "jsonl": json_lines, "cloudtrail": cloudtrail, "cef": cef, "leef": leef, "logfmt": logfmt, "w3c": w3c, "zeek": zeek, "timed": timed_log}

#: Probes in the order in which they are tried.
PROBES = (
    ("w3c", r"^#(?:Fields|Software|Version):"), ("zeek", r"^#(?:separator|fields|path)\s"), ("cef", r"CEF:\s*\d+\|"), ("leef", r"LEEF:\s*[12]"), ("syslog5424", r"^<\d{1,3}>1 \S+ "),
    ("syslog3164", r"^(?:<\d{1,3}>)?[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2} \S+ "), ("apache_error", r"^\[[A-Z][a-z]{2} [A-Z][a-z]{2} +\d"), ("access", r'^\S+ \S+ \S+ \[\d{1,2}/[A-Z][a-z]{2}/\d{4}:'),
    ("cloudtrail", r'^\s*\{.*"(?:Records|eventSource)"\s*:'), ("jsonl", r"^\s*\{.*\}\s*$"), ("logfmt", r'^(?:[\w.-]+=(?:"(?:\\.|[^"\\])*"|[^\s"]*)(?:\s+|$)){2,}$'), ("timed", r"^\[?\d{4}-\d{2}-\d{2}(?:[ T]|--)\d{2}[:-]\d{2}"),
)


def sniff(lines: DataFrame) -> str:
    """The format of the first lines: a mark in the first five, or 60 % of them in one shape; ``csv`` otherwise."""
    import re

    head = [r["value"] for r in lines.select("value").limit(5).collect()]
    for name, pattern in PROBES:
        hits = sum(bool(re.search(pattern, x)) for x in head)
        if hits and (name in ("w3c", "zeek") or hits >= 0.6 * len(head)):
            return name
    return "csv"


def load(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A log file, or folder of them, as a table of text; the format is sniffed unless given."""
    lines = read_lines(spark, path)
    kind = kind or sniff(lines)
    return read_csv(spark, path) if kind == "csv" else FORMATS[kind](lines)


def delimiter(header: str) -> str:
    """The most frequent of comma, semicolon, tab and bar outside quotes."""
    import re

    bare = re.sub(r'"[^"]*"', "", header[:4096])
    return max(",;\t|", key=bare.count)


def read_csv(spark: SparkSession, path: str | list[str], sep: str | None = None) -> DataFrame:
    """Delimited text as text columns: quotes may span lines, short rows are padded, empty cells are empty text.

    Every file has its header; files with different headers give the union of their columns. Cells past the header are in
    ``_extra`` as a JSON array. Lines without a character are no rows. Files are read in splits, whatever their quotes hold.
    """
    if sep is None:
        head = spark.read.text(path).limit(1).collect()
        sep = delimiter(head[0]["value"]) if head else ","
    return read_delimited(spark, path, sep)
