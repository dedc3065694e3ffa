"""Named queries that write events, orders and documents in each format, read them back, and must give the same cells.

Every query writes its whole table as files of the format in the shared folder; its SQL says from the table what the
reader has to give.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import indicators, stats, timeline
from strandline.sources import documents, folders, logs, sinks
from strandline.sources.folder import work_path, write_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def named(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    address = F.concat_ws(".", F.lit("10"), F.col("user_id") % 256, F.col("event_id") % 256, F.col("event_id") % 7)
    return e.withColumns({"ip": address, "k": F.regexp_extract("props", r"(\d+)", 1), "amount": F.col("value").cast("string"), "who": F.concat(F.lit("u"), F.col("user_id"))})


_E = """e AS (SELECT *, '10.' || (user_id % 256) || '.' || (event_id % 256) || '.' || (event_id % 7) AS ip, regexp_extract(props, '(\\d+)', 1) AS k, value::VARCHAR AS amount, 'u' || user_id AS who FROM events)"""


def _at(pattern: str) -> Column:
    return F.date_format("ts", pattern)


def _line(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")


def _back(e: DataFrame, line: Column, label: str, reader: Callable[[DataFrame], DataFrame] | None, head: str | None = None) -> DataFrame:
    """Writes one line a row of ``e`` and reads the files again; without a reader the format is sniffed."""
    path = write_lines(e.select(line), label, head)
    return reader(logs.read_lines(e.sparkSession, path)) if reader else logs.load(e.sparkSession, path)


def _back_after_first(e: DataFrame, line: Column, label: str, reader: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """As ``_back``, with the row of the least ``event_id`` in a folder that sorts first, so that it sets the columns."""
    least, path = e.agg(F.min("event_id")).first()[0], work_path(e.sparkSession, label)
    for folder, kept in (("0", F.col("event_id") <= least), ("1", F.col("event_id") > least)):
        e.filter(kept).select(line).write.text(f"{path}/{folder}")
    paths = [f"{path}/0", f"{path}/1"]
    return reader(logs.read_lines(e.sparkSession, paths)) if reader else logs.load(e.sparkSession, paths)


c = F.col


@named(rf"""WITH {_E} SELECT ip, '-' AS ident, who AS "user", strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000' AS "time", 'GET /' || event_type || '/' || event_id || '?k=' || k || ' HTTP/1.1' AS request,
(200 + event_id % 300)::VARCHAR AS status, CASE WHEN event_id % 4 = 0 THEN '-' ELSE k END AS bytes, 'http://r.example/' || k AS referer, 'UA "' || event_type || '" \x' AS user_agent FROM e""")
def log_access(spark, d):
    """Combined access log with escaped quotes; the format is sniffed."""
    line = _line(c("ip"), " - ", c("who"), " [", _at("dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /', c("event_type"), "/", c("event_id"), "?k=", c("k"), ' HTTP/1.1" ', 200 + c("event_id") % 300, " ", F.when(c("event_id") % 4 == 0, "-").otherwise(c("k")), ' "http://r.example/', c("k"), r'" "UA \"', c("event_type"), r'\" \\x"')
    return _back(_events(spark, d), line, "log-access", None).drop("_file", "_time", "_line")


_SEVERITY = "['emerg','alert','crit','err','warning','notice','info','debug']"
_FACILITY = "['kern','user','mail','daemon','auth','syslog','lpr','news','uucp','cron','authpriv','ftp','ntp','audit','alert','clock','local0','local1','local2','local3','local4','local5','local6','local7']"


@named(rf"""WITH {_E} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS "time", {_SEVERITY}[event_id % 192 % 8 + 1] AS severity, {_FACILITY}[event_id % 192 // 8 + 1] AS facility, 'host' || user_id AS host, event_type AS app,
CASE WHEN event_id % 3 = 0 THEN '' ELSE event_id::VARCHAR END AS pid, 'k is ' || k || ': ' || event_id AS message FROM e""")
def log_syslog_3164(spark, d):
    """BSD syslog; the year comes from a file time shortly after the last event."""
    e = _events(spark, d)
    last = e.agg(F.max("ts")).first()[0]
    pid = F.when(c("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("["), c("event_id"), F.lit("]")))
    line = _line("<", c("event_id") % 192, ">", _at("MMM"), " ", F.lpad(_at("d"), 2, " "), " ", _at("HH:mm:ss"), " host", c("user_id"), " ", c("event_type"), pid, ": k is ", c("k"), ": ", c("event_id"))
    return _back(e, line, "log-syslog-3164", lambda lines: logs.syslog_3164(lines, F.lit(last)))


@named(rf"""WITH {_E} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "time", {_SEVERITY}[event_id % 192 % 8 + 1] AS severity, {_FACILITY}[event_id % 192 // 8 + 1] AS facility, 'host' || user_id AS host, event_type AS app,
CASE WHEN event_id % 3 = 0 THEN '' ELSE k END AS pid, 'ID' || event_id AS message_id, CASE WHEN event_id % 2 = 0 THEN '' ELSE '[x@1 k="' || k || '" q="\]"][y@2]' END AS data, 'said ' || k AS message FROM e""")
def log_syslog_5424(spark, d):
    """IETF syslog with structured data; the format is sniffed."""
    data = F.when(c("event_id") % 2 == 0, "-").otherwise(F.concat(F.lit('[x@1 k="'), c("k"), F.lit(r'" q="\]"][y@2]')))
    line = _line("<", c("event_id") % 192, ">1 ", _at("yyyy-MM-dd'T'HH:mm:ss'Z'"), " host", c("user_id"), " ", c("event_type"), " ", F.when(c("event_id") % 3 == 0, "-").otherwise(c("k")), " ID", c("event_id"), " ", data, " said ", c("k"))
    return _back(_events(spark, d), line, "log-syslog-5424", None)


@named(rf"""WITH {_E} SELECT strftime(ts, '%a %b %d %H:%M:%S.%f %Y') AS "time", 'core' AS module, event_type AS level, k AS pid, CASE WHEN event_id % 2 = 0 THEN '' ELSE event_id::VARCHAR END AS tid, ip || ':' || k AS client,
CASE WHEN event_id % 3 = 0 THEN '' ELSE 'AH00128' END AS code, 'File ' || event_id || ' does not exist' AS message FROM e""")
def log_apache_error(spark, d):
    tid = F.when(c("event_id") % 2 == 0, "").otherwise(F.concat(F.lit(":tid "), c("event_id")))
    line = _line("[", _at("EEE MMM dd HH:mm:ss.SSSSSS yyyy"), "] [core:", c("event_type"), "] [pid ", c("k"), tid, "] [client ", c("ip"), ":", c("k"), "] ", F.when(c("event_id") % 3 == 0, "").otherwise("AH00128: "), "File ", c("event_id"), " does not exist")
    return _back(_events(spark, d), line, "log-apache-error", None).drop("_file", "_time", "_line")


@named(rf"""WITH {_E} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S,%g') AS "time", 'INFO' AS field_2, 'two words ' || k AS field_3, event_id::VARCHAR AS field_4, 'f5' AS field_5, 'f6' AS field_6, 'f7' AS field_7, 'f8' AS field_8, 'f9' AS field_9, 'f10 ' || event_type AS rest FROM e""")
def log_timed(spark, d):
    """Fields behind a time; those past the ninth column are kept together."""
    line = _line(_at("yyyy-MM-dd HH:mm:ss,SSS"), ' INFO "two words ', c("k"), '" ', c("event_id"), " f5 f6 f7 f8 f9 f10 ", c("event_type"))
    return _back(_events(spark, d), line, "log-timed", None)


@named(rf"""WITH {_E} SELECT event_id::VARCHAR AS "id", who AS "user.name", k AS "user.deep.k", event_type AS kind, '["' || k || '",1]' AS tags, CASE WHEN event_id > 0 AND event_id % 2 = 0 THEN '{{"later":"' || k || '"}}' ELSE '' END AS _extra FROM e""")
def log_json_lines(spark, d):
    """Nested JSON lines, flattened; a key that the first record lacks goes to ``_extra``."""
    e = _events(spark, d)
    later = F.when((c("event_id") > 0) & (c("event_id") % 2 == 0), F.concat(F.lit(',"later":"'), c("k"), F.lit('"'))).otherwise("")
    line = _line('{"id":', c("event_id"), ',"user":{"name":"', c("who"), '","deep":{"k":', c("k"), '}},"kind":"', c("event_type"), '","tags":["', c("k"), '",1]', later, "}")
    return _back_after_first(e, line, "log-jsonl", logs.json_lines)


@named(rf"""WITH {_E} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "eventTime", event_type AS "eventName", ip AS "sourceIPAddress", who AS "userIdentity.userName", '{{"k":' || k || '}}' AS "requestParameters", '' AS "errorCode", event_id::VARCHAR AS "eventID", CASE WHEN event_id % 2 = 0 THEN '{{"more":"' || k || '"}}' ELSE '' END AS _extra FROM e""")
def log_cloudtrail(spark, d):
    """Audit records, two thirds of them one a line and the others inside ``Records``."""
    record = F.concat(F.lit('{"eventTime":"'), _at("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","eventName":"'), c("event_type"), F.lit('","sourceIPAddress":"'), c("ip"), F.lit('","userIdentity":{"userName":"'), c("who"), F.lit('"},"requestParameters":{"k":'), c("k"), F.lit('},"eventID":"'), c("event_id"), F.lit('"'), F.when(c("event_id") % 2 == 0, F.concat(F.lit(',"more":'), c("k"))).otherwise(""), F.lit("}"))
    line = F.when(c("event_id") % 3 == 0, F.concat(F.lit('{"Records":['), record, F.lit("]}"))).otherwise(record).alias("value")
    return _back(_events(spark, d), line, "log-cloudtrail", logs.cloudtrail).select("eventTime", "eventName", "sourceIPAddress", "`userIdentity.userName`", "requestParameters", "errorCode", "eventID", "_extra")


@named(rf"""WITH {_E} SELECT '0' AS version, 'Ven|dor' AS vendor, 'Pro\duct' AS product, '1.0' AS device_version, event_id::VARCHAR AS signature, event_type AS name, (event_id % 11)::VARCHAR AS severity, ip AS src, 'two words = ' || k AS msg, CASE WHEN event_id > 0 AND event_id % 2 = 0 THEN '{{"later":"' || k || '"}}' ELSE '' END AS _extra FROM e""")
def log_cef(spark, d):
    e = _events(spark, d)
    later = F.when((c("event_id") > 0) & (c("event_id") % 2 == 0), F.concat(F.lit(" later="), c("k"))).otherwise("")
    line = _line(r"CEF:0|Ven\|dor|Pro\\duct|1.0|", c("event_id"), "|", c("event_type"), "|", c("event_id") % 11, "|src=", c("ip"), r" msg=two words \= ", c("k"), later)
    return _back_after_first(e, line, "log-cef", None)


@named(rf"""WITH {_E} SELECT (1 + event_id % 2)::VARCHAR AS version, 'Vendor' AS vendor, 'Product' AS product, '2.1' AS device_version, event_type AS event_id, ip AS src, 'a=' || k AS msg, CASE WHEN event_id > 0 AND event_id % 2 = 0 THEN '{{"later":"' || k || '"}}' ELSE '' END AS _extra FROM (SELECT *, event_id AS n FROM e) e""".replace("event_id % 2)::VARCHAR", "n % 2)::VARCHAR").replace("event_id > 0 AND event_id % 2 = 0", "n > 0 AND n % 2 = 0"))
def log_leef(spark, d):
    """Version 1 with tabs, version 2 with a caret that the header names."""
    e = _events(spark, d)
    even = c("event_id") % 2 == 0
    one = F.concat(F.lit("LEEF:1.0|Vendor|Product|2.1|"), c("event_type"), F.lit("|src="), c("ip"), F.lit("\tmsg=a="), c("k"), F.when(c("event_id") > 0, F.concat(F.lit("\tlater="), c("k"))).otherwise(""))
    two = F.concat(F.lit("LEEF:2.0|Vendor|Product|2.1|"), c("event_type"), F.lit("|x5E|src="), c("ip"), F.lit("^msg=a="), c("k"))
    return _back_after_first(e, F.when(even, one).otherwise(two).alias("value"), "log-leef", None)


@named(rf"""WITH {_E} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, event_type AS level, 'said "' || k || '" twice' AS msg, event_id::VARCHAR AS "id", CASE WHEN event_id > 0 AND event_id % 2 = 0 THEN '{{"later":"' || k || '"}}' ELSE '' END AS _extra FROM e""")
def log_logfmt(spark, d):
    e = _events(spark, d)
    later = F.when((c("event_id") > 0) & (c("event_id") % 2 == 0), F.concat(F.lit(" later="), c("k"))).otherwise("")
    line = _line("at=", _at("yyyy-MM-dd'T'HH:mm:ss'Z'"), " level=", c("event_type"), r' msg="said \"', c("k"), r'\" twice" id=', c("event_id"), later)
    return _back_after_first(e, line, "log-logfmt", None)


@named(rf"""WITH {_E} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "Timestamp", strftime(ts, '%Y-%m-%d') AS "date", strftime(ts, '%H:%M:%S') AS "time", ip AS "c-ip", event_id::VARCHAR AS "cs-id", CASE WHEN event_id % 5 = 0 THEN '' ELSE 'UA ' || k END AS "cs(User-Agent)" FROM e""")
def log_w3c(spark, d):
    """W3C extended logs; each file begins with its ``#Fields:`` line."""
    line = _line(_at("yyyy-MM-dd HH:mm:ss"), " ", c("ip"), " ", c("event_id"), " ", F.when(c("event_id") % 5 == 0, "-").otherwise(F.concat(F.lit("UA+"), c("k"))))
    return _back(_events(spark, d), line, "log-w3c", None, "#Fields: date time c-ip cs-id cs(User-Agent)")


@named(rf"""WITH {_E} SELECT 'conn' AS _path, event_id::VARCHAR AS ts, ip AS "id.orig_h", CASE WHEN event_id % 3 = 0 THEN '' ELSE k END AS note, '' AS query FROM e UNION ALL SELECT 'dns', event_id::VARCHAR, '', '', CASE WHEN event_id % 4 = 0 THEN '' ELSE event_type || '.example' END FROM e""")
def log_zeek(spark, d):
    """A folder with the files of two logs of different fields and marks."""
    e = _events(spark, d)
    line = _line(c("event_id"), "\t", c("ip"), "\t", F.when(c("event_id") % 3 == 0, "-").otherwise(c("k")))
    conn = write_lines(e.select(line), "log-zeek", "#separator \\x09\n#unset_field\t-\n#path\tconn\n#fields\tts\tid.orig_h\tnote")
    line = _line(F.when(c("event_id") % 4 == 0, "?").otherwise(F.concat(c("event_type"), F.lit(".example"))), "\t", c("event_id"))
    dns = write_lines(e.select(line), "log-zeek", "#separator \\x09\n#unset_field\t?\n#path\tdns\n#fields\tquery\tts")
    return logs.zeek(logs.read_lines(spark, [conn, dns]))


def _grid(e: DataFrame) -> DataFrame:
    said = F.when(c("event_id") % 4 == 0, F.concat(F.lit('say "'), c("k"), F.lit('", twice'))).when(c("event_id") % 4 == 1, F.concat(F.lit("two\nlines "), c("k"))).when(c("event_id") % 4 == 2, F.lit("")).otherwise(c("k"))
    return e.select("event_id", "event_type", said.alias("said"), "amount")


_GRID = f"""WITH {_E} SELECT event_id::VARCHAR AS event_id, event_type, CASE event_id % 4 WHEN 0 THEN 'say "' || k || '", twice' WHEN 1 THEN 'two' || chr(10) || 'lines ' || k WHEN 2 THEN '' ELSE k END AS said, amount FROM e"""


@named(_GRID)
def grid_csv(spark, d):
    """The grid export and the reader of delimited text: quotes, commas and line breaks in cells, CRLF between rows."""
    path = work_path(spark, "grid-csv")
    sinks.write_csv(_grid(_events(spark, d)), path)
    return logs.read_csv(spark, path).drop("_extra")


def _delimited(spark, d, sep: str) -> DataFrame:
    e = _events(spark, d)
    line = _line(c("event_id"), sep, c("event_type"), sep, '"', c("k"), sep, ' x"', sep, c("ip"))
    path = write_lines(e.select(line), "grid-delimited", sep.join(["event_id", "event_type", "said", "ip"]))
    return logs.read_csv(spark, path).drop("_extra")


_DELIMITED = "WITH {e} SELECT event_id::VARCHAR AS event_id, event_type, k || '{sep} x' AS said, ip FROM e"


@named(_DELIMITED.format(e=_E, sep=";"))
def grid_semicolons(spark, d):
    return _delimited(spark, d, ";")


@named(_DELIMITED.format(e=_E, sep="\t"))
def grid_tabs(spark, d):
    return _delimited(spark, d, "\t")


@named(_DELIMITED.format(e=_E, sep="|"))
def grid_bars(spark, d):
    return _delimited(spark, d, "|")


@named(f"""WITH {_E} SELECT event_id::VARCHAR AS event_id, k, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS said, CASE WHEN event_id % 5 = 0 THEN '["x,' || k || '","' || event_id || '"]' ELSE '' END AS _extra FROM e""")
def grid_extra_cells(spark, d):
    """Rows with too few and too many cells under one header."""
    e = _events(spark, d)
    i = c("event_id")
    said = F.when(i % 3 != 0, F.concat(F.lit(","), c("event_type"))).when(i % 5 == 0, ",").otherwise("")
    line = _line(i, ",", c("k"), said, F.when(i % 5 == 0, F.concat(F.lit(',"x,'), c("k"), F.lit('",'), i)).otherwise(""))
    return logs.read_csv(spark, write_lines(e.select(line), "grid-extra", "event_id,k,said"))


@named(f"""WITH {_E} SELECT CASE WHEN event_id % 3 = 0 THEN '' ELSE event_id::VARCHAR END AS a, CASE WHEN event_id % 3 = 0 THEN event_id::VARCHAR ELSE '' END AS b, 'line ' || k || chr(10) || chr(10) || 'and "' || event_type || '", ' || repeat('long ', (event_id % 40)::INT) AS said, '' AS _extra FROM e""")
def grid_csv_in_splits(spark, d):
    """Cells of several lines in files that are read in splits of some kilobytes, under two headers."""
    e = _events(spark, d)
    said = F.concat(F.lit('"line '), c("k"), F.lit('\n\nand ""'), c("event_type"), F.lit('"", '), F.expr("repeat('long ', cast(event_id % 40 as int))"), F.lit('"'))
    one = write_lines(e.filter("event_id % 3 <> 0").select(_line(c("event_id"), ",", said)), "grid-splits", "a,said")
    two = write_lines(e.filter("event_id % 3 = 0").select(_line(said, ",", c("event_id"))), "grid-splits", "said,b")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for name, value in (("maxPartitionBytes", "64k"), ("openCostInBytes", "0")):
        spark.conf.set(f"spark.sql.files.{name}", value)
    try:
        path = work_path(spark, "grid-splits-read")
        logs.read_csv(spark, [one, two], ",").write.parquet(path)
    finally:
        for name, value in zip(("maxPartitionBytes", "openCostInBytes"), before):
            spark.conf.set(f"spark.sql.files.{name}", value)
    return spark.read.parquet(path)


@named(f"WITH {_E} SELECT event_id FROM e WHERE event_id % 10 < 2")
def grid_malformed_rows(spark, d):
    """Rows with a cell too many, or an open quote."""
    e = _events(spark, d)
    line = _line(c("event_id"), ",", c("k"), ',"a,b"', F.when(c("event_id") % 10 == 0, ",more").when(c("event_id") % 10 == 1, '"').otherwise(""))
    lines = logs.read_lines(spark, write_lines(e.select(line), "grid-malformed"))
    return documents.malformed(lines, 3).select(F.substring_index("value", ",", 1).cast("long").alias("event_id"))


@named(f"""WITH {_E} SELECT event_id::VARCHAR AS event_id, event_type, '{{"k":"' || k || '"}}' AS props, CASE WHEN event_id % 2 = 0 THEN amount ELSE '' END AS amount FROM e""")
def grid_json_array(spark, d):
    """Arrays of objects, of a hundred rows each, many to a file."""
    e = _events(spark, d)
    row = F.to_json(F.struct("event_id", "event_type", F.struct("k").alias("props"), F.when(c("event_id") % 2 == 0, c("amount")).alias("amount")))
    whole = e.groupBy(F.floor(c("event_id") / 100).alias("part")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ","), F.lit("]")).alias("value"))
    return documents.read_json_grid(spark, write_lines(whole.select("value"), "grid-json"))


@named(f"""WITH {_E}, p AS (SELECT unnest([{{'path': 'id', 'value': event_id::VARCHAR}}, {{'path': 'user.name', 'value': who}}, {{'path': 'user.tags', 'value': '["' || k || '",' || event_id || ']'}}]) AS u FROM e
UNION ALL SELECT {{'path': 'user.role.kind', 'value': event_type}} FROM e WHERE event_id % 3 = 1 UNION ALL SELECT {{'path': 'user.role', 'value': '{{}}'}} FROM e WHERE event_id % 3 = 2
UNION ALL SELECT {{'path': 'n' || (event_id % 7) || '.x.y', 'value': '1.50'}} FROM e)
SELECT u.path AS path, u.value AS value, count(*) AS n FROM p GROUP BY ALL""")
def json_leaf_pairs(spark, d):
    """Every (path, value) of nested records that differ from each other, from the columns and ``_extra`` of the reader."""
    i = c("event_id")
    role = F.when(i % 3 == 1, F.concat(F.lit(',"role":{"kind":"'), c("event_type"), F.lit('"}'))).when(i % 3 == 2, ',"role":{}').otherwise("")
    line = _line('{"id":', i, ',"user":{"name":"', c("who"), '","tags":["', c("k"), '",', i, "]", role, '},"n', i % 7, '":{"x":{"y":1.50}}', F.when(i % 5 == 0, ',"gone":null').otherwise(""), "}")
    df = _back_after_first(_events(spark, d), line, "json-leaves", logs.json_lines)
    cells = F.create_map(*[x for n in df.columns if n != "_extra" for x in (F.lit(n), c(f"`{n}`"))])  # an empty cell is a null, or no leaf
    more = F.coalesce(F.from_json("_extra", "map<string,string>"), F.create_map().cast("map<string,string>"))
    pairs = df.select(F.explode(F.concat(F.map_entries(cells), F.map_entries(more))).alias("p")).select("p.key", "p.value").toDF("path", "value")
    return pairs.filter("value != ''").groupBy("path", "value").agg(F.count("*").alias("n"))


@named(f"""WITH {_E} SELECT ['access', 'syslog5424', 'jsonl', 'csv ;', 'csv ,', 'logfmt', 'cef'][event_id % 7 + 1] AS kind, event_id::VARCHAR AS id, who, CASE WHEN event_id % 7 IN (3, 4) AND event_id % 3 = 0 THEN 'two' || chr(10) || 'lines' ELSE event_type END AS what FROM e""")
def mixed_folder(spark, d):
    """One folder of files of seven formats, most without a telling name; every row comes back by the reader of its file."""
    e, i, path = _events(spark, d), c("event_id"), work_path(spark, "mixed")
    what = F.when(i % 3 == 0, '"two\nlines"').otherwise(c("event_type"))
    written = {
        "access": _line(c("ip"), " - ", c("who"), " [", _at("dd/MMM/yyyy:HH:mm:ss"), ' +0000] "GET /', c("event_type"), ' HTTP/1.1" 200 ', i),
        "syslog": _line("<13>1 ", _at("yyyy-MM-dd'T'HH:mm:ss'Z'"), " ", c("who"), " ", c("event_type"), " - ID", i, " - said"),
        "records.jsonl": _line('{"id":', i, ',"user":{"name":"', c("who"), '"},"what":"', c("event_type"), '"}'),
        "semicolons": _line(i, ";", c("who"), ";", what), "commas.csv": _line(c("who"), ",", i, ",", what),
        "pairs": _line("id=", i, " who=", c("who"), " what=", c("event_type")), "events.cef": _line("CEF:0|V|P|1|", i, "|", c("event_type"), "|1|suser=", c("who")),
    }
    heads = {"semicolons": "id;who;what", "commas.csv": "who,id,what"}
    for n, (name, line) in enumerate(written.items()):
        lines = write_lines(e.filter(i % 7 == n).select(line), "mixed-part", heads.get(name))
        # the ending of a name decides, so it has to be the files' own
        _renamed(spark, lines, path, name)
    tables = folders.load_folder(spark, path)
    shown = {
        "access": lambda t: t.select("bytes", "user", F.regexp_extract("request", r"/(\w+) ", 1)), "syslog5424": lambda t: t.select(F.substring("message_id", 3, 20), "host", "app"), "jsonl": lambda t: t.select("id", "`user.name`", "what"),
        "csv ;": lambda t: t.select("id", "who", "what"), "csv ,": lambda t: t.select("id", "who", "what"), "logfmt": lambda t: t.select("id", "who", "what"), "cef": lambda t: t.select("signature", "suser", "name"),
    }
    parts = [shown[kind](t).toDF("id", "who", "what").withColumn("kind", F.lit(kind)) for kind, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _renamed(spark: SparkSession, folder: str, to: str, name: str) -> None:
    """Moves the files of ``folder`` to ``to`` under ``name`` and their number, through the file system that Spark uses."""
    java = spark._jvm.org.apache.hadoop.fs.Path
    fs = java(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(java(to))
    stem, dot, ending = name.partition(".")
    for i, status in enumerate(sorted(str(s.getPath()) for s in fs.listStatus(java(folder)) if s.getPath().getName().startswith("part-"))):
        fs.rename(java(status), java(f"{to}/{stem}-{i}{dot}{ending}"))


# ---- exports ----------------------------------------------------------------------------------------------------


@named(f"""WITH {_E}, h AS (SELECT date_trunc('day', ts) AS day, event_type FROM e) SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS "begin", strftime(day + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS "end",
count(*) FILTER (event_type = 'click')::VARCHAR AS click, count(*) FILTER (event_type = 'error')::VARCHAR AS error, count(*) FILTER (event_type = 'view')::VARCHAR AS "view" FROM h GROUP BY day""")
def export_histogram(spark, d):
    """The histogram table, one column a stack key, written as CSV and read back."""
    e = timeline.with_time(_events(spark, d), "ts")
    lo, hi = timeline.data_range(e)
    day = 86_400_000
    lo = lo // day * day
    hist = timeline.histogram(e, lo, (hi // day + 1) * day, day, "event_type")
    path = work_path(spark, "export-histogram")
    sinks.write_csv(timeline.histogram_table(hist, day).drop("bucket").select("begin", "end", "click", "error", "view"), path)
    return logs.read_csv(spark, path).drop("_extra")


@named("SELECT event_type AS value, count(*)::VARCHAR AS n FROM events GROUP BY 1")
def export_top_values(spark, d):
    path = work_path(spark, "export-values")
    sinks.write_csv(stats.top_values(_events(spark, d), "event_type", 500), path)
    return logs.read_csv(spark, path).drop("_extra")


_EMAILS = r"""WITH v AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,6}'))) AS value FROM documents)"""


def _addresses(spark, d) -> DataFrame:
    """E-mail addresses of all documents with a severity by document, so that equal values have several."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    found = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,6}"), F.lit(0)))).alias("value"))
    return found.select(F.lit("Email").alias("type"), "value", F.get(F.array(*map(F.lit, indicators.RANKS)), (c("doc_id") % 5).cast("int")).alias("severity"))


_RANKED = "['info','low','medium','high','critical'][max(doc_id % 5) + 1]"


@named(f"{_EMAILS} SELECT 'Email' AS type, any_value(value) AS value, {_RANKED} AS severity FROM (SELECT doc_id, min(value) OVER (PARTITION BY lower(value)) AS value FROM v) GROUP BY lower(value)")
def export_indicators(spark, d):
    """One row a type and value (case ignored), with the highest severity, as CSV."""
    path = work_path(spark, "export-indicators")
    sinks.write_csv(sinks.indicator_list(_addresses(spark, d)), path)
    return logs.read_csv(spark, path).drop("_extra")


@named(f"""{_EMAILS}, u AS (SELECT min(value) AS value, {_RANKED} AS severity FROM v GROUP BY lower(value)) SELECT 'indicator' AS type, '2.1' AS spec_version, '[email-addr:value = ' || chr(39) || value || chr(39) || ']' AS pattern, substr(sha1('stix|Email|' || value), 1, 8) AS id_start FROM u""")
def export_stix(spark, d):
    """A STIX bundle written as one JSON document over several files, read back object by object."""
    path = work_path(spark, "export-stix")
    sinks.write_bundle(sinks.stix_objects(_addresses(spark, d)), "object", path)
    objects = sinks.read_bundle(spark, path)
    get = lambda p: F.get_json_object("value", f"$.{p}")
    return objects.select(get("type").alias("type"), get("spec_version").alias("spec_version"), get("pattern").alias("pattern"), F.substring(get("id"), 12, 8).alias("id_start"))


@named(f"""{_EMAILS}, u AS (SELECT min(value) AS value, max(doc_id % 5) AS worst FROM v GROUP BY lower(value)) SELECT 'Payload delivery' AS category, 'email-src' AS type, value, CASE WHEN worst >= 3 THEN 'true' ELSE 'false' END AS to_ids FROM u""")
def export_misp(spark, d):
    path = work_path(spark, "export-misp")
    sinks.write_bundle(sinks.misp_attributes(_addresses(spark, d)), "attribute", path, "event")
    get = lambda p: F.get_json_object("value", f"$.{p}").alias(p)
    return sinks.read_bundle(spark, path).select(*map(get, ("category", "type", "value", "to_ids")))


@named("""WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT '## Types' || chr(10) || chr(10) || '| event_type | n |' || chr(10) || '| --- | --- |' || chr(10) || (SELECT string_agg('| ' || event_type || ' | ' || n || ' |', chr(10) ORDER BY event_type) FROM t)
|| chr(10) || chr(10) || '## Users' || chr(10) || chr(10) || '| user_id | n |' || chr(10) || '| --- | --- |' || chr(10) || (SELECT string_agg('| ' || user_id || ' | ' || n || ' |', chr(10) ORDER BY n DESC, user_id) FROM u) AS markdown""")
def export_summary(spark, d):
    e = _events(spark, d)
    types = e.groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type")
    users = e.groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(10)
    return spark.createDataFrame([(sinks.summary([("Types", types), ("Users", users)]),)], "markdown string")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
