"""One or more lines of each format, and the cells they must give."""

import io
import json
import sqlite3
import tarfile
import zipfile

import pytest

from strandline.sources import files, logs


@pytest.fixture()
def lines(spark):
    def make(*text):
        return spark.createDataFrame([(t, "f", (0, i)) for i, t in enumerate(text)], "value string, _file string, _line struct<a:int,b:int>").coalesce(1)

    return make


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def test_access(lines):
    df = logs.access_log(lines(r'1.2.3.4 - bob [20/Jun/2012:19:05:12 +0200] "GET /a\"b HTTP/1.1" 200 512 "http://r/" "UA \\ x"', '1.2.3.4 - - [20/Jun/2012:19:05:12 +0200] "GET / HTTP/1.0" 404 -', "garbage"))
    assert rows(df, "ip", "user", "request", "status", "bytes", "user_agent") == [("1.2.3.4", "bob", 'GET /a"b HTTP/1.1', "200", "512", "UA \\ x"), ("1.2.3.4", "-", "GET / HTTP/1.0", "404", "-", "")]


def test_syslog_3164(spark, lines):
    from pyspark.sql import functions as F

    df = logs.syslog_3164(lines("<34>Oct 11 22:14:15 web su[230]: failed for root", "Jan  2 03:04:05 h app: x", "no"), F.lit("2024-02-01").cast("timestamp"))
    assert rows(df, "time", "severity", "facility", "host", "app", "pid", "message") == [("2023-10-11 22:14:15", "crit", "auth", "web", "su", "230", "failed for root"), ("2024-01-02 03:04:05", "", "", "h", "app", "", "x")]


def test_syslog_5424(lines):
    df = logs.syslog_5424(lines(r'<165>1 2003-10-11T22:14:15.003Z m.example evt - ID47 [x@1 a="\]"][y@2 b="2"] hello', "<999>1 - - - - - - x"))
    assert rows(df, "severity", "facility", "host", "pid", "message_id", "data", "message") == [("notice", "local4", "m.example", "", "ID47", r'[x@1 a="\]"][y@2 b="2"]', "hello")]


def test_apache_error(lines):
    df = logs.apache_error(lines("[Fri Sep 09 10:42:29.902022 2011] [core:error] [pid 35708:tid 4328636416] [client 72.15.99.187] AH00128: File does not exist", "[x] [notice] plain"))
    assert rows(df, "module", "level", "pid", "client", "code", "message") == [("core", "error", "35708", "72.15.99.187", "AH00128", "File does not exist"), ("", "notice", "", "", "", "plain")]


def test_json_lines(lines):
    df = logs.json_lines(lines('{"a":{"b":1,"c":[1,2]},"t":"x","n":null}', "not json", '{"t":"y","a":{"b":"2"},"new":{"k":1}}'))
    assert df.columns == ["a.b", "a.c", "t", "n", "_extra"]
    assert [tuple(r) for r in df.collect()] == [("1", "[1,2]", "x", "", ""), ("2", "", "y", "", '{"new.k":"1"}')]


def test_json_lines_lose_no_leaf(lines):
    """Leaves inside a known object, past the most columns, of odd names, and too deep."""
    df = logs.json_lines(lines('{"user":{"name":"a"}}', '{"user":{"name":"b","role":"admin"},"x.y":1.50,"x":{"y":2,"it\'s?":true},"e":{},"big":123456789012345678901}', '{"user":"plain"}'))
    assert df.columns == ["user.name", "_extra"]
    got = [(r["user.name"], json.loads(r["_extra"] or "{}")) for r in df.collect()]
    assert got == [("a", {}), ("b", {"user.role": "admin", "x.y": "1.50", '["x","y"]': "2", "x.it's?": "true", "e": "{}", "big": "123456789012345678901"}), ("", {"user": "plain"})]
    few = logs.json_lines(lines('{"u":{"a":1,"b":2,"c":3}}', '{"u":{"c":4}}'), most=2)
    assert [tuple(r) for r in few.collect()] == [("1", "2", '{"u.c":"3"}'), ("", "", '{"u.c":"4"}')]
    deep = logs.json_lines(lines('{"a":{"b":{"c":{"d":[{"e":1}]}}}}'), depth=2)
    assert (deep.columns[0], deep.first()[0]) == ("a.b", '{"c":{"d":[{"e":1}]}}')
    odd = logs.json_lines(lines('{"a":1,"a":"\\ud800","n":1e5}', '{"a":NaN}', "[1]", ""))
    assert [tuple(r) for r in odd.collect()] == [("\ufffd", "1e5", "")]


def test_cloudtrail(lines):
    df = logs.cloudtrail(lines('{"Records":[{"eventName":"A","userIdentity":{"type":"Root"},"odd":1},{"eventName":"B"}]}', '{"eventName":"C"}'))
    assert rows(df, "eventName", "userIdentity.type", "_extra") == [("A", "Root", '{"odd":"1"}'), ("B", "", ""), ("C", "", "")]
    df = logs.cloudtrail(lines('{"eventName":"A","userIdentity":{"type":"T","principalId":"P","sessionContext":{"mfa":true}},"requestParameters":{"k":{"z":1}}}'))
    assert rows(df, "userIdentity.type", "requestParameters", "_extra") == [("T", '{"k":{"z":1}}', '{"userIdentity.principalId":"P","userIdentity.sessionContext.mfa":"true"}')]


def test_cef(lines):
    df = logs.cef(lines(r"Sep 1 host CEF:0|Ven\|dor|Prod|1.0|100|Name|9|src=1.2.3.4 msg=two words\=x act=blocked", "CEF:0|V|P|1|2|N|3|src=5.6.7.8 extra=e"))
    assert rows(df, "vendor", "severity", "src", "msg", "act", "_extra") == [("Ven|dor", "9", "1.2.3.4", "two words=x", "blocked", ""), ("V", "3", "5.6.7.8", "", "", '{"extra":"e"}')]


def test_leef(lines):
    df = logs.leef(lines("LEEF:1.0|V|P|1|login|src=1.1.1.1\tusr=bob", "LEEF:2.0|V|P|1|out|^|src=2.2.2.2^usr=a=b", "LEEF:2.0|V|P|1|hex|x7c|src=3.3.3.3|usr=c"))
    assert rows(df, "event_id", "src", "usr") == [("login", "1.1.1.1", "bob"), ("out", "2.2.2.2", "a=b"), ("hex", "3.3.3.3", "c")]


def test_logfmt(lines):
    df = logs.logfmt(lines(r'level=info msg="a \"q\"\nb" flag n=1', "nothing here", "level=warn other=x"))
    assert rows(df, "level", "msg", "flag", "n", "_extra") == [("info", 'a "q"\nb', "", "1", ""), ("warn", "", "", "", '{"other":"x"}')]


def test_w3c(lines):
    df = logs.w3c(lines("#Version: 1.0", "#Fields: date time c-ip cs(User-Agent)", "2024-01-02 03:04:05 1.2.3.4 Moz+5", "#Fields: date time s-ip", "2024-01-03 00:00:00 -"))
    assert rows(df, "Timestamp", "c-ip", "cs(User-Agent)", "s-ip") == [("2024-01-02T03:04:05Z", "1.2.3.4", "Moz 5", ""), ("2024-01-03T00:00:00Z", "", "", "")]


def test_zeek(lines):
    df = logs.zeek(lines("#separator \\x09", "#unset_field\t-", "#path\tconn", "#fields\tts\tid.orig_h\tnote", "1.5\t1.2.3.4\t-", "2.5\t(empty)\tx", "#close\tx"))
    assert [tuple(r) for r in df.collect()] == [("1.5", "1.2.3.4", ""), ("2.5", "", "x")]


def test_zeek_folder_of_two_logs(spark, tmp_path):
    (tmp_path / "conn.log").write_text("#separator \\x09\n#unset_field\t-\n#path\tconn\n#fields\tts\tid.orig_h\n1.5\t1.2.3.4\n2.5\t-\n")
    (tmp_path / "dns.log").write_text("#separator \\x09\n#unset_field\t?\n#path\tdns\n#fields\tts\tquery\n3.5\ta.b\n4.5\t?\n5.5\t-\n#fields\tquery\tts\nc.d\t6.5\n")
    df = logs.zeek(logs.read_lines(spark, str(tmp_path)))
    assert df.columns == ["_path", "query", "ts", "id.orig_h"]  # of the distinct headers, in text order
    assert sorted((r["_path"], r["ts"], r["id.orig_h"], r["query"]) for r in df.collect()) == [("conn", "1.5", "1.2.3.4", ""), ("conn", "2.5", "", ""), ("dns", "3.5", "", "a.b"), ("dns", "4.5", "", ""), ("dns", "5.5", "", "-"), ("dns", "6.5", "", "c.d")]


def test_w3c_columns_beyond_the_most(lines):
    df = logs.w3c(lines("#Fields: a b c d", "1 2 3 4", "5 6"), most=2)
    assert [tuple(r) for r in df.collect()] == [("1", "2", '{"c":"3","d":"4"}'), ("5", "6", "")]


def test_headers_of_many_files_are_joined(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "BROADCAST_HEADERS", 1)
    for i in range(4):
        (tmp_path / f"{i}.log").write_text(f"#Fields: a b{i}\n{i} x\n#Fields: b{i} a\ny {i}\n")
    got = logs.w3c(logs.read_lines(spark, str(tmp_path)))
    assert sorted((r["a"], *(r[f"b{i}"] for i in range(4))) for r in got.collect()) == sorted((str(i), *(v if k == i else "" for k in range(4))) for i in range(4) for v in "xy")


def test_timed(lines):
    df = logs.timed_log(lines('2024-01-02 03:04:05,123 INFO "two words" x', "2024-01-02--03-04-05 y", "no time"))
    assert rows(df, "time", "field_2", "field_3", "field_4") == [("2024-01-02 03:04:05,123", "INFO", "two words", "x"), ("2024-01-02--03-04-05", "y", "", "")]


@pytest.mark.parametrize("kind, text", [
    ("w3c", "#Fields: a b"), ("zeek", "#separator \\x09"), ("cef", "CEF:0|a|b|c|d|e|1|"), ("leef", "LEEF:1.0|a|b|c|d|"), ("syslog5424", "<1>1 - - - - - -"), ("syslog3164", "Oct 11 22:14:15 h a: b"), ("access", "1.2.3.4 - - [20/Jun/2012:00:00:00 +0000] x"),
    ("cloudtrail", '{"eventSource":"x"}'), ("jsonl", '{"a":1}'), ("logfmt", "a=1 b=2"), ("timed", "2024-01-02 03:04:05 x"), ("csv", "a,b,c"),
])
def test_sniffing(lines, kind, text):
    assert logs.sniff(lines(text, text)) == kind


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name;"text; x"\n"multi\nline";"say ""hi"""\nb;\n')
    assert logs.delimiter('a;"b,c,d,e";f') == ";"
    df = logs.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["name", "text; x", "_extra"] and sorted(map(tuple, df.collect())) == [("b", "", ""), ("multi\nline", 'say "hi"', "")]
    (tmp_path / "b.log").write_text("level=info n=1\r\nlevel=warn n=2\r\n\r\n")
    assert rows(logs.load(spark, str(tmp_path / "b.log")), "level", "n") == [("info", "1"), ("warn", "2")]


def test_containers(spark, tmp_path):
    base = sqlite3.connect(tmp_path / "x.db")
    base.execute("create table t (a integer, b text)")
    base.executemany("insert into t values (?, ?)", [(1, "x"), (2, None)])
    base.commit()
    base.close()
    got = files.sqlite_table(files.read_files(spark, str(tmp_path), "*.db"), "t", "a long, b string")
    assert sorted(map(tuple, got.collect())) == [(1, "x"), (2, None)]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("../up.txt", "1")
        z.writestr("cv.pdf.exe", "22")
    with tarfile.open(tmp_path / "y.tar", "w") as t:
        info = tarfile.TarInfo("ok/file.txt")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "z.zip").write_bytes(b"not an archive")
    entries = files.archive_entries(files.read_files(spark, str(tmp_path), "*.{zip,tar}"))
    assert sorted((r["entry"], r["size"], r["warning"]) for r in entries.collect()) == [("../up.txt", 1, "traversal"), ("cv.pdf.exe", 2, "double extension"), ("ok/file.txt", 3, "")]


def test_timed_logs_keep_later_words(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05 a b c d e f g h i \"j k\" l",), ("2024-01-02 03:04:05 a",)], "value string")
    assert [(r["field_9"], r["rest"]) for r in logs.timed_log(df).collect()] == [("h", 'i "j k" l'), ("", "")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_logfmt_finds_pairs_once(lines):
    df = logs.logfmt(lines('a=1 b="x y" a=2 c', "plain", 'b=2 d="q \\"z\\""'))
    assert sorted((r["a"], r["b"], r["c"], r["_extra"]) for r in df.collect()) == [("", "2", "", '{"d":"q \\"z\\""}'), ("2", "x y", "", "")]
    maps = logs._logfmt_maps(lines("a=1"))._jdf.queryExecution().optimizedPlan().toString()
    assert maps.count("regexp_extract_all") == 2


def test_json_lines_are_parsed_once(lines):
    df = logs.json_lines(lines("no record", '{"a":1}', '{"a":2,"b":3}'))
    assert [tuple(r) for r in df.collect()] == [("1", ""), ("2", '{"b":"3"}')]
    assert _plan(df).count("ArrowEvalPython") == 1


def test_the_first_record_stands_behind_many_other_lines(lines):
    df = logs.json_lines(lines(*["no record"] * (logs.FIRST_LINES + 5), '{"z":1}', '{"a":2}'))
    assert df.columns == ["z", "_extra"] and [tuple(r) for r in df.collect()] == [("1", ""), ("", '{"a":"2"}')]


def test_json_leaf_pairs_read_the_files_once(spark, sf_dir):
    from strandline import source_queries

    assert _plan(source_queries.json_leaf_pairs(spark, sf_dir)).count("FileScan text") == 1
