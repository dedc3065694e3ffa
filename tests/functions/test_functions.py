import datetime

import pytest
from pyspark.sql import functions as F

from strandline.functions import coerce, text, timeparse


def ms(*a):
    return datetime.datetime(*a, tzinfo=datetime.UTC).timestamp() * 1000


TIMES = {
    "1700000000": 1.7e12, "1700000000123": 1700000000123.0, "2024-01-02 03:04:05": ms(2024, 1, 2, 3, 4, 5), "2024-01-02T03:04:05.250Z": ms(2024, 1, 2, 3, 4, 5) + 250, "2024-01-02T03:04:05+0200": ms(2024, 1, 2, 1, 4, 5),
    "2024-01-02 03:04:05 +02:00": ms(2024, 1, 2, 1, 4, 5), "2024-01-02 03:04:05 UTC": ms(2024, 1, 2, 3, 4, 5), "2024-01-02 03:04:05 (GMT)": ms(2024, 1, 2, 3, 4, 5), "2024-01-02T03:04:05_UTC": ms(2024, 1, 2, 3, 4, 5),
    "2024-01-02--03-04-05": ms(2024, 1, 2, 3, 4, 5), "/Date(1700000000123)/": 1700000000123.0, "2024/1/2": ms(2024, 1, 2), "2024.02.31": ms(2024, 3, 2), "2024-05": ms(2024, 5, 1), "1972.06": ms(1972, 6, 1), "1972.5": ms(1972, 5, 1),
    "1973.500": ms(1973, 1, 1) + 0.5 * 365 * 86_400_000, "20240102": ms(2024, 1, 2), "2024": ms(2024, 1, 1), "[20/Jun/2012:19:05:12 +0200]": ms(2012, 6, 20, 17, 5, 12), "5/Jan/2012:00:00:00": ms(2012, 1, 5),
    "Tue, 02 Jan 2024 03:04:05 +0000": ms(2024, 1, 2, 3, 4, 5), "Jan 2, 2024": ms(2024, 1, 2), "01/02/2024": ms(2024, 1, 2), "": None, "hello": None, "2024-13-02 03:04:05": None, "99": None,
}


def test_times(spark):
    df = spark.createDataFrame([(t,) for t in TIMES], "t string").select("t", timeparse.time_millis(F.col("t")).alias("ms"))
    assert {r["t"]: r["ms"] for r in df.collect()} == TIMES
    assert [timeparse.relative_millis(x) for x in ("15m", "2 h", "0d", "3y")] == [900_000, 7_200_000, None, None]


def test_numbers_and_text(spark):
    values = {" 12 ": (12.0, 12.0), "12abc": (None, 12.0), "0x1F": (31.0, 0.0), "1d": (None, 1.0), "": (None, None), "NaN": (None, None), "-.5e1": (-5.0, -5.0), "Infinity": (None, None)}
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", coerce.number(F.col("v")), coerce.leading_number(F.col("v")))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == values
    typed = spark.createDataFrame([(1.0, 1.5, None, True, datetime.datetime(2024, 1, 2, 3, 4, 5, 6000))], "a double, b double, c string, d boolean, e timestamp")
    assert list(typed.select(*[coerce.text_of(typed, c).alias(c) for c in typed.columns]).first()) == ["1", "1.5", "", "true", "2024-01-02 03:04:05.006"]


@pytest.mark.parametrize("fn, given, wanted", [
    (text.refang, "hxxps[:]//a[.]b(dot)c x[@]y", "https://a.b.c x@y"), (text.csv_cell, 'a"b', '"a""b"'), (text.html_text, "<a&'>", "&lt;a&amp;&#39;&gt;"), (text.url_host, "http://u:p@Ex.ORG:8/x", "ex.org"), (text.url_path, "http://h/a/b?c#d", "/a/b"),
    (text.safe_link, "https://eur.safelinks.protection.outlook.com/?url=http%3A%2F%2Fa.b%2F&data=1", "http://a.b/"), (text.safe_link, "https://urldefense.proofpoint.com/v2/url?u=http-3A__a.b_c&d=1", "http://a.b/c"),
    (text.safe_link, "https://urldefense.com/v3/__http://a.b/__;!x", "http://a.b/"), (text.safe_link, "http://plain/", "http://plain/"), (text.numeric_host, "2130706433", "127.0.0.1"), (text.numeric_host, "0x7f000001", "127.0.0.1"), (text.numeric_host, "017700000001", "127.0.0.1"),
    (text.normal_url, "http://0x7f000001/%61?q=%62", "http://127.0.0.1/a?q=%62"), (text.formula_risk, "=cmd|x", "critical"), (text.formula_risk, "-5", "none"), (text.formula_risk, "@x", "low"), (text.channel_name, "Microsoft-Windows-Sysmon/Operational", "Sysmon"),
])
def test_text(spark, fn, given, wanted):
    assert spark.createDataFrame([(given,)], "v string").select(fn(F.col("v"))).first()[0] == wanted


def test_sizes_and_entropy(spark):
    assert [r[0] for r in spark.createDataFrame([(512,), (1536,), (3 << 20,)], "n long").select(text.byte_size(F.col("n"))).collect()] == ["512 B", "1.5 KB", "3.0 MB"]
    assert [r[0] for r in spark.createDataFrame([("",), ("aaaa",), ("abcd",)], "v string").select(text.entropy(F.col("v"))).collect()] == [0.0, 0.0, 2.0]


def test_numeric_hosts_are_split_once(spark):
    from pyspark.sql import functions as F

    from strandline.functions import text as tx
    from strandline.operators.joins import ipv4_number

    hosts = ["2130706433", "0x7f.1", "0177.0.0.01", "1.2.65536", "1.2.3.4.5", "256.1", "08.1", "4294967296", "", None, "a.b"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = [r[0] for r in df.select(tx.numeric_host(F.col("h"))).collect()]
    assert got == ["127.0.0.1", "127.0.0.1", "127.0.0.1", "1.2.65536", "1.2.3.4.5", "256.1", "08.1", "4294967296", "", None, "a.b"]
    plan = df.select(tx.numeric_host(F.col("h")).alias("q"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
