import hashlib

from pyspark.sql import functions as F

from strandline.functions import binary, timeparse
from strandline.operators import joins, stats, timeline


def test_bytes(spark):
    rows = [(bytearray("plain é".encode()),), (bytearray("wide text".encode("utf-16-le")),), (bytearray(b"\xff\xfe\x01raw\x80"),)]
    assert [r[0] for r in spark.createDataFrame(rows, "b binary").select(binary.sniffed_text(F.col("b"))).collect()] == ["plain é", "wide text", "ÿþ\x01raw\x80"]
    data = b"\x00\x01first run\x02tiny\x02" + "second run".encode("utf-16-le") + b"\x07first run"
    assert spark.createDataFrame([(bytearray(data),)], "b binary").select(binary.printable_runs(F.col("b"))).first()[0] == ["first run", "second run"]
    names = spark.createDataFrame([(["B.f", "a.g"],)], "n array<string>").select(binary.token_hash(F.col("n")), binary.token_hash(F.col("n"), sort=True)).first()
    assert list(names) == [hashlib.md5(b"b.f,a.g").hexdigest(), hashlib.md5(b"a.g,b.f").hexdigest()]
    six = spark.createDataFrame([("2606:4700::1",), ("fe80::1",), ("::1",), ("1.2.3.4",), (None,)], "a string").select(binary.ipv6_full("a")).collect()
    assert [r[0] for r in six] == ["2606:4700:0000:0000:0000:0000:0000:0001", None, None, None, None]


def test_labels():
    assert [timeparse.duration_text(x) for x in (0, 250, 67_000, 7_500_000, -90_000_000)] == ["0ms", "250ms", "1m 7s", "2h 5m", "-1d 1h"]
    assert timeparse.tick_pattern(5000) == "HH:mm:ss.SSS" and timeparse.tick_pattern(30 * 86_400_000) == "yyyy-MM-dd"


def test_tables(spark):
    df = spark.createDataFrame([(0.0, "a"), (61_000.0, "b")], "_t double, k string")
    table = timeline.histogram_table(timeline.histogram(df, 0, 120_000, 60_000, "k"), 60_000)
    assert sorted(map(tuple, table.collect())) == [(0, "1970-01-01 00:00:00", "1970-01-01 00:01:00", 1, 0), (1, "1970-01-01 00:01:00", "1970-01-01 00:02:00", 0, 1)]
    values = spark.createDataFrame([("b", 1), ("A", 3), ("c", 2)], "value string, n int")
    assert ["".join(r["value"] for r in stats.card_order(values, m).collect()) for m in ("count_desc", "count_asc", "text_asc", "text_desc")] == ["Acb", "bcA", "Abc", "cbA"]
    assert stats.quick_filter(values, "A 3").count() == 1


def test_firefox_and_downloads(spark):
    visits = spark.createDataFrame([(1, 5, 1_700_000_000_000_000, 0), (2, 6, 0, 1)], "id long, place_id long, visit_date long, from_visit long")
    places = spark.createDataFrame([(5, "http://a/", "A")], "id long, url string, title string")
    history = joins.firefox_history(visits, places)
    rows = {r["id"]: r for r in history.collect()}
    assert rows[2]["referrer"] == "http://a/" and rows[2]["address"] == "" and rows[2]["time"] is None and str(rows[1]["time"]).startswith("2023-11-14")
    downloads = spark.createDataFrame([(9, 13_350_000_000_000_000, "/home/u/f.zip", 77)], "id long, start_time long, target string, total_bytes long")
    assert [(r["type"], r["title"], r["total_bytes"]) for r in joins.with_downloads(history, downloads).filter("id = 9").collect()] == [("download", "f.zip", 77)]


def test_all_printable_runs(spark):
    data = b"\x01".join(b"run %06d" % i for i in range(1500))
    assert len(spark.createDataFrame([(bytearray(data),)], "b binary").select(binary.printable_runs(F.col("b"))).first()[0]) == 1500
