import hashlib
from collections import defaultdict

from strandline.llm import warc

PAGES = "page_id long, url string, html string, digest string, file string"


def test_round_trip(spark):
    big, html = "x" * 1500, "ü" * 600
    rows = [(1, "http://a/ b%20\r\n", big), (2, None, big), (4, "u", big), (3, "v", html), (8, "v", html), (5, "w", "tiny"), (6, "w", "tiny"), (None, None, None), (None, "n", big), (4, "again", big), (7, "q", "")]
    pages = spark.createDataFrame([r + ("d", "f") for r in rows], PAGES).repartition(3)
    folder, index = warc.write_archives(pages)
    got = sorted((tuple(r)[:7] for r in warc.read_records(folder, index).drop("payload").collect()), key=str)
    largest = defaultdict(int)
    for i, _, h in rows:
        largest[h] = max(largest[h], i or 0)
    want = []
    for i, u, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= 1000 and i != largest[h]
        want.append((i, u, "revisit" if revisit else "response", len(b), hashlib.sha1(b).hexdigest(), largest[h] if revisit else None, True))
    assert got == sorted(want, key=str)
    payloads = {r["page_id"]: r["payload"] for r in warc.read_records(folder, index.filter("page_id in (4, 8, 5)")).collect()}
    assert {k: bytes(v) for k, v in payloads.items()} == {4: big.encode(), 8: html.encode(), 5: b"tiny"}


def test_shuffled_revisits_agree(spark, sf_dir, monkeypatch):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.unionByName(pages.withColumn("page_id", pages.page_id + 10_000))
    a = sorted(map(tuple, warc.digest(pages).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    assert a == sorted(map(tuple, warc.digest(pages).collect())) and any(r[3] == "revisit" for r in a)


def test_nearby_ranges_are_read_together(spark, monkeypatch):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    folder, index = warc.write_archives(pages)
    monkeypatch.setattr(warc, "READ_BYTES", 500)
    assert warc.read_records(folder, index.filter("page_id % 7 = 0")).count() == 8


def test_empty(spark):
    assert warc.digest(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
