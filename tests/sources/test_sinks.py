import json

from strandline.operators import indicators
from strandline.sources import sinks


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.b/'x 1.2.3.4"), (2, "1.2.3.4 bob@c.org")], "id int, t string")
    found = indicators.indicators(df, "id", "t")
    assert sinks.indicator_list(found).count() == 3
    objects = [json.loads(r["object"]) for r in sinks.stix_objects(found).collect()]
    assert {o["pattern"] for o in objects} == {"[ipv4-addr:value = '1.2.3.4']", "[email-addr:value = 'bob@c.org']", "[url:value = 'http://a.b/']"}
    assert {o["id"] for o in objects} == {r["id"] for r in sinks.stix_objects(found).collect()}
    attributes = [json.loads(r["attribute"]) for r in sinks.misp_attributes(found).collect()]
    assert {(a["type"], a["value"]) for a in attributes} == {("ip-dst", "1.2.3.4"), ("email-src", "bob@c.org"), ("url", "http://a.b/")}
    sinks.write_csv(spark.createDataFrame([(1.0, 'say "hi", x', None)], "a double, b string, c string").coalesce(1), str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part-*"))
    assert text == b'a,b,c\r\n1,"say ""hi"", x",\r\n'
    for objects, column, kind, listed in ((sinks.stix_objects(found), "object", "bundle", lambda x: x["objects"]), (sinks.misp_attributes(found), "attribute", "event", lambda x: x["Event"]["Attribute"])):
        for rows, n in ((objects.repartition(3), 3), (objects.limit(0), 0)):
            path = tmp_path / f"{kind}{n}"
            sinks.write_bundle(rows, column, str(path), kind)
            document = json.loads("".join(p.read_text() for p in sorted(path.glob("*/part-*"))))
            assert len(listed(document)) == n == sinks.read_bundle(spark, str(path)).count()


def test_indicator_list_is_the_same_in_every_order(spark):
    rows = [("IP", "A.b", "low"), ("IP", "a.b", "critical"), ("URL", "a.b", None), ("IP", "A.B", "medium"), ("Pattern", "x", "high")]
    for order in (rows, rows[::-1]):
        got = sinks.indicator_list(spark.createDataFrame(order, "type string, value string, severity string")).collect()
        assert sorted(map(tuple, got), key=str) == [("IP", "A.B", "critical"), ("URL", "a.b", None)]


def test_summary_fits(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 40) AS pad")
    assert len(sinks.summary([("A", df), ("B", df)], 900)) <= 900 and "## B" in sinks.summary([("A", df), ("B", df)], 900)
