import json
import struct
import zipfile

from pyspark.sql import functions as F

from strandline.operators import decode, lookups
from strandline.sources import documents, files, packets


def capture(*frames):
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    return head + b"".join(struct.pack("<IIII", 1700000000 + i, 500000, len(f), len(f)) + f for i, f in enumerate(frames))


def frame(proto, payload, src=b"\x01\x02\x03\x04", dst=b"\x05\x06\x07\x08"):
    ip = bytes([0x45, 0]) + struct.pack(">H", 20 + len(payload)) + bytes(4) + bytes([64, proto]) + bytes(2) + src + dst
    return bytes(12) + b"\x08\x00" + ip + payload


def test_packets(spark, tmp_path):
    dns = struct.pack(">HHHH", 40000, 53, 40, 0) + bytes(12) + b"\x03www\x04test\x00"
    http = struct.pack(">HH", 1234, 80) + bytes(8) + bytes([0x50, 0x18]) + bytes(6) + b"GET /x HTTP/1.1\r\nHost: a\r\n"
    syn = struct.pack(">HH", 1, 2) + bytes(8) + bytes([0x50, 0x02]) + bytes(6)
    (tmp_path / "a.pcap").write_bytes(capture(frame(17, dns), frame(6, http), frame(6, syn), bytes(12) + b"\x08\x06" + bytes(20)))
    (tmp_path / "b.pcap").write_bytes(b"no capture")
    df = packets.read_packets(files.read_files(spark, str(tmp_path), "*.pcap"))
    assert [(r["protocol"], r["source_port"], r["info"]) for r in df.orderBy("time").collect()] == [("DNS", 40000, "www.test"), ("HTTP", 1234, "GET /x HTTP/1.1"), ("TCP", 1, "SYN"), ("ARP", None, "")]
    assert df.orderBy("time").first()["time"] == 1700000000500.0
    assert [(r["packets"], r["protocols"]) for r in packets.talkers(df).collect()] == [(3, ["DNS", "HTTP", "TCP"])]


def test_mail_and_workbooks(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b'From: "Pay Pal" <x@evil.ru>\r\nSubject: =?utf-8?q?Hi_=C3=A9?=\r\nContent-Type: text/plain\r\n\r\nbody text\r\n')
    row = documents.read_mail(files.read_files(spark, str(tmp_path), "*.eml")).first()
    assert (row["name"], row["address"], row["subject"], row["text"].strip(), row["attachments"]) == ("Pay Pal", "x@evil.ru", "Hi é", "body text", [])
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>4.5</v></c></row></sheetData></worksheet>')
    row = documents.read_workbooks(files.read_files(spark, str(tmp_path), "*.xlsx")).first()
    assert (row["sheet"], row["row"], row["cells"]) == ("sheet1", 1, {"A": "name", "C": "4.5"})


def test_json_grid_and_malformed(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"a": 1, "b": {"c": 2}}, {"a": None, "d": "x"}]))
    df = documents.read_json_grid(spark, str(tmp_path / "g.json"))
    assert sorted(map(tuple, df.select("a", "b", "d").collect())) == [("", "", "x"), ("1", '{"c":"2"}', "")]
    lines = spark.createDataFrame([("a,b",), ('"x,y",b',), ("a,b,c",), ('a,"b',)], "value string")
    assert sorted(r[0] for r in documents.malformed(lines, 2).collect()) == ['a,"b', "a,b,c"]


def test_lookups(spark):
    code = "Sub AutoOpen()\nEnd Sub\nPrivate Sub Workbook_Open()\nFunction helper()"
    df = spark.createDataFrame([(code, "run p.o.w.e.r now a.b", "VirtualAlloc CreateRemoteThread")], "c string, s string, t string")
    row = df.select(lookups.macro_triggers(F.col("c")), lookups.without_separators(F.col("s")), lookups.capabilities(F.col("t"), {"injection": ["virtualalloc", "createremotethread", "x"], "net": ["socket"]})).first()
    assert list(row) == [["autoopen", "workbook_open"], "run power now ab", ["injection"]]


def test_more_encodings(spark):
    texts = {"octal": "\\110\\151\\041\\041", "entities": "&#72;&#105;&#33;&#33;", "spaced_hex": "48 69 21 21 48 69 21 21", "unicode": "\\u0048\\u0069\\u0021\\u0021"}
    df = spark.createDataFrame([(k, f"x {v} y") for k, v in texts.items()], "k string, t string")
    got = {r["k"]: (r["chain"], r["payload_text"]) for r in decode.decode_layers(df, "k", "t", 1).collect()}
    assert got == {k: ([k], "Hi!!" * (2 if k == "spaced_hex" else 1)) for k in texts}


def test_json_grids_of_several_arrays(spark, tmp_path):
    """An array a line gives all of its rows; a file of several arrays that run over lines is refused."""
    import pytest

    (tmp_path / "lines.json").write_text('[{"a":1},{"a":2,"t":"x] [y"}]\n\n[{"a":3}]\n{"a":4}\n')
    (tmp_path / "over.json").write_text('[\n {"a": 5,\n  "b": {"c": [1, 2]}},\n {"t": "] ["}\n]\n')
    got = documents.read_json_grid(spark, str(tmp_path))
    assert set(got.columns) == {"a", "b", "t"}
    assert sorted((r["a"], r["b"], r["t"]) for r in got.collect()) == [("", "", "] ["), ("1", "", ""), ("2", "", "x] [y"), ("3", "", ""), ("4", "", ""), ("5", '{"c":["1","2"]}', "")]
    (tmp_path / "two.json").write_text('[\n{"a":1}\n]\n[\n{"a":2}\n]')
    with pytest.raises(ValueError):
        documents.read_json_grid(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.json").write_text("")
    assert documents.read_json_grid(spark, str(tmp_path / "none")).count() == 0
