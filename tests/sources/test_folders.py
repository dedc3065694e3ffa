from strandline.sources import folders


def test_formats_and_tables(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    texts = {
        "a.log": "level=info n=1\nlevel=warn n=2\n", "deep/b": "<13>1 2024-01-02T03:04:05Z h app - - - said\n", "c.txt": "#Fields: date time x\n2024-01-02 03:04:05 1\n", "d.tsv": "a\tb,c\n1\t2\n", "e.csv": "a;b\n1;2\n",
        "f": "x|y|z\n1|2|3\n", "g.ndjson": '{"eventSource":"s","eventName":"E"}\n', "h.jsonl": '{"a":{"b":1}}\nbroken\n', "i.json": '[\n{"a": 1},\n{"a": 2}\n]\n', "j.cef": "CEF:0|V|P|1|2|N|3|src=1.1.1.1\n", "empty.log": "", "blank": "\n\n", "k.evtx": "ElfFile\n",
        "two words.log": "level=info n=3\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = {r["file"].rsplit("/", 1)[1].replace("%20", " "): (r["format"], r["sep"]) for r in folders.formats(spark, str(tmp_path)).collect()}
    assert got == {
        "a.log": ("logfmt", ""), "b": ("syslog5424", ""), "c.txt": ("w3c", ""), "d.tsv": ("csv", "\t"), "e.csv": ("csv", ";"), "f": ("csv", "|"), "g.ndjson": ("cloudtrail", ""), "h.jsonl": ("jsonl", ""), "i.json": ("json", ""),
        "j.cef": ("cef", ""), "k.evtx": ("unread", ""), "two words.log": ("logfmt", ""),
    }
    tables = folders.load_folder(spark, str(tmp_path))
    assert {k: t.count() for k, t in tables.items()} == {"cef": 1, "cloudtrail": 1, "csv \t": 1, "csv ;": 1, "csv |": 1, "json": 2, "jsonl": 1, "logfmt": 3, "syslog5424": 1, "w3c": 1}
    assert tables["csv \t"].columns == ["a", "b,c", "_extra"] and tables["jsonl"].first()["a.b"] == "1"
    both = folders.merge_folder(spark, str(tmp_path))
    assert both.count() == 13 and {r["__source"] for r in both.select("__source").distinct().collect()} == set(tables)
