"""Delimited text read in splits, against one reading of each whole file."""

import csv
import io
import json
import random

import pytest

from strandline.sources import delimited, logs


@pytest.fixture()
def tiny_splits(spark):
    before = {n: spark.conf.get(f"spark.sql.files.{n}") for n in ("maxPartitionBytes", "openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for name, value in before.items():
        spark.conf.set(f"spark.sql.files.{name}", value)


def whole(text, sep):
    """(names, rows) by the standard library, for text that it reads as we do."""
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if r]
    return rows[0], rows[1:]


def make(r, n, sep, names, end):
    cell = lambda: r.choice(["", "a", "two words", "ü", f"x{sep}y", 'say "hi"', "line\nbreak", "\n", '"', "\n\n" * r.randrange(30) + "end", "q" * r.randrange(200)])
    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=sep, lineterminator=end, quoting=r.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    w.writerow(names)
    for _ in range(n):
        row = [cell() for _ in range(r.choice([len(names)] * 6 + [1, len(names) + 2]))]
        w.writerow(row if row != [""] else ["a"])
        if r.random() < 0.1:
            out.write(end)
    return out.getvalue()


@pytest.mark.parametrize("size", [48, 300, 100_000])
def test_splits_equal_whole_files(spark, tmp_path, tiny_splits, size):
    r, want = random.Random(size), []
    headers = [["a", "b", "c"], ["c", "d"], ["a", "b", "c"]]
    for i, names in enumerate(headers):
        text = make(r, 60, ";", names, r.choice(["\n", "\r\n"]))
        (tmp_path / f"{i}.csv").write_text(text, newline="")
        got_names, rows = whole(text, ";")
        for row in rows:
            cells = dict(zip(got_names, row))
            extra = row[len(got_names) :]
            want.append((*[cells.get(n, "") for n in "abcd"], json.dumps(extra, ensure_ascii=False, separators=(",", ":")) if extra else ""))
    tiny_splits(size)
    df = logs.read_csv(spark, str(tmp_path), ";")
    assert sorted(df.columns) == ["_extra", "a", "b", "c", "d"]
    if size < 1000:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    assert sorted((*[r[n] for n in "abcd"], r["_extra"]) for r in df.collect()) == sorted(want)


def test_quotes_inside_bare_cells_are_text():
    for line, sep in (('a,5" pipe,x', ","), ('"a"b"c,d', ","), ('"x,""y"" z",w', ","), ("", ","), ('"', ","), ('""', ","), ('"""', ","), ('a"\tb"', "\t")):
        rows = list(csv.reader([line], delimiter=sep))
        assert delimited.cells_of(line, sep) == (rows[0] if rows and rows[0] else [""])
    assert [delimited.ends_inside(x, False, ",") for x in ('a,"b', 'a,b"', '"a""', '"a"', '"a"b"', '"a",b,"')] == [True, False, True, False, False, True]
    assert [delimited.ends_inside(x, True, ",") for x in ('a"', "a", 'a""', 'a",b', 'a","')] == [False, True, True, False, True]


def test_a_cell_that_is_never_closed_and_odd_headers(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_text('﻿a,,a\n1,2,3\n\n"open, and\nmore')
    tiny_splits(16)
    df = logs.read_csv(spark, str(tmp_path / "a.csv"), ",")
    assert df.columns == ["a", "_c1", "a (2)", "_extra"]
    assert sorted(map(tuple, df.collect())) == [("1", "2", "3", ""), ("open, and\nmore", "", "", "")]
    (tmp_path / "b.csv").write_text('"a long first line of the header\nheader",b\n1,2\n')
    with pytest.raises(ValueError):
        logs.read_csv(spark, str(tmp_path / "b.csv"), ",")
    (tmp_path / "c.csv").write_text("\n" * 100)
    tiny_splits("4m")
    spark.conf.set("spark.sql.files.openCostInBytes", "4m")  # one split
    assert logs.read_csv(spark, str(tmp_path / "c.csv"), ",").count() == 0


def test_splits_are_joined_where_they_are_many(spark, tmp_path, tiny_splits, monkeypatch):
    monkeypatch.setattr(delimited, "BROADCAST_SPLITS", 0)
    text = "a,b\n" + "".join(f'{i},"x\n{"y" * (i % 50)}\n"\n' for i in range(80))
    (tmp_path / "a.csv").write_text(text)
    tiny_splits(40)
    got = logs.read_csv(spark, str(tmp_path / "a.csv"), ",")
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted((str(i), f"x\n{'y' * (i % 50)}\n") for i in range(80))


def test_other_splits_are_an_error(spark, tmp_path, tiny_splits):
    (tmp_path / "a.csv").write_text("a,b\n" + '1,"x\ny"\n' * 200)
    tiny_splits(100)
    df = logs.read_csv(spark, str(tmp_path / "a.csv"), ",")
    assert df.count() == 200
    tiny_splits(130)
    with pytest.raises(Exception, match="other splits"):
        logs.read_csv(spark, str(tmp_path / "a.csv"), ",") and df.select("a", "b").collect()


def test_small_splits_share_tasks(spark, tmp_path):
    from strandline.sources import delimited, logs

    (tmp_path / "a.csv").write_text("a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(30_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
        assert lines.rdd.getNumPartitions() > 80 and delimited._together(spark, lines).rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        rows = logs.read_csv(spark, str(tmp_path), ",").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert sorted((int(r["a"]), r["b"]) for r in rows) == [(i, f"x\n{i}") for i in range(30_000)]
