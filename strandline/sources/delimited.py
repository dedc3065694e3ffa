"""Delimited text in splits: quoted cells may hold line breaks anywhere, also where one split of a file ends.

A line either begins a record or lies inside a quoted cell, so each split is a function from the one or the other state to
the state after it. A first pass finds these functions, one row a split, where only lines with a quote (and those of a
file's first split, for its header) meet Python. Composed in file order they say how every split begins, and a second pass
parses all splits where they lie. Records over the end of a split are put together from the pieces of the splits they
touch, which are read again for it; where no split ends inside a cell there are none.

Both passes must cut the files alike. Spark cuts them by its settings when a job runs, so a split is known by its file,
begin and length, and rows of a split that the first pass has not seen are an error, never a guess.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Splits are sent to every task up to so many (some 30 bytes each); more are joined by split.
BROADCAST_SPLITS = 500_000
#: Splits that are read by one task hold about so many bytes together, if there are more of them than four a core.
TASK_BYTES = 64 << 20


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted cell is open after ``line``; a quote inside a bare cell, or after a closing one, is text."""
    at, end = 0, len(line)
    while True:
        if inside or at < end and line[at] == '"':
            at = at if inside else at + 1
            inside = False
            while True:  # to the quote that closes the cell
                at = line.find('"', at)
                if at < 0:
                    return True
                if line.startswith('""', at):
                    at += 2
                    continue
                at += 1
                break
        at = line.find(sep, at)
        if at < 0:
            return False
        at += 1


def cells_of(record: str, sep: str) -> list[str]:
    record = record.removesuffix("\r")
    if '"' not in record:
        return record.split(sep)
    out, at = [], 0
    while True:
        parts = []
        if record.startswith('"', at):
            at += 1
            while (quote := record.find('"', at)) >= 0:
                parts.append(record[at:quote])
                if not record.startswith('""', quote):
                    break
                parts.append('"')
                at = quote + 2
            if quote < 0:
                parts.append(record[at:])
            at = quote + 1 if quote >= 0 else len(record)
        end = record.find(sep, at)
        out.append("".join([*parts, record[at : end if end >= 0 else len(record)]]))
        if end < 0:
            return out
        at = end + 1


def _runs(files: list[int], blocks: list[int]) -> Iterator[tuple[int, int]]:
    begin = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or files[i] != files[begin] or blocks[i] != blocks[begin]:
            yield begin, i
            begin = i


def _functions(sep: str):
    """(file, block, after_out, after_in, header) of each split."""
    schema = pa.schema([("_f", pa.int64()), ("_b", pa.int64()), ("_l", pa.int64()), ("after_out", pa.bool_()), ("after_in", pa.bool_()), ("header", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, header, done = None, [False, True], [], True  # key: file, begin, length

        def row() -> pa.RecordBatch:
            known = "\n".join(header) if header and done else None
            return pa.RecordBatch.from_pylist([{"_f": key[0], "_b": key[1], "_l": key[2], "after_out": states[0], "after_in": states[1], "header": known}], schema=schema)

        for batch in batches:
            files, blocks, values, lengths = (batch.column(i).to_pylist() for i in range(4))
            for lo, hi in _runs(files, blocks):
                if key is None or (files[lo], blocks[lo]) != key[:2]:
                    if key is not None:
                        yield row()
                    key, states, header, done = (files[lo], blocks[lo], lengths[lo]), [False, True], [], blocks[lo] != 0
                for line in values[lo:hi]:
                    if line is None:
                        continue
                    if not done and (header or line.strip()):
                        header.append(line if header else line.removeprefix("﻿"))
                        done = not ends_inside(line, states[0], sep)
                    states = [ends_inside(line, s, sep) for s in states]
        if key is not None:
            yield row()

    return run


_PIECES = pa.schema([("_f", pa.int64()), ("_b", pa.int64()), ("piece", pa.int32()), ("text", pa.string()), ("cells", pa.list_(pa.string()))])
#: Kinds of rows: a whole record, the end of one that began in an earlier split, the beginning of one that goes on.
_RECORD, _END, _BEGIN = 0, 1, 2


def _records(sep: str, pieces: bool):
    """The records of each split, or only the pieces of those that other splits share; a file's header is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, held, kind, head = None, False, [], _RECORD, False
        out: list[tuple] = []

        def close(kind: int) -> None:
            if pieces == (kind != _RECORD):
                text = "\n".join(held)
                if kind != _RECORD:
                    out.append((*key, kind, text, None))
                elif len(held) > 1 or text.strip():
                    out.append((*key, kind, None, cells_of(text, sep)))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)

        for batch in batches:
            files, blocks, values, starts = (batch.column(i).to_pylist() for i in range(4))
            for lo, hi in _runs(files, blocks):
                if (files[lo], blocks[lo]) != key:
                    if held:
                        close(kind if kind == _END else _BEGIN)
                    key, inside, held = (files[lo], blocks[lo]), starts[lo], []
                    kind, head = _END if inside else _RECORD, blocks[lo] == 0
                for line in values[lo:hi]:
                    held.append(line)
                    if '"' in line:
                        inside = ends_inside(line, inside, sep)
                    if not inside:
                        if head and (len(held) > 1 or line.strip()):
                            head = False
                        else:
                            close(kind)
                        held, kind = [], _RECORD
            if out:
                yield batch_of(out)
                out = []
        if held:
            close(kind if kind == _END else _BEGIN)
        if out:
            yield batch_of(out)

    return run


def _joined(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([cells_of(t, sep) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["_f", "cells"])

    return run


def _names(header: str, sep: str) -> list[str]:
    out: list[str] = []
    for i, name in enumerate(cells_of(header, sep)):
        name = name.strip() or f"_c{i}"
        same = sum(n == name or n.startswith(f"{name} (") for n in out)
        out.append(f"{name} ({same + 1})" if same else name)
    return out


def split_states(lines: DataFrame, sep: str) -> DataFrame:
    """(_f, _b, _l, header, starts, ends) of every split: whether it begins and ends inside a quoted cell."""
    shown = F.when(F.contains("value", F.lit('"')) | (F.col("_b") == 0), F.col("value"))
    functions = lines.select("_f", "_b", shown.alias("value"), "_l").mapInArrow(_functions(sep), "_f long, _b long, _l long, after_out boolean, after_in boolean, header string")
    # composed in order: a constant function sets the state, the others after it keep or swap it
    constant, swaps = F.col("after_out") == F.col("after_in"), F.col("after_out") & ~F.col("after_in")
    upto = W.partitionBy("_f").orderBy("_b")
    counted = functions.withColumn("_swaps", F.sum(swaps.cast("int")).over(upto.rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = F.last(F.when(constant, F.struct(F.col("after_out").alias("state"), "_swaps")), ignorenulls=True).over(upto.rowsBetween(W.unboundedPreceding, W.currentRow))
    after = counted.withColumn("_set", last).withColumn("ends", F.coalesce("_set.state", F.lit(False)) != ((F.col("_swaps") - F.coalesce("_set._swaps", F.lit(0))) % 2 == 1))
    return after.select("_f", "_b", "_l", "header", F.coalesce(F.lag("ends").over(upto), F.lit(False)).alias("starts"), "ends")


def read_delimited(spark: SparkSession, path: str | list[str], sep: str) -> DataFrame:
    """Files of delimited text as text columns, each under its own header; see ``logs.read_csv``."""
    raw = spark.read.option("lineSep", "\n").text(path)
    meta = F.col("_metadata")
    lines = raw.select(F.xxhash64(meta["file_path"]).alias("_f"), meta["file_block_start"].alias("_b"), meta["file_block_length"].alias("_l"), "value", F.monotonically_increasing_id().alias("_at"))
    lines = _together(spark, lines)
    states = _kept(split_states(lines, sep))
    if not states.groupBy("_f").agg(F.count("header").alias("n"), F.max("_b").alias("last"), F.bool_or("ends").alias("open")).filter("n = 0 and (last > 0 or open)").isEmpty():
        raise ValueError("a header must end within the first split of its file")
    headers = [r["header"] for r in states.filter("header is not null").groupBy("header").agg(F.min("_f").alias("f")).orderBy("f").collect()]  # distinct ones
    if not headers:
        return spark.createDataFrame([], "_extra string")
    edges = states.filter("starts or ends")
    small = states.count() <= BROADCAST_SPLITS
    split = ["_f", "_b", "_l"]

    def under(wanted: DataFrame, how: str) -> DataFrame:
        side = wanted.select(*split, "starts")
        if small:
            found = lines.join(F.broadcast(side), split, how)
        else:
            found = lines.join(side, split, how).repartition("_f", "_b").sortWithinPartitions("_f", "_b", "_at")
        changed = F.raise_error(F.lit("the files are cut into other splits than when they were opened: open them again under the present settings"))
        return found.select("_f", "_b", "value", F.coalesce("starts", changed.cast("boolean")).alias("starts"))

    piece = "_f long, _b long, piece int, text string, cells array<string>"
    rows = under(states, "left").mapInArrow(_records(sep, False), piece).select("_f", "cells")
    if not edges.isEmpty():
        parts = under(edges, "inner").mapInArrow(_records(sep, True), piece)
        order = W.partitionBy("_f").orderBy("_b", "piece")
        numbered = parts.withColumn("_n", F.sum((F.col("piece") == _BEGIN).cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        whole = numbered.groupBy("_f", "_n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "piece", "text"))), lambda p: p["text"]), "\n").alias("text"))
        rows = rows.unionByName(whole.select("_f", "text").mapInArrow(_joined(sep), "_f long, cells array<string>"))
    named = {h: _names(h, sep) for h in headers}
    if len(headers) == 1:
        names = named[headers[0]]
        width = F.lit(len(names))
        shown = [F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]
    else:
        names = list(dict.fromkeys(n for h in headers for n in named[h]))
        listed = spark.createDataFrame([(h, named[h]) for h in headers], "header string, _names array<string>")
        of_file = states.filter("header is not null").select("_f", "header").join(F.broadcast(listed), "header").select("_f", "_names")
        rows, width = rows.join(of_file, "_f"), F.size("_names")
        shown = [F.coalesce(F.when(F.array_contains("_names", n), F.get("cells", F.array_position("_names", n).cast("int") - 1)), F.lit("")).alias(n) for n in names]
    extra = F.when(F.size("cells") > width, F.to_json(F.slice("cells", width + 1, F.size("cells")))).otherwise("")
    return rows.select(*shown, extra.alias("_extra"))


def _together(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """Small splits, many to a task: a task costs more than some kilobytes of text do. The splits stay as they were cut."""
    cut = lines.rdd.getNumPartitions()
    size = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-cut * size // TASK_BYTES))
    return lines.coalesce(tasks) if tasks < cut else lines


def _kept(df: DataFrame) -> DataFrame:
    """One row a split, written once."""
    from strandline.sources.folder import work_path

    path = work_path(df.sparkSession, "splits")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
