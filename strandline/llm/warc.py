"""WARC archives: index first, then coalesced sorted byte-range reads of the selected records.

Archives are ``.warc.gz`` files with one gzip member a record. Tasks write them straight to a shared folder (any file
system that ``pyarrow.fs`` reaches) under names of their own, and return the index: file, offset, length, URL and digest
of every record. A task that runs again writes a new file, and only the index rows of the attempt that counts name it,
so lost executors leave at most files that nothing refers to.

Reading takes any selection of the index, deals it by file and stretch of 64 MB, sorts it by offset, and joins ranges
that lie close together into one read.

Defined results: a null payload is empty; a null URL writes no WARC-Target-URI and reads back as null; a null id sorts
before all others and is never the largest, unless all are null; rows with equal ids and equal payloads are alike, so
if theirs is the largest id, each of them is a response. Extra columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.scratch import keep, new_path, shuffle_partitions

DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Broadcast the revisits only up to so many rows (of about 100 bytes); beyond, they join by a shuffle.
BROADCAST_ROWS = 100_000
FILE_BYTES = 512 << 20
STRETCH = 64 << 20
GAP_BYTES, READ_BYTES = 128 << 10, 8 << 20

INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"
_INDEX_SCHEMA = pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string())])


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    value = urn.strip("<>").rpartition(":")[2]
    return None if value == "null" else int(value)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record of an HTTP response; a revisit keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        # line breaks in a field would end it; they are percent-coded, and so is the percent sign that marks that
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record; ``payload`` is None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = fields["WARC-Type"] == "revisit"
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": _page_id(fields["WARC-Record-ID"]),
        "url": None if url is None else re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url),
        "record_type": fields["WARC-Type"],
        "payload": None if revisit else payload,
        "payload_bytes": said,
        "said_digest": base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex(),
        "refers_to": _page_id(fields["WARC-Refers-To"]) if revisit else None,
    }


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        out = file = None
        at = 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, digest, keeper, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        file, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{file}", compression=None)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = packer.compress(build_record(page_id, url, html, digest, keeper, revisit)) + packer.flush()
                    out.write(member)
                    rows.append((page_id, file, at, len(member), url, digest, "revisit" if revisit else "response"))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX_SCHEMA)], schema=_INDEX_SCHEMA)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, smallest: int = 1000) -> tuple[str, DataFrame]:
    """(folder, index): one record a row of ``pages`` (page_id, url, html); payloads of ``smallest`` bytes or more dedupe."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    ids = rows.filter(F.octet_length("html") >= smallest).select("page_id", "digest")
    kept = ids.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1 and keeper is not null").drop("n")
    revisits = keep(ids.join(kept, "digest").filter("page_id is null or page_id < keeper").distinct(), "warc-revisits")
    side = F.broadcast(revisits) if revisits.count() <= BROADCAST_ROWS else revisits
    joined = rows.join(side, rows["page_id"].eqNullSafe(side["page_id"]) & (rows["digest"] == side["digest"]), "left")
    typed = joined.select(rows["page_id"], "url", "html", rows["digest"], "keeper", F.col("keeper").isNotNull().alias("revisit"))
    return folder, keep(typed.mapInArrow(_write(folder), INDEX), "warc-index")


_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, digest_holds boolean"


def _read(folder: str, with_payload: bool):
    def records(fs, base: str, rows: list[tuple]) -> list[dict]:
        file, begin = rows[0][0], rows[0][1]
        with fs.open_input_file(f"{base}/{file}") as f:
            blob = f.read_at(rows[-1][1] + rows[-1][2] - begin, begin)
        found = []
        for _, offset, length in rows:
            r = parse_record(zlib.decompress(blob[offset - begin : offset - begin + length], 31))
            r["payload_digest"] = r["said_digest"] if r["payload"] is None else hashlib.sha1(r["payload"]).hexdigest()
            r["digest_holds"] = r["payload_digest"] == r["said_digest"] and (r["payload"] is None or len(r["payload"]) == r["payload_bytes"])
            found.append(r)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("digest_holds", pa.bool_())]
        schema = pa.schema(fields + [("payload", pa.binary())] * with_payload)
        held: list[tuple] = []

        def near(row: tuple) -> bool:
            last = held[-1]
            return row[0] == last[0] and row[1] - last[1] - last[2] <= GAP_BYTES and row[1] + row[2] - held[0][1] <= READ_BYTES

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and not near(row):
                    yield pa.RecordBatch.from_pylist(records(fs, base, held), schema=schema)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(records(fs, base, held), schema=schema)

    return run


def read_records(folder: str, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` (or any selection of it) names, by coalesced byte-range reads."""
    parts = shuffle_partitions(index.sparkSession)
    ranges = index.select("file", "offset", "length").repartition(parts, "file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")
    return ranges.mapInArrow(_read(folder, with_payload), _RECORD + ", payload binary" * with_payload)


def digest(pages: DataFrame) -> DataFrame:
    folder, index = write_archives(pages)
    return read_records(folder, index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
