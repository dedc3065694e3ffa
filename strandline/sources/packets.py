"""Captured packets (classic pcap) as a timeline: one row a packet, parsed where the file's task runs."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, time double, source string, source_port int, target string, target_port int, protocol string, length int, info string"
_TCP_FLAGS = ("FIN", "SYN", "RST", "PSH", "ACK", "URG")


def _name(data: bytes, at: int) -> str:
    labels = []
    while at < len(data) and data[at] and data[at] < 64:
        labels.append(data[at + 1 : at + 1 + data[at]].decode("latin-1"))
        at += 1 + data[at]
    return ".".join(labels)


def _server_name(data: bytes) -> str:
    """The host that a TLS client hello asks for."""
    if data[:1] != b"\x16" or data[5:6] != b"\x01" or len(data) < 44:
        return ""
    at = 44 + data[43]
    at += 2 + int.from_bytes(data[at : at + 2], "big")
    at += 1 + data[at] + 2 if at < len(data) else 0
    while at + 4 <= len(data):
        kind, size = struct.unpack_from(">HH", data, at)
        if kind == 0:
            return data[at + 9 : at + 4 + size].decode("latin-1")
        at += 4 + size
    return ""


def _transport(kind: int, data: bytes) -> tuple[str, int | None, int | None, str]:
    if kind not in (6, 17) or len(data) < 8:
        return {1: "ICMP", 58: "ICMPv6"}.get(kind, str(kind)), None, None, ""
    a, b = struct.unpack_from(">HH", data)
    if kind == 17:
        return ("DNS", a, b, _name(data, 20)) if 53 in (a, b) else ("UDP", a, b, "")
    body = data[(data[12] >> 4) * 4 :] if len(data) > 13 else b""
    if name := _server_name(body):
        return "TLS", a, b, name
    if body[:4] in (b"GET ", b"POST", b"HEAD", b"PUT ", b"HTTP"):
        return "HTTP", a, b, body.split(b"\r\n", 1)[0].decode("latin-1")
    return "TCP", a, b, " ".join(f for i, f in enumerate(_TCP_FLAGS) if data[13] >> i & 1)


def packets(content: bytes) -> Iterator[tuple]:
    magic = content[:4]
    order = {b"\xd4\xc3\xb2\xa1": ("<", 1e3), b"\xa1\xb2\xc3\xd4": (">", 1e3), b"\x4d\x3c\xb2\xa1": ("<", 1e6), b"\xa1\xb2\x3c\x4d": (">", 1e6)}.get(magic)
    if order is None:
        return
    end, unit = order
    link, at = struct.unpack_from(end + "I", content, 20)[0], 24
    while at + 16 <= len(content):
        seconds, fraction, kept, length = struct.unpack_from(end + "IIII", content, at)
        data, at = content[at + 16 : at + 16 + kept], at + 16 + kept
        if link == 1:
            kind, data = int.from_bytes(data[12:14], "big"), data[14:]
            while kind == 0x8100:
                kind, data = int.from_bytes(data[2:4], "big"), data[4:]
        else:
            kind = 0x0800 if data[:1] and data[0] >> 4 == 4 else 0x86DD
        time = seconds * 1000 + fraction / unit
        if kind == 0x0800 and len(data) >= 20:
            source, target = (str(ipaddress.IPv4Address(data[i : i + 4])) for i in (12, 16))
            yield (time, source, target, *_transport(data[9], data[(data[0] & 15) * 4 :]), length)
        elif kind == 0x86DD and len(data) >= 40:
            source, target = (str(ipaddress.IPv6Address(data[i : i + 16])) for i in (8, 24))
            yield (time, source, target, *_transport(data[6], data[40:]), length)
        else:
            yield (time, "", "", "ARP" if kind == 0x0806 else f"0x{kind:04x}", None, None, "", length)


def read_packets(files: DataFrame) -> DataFrame:
    """Rows of every capture among ``files`` (path, content); ``time`` in milliseconds, the ``_t`` of a timeline."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = [(path, t, s, sp, d, dp, proto, n, info) for t, s, d, proto, sp, dp, info, n in packets(bytes(content))]
                for i in range(0, len(rows), 50_000):
                    yield pd.DataFrame(rows[i : i + 50_000], columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"source_port": "Int32", "target_port": "Int32"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def talkers(rows: DataFrame) -> DataFrame:
    """``(source, target, packets, bytes, protocols)`` of each pair."""
    return rows.filter("source <> ''").groupBy("source", "target").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.array_sort(F.collect_set("protocol")).alias("protocols"))
