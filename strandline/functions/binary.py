"""Expressions over bytes: text in them, printable runs, token hashes, addresses of version 6."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sniffed_text(b: Column) -> Column:
    """UTF-8 if valid, UTF-16LE if every other byte of the head is zero, else one character a byte."""
    head = F.hex(F.substring(b, 1, 64))
    wide = head.rlike(r"^(?:FFFE)?(?:[0-9A-F]{2}00){4,}")
    return F.when(wide, F.decode(b, "UTF-16LE")).when(F.is_valid_utf8(b.cast("string")), b.cast("string")).otherwise(F.decode(b, "ISO-8859-1"))


def printable_runs(b: Column, least: int = 6) -> Column:
    """Distinct runs of printable characters, of one byte each or of two with a zero byte."""
    text = F.decode(b, "ISO-8859-1")
    narrow = F.regexp_extract_all(text, F.lit(rf"[\x20-\x7e]{{{least},}}"), F.lit(0))
    wide = F.transform(F.regexp_extract_all(text, F.lit(rf"(?:[\x20-\x7e]\x00){{{least},}}"), F.lit(0)), lambda v: F.replace(v, F.lit("\0"), F.lit("")))
    return F.array_distinct(F.concat(narrow, wide))


def token_hash(tokens: Column, sort: bool = False) -> Column:
    """MD5 of lower-cased tokens joined by commas, in their order or sorted (import and symbol hashes)."""
    low = F.transform(tokens, lambda t: F.lower(t))
    return F.md5(F.array_join(F.array_sort(low) if sort else low, ","))


@F.pandas_udf(T.StringType())
def ipv6_full(address: pd.Series) -> pd.Series:
    """All eight groups of a version 6 address; null for anything else and for reserved addresses."""

    def one(a):
        try:
            v = ipaddress.IPv6Address(a)
        except (ValueError, TypeError):
            return None
        return None if v.is_private or v.is_multicast or v.is_loopback or v.is_unspecified else v.exploded

    return address.map(one)
