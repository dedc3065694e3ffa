import random
import re

import pytest
from pyspark.sql import functions as F

from strandline.functions import text

CASES = [
    (r"a\u4f60\u597d", "a你好"), (r"\x68\x74tp", "http"), (r"\u{1F600}!", "😀!"), (r"\ud83d\ude00", "😀"), (r"x\ud83dx", r"x\ud83dx"), (r"\ude00\u0041", r"\ude00A"), (r"\ud83d\u0041", r"\ud83dA"),
    (r"\u{41}\u{0000e9}", "Aé"), (r"\u{110000}\u{d800}\u{}", r"\u{110000}\u{d800}\u{}"), (r"\xe9", "é"), (r"\x5cu0041", "A"), (r"\x5cx5cx41", "A"), (r"\x5cx5cx5cx41", r"\x41"), ("%E4%BD%A0", "你"), (r"\x2541", "A"),
    ("100%", "100%"), ("a+b%20c", "a+b c"), (r"C:\users\x", r"C:\users\x"), ("", ""), (None, None), (r"\u{10ffff}", "\U0010ffff"), (r"\u{fffff}", "\U000fffff"), (r"\u{00d7ff}", "\ud7ff"),
]


def test_escapes(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(CASES)], "i int, c string")
    got = {r["i"]: r["d"] for r in df.select("i", text.decoded_escapes(F.col("c")).alias("d")).collect()}
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


def one_pass(s):
    """Character by character."""
    out, i = "", 0
    while i < len(s):
        unit = lambda j: int(s[j + 2 : j + 6], 16) if re.fullmatch(r"\\u[0-9a-fA-F]{4}", s[j : j + 6]) else -1  # noqa: B023, E731
        a, b = unit(i), unit(i + 6)
        brace = re.match(r"\\u\{([0-9a-fA-F]{1,6})\}", s[i:])
        if 0xD800 <= a < 0xDC00 <= b < 0xE000:
            out, i = out + chr(0x10000 + (a - 0xD800 << 10) + b - 0xDC00), i + 12
        elif a >= 0 and not 0xD800 <= a < 0xE000:
            out, i = out + chr(a), i + 6
        elif brace and int(brace[1], 16) < 0x110000 and not 0xD800 <= int(brace[1], 16) < 0xE000:
            out, i = out + chr(int(brace[1], 16)), i + brace.end()
        elif re.fullmatch(r"\\x[0-9a-fA-F]{2}", s[i : i + 4]):
            out, i = out + chr(int(s[i + 2 : i + 4], 16)), i + 4
        else:
            out, i = out + s[i], i + 1
    return out


def test_escapes_against_a_reader_of_characters(spark):
    rng = random.Random(3)
    parts = ["\\", "u", "x", "{", "}", "d8", "3d", "de", "00", "41", "5c", "\\u", "\\x", "\\u{", "e9", "é", "10", "f", "0"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    got = {r["i"]: r["d"] for r in df.select("i", text.decoded_escapes(F.col("c")).alias("d")).collect()}
    for i, s in enumerate(texts):
        assert got[i] == one_pass(one_pass(one_pass(s))), s
