"""PII: format-preserving Feistel pseudonyms for validated numbers, dates, addresses and keys.

A value becomes a number in a mixed-radix domain of its own format (ten for a digit, 26 for a letter, 256 for an octet,
the days of 1900-2099 for a date), which a keyed Feistel network over its two halves permutes; the
result is written back in the format of the original: separators, letter case and check digits stay right. The same
value gives the same pseudonym in every document, whatever its spelling (spaces, case), and different values of one
format never collide, so links between documents survive. Without the key they can't be undone.

Kinds, and what validates them:

* ``email``: one ``@`` between a local part and a host of two labels or more, in letters of any script; the last two
  labels stay;
* ``card``: 13-19 digits, in one run or in groups, the longest such beginning of a longer row of groups whose Luhn digit
  holds (unless ``check`` is off); it holds again in the pseudonym;
* ``iban``: a country of ``IBAN_LENGTHS``, its number of letters and digits, with or without spaces, and a rest of 1
  modulo 97; the country stays and the rest is 1 again;
* ``phone``: ten digits in the usual groups, with or without a country code;
* ``ip``: four octets of 0-255;
* ``ipv6``: an address in any spelling, with a digit and either three groups or a first group of four digits (so that
  ``a::b`` of programs stays); the pseudonym is in the short spelling, and an embedded IPv4 address becomes groups;
* ``date``: a real day of 1900-2099 as year-month-day, or day and month (either order) before the year; ``T`` and a time
  may follow; a day or month without its leading zero is written without one again. Where both orders would do, the day
  comes first; so days up to the 12th of a month are permuted among themselves and later ones, which have one reading,
  among themselves, and a day has one pseudonym in all orders;
* ``ssn``: 3-2-4 digits in the ranges that are given out; the pseudonym is in them too;
* ``secret``: 16 or more letters and digits after ``token``, ``secret``, ``password`` or ``key`` and ``=`` or ``:``;
* ``credential``: keys of cloud, repository, chat, payment and web services that begin with one of ``CREDENTIALS``; that
  beginning stays.

Defined results: null and empty texts stay as they are, and texts without findings byte for byte; longer findings win over
shorter ones that overlap them, then earlier ones. All columns of the input stay, whatever their names, but for one named
``pii_spans`` where spans are asked for: the new column takes its place. Texts must be valid UTF-8.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("email", "card", "iban", "phone", "ip", "ipv6", "date", "ssn", "secret", "credential")
#: Length of an account number by its country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: How credentials begin, and what follows.
CREDENTIALS = {
    "AKIA": "[A-Z0-9]{16}", "ASIA": "[A-Z0-9]{16}", "AGPA": "[A-Z0-9]{16}", "AROA": "[A-Z0-9]{16}", "AIDA": "[A-Z0-9]{16}", "ghp_": "[A-Za-z0-9]{36,}", "gho_": "[A-Za-z0-9]{36,}",
    "ghu_": "[A-Za-z0-9]{36,}", "ghs_": "[A-Za-z0-9]{36,}", "ghr_": "[A-Za-z0-9]{36,}", "github_pat_": "[A-Za-z0-9_]{22,}", "glpat-": "[A-Za-z0-9_-]{20,}", "xoxa-": "[A-Za-z0-9-]{10,}",
    "xoxb-": "[A-Za-z0-9-]{10,}", "xoxp-": "[A-Za-z0-9-]{10,}", "xoxr-": "[A-Za-z0-9-]{10,}", "xoxs-": "[A-Za-z0-9-]{10,}", "sk_live_": "[A-Za-z0-9]{16,}", "rk_live_": "[A-Za-z0-9]{16,}",
    "AIza": "[A-Za-z0-9_-]{35}",
}
ROUNDS = 10
SLICE_ROWS = 256
PIECE = 4096
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST_DAY + 1
_SPOT = re.compile(r"[+(0-9]")
_RUN = re.compile(r"[+(]*[0-9]*")
_GIVEN = re.compile(r"[=:]")
_LOCAL = re.compile(r"[^\W_](?:[\w.%+-]*[^\W_])?$")
_HOST = re.compile(r"(?:[^\W_](?:[^\W_]|-(?=[\w-]{0,62}[^\W_]\.)){0,62}\.)+[^\W\d_]{2,24}(?![^\W_])")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}")
_PAIR = re.compile(r":[0-9A-Fa-f]{0,4}:")
_LEFT, _RIGHT = re.compile(r"[0-9A-Fa-f:]*$"), re.compile(r"[0-9A-Fa-f:.]*")
_CREDENTIAL = re.compile("|".join(f"{begin}{rest}" for begin, rest in CREDENTIALS.items()))
_IP = re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])")
_DATE = re.compile(r"(?:([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})|([0-9]{1,2})([-/.])([0-9]{1,2})\6([0-9]{4}))(?![0-9])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_PHONE = re.compile(r"(?:\+[0-9]{1,3}[ .-]?|1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){12,18}")
_TIME = re.compile(r"T[0-9]{2}(?![0-9])|T[0-9]{4}(?![0-9])|T[0-9]{6}(?![0-9])")
_KEYWORD = re.compile(r"(?:token|secret|password|passwd|key)[\"']?\s{0,3}$", re.IGNORECASE)
_SECRET = re.compile(r"\s{0,3}[\"']?([A-Za-z0-9+/_-]{16,})")


def luhn_digit(digits: list[int]) -> int:
    """The check digit for ``digits``."""
    return -sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(reversed(digits))) % 10


def permute(values: list[int], radices: list[int], key: bytes, kind: str) -> list[int]:
    """A keyed permutation of the mixed-radix number ``values``: additive Feistel rounds between its two halves."""
    middle = len(radices) // 2
    if len(radices) == 1:  # one digit has no halves: split the radix in quotient and rest, and walk out of the surplus
        n = radices[0]
        low = max(2, int(n**0.5))
        high = -(-n // low)
        value = values[0]
        while True:
            a, b = permute(list(divmod(value, low)), [high, low], key, kind)
            value = a * low + b
            if value < n:
                return [value]
    sides = [radices[:middle], radices[middle:]]
    sizes = [prod(s) for s in sides]
    halves = []
    for part, side in zip((values[:middle], values[middle:]), sides):
        number = 0
        for v, r in zip(part, side):
            number = number * r + v
        halves.append(number)
    width = max(s.bit_length() for s in sizes) // 8 + 9
    for turn in range(ROUNDS):
        to, by = turn % 2, 1 - turn % 2
        text = "|".join([kind, str(turn), *map(_spelled, (sizes[0], sizes[1], halves[by]))]).encode()
        halves[to] = (halves[to] + int.from_bytes(_stretch(key, text, width), "big")) % sizes[to]
    out: list[int] = []
    for number, side in zip(halves, sides):
        part = []
        for r in reversed(side):
            number, v = divmod(number, r)
            part.append(v)
        out += reversed(part)
    return out


def _spelled(n: int) -> str:
    """Decimal digits; hexadecimal ones where Python refuses or is slow to write decimals."""
    return str(n) if n.bit_length() < 14_000 else hex(n)


def _stretch(key: bytes, text: bytes, width: int) -> bytes:
    if width <= 64:
        return hashlib.blake2b(text, key=key, digest_size=width).digest()
    return b"".join(hashlib.blake2b(text + b"|%d" % i, key=key).digest() for i in range(-(-width // 64)))


def _digits(text: str, key: bytes, kind: str, skip: int = 0, luhn: bool = False) -> str:
    """The digits of ``text`` after the first ``skip``, permuted in place."""
    at = [i for i, c in enumerate(text) if c.isdigit()][skip:]
    old = [int(text[i]) for i in at]
    if luhn:
        new = permute(old[:-1], [10] * (len(old) - 1), key, kind)
        new.append(luhn_digit(new))
    else:
        new = permute(old, [10] * len(old), key, kind)
    out = list(text)
    for i, v in zip(at, new):
        out[i] = str(v)
    return "".join(out)


@cache
def _alphabet(char: str) -> str:
    """The letters that may take the place of ``char``: 26, or those of its block of 64 code points and its case."""
    if char.isascii():
        return "abcdefghijklmnopqrstuvwxyz"
    first = ord(char) & ~63
    return "".join(c for c in map(chr, range(first, first + 64)) if c.isalpha() and not c.isascii() and c.isupper() == char.isupper())


def _letters(text: str, key: bytes, kind: str) -> str:
    """Letters and digits of ``text`` permuted within their classes; the case of ASCII letters stays where it was."""
    at = [i for i, c in enumerate(text) if c.isalpha() or "0" <= c <= "9"]
    classes = ["0123456789" if text[i].isdigit() else _alphabet(text[i]) for i in at]
    old = [a.index(text[i].lower() if text[i].isascii() else text[i]) for i, a in zip(at, classes)]
    out = list(text)
    for i, v, a in zip(at, permute(old, [len(a) for a in classes], key, kind), classes):
        out[i] = a[v].upper() if text[i].isascii() and text[i].isupper() else a[v]
    return "".join(out)


def _hex(text: str, key: bytes) -> str:
    new = permute([int(c, 16) for c in text], [16] * len(text), key, "hex")
    upper = any(c.isupper() for c in text)
    return "".join("0123456789ABCDEF"[v] if upper else "0123456789abcdef"[v] for v in new)


def _email(text: str, key: bytes) -> str:
    local, _, host = text.partition("@")
    labels = host.split(".")
    changed = _letters("@".join([local, ".".join(labels[:-2])]), key, "email")
    local, _, sub = changed.partition("@")
    return f"{local}@{'.'.join([sub] * bool(sub) + labels[-2:])}"


def _ip(text: str, key: bytes) -> str:
    return ".".join(map(str, permute([int(x) for x in text.split(".")], [256] * 4, key, "ip")))


def _ipv6(text: str, key: bytes) -> str:
    groups = ipaddress.IPv6Address(text).packed
    new = permute([groups[i] << 8 | groups[i + 1] for i in range(0, 16, 2)], [65536] * 8, key, "ipv6")
    out = str(ipaddress.IPv6Address(b"".join(v.to_bytes(2, "big") for v in new)))
    return out.upper() if any(c.isupper() for c in text) else out


def _rest_97(country: str, body: str) -> int:
    """An account number as a number (letters are 10-35), its beginning moved behind its rest, modulo 97."""
    return int("".join(str(int(c, 36)) for c in body + country)) % 97


def _iban(text: str, key: bytes) -> str:
    """The part behind the check digits is permuted; then these are set again."""
    plain = text.replace(" ", "")
    body = _letters(plain[4:], key, "iban" + plain[:2])
    new = iter(f"{plain[:2]}{98 - _rest_97(plain[:2] + '00', body):02}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _credential(text: str, key: bytes) -> str:
    begin = next(b for b in CREDENTIALS if text.startswith(b))
    return begin + _secret(text[len(begin) :], key)


def _ssn(text: str, key: bytes) -> str:
    """Walks on through the permutation of all nine digits until the groups are in their ranges: a permutation of these."""
    while True:
        text = _digits(text, key, "ssn")
        if _SSN.fullmatch(text):
            return text


def _as_date(m: re.Match) -> tuple[datetime.date, str] | None:
    """(day, order of its parts) of a match, if it is a real day in range; day before month where both would do."""
    a, b, c = (m[1], m[3], m[4]) if m[1] else (m[5], m[7], m[8])
    for order in ("ymd",) if m[1] else ("dmy", "mdy"):
        part = dict(zip(order, map(int, (a, b, c))))
        try:
            day = datetime.date(part["y"], part["m"], part["d"])
        except ValueError:
            continue
        if 0 <= day.toordinal() - _FIRST_DAY < _DAYS:
            return day, order
    return None


def _date(text: str, key: bytes) -> str:
    """Walks on through the permutation of all days until the order of the parts can be read back as it is here."""
    m = _DATE.fullmatch(text)
    day, order = _as_date(m)
    new, late = day, day.day > 12
    while True:
        new = datetime.date.fromordinal(_FIRST_DAY + permute([new.toordinal() - _FIRST_DAY], [_DAYS], key, "date")[0])
        if (new.day > 12) == late:
            break
    sep = m[2] or m[6]
    short = any(len(p) == 1 for p in text.split(sep))
    wide = {"y": 4, "m": 1 if short else 2, "d": 1 if short else 2}
    return sep.join(str({"y": new.year, "m": new.month, "d": new.day}[p]).zfill(wide[p]) for p in order)


def _secret(text: str, key: bytes) -> str:
    """Pieces of a very long secret are permuted one by one: the arithmetic of one number grows with its square."""
    one = _hex if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) else lambda t, k: _letters(t, k, "secret")
    return "".join(one(text[i : i + PIECE], key) if any(c.isalnum() for c in text[i : i + PIECE]) else text[i : i + PIECE] for i in range(0, len(text), PIECE))


def _phone_skip(text: str) -> int:
    return sum(c.isdigit() for c in text) - 10


_MAKE: dict[str, Callable[[str, bytes], str]] = {
    "email": _email,
    "iban": _iban,
    "ip": _ip,
    "ipv6": _ipv6,
    "date": _date,
    "ssn": _ssn,
    "credential": _credential,
    "phone": lambda t, k: _digits(t, k, "phone", _phone_skip(t)),
    "card": lambda t, k: _digits(t, k, "card", luhn=_luhn_holds(t)),
    "secret": _secret,
}


def _luhn_holds(text: str) -> bool:
    digits = [int(c) for c in text if c.isdigit()]
    return luhn_digit(digits[:-1]) == digits[-1]


@lru_cache(maxsize=50_000)
def pseudonym(kind: str, text: str, key: bytes) -> str:
    return _MAKE[kind](text, key)


def _card_end(text: str, hit: re.Match, check: bool) -> int:
    """Where the longest card in a match ends that no digit or letter follows and whose Luhn digit holds; -1 if none."""
    digits = [i for i in range(hit.start(), hit.end()) if text[i] not in " -"]
    for last in reversed(digits[12:]):
        if not text[last + 1 : last + 2].isalnum() and (not check or _luhn_holds(text[hit.start() : last + 1])):
            return last + 1
    return -1


def _ibans(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _ACCOUNT.finditer(text):
        begin, length = m.start(), IBAN_LENGTHS.get(text[m.start() : m.start() + 2])
        if not length or text[begin - 1 : begin].isalnum():
            continue
        end, plain = begin, ""
        while len(plain) < length and end < len(text):
            c = text[end]
            if c != " ":
                if not (c.isascii() and (c.isdigit() or c.isupper())):
                    break
                plain += c
            elif text[end - 1] == " ":
                break
            end += 1
        if len(plain) == length and not text[end : end + 1].isalnum() and _rest_97(plain[:4], plain[4:]) == 1:
            yield begin, end, "iban"


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """IPv6 addresses around a colon that a second one follows after four digits at most."""
    at = text.find(":")
    while at >= 0:
        end = at + 1
        if _PAIR.match(text, at):
            left = _LEFT.search(text[max(0, at - 46) : at])[0]
            begin, end = at - len(left), _RIGHT.match(text, at, at + 46).end()
            value = text[begin:end].rstrip(".")
            value = value[:-1] if value.endswith(":") and not value.endswith("::") else value
            before, after = text[begin - 1 : begin] if begin else "", text[begin + len(value) : begin + len(value) + 1]
            groups = [g for g in value.split(":") if g]
            wide = len(groups) >= 3 or groups and value.startswith(groups[0]) and len(groups[0]) == 4
            if wide and not (before.isalnum() or before == "_" or after.isalnum() or after == "_") and any(map(str.isdigit, value)):
                try:
                    ipaddress.IPv6Address(value)
                    yield begin, begin + len(value), "ipv6"
                except ValueError:
                    pass
        at = text.find(":", max(at + 1, end))


def find(text: str, check: bool = True) -> list[tuple[int, int, str]]:
    """(begin, end, kind) of all findings, in order and without overlaps."""
    found: list[tuple[int, int, str]] = []
    at = text.find("@")
    while at >= 0:
        local, host = _LOCAL.search(text[max(0, at - 65) : at]), _HOST.match(text, at + 1)
        if local and host:
            found.append((at - len(local[0]), host.end(), "email"))
        at = text.find("@", at + 1)
    at, m = 0, _SPOT.search(text)
    while m:
        i = m.start()
        at = max(_RUN.match(text, i).end(), i + 1)
        if i == 0 or not (text[i - 1].isalnum() or text[i - 1] == "_" or text[i - 1] in ".-" and i > 1 and text[i - 2].isdigit()):
            for kind, pattern in (("ip", _IP), ("date", _DATE), ("ssn", _SSN), ("phone", _PHONE), ("card", _CARD)):
                hit = pattern.match(text, i)
                if not hit:
                    continue
                end = _card_end(text, hit, check) if kind == "card" else hit.end()
                ends = not text[end : end + 1].isalnum() or kind == "date" and _TIME.match(text, end)
                if end >= 0 and ends and (kind != "date" or _as_date(hit)):
                    found.append((i, end, kind))
                    at = end
                    break
        m = _SPOT.search(text, at)
    for m in _GIVEN.finditer(text):
        if _KEYWORD.search(text[max(0, m.start() - 14) : m.start()]) and (hit := _SECRET.match(text, m.end())):
            found.append((hit.start(1), hit.end(1), "secret"))
    found += _ibans(text)
    found += _addresses(text)
    if any(begin in text for begin in CREDENTIALS):
        found += [(m.start(), m.end(), "credential") for m in _CREDENTIAL.finditer(text) if not (text[m.start() - 1 : m.start()].isalnum() or text[m.end() : m.end() + 1].isalnum())]
    return _apart(found)


def _apart(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The longest, then earliest, of findings that overlap."""
    if len(found) < 2:
        return found
    kept: list[tuple[int, int, str]] = []
    for span in sorted(found, key=lambda s: (s[0] - s[1], s[0])):
        i = bisect(kept, span)  # those kept are apart: only its neighbours can overlap it
        if (i == 0 or kept[i - 1][1] <= span[0]) and (i == len(kept) or kept[i][0] >= span[1]):
            kept.insert(i, span)
    return kept


def replace(text: str, key: bytes, check: bool = True) -> tuple[str, list[tuple[int, int, str]]]:
    spans = find(text, check)
    if not spans:
        return text, spans
    out, at = [], 0
    for begin, end, kind in spans:
        out += [text[at:begin], pseudonym(kind, text[begin:end], key)]
        at = end
    return "".join([*out, text[at:]]), spans


_SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def _run(position: int, key: bytes, check: bool, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                rows = batch.slice(at, SLICE_ROWS)
                texts, spans = [], []
                for text in rows.column(position).to_pylist():
                    new, found = (None, []) if text is None else replace(text, key, check)
                    texts.append(new)
                    if with_spans:
                        spans.append([dict(zip(("begin", "end", "kind"), s)) for s in found])
                columns = list(rows.columns)
                columns[position] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns + [pa.array(spans, _SPANS)] * with_spans, names=[*batch.schema.names] + ["pii_spans"] * with_spans)

    return run


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", check: bool = True, with_spans: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; with ``pii_spans`` (begin, end, kind in the old text) if asked for."""
    rows = docs.drop("pii_spans") if with_spans else docs
    spans = [T.StructField("pii_spans", T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())])))]
    return rows.mapInArrow(_run(rows.columns.index(text_col), key, check, with_spans), T.StructType(rows.schema.fields + spans * with_spans))
