"""What a filter of the timeline language says about raw columns, in a form that a scan can use.

The language compares text forms (``coalesce(c, '') = 'x'``), which no reader of files understands. ``implied`` gives a
typed condition on the raw column that holds wherever the filter does: ``c = 'x'``, ``c IN (...)``, bounds on numbers,
dates and times, null tests for the empty text; under NOT the opposite one. ANDed to the filter it changes no row, and
Spark hands it to the scan, where Parquet skips row groups by it. Parts that say nothing raw (substrings, patterns) are
left out of an AND, and make an OR say nothing.
"""

from __future__ import annotations

import datetime
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.plans import query as q

_INTEGERS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_WHOLE = re.compile(r"0|-?[1-9]\d*")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
#: Doubles below this count every integer, so bounds are exact.
_EXACT = 2**53
_EPOCH = datetime.date(1970, 1, 1).toordinal()
_UTC = ("UTC", "Etc/UTC", "GMT", "Z", "+00:00")


def _all(parts: list[Column | None]) -> Column | None:
    some = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, some) if some else None


def _any(parts: list[Column | None]) -> Column | None:
    return None if any(p is None for p in parts) else reduce(lambda a, b: a | b, parts)


class _Raw:
    """One column and its type."""

    def __init__(self, df: DataFrame, name: str):
        self.kind, self.c = df.schema[name].dataType, F.col(f"`{name}`")
        self.utc = df.sparkSession.conf.get("spark.sql.session.timeZone") in _UTC

    def _time(self, micros: int) -> Column:
        out = F.timestamp_micros(F.lit(micros))
        return out.cast("timestamp_ntz") if isinstance(self.kind, T.TimestampNTZType) else out

    def equal(self, value: str) -> Column | None:
        """Implied by: the text form is ``value`` (not empty)."""
        if isinstance(self.kind, T.StringType):
            return self.c == F.lit(value)
        if type(self.kind) in _INTEGERS:
            fits = _WHOLE.fullmatch(value) and -(2 ** (_INTEGERS[type(self.kind)] - 1)) <= int(value) < 2 ** (_INTEGERS[type(self.kind)] - 1)
            return self.c == F.lit(int(value)).cast(self.kind) if fits else F.lit(False)
        if isinstance(self.kind, T.DoubleType):
            return self.c == F.lit(float(value)) if _NUMBER.fullmatch(value) and math.isfinite(float(value)) else None
        if isinstance(self.kind, T.BooleanType):
            return self.c == F.lit(value == "true") if value in ("true", "false") else F.lit(False)
        if isinstance(self.kind, T.DateType) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            try:
                return self.c == F.lit(datetime.date.fromisoformat(value))
            except ValueError:
                return F.lit(False)
        if isinstance(self.kind, (T.TimestampType, T.TimestampNTZType)) and self.utc:
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}", value):
                return None
            try:
                t = datetime.datetime.fromisoformat(value + "+00:00") - datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)
            except ValueError:
                return F.lit(False)
            return self.millis_between(t // datetime.timedelta(milliseconds=1), t // datetime.timedelta(milliseconds=1))
        return None

    def unequal(self, value: str) -> Column | None:
        """Implied by: the text form is not ``value`` (not empty). Only where one raw value alone has that text form."""
        one = isinstance(self.kind, (T.StringType, T.BooleanType, T.DateType)) or type(self.kind) in _INTEGERS
        if one or isinstance(self.kind, T.DoubleType) and re.fullmatch(r"-?[1-9]\d{0,14}", value):
            other = self.equal(value)
            return None if other is None or "false" == str(other._jc.toString()) else self.c.isNull() | ~other
        return None

    def empty(self, want: bool) -> Column:
        """Implied by: the text form is empty, or (``want`` false) is not."""
        if isinstance(self.kind, T.StringType):
            return self.c.isNull() | (self.c == F.lit("")) if want else self.c.isNotNull() & (self.c != F.lit(""))
        return self.c.isNull() if want else self.c.isNotNull()

    def among(self, values: tuple[str, ...]) -> Column | None:
        filled = [v for v in values if v]
        if isinstance(self.kind, T.StringType) and filled:
            parts = [self.c.isin(filled)]
        else:
            parts = [self.equal(v) for v in filled]
        return _any([*parts, *([self.empty(True)] if "" in values else [])])

    def millis_between(self, lo: float | None, hi: float | None) -> Column | None:
        """Implied by: the column's milliseconds lie in the inclusive window."""
        parts: list[Column | None] = []
        finite = lambda x: x is not None and math.isfinite(x) and abs(x) < 200_000_000_000_000
        if isinstance(self.kind, (T.TimestampType, T.TimestampNTZType)) and (self.utc or isinstance(self.kind, T.TimestampType)):
            parts = [self.c >= self._time(math.ceil(lo) * 1000) if finite(lo) else None, self.c < self._time((math.floor(hi) + 1) * 1000) if finite(hi) else None]
        elif isinstance(self.kind, T.DateType):
            day = lambda n: F.lit(datetime.date.fromordinal(n + _EPOCH)) if 0 < n + _EPOCH < 3_652_000 else None
            first, last = day(math.ceil(lo / 86_400_000)) if finite(lo) else None, day(math.floor(hi / 86_400_000)) if finite(hi) else None
            parts = [self.c >= first if first is not None else None, self.c <= last if last is not None else None]
        elif type(self.kind) in _INTEGERS or isinstance(self.kind, T.DoubleType):
            parts = [self.bound(">=", lo) if finite(lo) else None, self.bound("<=", hi) if finite(hi) else None]
        return _all([*parts, self.c.isNotNull()])

    def bound(self, op: str, x: float) -> Column | None:
        """Implied by: the number, or the time in milliseconds, compares so with ``x``."""
        if isinstance(self.kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            step = {"<": (None, math.ceil(x) - 1), "<=": (None, x), ">": (math.floor(x) + 1, None), ">=": (x, None)}[op]
            if isinstance(self.kind, T.DateType):
                return self.millis_between(*(x if s is not None else None for s in step))
            return self.millis_between(*step)
        if isinstance(self.kind, T.DoubleType):
            value = F.lit(float(x))
        elif type(self.kind) in _INTEGERS:
            half = 2 ** (_INTEGERS[type(self.kind)] - 1)
            whole = {"<": math.ceil(x), ">=": math.ceil(x), "<=": math.floor(x), ">": math.floor(x)}[op]
            if abs(x) >= _EXACT or not -half <= whole < half:
                return self.c.isNotNull()
            value = F.lit(whole).cast(self.kind)
        else:
            return self.c.isNotNull()
        return {"<": self.c < value, "<=": self.c <= value, ">": self.c > value, ">=": self.c >= value}[op]


def _leaf(binder: q.Binder, node: q.Test, want: bool) -> Column | None:
    raw = _Raw(binder.df, binder.name(node.field, node.at))
    if node.op in ("=", "!="):
        same = (node.op == "=") == want
        if not node.value:
            return raw.empty(same)
        return raw.equal(node.value) if same else raw.unequal(node.value)
    if node.op in (":", "~"):
        return raw.empty(False) if node.op == ":" and want and node.value else None
    if not _NUMBER.fullmatch(node.value.strip()):
        return F.lit(False) if want else None
    if want:
        return raw.bound(node.op, float(node.value))
    # a comparison fails for null, and for texts that are no numbers
    if isinstance(raw.kind, T.StringType) or not (type(raw.kind) in _INTEGERS or isinstance(raw.kind, (T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType))):
        return None
    return raw.c.isNull() | raw.bound({"<": ">=", "<=": ">", ">": "<=", ">=": "<"}[node.op], float(node.value))


def implied(binder: q.Binder, node: q.Node, want: bool = True) -> Column | None:
    """A condition on raw columns that holds wherever ``node`` is ``want``; None if there is none to say."""
    match node:
        case q.Not(item):
            return implied(binder, item, not want)
        case q.And(items) | q.Or(items):
            return (_all if isinstance(node, q.And) == want else _any)([implied(binder, i, want) for i in items])
        case q.Member(name, values, negated, at):
            raw = _Raw(binder.df, binder.name(name, at))
            if want != negated:
                return raw.among(values)
            parts = [raw.unequal(v) for v in values if v] if not isinstance(raw.kind, T.StringType) else [raw.c.isNull() | ~raw.c.isin([v for v in values if v])] if any(values) else []
            return _all([*parts, *([raw.empty(False)] if "" in values else [])])
        case q.Test(name):
            return _leaf(binder, node, want) if name != q.ANY else None
    return None


def window(df: DataFrame, name: str, lo: float | None, hi: float | None) -> Column | None:
    """Implied by: the milliseconds of column ``name`` lie in the inclusive window."""
    return _Raw(df, name).millis_between(lo, hi)
