"""Times of many spellings as UTC milliseconds; null where nothing fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ISO = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"
#: Free-form layouts that are tried last.
FALLBACK_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "MMM d, yyyy HH:mm:ss", "MMM d, yyyy", "M/d/yyyy HH:mm:ss", "M/d/yyyy", "MMM d HH:mm:ss yyyy", "d MMM yyyy HH:mm:ss", "d MMM yyyy")


def _millis(ts: Column) -> Column:
    return F.unix_millis(ts).cast("double")


def _day(y: Column, m: Column, d: Column) -> Column:
    """Milliseconds of a day; days past the month's end roll over, as day counts do."""
    first = F.make_date(y, m, F.lit(1))
    return F.when(y.isNotNull() & m.between(1, 12) & d.between(1, 31), (F.unix_date(first) + d - 1).cast("double") * 86_400_000)


def normalise_zone(s: Column) -> Column:
    """``UTC``/``GMT`` suffixes in any dress become ``Z``; a space before an offset goes; an offset gets its colon."""
    s = F.regexp_replace(s, r"(?i)[\s_-]*[\[(]?\s*(?:UTC|GMT)\s*[\])]?$", "Z")
    s = F.regexp_replace(s, r"(\d)\s+(Z|[+-]\d{2}:?\d{2})$", "$1$2")
    return F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2")


def time_millis(text: Column) -> Column:
    """The branches are tried in this order; an ISO-shaped text that fails stays null.

    The shape of a text (its length, and where its digits stop) chooses the few branches that can fit it, so that each
    text meets two or three patterns and the free-form layouts only where it has letters.
    """
    s = F.trim(text)
    number = lambda begin, n: F.substring(s, begin, n).try_cast("int")
    clock = [number(13, 2), number(16, 2), number(19, 2)]
    dashed = F.when(
        s.rlike(r"^\d{4}-\d{2}-\d{2}--\d{2}-\d{2}-\d{2}$") & (clock[0] < 24) & (clock[1] < 60) & (clock[2] < 60),
        _day(number(1, 4), number(6, 2), number(9, 2)) + clock[0] * 3_600_000 + clock[1] * 60_000 + clock[2] * 1000,
    )
    parts = F.split(s, "[-./]")
    part = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    begin = _day(part(0), F.lit(1), F.lit(1))
    fraction = F.get(parts, F.lit(1))
    decimal = F.coalesce(
        F.when(F.length(fraction) <= 2, _day(part(0), part(1), F.lit(1))),
        begin + F.concat(F.lit("0."), fraction).try_cast("double") * (_day(part(0) + 1, F.lit(1), F.lit(1)) - begin),
    )
    clf = r"(?i)^\[?(\d{1,2}/(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)/\d{4}:\d{2}:\d{2}:\d{2})(?:\s+([+-]\d{4}))?\]?$"
    access = F.when(s.rlike(clf), _millis(F.try_to_timestamp(F.concat(F.initcap(F.regexp_extract(s, clf, 1)), F.lit(" "), F.coalesce(F.nullif(F.regexp_extract(s, clf, 2), F.lit("")), F.lit("+0000"))), F.lit("d/MMM/yyyy:HH:mm:ss Z"))))
    no_weekday = F.regexp_replace(s, r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,?\s+", "")
    other = F.coalesce(*[_millis(F.try_to_timestamp(no_weekday, F.lit(f))) for f in FALLBACK_FORMATS])
    digits = F.length(F.ltrim(s, F.lit("-0123456789"))) == 0  # nothing but digits and dashes
    free = F.when(F.contains(s, F.lit("/Date(")), F.regexp_extract(s, r"^/Date\((-?\d+)\)/$", 1).try_cast("double")).when(F.contains(s, F.lit(":")) & s.rlike(r"^\[?\d{1,2}/"), F.coalesce(access, other)).when(F.length(s) >= 8, other)
    return (
        F.when(digits & s.rlike(r"^-?\d{10}$"), s.try_cast("double") * 1000)
        .when(digits & s.rlike(r"^-?\d{13}$"), s.try_cast("double"))
        .when(digits & (F.length(s) == 8) & s.rlike(r"^[1-9]\d{7}$"), _day(number(1, 4), number(5, 2), number(7, 2)))
        .when(digits & (F.length(s) == 4), F.when(s.rlike(r"^[1-9]\d{3}$"), _day(s.try_cast("int"), F.lit(1), F.lit(1))))
        .when((F.length(s) >= 19) & s.rlike(_ISO), _millis(normalise_zone(s).try_cast("timestamp")))
        .when((F.length(s) <= 10) & s.rlike(r"^\d{4}[-./]\d{1,2}[-./]\d{1,2}$"), _day(part(0), part(1), part(2)))
        .when((F.length(s) == 7) & s.rlike(r"^\d{4}[-./]\d{2}$"), F.coalesce(_day(part(0), part(1), F.lit(1)), F.when(F.substring(s, 5, 1) == ".", decimal)))
        .when(F.substring(s, 5, 1) == ".", F.when(s.rlike(r"^\d{4}\.\d+$"), decimal))
        .when(F.length(s) == 20, F.coalesce(dashed, free))
        .otherwise(free)
    )


def column_millis(df: DataFrame, name: str) -> Column:
    """Milliseconds of a column: natively for times and dates, parsed for texts, as they are for numbers."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # microseconds count in whole milliseconds, as in the sources
        return F.floor(F.unix_micros(c.cast("timestamp")) / 1000).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double") * 86_400_000
    if isinstance(kind, T.StringType):
        return time_millis(c)
    return c.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")


def chrome_time(micros: Column) -> Column:
    """Microseconds since 1601 as a timestamp; null for zero and below."""
    return F.when(micros > 0, F.timestamp_micros(micros.cast("long") - F.lit(11_644_473_600_000_000)))


def firefox_time(micros: Column) -> Column:
    return F.when(micros > 0, F.timestamp_micros(micros.cast("long")))


def syslog_year(month: Column, day: Column, file_time: Column) -> Column:
    """Year of a date without one: the file's, or the year before if that lies over 30 days ahead of the file."""
    this = F.make_date(F.year(file_time), month, day)
    return F.when(F.datediff(this, file_time) > 30, F.year(file_time) - 1).otherwise(F.year(file_time))


def relative_millis(text: str) -> int | None:
    """``15m``, ``24 h``, ``7d`` as milliseconds."""
    import re

    m = re.fullmatch(r"\s*(\d+)\s*([smhdw])\s*", text)
    unit = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
    return int(m[1]) * unit[m[2]] if m and int(m[1]) > 0 else None


def duration_text(millis: float) -> str:
    """``3d 4h``, ``2h 5m``, ``1m 7s``, ``250ms``: the two largest units."""
    left, parts = int(abs(millis)), []
    for unit, size in (("w", 604_800_000), ("d", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1000), ("ms", 1)):
        n, left = divmod(left, size)
        if n:
            parts.append(f"{n}{unit}")
    return ("-" if millis < 0 else "") + (" ".join(parts[:2]) or "0ms")


def tick_pattern(span: float) -> str:
    """The date pattern that tells the ticks of an axis of this length apart."""
    return "HH:mm:ss.SSS" if span < 10_000 else "HH:mm:ss" if span < 3_600_000 else "HH:mm" if span < 86_400_000 else "MM-dd HH:mm" if span < 14 * 86_400_000 else "yyyy-MM-dd"
