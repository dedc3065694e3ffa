"""Merging sources onto a canonical schema: canonical columns first, native columns fused or namespaced."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.coerce import text_of
from strandline.functions.text import IPV4

#: Canonical columns and, for each, names under which sources know it, best first.
CANONICAL = ("__source", "Timestamp", "Host", "User", "EventID", "Severity", "Category", "SourceIP", "DestIP")
ALIASES = {
    "Timestamp": ("timestamp", "@timestamp", "time", "ts", "datetime", "date", "eventtime", "event_time", "start", "rt"),
    "Host": ("host", "hostname", "computer", "device", "dvchost", "dhost", "src_host", "identhostname"),
    "User": ("user", "username", "user_id", "userid", "account", "suser", "usrname", "useridentity.username", "targetusername"),
    "EventID": ("eventid", "event id", "event_id", "signature", "event_code", "eventname", "message_id"),
    "Severity": ("severity", "level", "sev", "priority", "loglevel"),
    "Category": ("category", "event_type", "type", "facility", "channel", "product", "eventsource", "module"),
    "SourceIP": ("sourceip", "src", "src_ip", "ip", "client_ip", "c-ip", "sourceipaddress", "id.orig_h", "client"),
    "DestIP": ("destip", "dst", "dst_ip", "dest_ip", "s-ip", "id.resp_h"),
}


@dataclass(frozen=True)
class Source:
    label: str
    df: DataFrame
    kind: str = "csv"
    time_is_number: bool = False


def unique_labels(labels: list[str]) -> list[str]:
    out: list[str] = []
    for label in labels:
        out.append(next(n for n in (label, *(f"{label} ({i})" for i in range(2, len(labels) + 2))) if n not in out))
    return out


def canonical(df: DataFrame, name: str) -> Column:
    """The first alias that is there and not empty."""
    names = {c.lower(): c for c in df.columns}
    found = [F.nullif(text_of(df, names[a]), F.lit("")) for a in ALIASES[name] if a in names]
    return F.coalesce(*found, F.lit("")) if found else F.lit("")


def content_class(df: DataFrame, names: list[str], sample: int = 200) -> dict[str, str]:
    """empty, ipv4, numeric or text of each column, by an 80 % vote over a sample; one small aggregate."""
    if not names:
        return {}
    head = df.limit(sample)
    row = head.agg(*[x for i, c in enumerate(names) for x in (F.count_if(text_of(df, c) != "").alias(f"n{i}"), F.count_if(text_of(df, c).rlike(f"^{IPV4}$")).alias(f"a{i}"), F.count_if(text_of(df, c).rlike(r"^-?\d+(\.\d+)?$")).alias(f"d{i}"))]).first()
    kind = lambda n, a, d: "empty" if not n else "ipv4" if a >= 0.8 * n else "numeric" if d >= 0.8 * n else "text"
    return {c: kind(row[f"n{i}"], row[f"a{i}"], row[f"d{i}"]) for i, c in enumerate(names)}


def _apart(names: list[str]) -> dict[str, str]:
    """Names of native columns that differ from canonical ones, and from each other, in more than letter case."""
    taken, out = {c.lower() for c in CANONICAL}, {}
    for n in names:
        base = f"{n} (native)" if n.lower() in {c.lower() for c in CANONICAL} else n
        out[n] = next(x for x in (base, *(f"{base} ({i})" for i in range(2, len(names) + 3))) if x.lower() not in taken)
        taken.add(out[n].lower())
    return out


def merge(sources: list[Source], keep_empty: bool = False) -> DataFrame:
    """All rows of all sources: ``__source``, canonical columns, then native ones.

    Columns of one name fuse if their contents are of one class (or one side is empty); else each is named
    ``label·column``. Missing cells are empty text. Nothing is copied: this is a union of projections.
    """
    if len({s.time_is_number for s in sources}) > 1:
        raise ValueError("a numeric axis and clock times can't be merged")
    labels = unique_labels([s.label for s in sources])
    classes = [content_class(s.df, s.df.columns) for s in sources]
    names: dict[str, list[int]] = {}
    for i, s in enumerate(sources):
        for c in s.df.columns:
            names.setdefault(c, []).append(i)
    place: dict[tuple[int, str], str] = {}
    for c, at in names.items():
        fused = len({classes[i][c] for i in at} - {"empty"}) <= 1 and (len({sources[i].kind for i in at}) == 1 or any(sources[i].kind == "csv" for i in at))
        for i in at:
            place[i, c] = c if fused or len(at) == 1 else f"{labels[i]}·{c}"
    used = {n for n in CANONICAL[1:] if keep_empty or len(sources) < 2 or any({c.lower() for c in s.df.columns} & set(ALIASES[n]) for s in sources)}
    shown = _apart(list(dict.fromkeys(place.values())))
    parts = []
    for i, (label, s) in enumerate(zip(labels, sources)):
        own = {n: c for (j, c), n in place.items() if j == i}
        parts.append(s.df.select(F.lit(label).alias("__source"), *[canonical(s.df, n).alias(n) for n in CANONICAL[1:] if n in used], *[(text_of(s.df, own[n]) if n in own else F.lit("")).alias(to) for n, to in shown.items()]))
    return reduce(DataFrame.unionByName, parts)


def enabled(df: DataFrame, labels: list[str]) -> DataFrame:
    return df.filter(F.col("__source").isin(labels))


def capped_distinct(values: Column, most: int = 200) -> Column:
    """First-seen distinct values of an array, at most ``most``."""
    return F.slice(F.array_distinct(values), 1, most)
