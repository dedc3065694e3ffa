"""Virtual columns: regex, JSON path and key-value extraction, and the scan that proposes them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.coerce import text_of
from strandline.functions.jsonpaths import leaf_paths
from strandline.functions.text import HOST, URL
from strandline.plans.query import check_pattern


@dataclass(frozen=True)
class Extract:
    """``kind`` is regex, json or kv; ``spec`` the pattern, the path or the key."""

    source: str
    kind: str
    spec: str
    name: str
    group: int = 0
    share: float = 100.0


def unique_name(taken: list[str], base: str) -> str:
    return next(n for n in (base, *(f"{base} {i}" for i in range(2, len(taken) + 3))) if n.lower() not in {t.lower() for t in taken})


def regex_column(text: Column, pattern: str, group: int = 0, trim: bool = True) -> Column:
    """First match, or its group (the whole match if there is no such group); empty if nothing matches."""
    check_pattern(pattern)
    groups = re.compile(re.sub(r"\(\?<([A-Za-z])", r"(?P<\1", pattern)).groups
    out = F.regexp_extract(text, pattern, group if group <= groups else 0)
    return F.trim(out) if trim else out


def json_column(text: Column, path: str) -> Column:
    """The scalar at ``a.b[0]`` or ``a[*].b`` (the first of the expansion); objects, arrays and misses are empty."""
    full = "$" + "".join(p if p.startswith("[") else f".{p}" for p in re.findall(r"\[\*\]|\[\d+\]|[^.\[\]]+", path))
    got = F.get_json_object(text, full)
    if "[*]" in path:
        got = F.when(got.rlike(r"^\s*\["), F.get_json_object(got, "$[0]")).otherwise(got)
    return F.coalesce(F.when(~got.rlike(r"^\s*[\[{]"), got), F.lit(""))


def kv_column(text: Column, key: str) -> Column:
    k = re.escape(key)
    return F.trim(F.regexp_extract(text, rf"(?s)(?:^| \| ){k}=(.*?)(?= \| [^=|]+=|$)", 1))


def column_of(df: DataFrame, e: Extract) -> Column:
    text = text_of(df, e.source)
    return {"regex": lambda: regex_column(text, e.spec, e.group), "json": lambda: json_column(text, e.spec), "kv": lambda: kv_column(text, e.spec)}[e.kind]()


def with_extracts(df: DataFrame, extracts: list[Extract]) -> DataFrame:
    """All extracts in one projection; repeats of the same source and spec are left out."""
    seen, out, names = set(), {}, list(df.columns)
    for e in extracts:
        if (e.source, e.kind, e.spec, e.group) not in seen:
            seen.add((e.source, e.kind, e.spec, e.group))
            name = unique_name(names, e.name)
            names.append(name)
            out[name] = column_of(df, e)
    return df.withColumns(out) if out else df


def propose(df: DataFrame, rows: int = 200, most: int = 12) -> list[Extract]:
    """Extracts that fit a sample of ``rows`` rows, the most common first, at most ``most`` a column.

    Only counts come to the driver: JSON leaves in half the cells, ``k=v | k=v`` keys, URLs and host names in a third.
    """
    head = df.limit(rows)
    out: list[Extract] = []
    for name in [f.name for f in df.schema if f.dataType.simpleString() == "string"]:
        cells = head.select(text_of(df, name).alias("v")).filter("v != ''")
        total, json, kv, urls, hosts = cells.agg(
            F.count("*"), F.count_if(F.col("v").rlike(r"^\s*[{\[]")), F.count_if(F.regexp_count("v", F.lit(r"(?:^| \| )[^=|]{1,59}=")) >= 2), F.count_if(F.col("v").rlike(URL)), F.count_if(F.col("v").rlike(rf"^{HOST}$"))
        ).first()
        if not total:
            continue
        found: list[Extract] = []
        if json >= max(3, 0.5 * total):
            keys = cells.select(F.explode(leaf_paths(F.col("v"))).alias("k")).groupBy("k").count().filter(F.col("count") >= max(3, 0.3 * total))
            found += [Extract(name, "json", r["k"], f"{name}.{r['k']}", share=100 * r["count"] / total) for r in keys.collect()]
        elif kv >= max(3, 0.5 * total):
            keys = cells.select(F.explode(F.regexp_extract_all("v", F.lit(r"(?:^| \| )([^=|]{1,59})="), 1)).alias("k")).groupBy("k").count().filter(F.col("count") >= max(3, 0.3 * total))
            found += [Extract(name, "kv", r["k"], r["k"], share=100 * r["count"] / total) for r in keys.collect()]
        elif urls >= max(3, 0.3 * total):
            found.append(Extract(name, "regex", URL, f"{name} url", share=100 * urls / total))
        elif hosts >= max(3, 0.3 * total):
            found.append(Extract(name, "regex", HOST, f"{name} host", share=100 * hosts / total))
        out += sorted(found, key=lambda e: (-e.share, e.name))[:most]
    return sorted(out, key=lambda e: (-e.share, e.source, e.name))
