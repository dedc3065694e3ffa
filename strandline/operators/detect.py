"""Rule-based detections and their roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.indicators import RANKS

_RANK = lambda c: F.coalesce(*[F.when(c == s, F.lit(r)) for s, r in RANKS.items()], F.lit(0))

#: ATT&CK tactics in the order of an attack.
TACTICS = ("reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion", "credential-access", "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact")


def event_stats(df: DataFrame, event: str, channel: str, level: str, order: str) -> DataFrame:
    """``(event, channel, n, first, last, level)`` of every event id; the level is the first row's."""
    return df.groupBy(event, channel).agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.min_by(level, order).alias("level"))


def detections(stats: DataFrame, rules: DataFrame, event: str) -> DataFrame:
    """Rules ``(event, title, severity, technique)`` that fire, most severe first; rules are broadcast if Spark finds them small."""
    return stats.join(rules, event).groupBy(event, "title", "severity", "technique").agg(F.sum("n").alias("hits"), F.min("first").alias("first"), F.max("last").alias("last"))


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(_RANK(F.col("severity")).desc(), F.desc("hits"), "first", "title")


def severity_tally(found: DataFrame) -> DataFrame:
    """``(severity, rules, hits)``."""
    return found.groupBy("severity").agg(F.count("*").alias("rules"), F.sum("hits").alias("hits"))


def by_tactic(found: DataFrame, techniques: DataFrame) -> DataFrame:
    """``(tactic, technique, severity, hits)``: each technique once, with its highest severity, in the order of an attack."""
    each = found.withColumn("_r", _RANK(F.col("severity"))).groupBy("technique").agg(F.max_by("severity", F.struct("_r", "hits")).alias("severity"), F.max("_r").alias("_r"), F.sum("hits").alias("hits"))
    place = F.array_position(F.array(*map(F.lit, TACTICS)), F.col("tactic"))
    return each.join(techniques, "technique").orderBy(place, F.desc("_r"), "technique").select("tactic", "technique", "severity", "hits")


def risk(found: DataFrame) -> DataFrame:
    """One row: the highest severity, at least medium if anything was found."""
    top = F.max(_RANK(F.col("severity")))
    return found.agg(F.when(F.count("*") == 0, "info").otherwise(F.get(F.array(*map(F.lit, RANKS)), F.greatest(top, F.lit(RANKS["medium"])))).alias("risk"))


def keyword_severity(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The highest severity of (pattern, severity) rules that match, null if none."""
    best = F.greatest(*[F.when(text.rlike(p), F.lit(RANKS[s])) for p, s in rules], F.lit(None).cast("int"))
    return F.get(F.array(*map(F.lit, RANKS)), best)


def sender_spoof(display: Column, address: Column, brands: dict[str, list[str]]) -> Column:
    """high if the shown name is a brand whose hosts the address is not under, medium if it names another host, else none."""
    host = F.lower(F.regexp_extract(address, r"@([^>\s]+)", 1))
    shown = F.lower(display)
    high = F.lit(False)
    for brand, hosts in brands.items():
        under = F.lit(False)
        for h in hosts:
            under = under | (host == h) | host.endswith("." + h)
        high = high | (shown.rlike(rf"\b{brand.lower()}\b") & ~under)
    named = F.regexp_extract(shown, r"([a-z0-9-]+(?:\.[a-z0-9-]+)+)", 1)
    return F.when(high, "high").when((named != "") & (host != named) & ~host.endswith(F.concat(F.lit("."), named)), "medium").otherwise("none")
