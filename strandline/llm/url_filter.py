"""URL filters: a trie over reversed host labels and path segments, broadcast; the longest fitting rule decides.

A rule is a host, the beginning of a path, and ``allow`` or ``block``. It fits its host and every subdomain, where the
URL's path starts with the rule's. The trie goes from the top-level label down to the host, and from there along whole
path segments; the last stretch of a rule's path, which may end inside a segment, hangs on its node. The walk keeps every
host node that it passes, and asks them from the deepest to the top: a longer host goes before a longer path. Where one
(host, path) is both allowed and blocked, it is blocked. URLs that no rule fits get ``default``.

The rules are counted first. Up to RULES of them and RULE_CHARS characters they travel as a broadcast trie; beyond, the
same answer comes from equality joins: distinct URLs meet rule hosts by their host suffixes, and a host's rules by path
prefixes of the lengths that occur there.

Defined results: a null URL, or one without ``://``, has an empty host and path, which no rule fits; ports and user names
belong to the host as written; only A-Z are lower-cased; repeated rows are judged alike; an empty table, or one without
rules, is no special case. A rule without a host, or with another verdict, is an error. Extra columns stay; the columns
``host path rule verdict`` are new, and a column that has such a name already is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

RULES, RULE_CHARS = 200_000, 16_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Trie:
    """A node's children by label or segment, its path trie, and the rules that end here by their last stretch."""

    __slots__ = ("children", "paths", "tails", "lengths")

    def __init__(self) -> None:
        self.children: dict[str, Trie] = {}
        self.paths: Trie | None = None
        self.tails: dict[str, tuple[str, str]] = {}
        self.lengths: list[int] = []

    def child(self, key: str) -> Trie:
        return self.children.setdefault(key, Trie())

    def add(self, host: str, path: str, verdict: str) -> None:
        node = self
        for label in reversed(host.split(".")):
            node = node.child(label)
        node.paths = node.paths or Trie()
        node, (*whole, tail) = node.paths, path.split("/")
        for segment in whole:
            node = node.child(segment)
        if verdict == "block" or tail not in node.tails:
            node.tails[tail] = (host + path, verdict)
        node.lengths = sorted({len(t) for t in node.tails}, reverse=True)

    def _longest(self, path: str) -> tuple[str, str] | None:
        node, best = self, None
        for segment in path.split("/"):
            for length in node.lengths:
                found = node.tails.get(segment[:length]) if length <= len(segment) else None
                if found:
                    best = found
                    break
            node = node.children.get(segment)
            if node is None:
                break
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        node, passed = self, []
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            if node.paths:
                passed.append(node.paths)
        for paths in reversed(passed):
            if found := paths._longest(path):
                return found
        return None


@lru_cache(maxsize=2)
def _built(rules: tuple[tuple[str, str, str], ...]) -> Trie:
    """Built once a worker; the rules travel, since a deep trie can't be pickled."""
    trie = Trie()
    for host, path, verdict in rules:
        trie.add(host, path, verdict)
    return trie


def _walk(rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _built(rules.value)
        for batch in batches:
            at = batch.schema.get_field_index("host")
            hosts, paths = batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()
            found = [trie.find(h, p) or (None, None) for h, p in zip(hosts, paths)]
            rule, verdict = ([f[i] for f in found] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return run


def _by_joins(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the distinct URLs that a rule fits, without a broadcast."""
    rules = rules.groupBy(F.col("host").alias("of"), F.col("path").alias("start")).agg(F.max(F.col("verdict") == "block").alias("blocks"))
    lengths = rules.groupBy("of").agg(F.collect_set(F.length("start")).alias("lengths"))
    labels = F.split("host", r"\.", -1)
    suffixes = urls.select("host", "path").distinct().withColumn("of", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    starts = suffixes.join(lengths, "of").withColumn("n", F.explode("lengths")).filter(F.col("n") <= F.length("path")).withColumn("start", F.expr("substring(path, 1, n)"))
    found = starts.drop("lengths").join(rules, ["of", "start"])
    best = F.max(F.struct(F.length("of").alias("a"), F.col("n").alias("b"), F.concat("of", "start").alias("rule"), "blocks"))
    return found.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", F.when(F.col("best.blocks"), "block").otherwise("allow").alias("verdict"))


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with its host, path, the ``rule`` (host and path together) that decides, and the verdict.

    ``rules`` has the columns host, path and verdict; its hosts are in lower case.
    """
    rules = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
    wrong = F.coalesce(F.col("host") == "", F.lit(True)) | ~F.coalesce(F.col("verdict").isin("allow", "block"), F.lit(False))
    size = rules.agg(F.count("*").alias("n"), F.sum(F.length(F.concat("host", "path"))).alias("chars"), F.count_if(wrong).alias("wrong")).first()
    if size["wrong"]:
        raise ValueError(f"{size['wrong']} rules have no host, or a verdict other than allow and block")
    url = F.col(url_col).cast("string")
    part = lambda i: F.coalesce(F.regexp_extract(url, _PARTS, i), F.lit(""))
    taken = {"host", "path", "rule", "verdict"}
    parted = urls.select(*[c for c in urls.columns if c not in taken], F.translate(part(1), _UPPER, _LOWER).alias("host"), part(2).alias("path"))
    if size["n"] > RULES or (size["chars"] or 0) > RULE_CHARS:
        found = parted.join(_by_joins(parted, rules), ["host", "path"], "left").select(*parted.columns, "rule", "verdict")
    else:
        sent = urls.sparkSession.sparkContext.broadcast(tuple(map(tuple, rules.collect())))
        found = parted.mapInArrow(_walk(sent), StructType([*parted.schema, StructField("rule", StringType()), StructField("verdict", StringType())]))
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
