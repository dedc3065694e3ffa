"""Nested address ranges of both families: each address gets the label of its longest network.

A network is a prefix length and the address bits under it, so an address is looked up by one equality for each length
that occurs in the table (at most 33 and 129 of them): no ranges are compared, and networks may nest to any depth. Only
distinct addresses are looked up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.indicators import ipv6_long
from strandline.operators.joins import ipv4_number

#: Networks are sent to every task up to so many (about 50 bytes each); more are joined by a shuffle.
BROADCAST_NETWORKS = 500_000
#: Groups of one to four digits; no lone colon at an end, no three in a row.
_SPELLED = r"^(?!:[^:])(?!.*:::)(?:[0-9A-Fa-f]{0,4}:)+[0-9A-Fa-f]{0,4}(?<![^:]:)$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _six(groups: Column) -> Column:
    signed = lambda begin: F.conv(F.substring(groups, begin, 16), 16, -10).try_cast("long")
    return F.when(groups.rlike("^[0-9a-f]{32}$"), F.struct(F.lit(6).alias("family"), signed(1).alias("hi"), signed(17).alias("lo")))


def _bits(address: Column) -> Column:
    """struct<family, hi, lo>: the bits of an address from the top of 128; null for anything else."""

    def undotted(a: Column) -> Column:
        tail = ipv4_number(F.regexp_extract(a, r":(\d+\.\d+\.\d+\.\d+)$", 1))
        return _let(tail, lambda n: F.when(F.contains(a, F.lit(".")), F.concat(F.regexp_replace(a, r"\d+\.\d+\.\d+\.\d+$", ""), F.lower(F.hex(F.floor(n / 65536))), F.lit(":"), F.lower(F.hex(n % 65536)))).otherwise(a))

    def parsed(a: Column) -> Column:
        six = _let(undotted(a), lambda x: F.when(x.rlike(_SPELLED), _let(F.replace(ipv6_long(x), F.lit(":"), F.lit("")), _six)))
        four = _let(ipv4_number(a), lambda n: F.when(n.isNotNull(), F.struct(F.lit(4).alias("family"), F.shiftleft(n, 32).alias("hi"), F.lit(0).cast("long").alias("lo"))))
        return F.when(F.contains(a, F.lit(":")), six).otherwise(four)

    return _let(address, parsed)


def _under(bits: Column, length: Column) -> tuple[Column, Column]:
    """The first ``length`` bits of hi and lo."""

    def cut(half: Column, n: Column) -> Column:
        spare = F.lit(64) - n
        kept = F.call_function("shiftleft", F.call_function("shiftright", half, spare), spare)
        return F.when(n >= 64, half).when(n <= 0, F.lit(0).cast("long")).otherwise(kept)

    return cut(bits["hi"], length), cut(bits["lo"], length - 64)


def networks(table: DataFrame, cidr: str, label: str) -> DataFrame:
    """``(family, length, hi, lo, label)`` of ``address/length`` texts; a lone address is its own network.

    Bits past the length don't count; rows that are no network go; of equal networks the least label stays.
    """
    text = F.trim(F.col(cidr))
    address, size = F.substring_index(text, "/", 1), F.regexp_extract(text, r"^[^/]*/(\d{1,3})$", 1)
    rows = table.select(_bits(address).alias("b"), F.when(~F.contains(text, F.lit("/")), F.lit(-1)).otherwise(size.try_cast("int")).alias("n"), F.col(label).alias("label")).filter("b is not null and n is not null")
    most = F.when(F.col("b.family") == 4, 32).otherwise(128)
    rows = rows.withColumn("length", F.when(F.col("n") < 0, most).otherwise(F.col("n"))).filter(F.col("length") <= most)
    hi, lo = _under(F.col("b"), F.col("length"))
    return rows.groupBy(F.col("b.family").alias("family"), "length", hi.alias("hi"), lo.alias("lo")).agg(F.min("label").alias("label"))


def longest_network(df: DataFrame, column: str, table: DataFrame, cidr: str, label: str) -> DataFrame:
    """Adds ``<column>.<label>``: the label of the longest network that holds the address, empty text if none does."""
    nets = networks(table, cidr, label)
    lengths = {r["family"]: sorted(r["l"]) for r in nets.groupBy("family").agg(F.collect_set("length").alias("l")).collect()}
    literal = lambda family: F.array(*map(F.lit, lengths.get(family, []))).cast("array<int>")
    addresses = df.select(F.col(column).alias("_a")).filter("_a is not null").distinct().withColumn("_b", _bits(F.trim("_a"))).filter("_b is not null")
    each = addresses.withColumn("length", F.explode(F.when(F.col("_b.family") == 4, literal(4)).otherwise(literal(6))))
    hi, lo = _under(F.col("_b"), F.col("length"))
    side = F.broadcast(nets) if nets.limit(BROADCAST_NETWORKS + 1).count() <= BROADCAST_NETWORKS else nets
    held = each.select("_a", F.col("_b.family").alias("family"), "length", hi.alias("hi"), lo.alias("lo")).join(side, ["family", "length", "hi", "lo"])
    best = held.groupBy("_a").agg(F.max_by("label", "length").alias("_label"))
    return df.join(best, df[column] == best["_a"], "left").drop("_a").withColumn(f"{column}.{label}", F.coalesce("_label", F.lit(""))).drop("_label")
