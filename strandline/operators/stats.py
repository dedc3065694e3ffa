"""Facets, column statistics, pivots and typed sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.coerce import leading_number, number, text_of
from strandline.functions.timeparse import column_millis, time_millis
from strandline.plans.query import Node, compile_query, parse, without


def top_values(df: DataFrame, name: str, limit: int = 50, order: str | None = None) -> DataFrame:
    """``(value, n)`` by count; ties by first appearance if ``order`` names a row order, else by text."""
    tie = F.min(order) if order else F.lit(0)
    counts = df.groupBy(text_of(df, name).alias("value")).agg(F.count("*").alias("n"), tie.alias("first"))
    return counts.orderBy(F.desc("n"), "first", "value").limit(limit).select("value", "n")


def card_order(values: DataFrame, mode: str = "count_desc") -> DataFrame:
    """``(value, n)`` rows in the order of a card: count_desc, count_asc, text_asc or text_desc."""
    by, _, way = mode.rpartition("_")
    key = F.col("n") if by == "count" else F.lower("value")
    return values.orderBy(key.desc() if way == "desc" else key.asc(), "value")


def quick_filter(df: DataFrame, needle: str) -> DataFrame:
    """Rows whose cells, joined by spaces, hold the text (so it may span cells), letter case ignored."""
    cells = F.concat_ws(" ", *[text_of(df, c) for c in df.columns if not c.startswith("_")])
    return df.filter(F.contains(F.lower(cells), F.lit(needle.lower())))


def distinct_counts(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(column, total, distinct, all_unique)`` of each column; empty texts count as a value.

    Values are counted from (column, value) groups, so a high-cardinality column costs one partial aggregation and no
    set grows in one place.
    """
    values = column_values(df, names)
    return values.groupBy("column").agg(F.sum("n").alias("total"), F.count("*").alias("distinct")).withColumn("all_unique", (F.col("distinct") == F.col("total")) & (F.col("total") > 1))


def column_values(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(column, value, n)`` of every value of every column, by one unpivot and one shuffle of partial counts."""
    names = names or [c for c in df.columns if not c.startswith("_")]
    texts = df.select(*[text_of(df, c).alias(c) for c in names])
    return texts.unpivot([], names, "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


def column_stats(df: DataFrame, names: list[str] | None = None, limit: int = 100) -> DataFrame:
    """The ``limit`` most frequent values of each column with its totals; none for columns whose values all differ."""
    values = column_values(df, names)
    totals = values.groupBy("column").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"))
    ranked = values.withColumn("rank", F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= limit)
    return ranked.join(F.broadcast(totals), "column").filter("distinct < total").select("column", "total", "distinct", "rank", "value", "n")


def facet(df: DataFrame, query: str | Node, name: str, limit: int = 50) -> DataFrame:
    """Values of a column under the query less its own terms, as a filter menu shows them."""
    tree = parse(query) if isinstance(query, str) else query
    return top_values(df.filter(compile_query(df, without(tree, name))), name, limit)


def pivot(df: DataFrame, rows: str, columns: str, how: str = "count", value: str | None = None, most: int = 50) -> DataFrame:
    """``(row, column, value)`` over the most frequent rows and columns; ``how`` is count, distinct or sum.

    Both rankings come from one small table of (row, column) counts; cells outside the kept keys are dropped.
    """
    base = df.select(text_of(df, rows).alias("row"), text_of(df, columns).alias("column"), *([text_of(df, value).alias("v")] if value else []))
    cells = base.groupBy("row", "column").agg(F.count("*").alias("n"))
    top = lambda key: cells.groupBy(key).agg(F.sum("n").alias("c")).orderBy(F.desc("c"), key).limit(most).select(key)
    measure = {"count": F.count("*"), "distinct": F.count_distinct("v"), "sum": F.sum(leading_number(F.col("v")))}[how]
    kept = base.join(F.broadcast(top("row")), "row").join(F.broadcast(top("column")), "column")
    return kept.groupBy("row", "column").agg(measure.alias("value"))


def auto_pivot(df: DataFrame, rows: str, stack: str | None = None) -> str | None:
    """The other axis for a pivot: the stack column, or the one with 2-60 values nearest to 15."""
    counts = {r["column"]: r["distinct"] for r in distinct_counts(df, [c for c in df.columns if c != rows and not c.startswith("_")]).collect()}
    fit = {c: n for c, n in counts.items() if 2 <= n <= 60}
    if stack in fit:
        return stack
    return min(fit, key=lambda c: (abs(fit[c] - 15), df.columns.index(c)), default=None)


def _profile(df: DataFrame, name: str, sample: int = 200) -> tuple[int, int, int, int, int]:
    """(values, times, distinct, short integers, numbers) among the first rows."""
    head = df.select(text_of(df, name).alias("v")).filter("v != ''").limit(sample)
    row = head.agg(
        F.count("*"), F.count(time_millis(F.col("v"))), F.count_distinct("v"), F.count_if(F.col("v").rlike(r"^\d{1,6}$")), F.count(number(F.col("v")))
    ).first()
    return tuple(row)


def sort_key(df: DataFrame, name: str) -> Column:
    """Time, number or lower-cased text, as the column's first values suggest; typed columns keep their type."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return column_millis(df, name)
    if not isinstance(kind, T.StringType):
        return F.col(f"`{name}`")
    n, times, distinct, short, numbers = _profile(df, name)
    text = text_of(df, name)
    if n >= 3 and times >= 0.5 * n and distinct >= 2 and short <= 0.8 * n:
        return time_millis(text)
    return number(text) if n and numbers >= 0.9 * n else F.lower(text)


def sort_by(df: DataFrame, name: str, order: str, descending: bool = False) -> DataFrame:
    """Rows by the typed key, what can't be read last in both directions, ties in row order."""
    key = sort_key(df, name)
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), order)


def chronological(df: DataFrame, order: str) -> DataFrame:
    return df.orderBy(F.col("_t").asc_nulls_last(), order)


def detect_time_column(df: DataFrame, sample: int = 200) -> str | None:
    """The column to read times from: a time-like name with half its values readable, else the best over 60 %."""
    head = df.limit(sample)
    shares: dict[str, float] = {}
    for name in df.columns:
        if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return name
    counts = head.agg(*[x for c in df.columns for x in (F.count_if(text_of(df, c) != "").alias(f"n_{c}"), F.count(time_millis(text_of(df, c))).alias(f"t_{c}"))]).first().asDict()
    for c in df.columns:
        shares[c] = counts[f"t_{c}"] / counts[f"n_{c}"] if counts[f"n_{c}"] else 0.0
    named = [c for c in df.columns if any(w in c.lower() for w in ("time", "date", "timestamp", "ts", "created", "when")) and shares[c] >= 0.5]
    if named:
        return named[0]
    best = max(df.columns, key=lambda c: shares[c], default=None)
    return best if best and shares[best] > 0.6 else None


def detect_stack_column(df: DataFrame, sample: int = 2000) -> str | None:
    """A categorical column: 2-40 values that repeat; familiar names first."""
    head = df.limit(sample)
    names = [c for c in df.columns if not c.startswith("_")]
    row = head.agg(*[x for c in names for x in (F.count_if(text_of(df, c) != "").alias(f"n_{c}"), F.count_distinct(F.nullif(text_of(df, c), F.lit(""))).alias(f"d_{c}"))]).first().asDict()
    fit = [c for c in names if row[f"n_{c}"] >= 10 and 2 <= row[f"d_{c}"] <= 40 and row[f"d_{c}"] <= 0.5 * row[f"n_{c}"]]
    for exact in (True, False):
        for word in ("level", "severity", "status", "event_type", "type", "category", "priority"):
            for c in fit:
                if c.lower() == word if exact else word in c.lower():
                    return c
    return fit[0] if fit else None
