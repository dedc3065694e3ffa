"""Filters reach the scan, and what they imply for raw columns never loses a row."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from strandline import queries
from strandline.operators import timeline
from strandline.plans import pushdown
from strandline.plans import query as q

KINDS = {
    "s": ("string", ["", "a", "A", "10", "1e1", None]),
    "i": ("int", [0, 10, -5, 2**31 - 1, -(2**31), None]),
    "n": ("long", [0, 10, 2**53 + 1, -(2**63), None]),
    "x": ("double", [0.0, -0.0, 10.0, 2.5, 1e16, float("nan"), float("inf"), None]),
    "f": ("float", [0.1, 10.0, None]),
    "b": ("boolean", [True, False, None]),
    "d": ("date", [datetime.date(1970, 1, 1), datetime.date(2024, 2, 29), datetime.date(1, 1, 1), None]),
    "t": ("timestamp", [datetime.datetime(2024, 1, 2, 3, 4, 5, 678999), datetime.datetime(1969, 12, 31, 23, 59, 59, 999999), None]),
    "u": ("timestamp_ntz", [datetime.datetime(2024, 1, 2, 3, 4, 5, 678000), None]),
    "m": ("decimal(20,3)", ["10.000", "2.500", "-0.001", None]),
    "a": ("array<int>", [[1], [], None]),
}
VALUES = ["", "a", "10", "10.0", "2.5", "-5", "-0", "0", "007", "1e1", "0.1", "NaN", "true", "2024-02-29", "2024-02-30", "2024-01-02 03:04:05.678", "1704164645678", "1704164645678.5", "9007199254740993", "1e30", "-1", "-1e300", "[1]"]


def random_tree(r, depth=3):
    if depth == 0 or r.random() < 0.35:
        name = r.choice([*KINDS, q.ANY])
        if r.random() < 0.3 and name != q.ANY:
            return q.Member(name, tuple(dict.fromkeys(r.choices(VALUES, k=3))), r.random() < 0.5)
        op = r.choice(["=", "!=", ":", "~", "<", "<=", ">", ">="])
        if name == q.ANY and op in "=!=:":
            return q.Anywhere("a")
        return q.Test(name, op, r.choice(["a", "1.", "^$"]) if op == "~" else r.choice(VALUES))
    kind = r.choice([q.Not, q.And, q.Or])
    return kind(random_tree(r, depth - 1)) if kind is q.Not else kind(tuple(random_tree(r, depth - 1) for _ in range(r.randrange(2, 4))))


@pytest.fixture(scope="module")
def mixed(spark):
    r = random.Random(2)
    rows = [tuple(r.choice(v) for _, v in KINDS.values()) for _ in range(250)]
    loose = ", ".join(f"{n} {'string' if k.startswith('decimal') else k}" for n, (k, _) in KINDS.items())
    return spark.createDataFrame(rows, loose).withColumn("m", F.col("m").cast("decimal(20,3)")).cache()


def test_implied_never_loses_a_row(mixed):
    """Whatever a query and its negation let through, the raw condition lets through too; and it is true, not null, there."""
    r = random.Random(9)
    trees = [random_tree(r) for _ in range(40)]
    trees += r.sample([q.Test(n, op, v) for n in KINDS for op in ("=", "!=", "<", "<=", ">", ">=") for v in VALUES], 160) + [q.Test("n", op, "9007199254740993") for op in ("<", "<=", ">", ">=", "=", "!=")]
    binder = q.Binder(mixed)
    for chunk in range(0, len(trees), 60):
        lost, said = [], 0
        for t in trees[chunk : chunk + 60]:
            for want in (True, False):
                raw = pushdown.implied(binder, t, want)
                if raw is not None:
                    said += 1
                    exact = binder.column(t) if want else ~binder.column(t)
                    lost.append(F.count_if(exact & ~F.coalesce(raw, F.lit(False))).alias(f"{want} {q.to_text(t)}"[:200] + f" #{len(lost)}"))
        assert said > 20
        assert {k: v for k, v in mixed.agg(*lost).first().asDict().items() if v} == {}


def test_windows_never_lose_a_row(mixed):
    for name in ("n", "x", "d", "t", "u"):
        timed = timeline.with_time(mixed, name)
        for lo, hi in [(None, 10), (0, 86_399_999.5), (1704164645678, 1704164645678), (1704164645678.5, None), (-1, 0), (float("-inf"), float("inf")), (-1e18, 1e18)]:
            assert timeline.clip(timed, lo, hi, name).count() == timeline.clip(timed, lo, hi).count(), (name, lo, hi)


def pushed(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(re.findall(r"PushedFilters: \[(.*?)\], ReadSchema", plan))


@pytest.mark.parametrize("name, parts", [
    ("dsl_equals", ["EqualTo(c_mktsegment,BUILDING)"]), ("dsl_in", ["In(event_type, [error,purchase])"]), ("dsl_not_in", ["Not(In(o_orderpriority"]),
    ("dsl_range", ["GreaterThanOrEqual(o_totalprice,100000.0)", "LessThan(o_totalprice,250000.5)", "GreaterThanOrEqual(o_orderdate,1998-07-09"]),
    ("dsl_boolean_mix", ["Or(EqualTo(l_returnflag,R),GreaterThan(l_quantity,45.0))", "GreaterThanOrEqual(l_discount,0.05)"]),
    ("dsl_not_equals", ["Not(EqualTo(event_type,click))", "Not(EqualTo(props,))"]), ("time_window", ["GreaterThanOrEqual(ts,2024-01-08", "LessThan(ts,2024-01-09"]),
    ("preset_last_day", ["GreaterThanOrEqual(ts,2024-01-2"]), ("dsl_facet_without_own_clause", ["GreaterThanOrEqual(value,100.0)"]),
])
def test_filters_reach_the_scan(spark, sf_dir, name, parts):
    found = pushed(queries.QUERIES[name](spark, sf_dir))
    assert all(p in found for p in parts), found


def _rows_read(df):
    df.collect()
    nodes, read = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan"):
            read += node.metrics().get("numOutputRows").get().value()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return read


def test_row_groups_are_skipped(spark, tmp_path):
    """A file of many row groups, sorted by time and id: a filter of the language and a window read a few of them."""
    path = str(tmp_path / "sorted")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")  # the default has no statistics
    rows = spark.range(60_000).select("id", F.timestamp_millis(1_700_000_000_000 + F.col("id") * 1000).alias("ts"), F.format_string("k%05d", "id").alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("load"))
    rows.coalesce(1).sortWithinPartitions("id").write.option("parquet.block.size", 65_536).option("parquet.page.row.count.limit", 500).parquet(path)
    spark.conf.unset("spark.sql.parquet.outputTimestampType")
    df = spark.read.parquet(path)
    for query in ("id>=59000", "key=k59990", "ts>1700059000000", "NOT id<59990", "key IN (k59000, k59001) AND load:a", "id=59990 OR id=59991"):
        kept = q.where(df, query)
        assert 0 < kept.count() and _rows_read(kept) < 12_000, query
    timed = timeline.clip(timeline.with_time(df, "ts"), 1_700_059_000_000, None, "ts")
    assert _rows_read(timed) < 12_000
