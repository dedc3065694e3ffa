"""The filter language: syntax, printing, edits, and its columns against a row-at-a-time reading."""

import random
import re

import pytest

from strandline.plans import query as q

ROWS = [(1, "alpha", "Error: disk", 3.5, None), (2, "beta", "ok", 50.0, "x y"), (3, None, "WARN net", None, ""), (4, "Alpha", "error", -1.0, "2024-01-02"), (5, 'qu"ote', "a\\b", 1e3, "IN")]
FIELDS = ("id", "name", "msg", "value", "extra")


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, name string, msg string, value double, extra string")


def text(v):
    return "" if v is None else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def holds(node, row):
    cell = dict(zip(FIELDS, row))
    match node:
        case q.Everything():
            return True
        case q.Anywhere(n):
            return n.lower() in "\n".join(text(v) for v in row).lower()
        case q.Not(i):
            return not holds(i, row)
        case q.And(items):
            return all(holds(i, row) for i in items)
        case q.Or(items):
            return any(holds(i, row) for i in items)
        case q.Member(f, values, negated):
            return (text(cell[f.lower()]) in values) != negated
        case q.Test(f, op, v, flags):
            t = text(cell[f.lower()])
            if op == ":":
                return v.lower() in t.lower()
            if op in "=!=":
                return (t == v) == (op == "=")
            if op == "~":
                return bool(re.search(v, t, re.I if "i" in flags else 0))
            try:
                x, y = float(t), float(v)
            except ValueError:
                return False
            return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def random_tree(r, depth=3):
    if depth == 0 or r.random() < 0.3:
        f = r.choice(FIELDS[1:4])
        return r.choice([
            q.Anywhere(r.choice(["err", "alpha", "ok", '"', "x y"])), q.Test(f, r.choice([":", "=", "!="]), r.choice(["alpha", "error", "50", "", 'qu"ote', "a\\b", "NOT"])),
            q.Test(f, "~", r.choice(["^a", "r+or", "[0-9]/?"]), r.choice(["", "i"])), q.Test("value", r.choice(["<", "<=", ">", ">="]), r.choice(["0", "50", "abc", "-1"])),
            q.Member(f, tuple(r.sample(["alpha", "ok", "50", "in"], 2)), r.random() < 0.5),
        ])
    kind = r.choice([q.Not, q.And, q.Or])
    if kind is q.Not:
        return q.Not(random_tree(r, depth - 1))
    items = tuple(random_tree(r, depth - 1) for _ in range(r.randrange(2, 4)))
    return kind(tuple(i for i in items if not isinstance(i, kind)) or items) if len([i for i in items if not isinstance(i, kind)]) > 1 else items[0]


def test_columns_and_round_trip(df):
    r = random.Random(11)
    trees = [random_tree(r) for _ in range(60)]
    for tree in trees:
        assert q.parse(q.to_text(tree)) == tree, q.to_text(tree)
    from pyspark.sql import functions as F

    got = df.select("id", *[q.compile_query(df, t).alias(f"c{i}") for i, t in enumerate(trees)]).collect()
    for row in got:
        for i, tree in enumerate(trees):
            assert row[f"c{i}"] is holds(tree, ROWS[row["id"] - 1]), q.to_text(tree)


@pytest.mark.parametrize("source, ids", [
    ("", {1, 2, 3, 4, 5}), ("alpha", {1, 4}), ("name:ALPHA", {1, 4}), ("name=alpha", {1}), ("name!=alpha", {2, 3, 4, 5}), ("-alpha", set()), ("any!=alpha", {1, 4}), ("any~/alpha/", set()), ("any<5", set()),
    ("value>2024-01-01", set()), ("extra>2024-01-01", set()), ("extra>1000000000000", {4}), ("name IN (alpha, beta)", {1, 2}), ("name NOT IN (alpha, beta)", {3, 4, 5}), ('extra=""', {1, 3}), ("NOT msg~/ERROR/i", {2, 3, 5}),
    ("alpha OR msg:ok value>10", {1, 2, 4}), ("(alpha OR msg:ok) value>10", {2}), ('extra="IN"', {5}), ("[name]:=beta", {2}), ("name:!beta", {1, 3, 4, 5}),
])
def test_meanings(df, source, ids):
    assert {r["id"] for r in q.where(df, source).collect()} == ids


@pytest.mark.parametrize("source", ["(alpha", "name=", "nofield=1", "name IN ()", "any IN (a)", "is:odd", 'name:"open', "url:http://x", "a)", "name~/(a+)+/", "name~/[/", "OR x"])
def test_errors(df, source):
    with pytest.raises(q.QuerySyntaxError) as e:
        q.where(df, source)
    assert 0 <= e.value.at <= len(source)
    assert df.filter(q.compile_query(df, source, lenient=True)).count() == 5


def test_edits():
    tree = q.parse("name=a AND msg:b OR name:c")
    assert q.to_text(q.without(tree, "NAME")) == "msg:b"
    assert isinstance(q.without(q.parse("NOT name=a"), "name"), q.Everything)
    assert q.to_text(q.toggle(q.parse("msg:b"), "name", "x")) == "msg:b AND name=x"
    assert q.to_text(q.toggle(q.parse("msg:b AND name=x"), "name", "x")) == "msg:b"
    assert q.to_text(q.toggle(q.parse("name=x"), "name", "x", negated=True)) == "name!=x"
    assert q.to_text(q.set_clause(q.parse("name=x AND msg:b"), q.Member("name", ("p", "q")))) == "msg:b AND name IN (p, q)"
    assert q.fields_of(tree) == ["name", "msg"]


def test_columns_are_pruned(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    plan = q.where(part, "p_brand IN (Brand#1) p_type=ECONOMY").select("p_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<p_partkey:bigint,p_brand:string,p_type:string>" in plan


def test_suggestions(df):
    assert "name" in q.suggestions(df, "na") and q.suggestions(df, "msg:err") == ['"Error: disk"', "error"]
