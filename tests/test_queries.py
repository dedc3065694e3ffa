"""Every named query against its SQL on the same tables."""

import math

import duckdb
import pytest

from strandline import queries, source_queries

QUERIES, SQL = queries.QUERIES | source_queries.QUERIES, queries.SQL | source_queries.SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def base(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def values(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v
    return sorted(tuple(str(cell(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf_dir, base, name):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name in SQL:
        answer = base.execute(SQL[name])
        columns = [c[0] for c in answer.description]
        assert sorted(df.columns) == sorted(columns)
        assert values(rows, df.columns) == values(answer.fetchall(), columns)
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_shared_addresses_and_letters_beyond_ascii(spark, tmp_path):
    texts = ["at 100.64.1.2 and é8.8.8.8 or 9.9.9.9ü", "100.127.255.255, x7.7.7.7, 10.1.1.1, 172.16.0.1", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in queries.queries()["indicator_addresses"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.execute(queries.oracle_sql()["indicator_addresses"]).fetchall()) and len(got) == 4
