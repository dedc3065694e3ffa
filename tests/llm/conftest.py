import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, at int, n int, `class` string, size string, part string, token string"


def rows_of(texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "en", "s", 0, "k", 1, 2, "c", "z", "p", "t") for i, t in zip(ids, texts)]


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names the operators use inside."""
    return lambda texts, ids=None, parts=3: spark.createDataFrame(rows_of(texts, ids), SCHEMA).repartition(parts)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def prose():
    """Texts with shared passages, ties, repeats, empty and long ones; ids need not follow any order."""
    r = random.Random(7)
    base = [f"{r.choice('abcdef')}{r.randrange(40)}" for _ in range(600)]
    texts = []
    for i in range(60):
        a, b = r.randrange(400), r.randrange(400)
        texts.append(" ".join(base[a : a + r.randrange(150)] + [f"x{i}"] * r.randrange(60) + base[b : b + r.randrange(150)]))
    texts += [texts[3], texts[3], None, "", "   \n\t ", "one", "The the THE tHe " * 30, "é ü " * 40, " ".join(base * 20)]
    return texts
