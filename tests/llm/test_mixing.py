import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.llm import mixing


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        over = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        capped |= over


def check(docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want, got = targets(sizes), mixing.digest(docs).collect()
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, size(t)) for i, t, _ in rows)
    block = max(1, min(64, int(sum(want.values())) // mixing.MIN_SLOTS))
    assert all(abs(taken[s] - want[s]) <= 4 * block for s in want)  # the discrepancy: a few slots
    assert all((r["first_slot"] is None) == (r["taken"] == 0) for r in got)
    return got


def test_whole_table(documents):
    got = check(documents)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.digest(documents.repartition(5)).collect()))


def test_edges(spark):
    rows = [(1, "a b c", None), (2, None, "x"), (3, "", "x"), (4, "d " * 900, "x"), (4, "d " * 900, "x"), (5, "é f g", "😀"), (6, "h", "￿"), (7, "i " * 5000, "zz")]
    check(spark.createDataFrame([r + (9, 9) for r in rows], "doc_id long, text string, source string, block int, chunk int"))


def test_only_empty_texts_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.digest(df).collect()] == [(0, 0, 0.0)] * 2
    assert mixing.digest(df.limit(0)).collect() == []


def test_schedule_spreads_sources(documents):
    plan = mixing.mix(documents, block_words=16)
    slots = [r["source_no"] for r in plan.schedule.orderBy("slot").collect()]
    share = Counter(slots)
    for source, n in share.most_common(3):
        for cut in (len(slots) // 4, len(slots) // 2):
            assert abs(Counter(slots[:cut])[source] - n * cut / len(slots)) < 6
    assert sum(share.values()) == len(set(r["slot"] for r in plan.schedule.collect()))
    assert plan.schedule.groupBy("source_no", "block").count().filter("count > 1").count() == 0


@pytest.mark.parametrize("replaced", ["constant", "permuted", "clumped"])
def test_the_points_decide(documents, monkeypatch, replaced):
    """Other points take other words of other documents, at other slots."""
    want = {r["doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.digest(documents).collect()}
    real = mixing.points
    u = {"constant": F.lit(0.25), "permuted": F.pmod(F.xxhash64("slot"), F.lit(1 << 30)) / F.lit(float(1 << 30)), "clumped": F.col("u") * F.col("u")}[replaced]
    monkeypatch.setattr(mixing, "points", lambda spark, slots: real(spark, slots).withColumn("u", u))
    got = {r["doc_id"]: (r["taken"], r["first_slot"]) for r in mixing.digest(documents).collect()}
    assert sum(got[i] != want[i] for i in want) > len(want) // 3
    assert sum(got[i][0] != want[i][0] for i in want) >= 10


def test_blocks_of_several_words(documents, monkeypatch):
    monkeypatch.setattr(mixing, "MIN_SLOTS", 1000)
    docs = documents.select("doc_id", "text", "source")
    got = check(docs)
    plan = mixing.mix(docs)
    assert plan.block_words > 32
    # by hand: the words of each block of the schedule
    pieces = {}
    for r in plan.pieces.collect():
        pieces.setdefault((r["source_no"], r["block"]), []).append(r)
    taken = Counter()
    for r in plan.schedule.collect():
        for p in pieces.get((r["source_no"], r["block"]), []):
            taken[p["rid"]] += p["taken"]
    assert sorted(taken.values()) == sorted(r["taken"] for r in got if r["taken"])
