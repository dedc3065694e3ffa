from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import tiktoken

import corpus_pipeline as cp

from strandline.llm import byte_bpe, language_id, mixing, pii
from strandline.llm.queries import pii_key
from tests.llm.test_ngram_join import brute


def test_stages_against_brute_force(spark, documents, tmp_path):
    docs, seen = documents, {"documents": documents}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, None)
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != cp.STAGES[-1][0]:
            assert sorted(docs.columns) == sorted(documents.columns)
    rows = {name: df.collect() for name, df in seen.items()}

    # language ID: what the labels of the whole table say
    labels = {r["doc_id"]: r for r in language_id.digest(documents).collect()}
    kept = {r.doc_id for r in rows["language_id"]}
    assert kept == {i for i, r in labels.items() if r["lang_pred"] != "und" and r["score"] >= cp.MIN_SCORE} and len(kept) > 0.97 * documents.count()
    assert all(r.lang == labels[r.doc_id]["lang_pred"] for r in rows["language_id"])

    # near duplicates: the smallest id of each group of the brute-force links
    groups = brute([(r.doc_id, r.text) for r in rows["language_id"]], 5, 80)
    assert sorted(r.doc_id for r in rows["ngram_join"]) == sorted({least for _, n, least in groups if n} | {i for i, n, _ in groups if not n})

    # pseudonyms: text by text
    before = {r.doc_id: r for r in rows["ngram_join"]}
    assert sorted(r.doc_id for r in rows["pii"]) == sorted(before)
    for r in rows["pii"]:
        text = before[r.doc_id].text
        assert r.text == pii.replace(text, pii_key(spark))[0] and r.n_chars == len(r.text)
    assert any(r.text != before[r.doc_id].text for r in rows["pii"])

    # mixing: each copy has half its words or more in blocks of the schedule; rows of a file come in the order of their slots
    plan = mixing.mix(spark.read.parquet(str(tmp_path / "pii")))
    pieces = {}
    for p in plan.pieces.collect():
        pieces.setdefault((p["source_no"], p["block"]), []).append(p)
    taken, first = Counter(), {}
    for slot in sorted(plan.schedule.collect(), key=lambda r: r["slot"]):
        for p in pieces.get((slot["source_no"], slot["block"]), []):
            taken[p["rid"], p["epoch"]] += p["taken"]
            first.setdefault((p["rid"], p["epoch"]), slot["slot"])
    ids = {r["rid"]: (r["doc_id"], r["size"]) for r in plan.documents.collect()}
    copies = Counter(ids[rid][0] for (rid, _), n in taken.items() if 2 * n >= ids[rid][1])
    slots = {}
    for (rid, _), slot in first.items():
        slots.setdefault(ids[rid][0], []).append(slot)
    for part in (tmp_path / "source_mixing").glob("part-*.parquet"):
        before = -1
        for i in pq.read_table(part)["doc_id"].to_pylist():
            before = min(s for s in slots[i] if s > before)
    assert Counter(r.doc_id for r in rows["source_mixing"]) == copies and max(copies.values()) == 2

    # token ids: as the library has them
    texts = {r.doc_id: r.text for r in rows["pii"]}
    ranks = byte_bpe.load_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read())
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter(r.doc_id for r in rows["byte_bpe"]) == copies
    for r in rows["byte_bpe"]:
        want = oracle.encode_ordinary(texts[r.doc_id])
        assert np.frombuffer(r.ids, "<u4").tolist() == want and r.n_tokens == len(want) and r.round_trip


def test_edges(spark, make, prose, documents):
    texts = [*prose, "12 34", None]
    docs = make(texts, [None if i == 5 else i for i in range(len(texts))]).unionByName(make(texts[:2])).unionByName(documents.limit(50), allowMissingColumns=True)
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, None)
        docs.count()
    empty = documents.limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, None).count() == 0
