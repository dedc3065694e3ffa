"""Substring and suffix-array dedup against a brute-force reading of the same rule."""

import hashlib

import pytest

from strandline.llm import substring_dedup, suffix_dedup


def brute(rows, width):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        words = (text or "").encode().split()
        covered = bytearray(len(words))
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                covered[i : i + width] = b"\1" * width
            seen.add(window)
        kept = b" ".join(w for w, c in zip(words, covered) if not c)
        out[doc_id] = (len(words), sum(covered), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
@pytest.mark.parametrize("width", [20, 50])
def test_whole_table(documents, op, width):
    assert result(op.digest(documents, width)) == brute([(r.doc_id, r.text) for r in documents.collect()], width)


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_edges(make, prose, op):
    ids = [7 * i % 101 for i in range(len(prose) - 1)] + [None]
    assert result(op.digest(make(prose, ids), 20)) == brute(list(zip(ids, prose)), 20)


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_small_blocks_agree(make, prose, op, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_WINDOWS", 50)
    monkeypatch.setattr(suffix_dedup, "BLOCK_CONTEXTS", 5)
    assert result(op.digest(make(prose, parts=7), 20)) == brute(list(enumerate(prose)), 20)


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup])
def test_empty_table_and_repeated_rows(make, op):
    assert op.digest(make([]).limit(0)).collect() == []
    text = " ".join(f"w{i}" for i in range(60))
    rows = op.digest(make([text, text, text], [5, 5, 9])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(5, 0), (5, 0), (9, 60)]


def test_intervals_are_maximal(make):
    text = " ".join(f"w{i}" for i in range(45))
    rows = substring_dedup.removal_intervals(make([text, "a b " + text + " c"])).collect()
    assert [(r["doc_id"], r["begins"], r["ends"]) for r in rows] == [(1, [2], [47])]
