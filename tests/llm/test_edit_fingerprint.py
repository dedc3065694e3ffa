import hashlib

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import edit_fingerprint as ef


def walk(text):
    level = ef.level_of(len(text))
    if not text:
        return "0:"
    moves, codes = ef._codes(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    bits, levels = ef._step_moves(0, 3 * len(text)), ef._step_levels(0, 3 * len(text))
    at, out = 0, ""
    for step in range(3 * len(text)):
        if at >= len(text):
            break
        if levels[step] >= level:
            out += "0123456789abcdef"[codes[at]]
        at += int(bits[step][moves[at]])
    return f"{level}:{out}"


def test_walks(prose, monkeypatch):
    texts = [t or "" for t in prose] + ["a\0b" * 40]
    want = [walk(t) for t in texts]
    assert ef.fingerprints(texts) == want
    monkeypatch.setattr(ef, "_FEW", 2)
    assert ef.fingerprints(texts) == want


def test_query(make, prose):
    ids = [7 * i % 101 for i in range(len(prose))]
    rows = sorted(zip(ids, [t or "" for t in prose]))
    got = {r["doc_id"]: r for r in ef.digest(make(prose, ids, 5)).collect()}
    assert len(got) == len(prose)
    for k, (i, text) in enumerate(rows):
        edited = ef.edit(text, rows[(k + 1) % len(rows)][1])
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == walk(text) and r["edited_fingerprint"] == walk(edited)
        assert r["near_next"] == ef.likeness(walk(text), walk(rows[(k + 1) % len(rows)][1]))


def test_edges(make):
    assert ef.digest(make([]).limit(0)).collect() == []
    one = ef.digest(make(["abcdefgh"])).first()
    assert one["near_next"] == 1.0 and one["edited_fingerprint"] == walk("abcdefab")
    rows = ef.digest(make(["abcd", "abcd", None, "zz"], [None, 3, 3, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in rows) == [("3", 0), ("3", 4), ("None", 2), ("None", 4)]


def test_likeness_follows_edits(documents):
    texts = [r.text for r in documents.collect() if r.text and len(r.text) > 400]
    marks = ef.fingerprints(texts)
    small = ef.fingerprints([t[:200] + "#" + t[201:] for t in texts])
    shifted = ef.fingerprints(["!" + t for t in texts])
    assert np.median([ef.likeness(a, b) for a, b in zip(marks, small)]) > 0.9
    assert np.median([ef.likeness(a, b) for a, b in zip(marks, shifted)]) > 0.7
    assert np.median([ef.likeness(a, b) for a, b in zip(marks, marks[1:])]) < 0.3


def test_banding_finds_near_copies(make):
    base = [f"{chr(97 + i % 26)}{i * i}" for i in range(300)]
    texts = [" ".join(base[k:] + base[:k]) for k in range(0, 300, 30)]
    near = [t[:100] + "?" + t[102:] for t in texts]
    links = ef.near_links(ef.fingerprint(make(texts + near + [None, ""]))).collect()
    pairs = {frozenset((r["a"], r["b"])) for r in links}
    assert sum(frozenset((walk(a), walk(b))) in pairs for a, b in zip(texts, near)) >= 7


def reaching(mark, others, links):
    """All fingerprints that links connect with ``mark``."""
    seen, left = {mark}, [mark]
    while left:
        x = left.pop()
        for a, b in links:
            y = b if a == x else a if b == x else None
            if y is not None and y not in seen:
                seen.add(y)
                left.append(y)
    return seen


def test_bands_cover_the_whole_sample():
    r = np.random.default_rng(5)
    for n in (24, 60, 300, 500):
        for where in (slice(0, None), slice(None, None, -1)):  # all differences at the start, or all at the end
            met = 0
            for _ in range(100):
                digits = r.integers(0, 16, n)
                other = digits.copy()
                at = np.arange(n)[where][: n // 5]
                other[at] = (digits[at] + 1 + r.integers(0, 15, len(at))) % 16
                a, b = ("0:" + "".join("0123456789abcdef"[d] for d in row) for row in (digits, other))
                assert ef.likeness(a, b) >= 0.8
                met += bool(set(ef.band_keys(a).tolist()) & set(ef.band_keys(b).tolist()))
            assert met >= 93


def test_crowded_bands_are_compared_beyond_their_first(spark, monkeypatch):
    r = np.random.default_rng(6)
    text = lambda row: "0:" + "".join("0123456789abcdef"[d] for d in row)
    monkeypatch.setattr(ef, "CROWDED", 4)
    monkeypatch.setattr(ef, "BLOCK", 8)
    stem = r.integers(0, 16, 170)  # hot boilerplate: half of every text
    pairs = []
    for _ in range(40):
        a = np.concatenate([stem, r.integers(0, 16, 170)])
        b = a.copy()
        b[r.integers(0, 340, 20)] ^= 1
        pairs.append((text(a), text(b)))
    marks = [m for p in pairs for m in p]
    found = [(x["a"], x["b"]) for x in ef.near_links(spark.createDataFrame([(m,) for m in marks], "fingerprint string")).collect()]
    want = {frozenset((x, y)) for i, x in enumerate(marks) for y in marks[:i] if ef.likeness(x, y) >= 0.8}
    assert want and all(y in reaching(x, marks, found) for x, y in map(tuple, want))
    assert np.allclose(ef._likenesses(marks[:9], ["1:" + m[2::2] for m in marks[:9]] + marks[9:20]), [[ef.likeness(x, y) for y in ["1:" + m[2::2] for m in marks[:9]] + marks[9:20]] for x in marks[:9]])


@pytest.mark.parametrize("n", [2, 3, 4, 20, 32, 33, 500])
def test_bands_of_any_size_make_no_more_rows_than_members(n):
    bands = pa.RecordBatch.from_arrays([pa.array(np.repeat([5, 9], n)), pa.array(np.arange(2 * n))], names=["band", "id"])
    rows = [r for b in ef._meetings(iter([bands])) for r in b.to_pylist()]
    assert len(rows) <= 2 * n
    for band, first in ((5, 0), (9, n)):  # and every member meets the first one
        assert {r["b"] for r in rows if r["band"] == band and r["a"] == first} == set(range(first + 1, first + n))


def test_near_classes_of_the_query(make):
    r = np.random.default_rng(8)
    words = lambda n: " ".join("".join(map(chr, r.integers(97, 123, 5))) for _ in range(n))
    base = [words(80) for _ in range(12)]
    texts = base + [t[:200] + "#" + t[201:] for t in base] + [base[0], "", None]
    got = {x["doc_id"]: (x["near_class"], x["near_rows"]) for x in ef.digest(make(texts)).collect()}
    assert got[0] == got[12] == got[24] == (0, 3) and got[25] == got[26] == (25, 2)
    assert sum(got[i] == got[12 + i] == (i, 2) for i in range(1, 12)) >= 10


def test_walks_do_not_depend_on_the_batch(monkeypatch):
    r = np.random.default_rng(3)
    texts = [chr(c) for c in range(33, 900)] + ["".join(map(chr, r.integers(97, 123, n))) for n in range(2, 80) for _ in range(4)]
    want = [walk(t) for t in texts]
    assert ef.fingerprints(texts) == want and [ef.fingerprints([t])[0] for t in texts] == want
    monkeypatch.setattr(ef, "_FEW", 0)
    assert ef.fingerprints(texts) == want


def test_levels_of_long_samples():
    for level in (0, 3, 14, 15):
        assert len(ef._sample_levels(level, 768)) == 768 and (ef._sample_levels(level, 768) >= level).all()
    assert (ef._sample_levels(3, 1024)[:512] == ef._sample_levels(3, 512)).all()


def test_text_of_ten_million_characters():
    text = np.random.default_rng(4).integers(97, 123, 10_000_000).astype(np.uint8).tobytes().decode()
    mark = ef.fingerprints([text])[0]
    own = int(mark.split(":")[0])
    assert own == ef.level_of(len(text)) == 16 and 200 < len(mark) < 400
    higher = ef.at_level(mark, own + 1)
    # the walk of the same text, sampled at the next level
    moves, codes = ef._codes(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    moves, codes = np.append(moves, np.uint8(63)), np.append(codes, np.uint8(ef._END))
    sampled = ef._alone(moves, codes, 0, len(text), own + 1, 0, 3 * len(text))
    assert higher.tobytes().decode() == "".join("0123456789abcdef"[c] for c in sampled)


def test_order_with_hot_and_null_ids(make):
    """A third of the rows has no id and another third one id; every row meets the row behind it, and no part holds them all."""
    r = np.random.default_rng(2)
    texts = [" ".join(map(str, r.integers(0, 50, 12))) for _ in range(90)] + ["same text"] * 9
    ids = [None] * 30 + [7] * 30 + list(range(100, 130)) + [None] * 3 + [7] * 3 + [500] * 3
    placed = ef.next_to_each_other(make(texts, ids, 5)).collect()
    parts = {}
    for x in placed:
        parts.setdefault(x["part"], []).append(x)
    assert sum(not x["guard"] for x in placed) == len(texts) and sum(x["guard"] for x in placed) == len(parts)
    assert max(len(p) for p in parts.values()) < 30
    order = sorted(parts)
    rows = [x for p in order for x in parts[p] if not x["guard"]]
    named = [(x["doc_id"] is None, x["doc_id"] or 0) for x in rows]
    assert named == sorted(named) and sorted(x["text"] for x in rows) == sorted(texts)
    for p, q in zip(order, order[1:] + order[:1]):
        guard = [x for x in parts[p] if x["guard"]]
        assert len(guard) == 1 and guard[0]["text"] == [x for x in parts[q] if not x["guard"]][0]["text"]
    got = ef.digest(make(texts, ids, 5)).collect()
    assert len(got) == len(texts)
    want = sorted(hashlib.sha256(ef.edit(a["text"], b["text"]).encode()).hexdigest() for a, b in zip(rows, rows[1:] + rows[:1]))
    assert sorted(x["edited_sha256"] for x in got) == want


def test_recall_of_links_over_a_whole_table(spark):
    """All pairs of fingerprints by brute force: those of likeness 0.8 or more that lie in one class."""
    rows = ef.digest(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    of = {x["fingerprint"]: x["near_class"] for x in rows}
    marks = sorted(m for m in of if len(m) > 2)
    share = np.zeros((len(marks), len(marks)))
    for at in range(0, len(marks), 64):
        share[at : at + 64] = ef._likenesses(marks[at : at + 64], marks)
    pairs = [(marks[i], marks[j]) for i, j in zip(*np.nonzero(np.triu(share >= ef.LEAST, 1)))]
    found = sum(of[a] == of[b] for a, b in pairs)
    assert len(pairs) > 7 and found >= 0.9 * len(pairs)
    for x in rows:
        assert x["near_rows"] == sum(y["near_class"] == x["near_class"] for y in rows)
