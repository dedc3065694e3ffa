import hashlib
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest

from strandline.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def spell():
    """text -> (A ids, A bytes, B ids, B bytes) by the libraries that own the files."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    chars = {c: x for x, c in ta.byte_chars().items()}

    def run(text):
        ids, pieces = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return ids, [bytes(chars[c] for c in a.id_to_token(i)) for i in ids], pieces, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]

    return run


def brute(texts, spell):
    docs, links = [], Counter()
    for text in texts:
        a, ab, b, bb = spell(text) if text else ([], [], [], [])
        if not text or not b"".join(ab) == b"".join(bb) == (" " + text).encode():
            docs.append(None)
            continue
        ae, be = (list(accumulate(map(len, side))) for side in (ab, bb))
        b_at = {e: j for j, e in enumerate(be)}
        pairs, groups, i0, j0 = [], [], 0, 0
        for i, e in enumerate(ae):
            if e in b_at:
                j = b_at[e]
                pairs.append((a[i], b[j]))
                groups.append(",".join(map(str, a[i0 : i + 1])) + "|" + ",".join(map(str, b[j0 : j + 1])))
                i0, j0 = i + 1, j + 1
        links.update(pairs)
        overlaps = len({*ae} | {*be})
        docs.append((len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest(), overlaps))
    top = Counter()
    for (_, y), n in links.items():
        top[y] = max(top[y], n)
    return [
        (0, 0, 0, 0, 0, 0, "", 0) if d is None else (d[0], d[1], d[2], d[2], sum(links[p] == top[p[1]] for p in d[3]), sum(links[p] for p in d[3]), d[4], d[5])
        for d in docs
    ]


TEXTS = [
    None, "", " ", "a", "hello world", "hello world", "  two  spaces \n\n lines\t\t", "naïve café — 你好 мир 🙂🙂", "<|endoftext|> <s> </s> <unk> <0x41>", "under▁score", "x" * 3000, " " * 2500 + "y", "\n" * 1500,
    "don't I'll we've 123456 3.14 ///// $$$", "é" * 700, "\u0000nul\u0001", "é ﬁ ①", "a b " * 800, "٣٤٥ ขอบคุณ 한국어", "﻿bom", "end ",
]


def rows(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("heavy, stretch", [(1_000_000, 1 << 20), (25, 40), (0, 7)])
def test_equals_brute_force(spark, make, spell, monkeypatch, heavy, stretch):
    for name, value in (("HEAVY_PAIRS", heavy), ("STRETCH", stretch), ("SLICE", 64)):
        monkeypatch.setattr(ta, name, value)
    monkeypatch.setattr(ta, "SUM_PAIRS", 50)
    got = rows(ta.digest(make(TEXTS), A, B))
    assert [got[i] for i in range(len(TEXTS))] == brute(TEXTS, spell)


def test_equals_brute_force_on_documents(spark, documents, spell):
    ids, texts = zip(*[(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()])
    got, want = rows(ta.digest(documents, A, B)), brute(texts, spell)
    assert got == dict(zip(ids, want)) and sum(w[0] > 0 for w in want) > 100


def test_stretches_join_to_the_text():
    text = " a  b " * 9 + "c" * 50
    for size in (1, 3, 20):
        parts = ta.stretches(text, size)
        assert "".join(parts) == text and all(p.startswith(" ") for p in parts[1:])


def test_groups(spark, make):
    got = {r["doc_id"]: r["groups"] for r in ta.encoded(make(["hello world", None, "naïve"]), A, B, detail=True).collect()}
    assert got[1] == [] and [g["end"] for g in got[0]][-1] == len(" hello world") and [g["end"] for g in got[2]][-1] == len(" naïve".encode())
    assert all(g["a"] and g["b"] for g in got[0] + got[2])


def test_both_libraries_agree(spell):
    """A's fast library against the one that owns the file, around every code point below U+3000 and some beyond."""
    tok = ta.Tokenizers(A, B)
    points = [c for c in [*range(0x3000), *range(0xFE00, 0xFF70), *range(0x1F300, 0x1F700)]]
    texts = [f" a{x}b 1{x}2 {x}{x} .{x}. {x}\n{x}'s{x}\n\n {x}  {x}" for x in map(chr, points)]
    slow = [e.ids for e in tok._slow.encode_batch(texts, add_special_tokens=False)]
    assert tok.encode_a(texts) == slow


def test_empty(spark):
    assert ta.digest(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []
    got = ta.digest(spark.createDataFrame([(None, "same text"), (1, "same text"), (1, None)], "doc_id long, text string"), A, B).collect()
    assert sorted(r["n_a"] for r in got) == [0, 2, 2] and {r["count_sum"] for r in got if r["n_a"]} == {4}
