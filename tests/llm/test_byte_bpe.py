import hashlib
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import byte_bpe
from strandline.llm.tokens import utf8

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.load_ranks(open(PATH, "rb").read())
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CHARS = st.sampled_from(list("  \n\t\r''strevmdlaLE09.,!-éñ 　ß٣中’\x1c\x85​😀") + ["'s", "'re", "'ll", " '", "<|endoftext|>"])


def ids(texts):
    pieces, first = byte_bpe.split_rows(*utf8(pa.array(texts)))
    memo = byte_bpe._Pieces(RANKS)
    return [np.frombuffer(b"".join(memo[p] for p in pieces[a:b]), "<u4").tolist() for a, b in zip(first[:-1], first[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(CHARS, max_size=40).map("".join), min_size=1, max_size=8))
def test_like_tiktoken(texts):
    assert ids(texts) == [ORACLE.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("text", ["a" * 700, "'ll" * 300, " " * 900, "x" * 3000 + " 's", "ab" * 500])
def test_long_pieces(text):
    assert ids([text]) == [ORACLE.encode_ordinary(text)]


def test_query_and_offsets(make, prose, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 20)
    df = make(prose)
    got = {r["doc_id"]: tuple(r)[1:] for r in byte_bpe.digest(df, PATH).collect()}
    for i, text in enumerate(prose):
        want = ORACLE.encode_ordinary(text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert got[i] == (len(want), sha(struct.pack(f"<{len(want)}I", *want)), sha((text or "").encode()))
    row = byte_bpe.encode(df.filter("doc_id = 67"), PATH).first()
    ends = np.frombuffer(row["ends"], "<u4").tolist()
    tokens = [ORACLE.decode_single_token_bytes(t) for t in np.frombuffer(row["ids"], "<u4").tolist()]
    raw = prose[67].encode()
    assert [raw[a:b] for a, b in zip([0, *ends], ends)] == tokens
    assert byte_bpe.digest(df.limit(0), PATH).collect() == []
