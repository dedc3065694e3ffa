import random
import string
from collections import Counter, defaultdict

import pytest

from strandline.llm import ngram_join

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, width, percent):
    sets = []
    for doc_id, text in rows:
        w = (text or "").translate(LOWER).encode().split()
        sets.append((doc_id, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for j, common in Counter(j for t in s for j in holders[t]).items():
            if 100 * common >= percent * (len(s) + len(sets[j][1]) - common):
                parent[find(i)] = find(j)
        for t in s:
            holders[t].append(i)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id, len(s), least[find(i)]) for i, (doc_id, s) in enumerate(sets))


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (2, 30)])
def test_whole_table(documents, width, percent):
    assert sorted(map(tuple, ngram_join.groups(documents, width, percent).collect())) == brute([(r.doc_id, r.text) for r in documents.collect()], width, percent)


@pytest.mark.parametrize("crowded, partners", [(2, 20), (10, 256), (1000, 16)])
def test_hot_group_with_links_on_the_edge(make, monkeypatch, crowded, partners):
    """Near copies of which some pairs link and some just don't, in lists that nearly all of them share."""
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    monkeypatch.setattr(ngram_join, "CROWDED", crowded)
    monkeypatch.setattr(ngram_join, "PARTNERS", partners)
    r = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(200):
        words = list(base)
        for _ in range(r.randrange(6)):
            words[r.randrange(60)] = f"z{r.randrange(40)}"
        texts.append(" ".join(words))
    texts += [None, "", " ", "A b", "a B", "a", texts[0], texts[0].upper()]
    got = sorted(map(tuple, ngram_join.groups(make(texts, parts=5), 4, 85).collect()))
    assert got == brute(list(enumerate(texts)), 4, 85)


def test_edges(make, prose):
    assert sorted(map(tuple, ngram_join.digest(make(prose)).collect())) == brute(list(enumerate(prose)), 4, 85)
    assert ngram_join.digest(make([]).limit(0)).collect() == []
    rows = ngram_join.digest(make(["a b c d e"] * 3 + [None], [None, None, 4, None])).collect()
    assert sorted(map(str, rows)) == sorted(["Row(doc_id=4, n_shingles=2, component_id=4)"] + ["Row(doc_id=None, n_shingles=2, component_id=4)"] * 2 + ["Row(doc_id=None, n_shingles=0, component_id=None)"])


def test_crowded_lists_of_many_set_sizes(make, monkeypatch):
    """Texts of one common stem and of many lengths: links run between neighbouring size bands."""
    monkeypatch.setattr(ngram_join, "PIVOTS", 1)
    monkeypatch.setattr(ngram_join, "CROWDED", 2)
    monkeypatch.setattr(ngram_join, "PARTNERS", 8)
    r = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for n in [*range(20, 300, 3)] * 2:
        words = base[:n]
        for _ in range(r.randrange(4)):
            words[r.randrange(n)] = f"z{r.randrange(20)}"
        texts.append(" ".join(words))
    for percent in (85,):
        assert sorted(map(tuple, ngram_join.groups(make(texts, parts=3), 4, percent).collect())) == brute(list(enumerate(texts)), 4, percent)


@pytest.mark.parametrize("bound", [0, 1000])
def test_one_row_of_each_group_stays(make, monkeypatch, bound):
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", bound)
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    texts = [a, a + " x", b, a, b + " y", b, None, "", "one", "one", a + " z"]
    ids = [5, 9, 5, None, None, None, 3, 3, 8, 8, 5]
    left = ngram_join.one_of_each(make(texts, ids)).collect()
    got = sorted(((r["doc_id"], r["text"]) for r in left), key=str)
    assert len(got) == 5 and [t for i, t in got if i == 3].count(None) == 1 and (8, "one") in got and (5, b) in got
    assert sum(t in (a, a + " z") and i == 5 for i, t in got) == 1 and left[0]["key"] == "k" and left[0].__fields__[0] == "doc_id"
    assert ngram_join.one_of_each(make([]).limit(0)).collect() == []


@pytest.mark.parametrize("width, percent", [(4, 85), (2, 80)])
def test_only_classes_with_likely_partners_send_all_their_shingles(make, monkeypatch, width, percent):
    """Near copies, and texts that have a passage in common: their prefixes go through a shuffle, the sets of near copies only."""
    r = random.Random(21)
    passage = [f"p{i}" for i in range(20)]
    near = [[f"n{k}-{i}" for i in range(100)] for k in range(10)]
    for base in list(near):
        for _ in range(3):
            words = list(base)
            for _ in range(r.randrange(9)):
                words[r.randrange(100)] = f"z{r.randrange(40)}"
            near.append(words)
    alone = [[f"a{k}-{i}" for i in range(60)] + passage + [f"b{k}-{i}" for i in range(60)] for k in range(60)]
    texts = [" ".join(words) for words in near + alone]
    sent = []
    whole = ngram_join.keep

    def keep(df, label):
        out = whole(df, label)
        sent.extend([out.count()] if label == "ngram-likely" else [])
        return out

    monkeypatch.setattr(ngram_join, "keep", keep)
    got = sorted(map(tuple, ngram_join.groups(make(texts), width, percent).collect()))
    assert got == brute(list(enumerate(texts)), width, percent) and len({x[2] for x in got}) < len(texts)
    assert len(sent) == 1 and sent[0] <= len(near)
