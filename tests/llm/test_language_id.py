import zlib

import numpy as np

from strandline.llm import language_id as lid


def test_gradients():
    r = np.random.default_rng(0)
    draw = lambda *s: r.normal(0, 0.3, s)
    model = lid.Model(["a", "b"], [draw(256, 9), draw(256, 9)], [draw(3, 9), draw(3, 9)], draw(6, 2), np.zeros(2))
    codes, length, label = r.integers(0, 256, (7, 5)).astype(np.uint8), np.array([6, 5, 7, 3, 1]), np.array([0, 1, 0, 1, 1])
    _, grad = lid._gradients(model, codes, length, label)
    for i, w in enumerate(model.weights):
        at = (int(codes[2, 1]), 4) if i < 2 else tuple(int(r.integers(0, s)) for s in w.shape)
        old, losses = w[at], []
        for step in (1e-2, -1e-2):
            w[at] = old + step
            losses.append(lid._gradients(model, codes, length, label)[0])
        w[at] = old
        assert abs((losses[0] - losses[1]) / 2e-2 - grad[i][at]) < 1e-5


def test_windows_label_every_byte_in_its_context(monkeypatch):
    """Pooled windows equal one pass over the whole text but for what lies beyond the halo, which fades."""
    r = np.random.default_rng(1)
    draw = lambda *s: r.normal(0, 0.3, s).astype(np.float32)
    model = lid.Model(["a", "b", "c"], [draw(256, 12), draw(256, 12)], [draw(4, 12), draw(4, 12)], draw(8, 3), draw(3))
    texts = [r.integers(0, 256, n).astype(np.uint8) for n in (1, 5, 191, 192, 193, 224, 225, 1000, 3000)]
    data, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    begins = ends - [len(t) for t in texts]
    want = np.array([lid.position_probabilities(model, t[:, None], np.array([len(t)])).mean(axis=0)[:, 0] for t in texts])
    got = lid.Reader(model).texts(data, begins, ends)
    assert np.abs(got[:4] - want[:4]).max() < 1e-6 and np.abs(got - want).max() < 1e-3
    monkeypatch.setattr(lid, "BATCH", 3)
    assert np.abs(lid.Reader(model).texts(data, begins, ends) - got).max() < 1e-6
    alone = np.concatenate([lid.Reader(model).texts(t, np.array([0]), np.array([len(t)])) for t in texts])
    assert np.abs(alone - got).max() < 1e-6
    # the state runs across words: what stands before a word changes its labels
    two = [np.frombuffer(x, np.uint8) for x in (b"abcd efgh", b"zzzz efgh")]
    p = [lid.position_probabilities(model, t[:, None], np.array([9]))[5:] for t in two]
    assert np.abs(p[0] - p[1]).max() > 1e-3


def test_held_out_accuracy(documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    got = lid.digest(documents).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"]: r["held_out"] for r in got} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in truth}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edges(spark, make, prose, documents):
    model = lid.fit(documents)
    texts = [*prose, "123 !?", "中文", "a" * 5000]
    docs = make(texts)
    got = {r["doc_id"]: r for r in lid.label(docs, model).collect()}
    for i, text in enumerate(texts):
        assert (got[i]["lang_pred"] == "und") == (not any(map(str.isalpha, text or "")))
    assert got[3]["score"] == got[60]["score"] and got[0]["key"] == "k"
    clash = spark.createDataFrame([(1, "words here", "x", 2.0)], "doc_id long, text string, LANG_PRED string, score double")
    assert lid.label(clash, model).columns == ["doc_id", "text", "lang_pred", "score"] and lid.label(clash, model).first()["score"] <= 1
    nothing = spark.createDataFrame([(1, "words here", None), (None, "more words", "en")], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"], r["held_out"]) for r in lid.digest(nothing).collect()] == [("und", 0.0, False)] * 2
    assert lid.digest(nothing.limit(0)).collect() == []


def test_training_rows_are_bounded(documents):
    counts = lid.sample(documents, per_lang=5, sample_chars=80).groupBy("lang").count().collect()
    assert all(r["count"] <= 5 for r in counts) and len(counts) > 1
