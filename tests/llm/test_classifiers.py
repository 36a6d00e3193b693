import numpy as np
import pyarrow as pa
import pytest

from strideline.llm import language as L
from strideline.llm import quality as Q

WORDS = {"en": "the and that with ing tion er ly th wh".split(), "de": "der und sch keit ung ein ich pf zu über".split(), "fr": "le des eau tion é ê ai oi que elle".split()}


def passage(rng, lang, n):
    return " ".join("".join(rng.choice(WORDS[lang], int(rng.integers(1, 4)))) for _ in range(n))


def test_gradients_as_differences():
    rng, net = np.random.default_rng(1), L.Network.fresh(["a", "b", "c"])
    for name in ("embed", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.filters, net.bias = [f.astype(np.float64) for f in net.filters], [b.astype(np.float64) for b in net.bias]
    windows, labels = rng.integers(0, 256, (4, 40)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss = lambda: -net.log_probabilities(windows)[np.arange(4), labels].mean()
    for w, g in zip(net.weights(), net.gradients(windows, labels), strict=True):
        for i in rng.choice(w.size, min(w.size, 12), replace=False):
            at, h = np.unravel_index(i, w.shape), 1e-6
            old = w[at]
            w[at] = old + h
            up = loss()
            w[at] = old - h
            down = loss()
            w[at] = old
            assert (up - down) / (2 * h) == pytest.approx(g[at], abs=1e-5)


def test_windows_cover_every_byte_once():
    data = np.arange(1, 21, dtype=np.uint8)
    windows, row, own = L.cut(data, np.array([0, 0, 7, 7, 20]), 5)
    assert row.tolist() == [1, 1, 3, 3, 3] and own.tolist() == [5, 2, 5, 5, 3]
    assert np.concatenate([w[:n] for w, n in zip(windows, own, strict=True)]).tolist() == data.tolist()


def test_language_held_out_and_odd_texts(spark):
    rng = np.random.default_rng(2)
    rows = [(i, passage(rng, lang := list(WORDS)[i % 3], int(rng.integers(20, 200))), lang) for i in range(240)]
    docs = spark.createDataFrame([(i, t, x if i % 2 else None, "y") for i, t, x in rows], "doc_id long, text string, lang string, score string")
    net = L.learn(docs)
    got = {r.doc_id: r for r in L.predicted(docs, net).collect()}
    assert np.mean([got[i].lang_pred == x for i, _, x in rows if i % 2 == 0]) > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "the " * 60000), (4, "the " * 60000)], "doc_id long, text string")
    assert [r.lang_pred for r in L.predicted(odd, net).orderBy("doc_id").collect()] == ["und", "und", "und", "en", "en"]
    none = L.predicted(odd, L.learn(docs.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_quality_held_out_and_odd_texts(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        good, lang = i % 3 > 0, list(WORDS)[i % 2]
        words = passage(rng, lang, int(rng.integers(30, 120))).split()
        rows.append((i, " ".join(words) if good else " ".join(w + "###" if i % 2 else w.upper() for w in words), int(good)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y if i % 7 else None) for i, _, y in rows if i < 300], "doc_id long, quality int")
    model = Q.learn(docs, labels)
    got = {r.doc_id: r for r in Q.scored(docs, model).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows if i >= 300]) > 0.95
    odd = spark.createDataFrame([(None, None, "a"), (2, "", "b"), (2, "", "b")], "doc_id long, text string, score string")
    assert all(0 <= r.score <= 1 for r in Q.scored(odd, model).collect())
    assert Q.scored(odd, Q.learn(docs.limit(0), labels)).count() == 3
    assert Q.scored(docs.limit(0), Q.learn(docs, labels.limit(0))).count() == 0


def test_pooling_and_constant_classifier():
    table = np.random.default_rng(4).normal(size=(Q.BUCKETS, Q.DIMENSIONS)).astype(np.float32)
    both, one = Q.pooled(pa.array(["a b c!", None, "x y z"]), table), Q.pooled(pa.array(["x y z"]), table)
    assert np.allclose(both[2], one[0], atol=1e-5) and not both[1].any()
    net = Q.train(np.zeros((3, 2)), np.array([1, 1, 1]))
    assert net.probabilities(np.zeros((1, 2)))[0] == pytest.approx(0.8)


def test_languages_of_few_texts_with_many_copies_are_learnt(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(L, "fit", lambda texts, labels: seen.update(texts=texts, labels=labels))
    docs = spark.range(20_000).selectExpr("concat('text number ', id % 7) AS text", "'xx' AS lang").union(spark.range(50).selectExpr("concat('other ', id)", "'yy'"))
    L.learn(docs)
    assert len(set(seen["texts"])) == 57 and seen["labels"].count("xx") == 7 and seen["labels"].count("yy") == 50
