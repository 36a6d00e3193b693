import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strideline.llm import katz as K


def brute(rows, train, most):
    """The same model without Spark, hashes or packing; also checks that every history's probabilities add up to 1."""
    texts = [[*[w for w in (t or "").lower().replace("\n", " ").split(" ") if w], None] for _, t in rows]
    learn = [t for t, ok in zip(texts, train, strict=True) if ok]
    uni = Counter(w for t in learn for w in t)
    n, v = sum(uni.values()), len(uni)
    of = Counter(uni.values())
    least, kept = 100_000, 0
    for c in sorted(of, reverse=True):
        if c < 2 or kept + of[c] > most:
            break
        least, kept = c, kept + of[c]
    vocab = {w for w, c in uni.items() if c >= least} | {None}

    def d(factors, c):
        return c * (factors[c] if c <= K.DISCOUNTED else 1)

    f1 = K.discounts(of)
    mass = sum(d(f1, c) for c in uni.values())
    unseen = 1 - mass / n if mass < n else 1 / (n + 1)
    scale = (1 - unseen) / (mass / n)
    p1 = {w: d(f1, c) * scale / n for w, c in uni.items()}
    unk = 1 - sum(p1.get(w, 0) for w in vocab)
    cls = lambda w: w if w in vocab else 0
    p = {w: p1.get(w, 0) for w in vocab} | {0: unk}
    bi, hist = Counter(), Counter()
    for t in learn:
        for h, w in zip(["<s>", *map(cls, t)], map(cls, t), strict=False):
            bi[h, w] += 1
            hist[h] += 1
    f2 = K.discounts(Counter(bi.values()))

    def model(h):
        seen = {w: d(f2, c) for (g, w), c in bi.items() if g == h}
        if not seen:
            return seen, 1, 1
        den = hist[h] + (sum(seen.values()) >= hist[h] - 1e-9)
        rest = 1 - sum(p[w] for w in seen)
        if rest < 1e-9:
            return seen, sum(seen.values()), 0
        return seen, den, (1 - sum(seen.values()) / den) / rest

    models = {h: model(h) for h in {*hist, *vocab, 0, "<s>"}}
    for seen, den, alpha in models.values():
        assert sum(seen[w] / den if w in seen else alpha * p[w] for w in p) == pytest.approx(1)
    out = []
    for (i, _), t, ok in zip(rows, texts, train, strict=True):
        score = base = 0
        for h, w in zip(["<s>", *map(cls, t)], t, strict=False):
            seen, den, alpha = models[h]
            q = seen[cls(w)] / den if cls(w) in seen else alpha * p[cls(w)]
            score += math.log10(q) + (math.log10(p1.get(w, unseen) / unk) if w not in vocab else 0)
            base += math.log10((uni[w] + 1) / (n + v + 1))
        out.append((i, not ok, len(t), sum(uni[w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize(("most", "bucket"), [(1 << 20, 10**6), (40, 300)])
def test_scores_as_brute_force(spark, monkeypatch, most, bucket):
    monkeypatch.setattr(K, "CHUNK", 4000)
    monkeypatch.setattr(K, "HOT_SHARE", 30)
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"W{int(x)}" for x in np.minimum(rng.zipf(1.5, n), 400))
    rows = [(i, text(int(rng.integers(0, 90)))) for i in range(140)] + [(900, None), (901, ""), (902, "never seen\nbefore é é"), (903, "a a"), (903, "a a")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(3)
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    got = sorted(tuple(r) for r in K.scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, most, bucket).collect())
    want = sorted(brute(rows, train, most))
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-11)
    held = [x for x in got if x[1] and x[2] > 20]
    assert sum(x[6] for x in held) > sum(x[5] for x in held) * 1.05


def test_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    assert K.scores(docs.limit(0), F.lit(True)).count() == 0
    assert sorted(r.n_tokens for r in K.scores(docs, F.lit(True)).collect()) == [1, 3, 3]
    none = K.scores(docs, F.lit(False)).collect()
    assert [r.train_tokens for r in none] == [0, 0, 0] and all(math.isfinite(r.score) for r in none)


def test_packing():
    arrays = [np.array([5, -3, 2**40]), np.zeros(0, np.int32), np.array([1.5, -2.25], np.float32)]
    for a, b in zip(arrays, K._unpack(K._pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and a.tolist() == b.tolist()


def whole_brute(rows, train):
    """As brute, with every word of training in the vocabulary."""
    texts = [[*(t or "").lower().split(), None] for _, t in rows]
    learn = [t for t, ok in zip(texts, train, strict=True) if ok]
    uni, bi = Counter(w for t in learn for w in t), Counter((h, w) for t in learn for h, w in zip(["<s>", *t], t, strict=False))
    n, of, hist = sum(uni.values()), Counter(uni.values()), Counter()
    for (h, _), c in bi.items():
        hist[h] += c
    d = lambda factors, c: c * (factors[c] if c <= K.DISCOUNTED else 1)
    f1, f2 = K.discounts(of), K.discounts(Counter(bi.values()))
    mass = sum(d(f1, c) for c in uni.values())
    unseen = 1 - mass / n if mass < n else 1 / (n + 1)
    p = {w: d(f1, c) * (1 - unseen) / mass for w, c in uni.items()}
    models = {}
    for h, count in hist.items():
        seen = {w: d(f2, c) for (g, w), c in bi.items() if g == h}
        den, rest = count + (sum(seen.values()) >= count - 1e-9), 1 - sum(p[w] for w in seen)
        models[h] = seen, den, (1 - sum(seen.values()) / den) / rest
        assert sum(x / den for x in seen.values()) + models[h][2] * (sum(p[w] for w in p if w not in seen) + unseen) == pytest.approx(1)
    out = []
    for (i, _), t, ok in zip(rows, texts, train, strict=True):
        score = 0
        for h, w in zip(["<s>", *t], t, strict=False):
            seen, den, alpha = models.get(h, ({}, 1, 1))
            score += math.log10(seen[w] / den if w in seen else alpha * p.get(w, unseen))
        base = sum(math.log10((uni[w] + 1) / (n + len(uni) + 1)) for w in t)
        out.append((i, not ok, len(t), sum(uni[w] > 0 for w in t), n, base, score))
    return out


@pytest.mark.parametrize(("table", "bucket"), [(1 << 20, 300), (40, 300), (1 << 20, 60)])
def test_every_word_of_training_has_its_own_pairs(spark, monkeypatch, table, bucket):
    monkeypatch.setattr(K, "CHUNK", 4000)
    monkeypatch.setattr(K, "HOT_SHARE", 30)
    monkeypatch.setattr(K, "VOCABULARY", table)
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"W{int(x)}" for x in np.minimum(rng.zipf(1.5, n), 400))
    rows = [(i, text(int(rng.integers(0, 90)))) for i in range(140)] + [(900, None), (901, ""), (902, "never seen before é é"), (903, "once met only"), (903, "rare met rare"), (904, "once met only rare met")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    got = sorted(tuple(r) for r in K.scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, bucket_tokens=bucket).collect())
    want = sorted(whole_brute(rows, train))
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-11)
