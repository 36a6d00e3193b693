import hashlib

import numpy as np
import pyarrow as pa
import pytest

from strideline.llm import sketches as S


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_estimates_follow_the_sets():
    rng = np.random.default_rng(1)
    a = [f"w{x}" for x in rng.integers(0, 900, 3000)]
    for share in (0.2, 0.5, 0.9):
        b = a[: int(3000 * share)] + [f"v{x}" for x in rng.integers(0, 900, 3000 - int(3000 * share))]
        x, y = S.sketches(pa.array([" ".join(a), " ".join(b)]))
        p, q = shingles(" ".join(a)), shingles(" ".join(b))
        assert abs(S.resemblance(x, y) - len(p & q) / len(p | q)) < 0.15
        assert abs(S.containment(x, y) - len(p & q) / len(p)) < 0.2
        assert abs(S.distinct(x) / len(p) - 1) < 0.3


def test_small_texts_are_exact_and_parts_merge():
    texts = ["a b c d e f g", "a b c d e f h", "one two", "", None, "x y " * 40]
    got = S.sketches(pa.array(texts))
    for i, s in enumerate(texts):
        assert len(got[i]) == len(shingles(s))
        for j, t in enumerate(texts):
            p, q = shingles(s), shingles(t)
            assert S.resemblance(got[i], got[j]) == pytest.approx(len(p & q) / len(p | q) if p | q else 1)
            assert len(S.merge(got[i], got[j])) == len(p | q)
    assert (S.loaded(S.dumped(got[0])) == got[0]).all()
    long = " ".join(f"w{i % 9000}" for i in range(20000))
    whole = S.sketches(pa.array([long]))[0]
    assert (whole == np.unique(S.sketches(pa.array([long]), 10**6)[0])[:128]).all()


@pytest.mark.parametrize("parts", ["1", "4", "9"])
def test_against_the_next_document(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rng = np.random.default_rng(2)
        rows = [(i * 3, " ".join(f"é{x}" for x in rng.integers(0, 30, int(rng.integers(0, 40))))) for i in range(60)] + [(500, None), (501, "")]
        docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string").repartition(3)
        got = {r.doc_id: r for r in S.against_next(docs).collect()}
        assert len(got) == len(rows)
        order = sorted(rows, key=lambda r: -r[0])
        for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
            t, u = t or "", u or ""
            half = len(t) // 2
            edited = t[: len(t) - half] + u[:half]
            assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            a, b, c = shingles(t), shingles(edited), shingles(u)
            assert got[i].near_edited == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
            assert got[i].near_next == pytest.approx(len(a & c) / len(a | c) if a | c else 1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (7, "b c"), (7, "b c"), (7, "d")], "doc_id long, text string")
    assert S.against_next(docs).count() == 5
    assert S.against_next(docs.limit(0)).count() == 0
    assert S.against_next(docs.where("text = 'd'")).first().near_next == 1
    assert S.fingerprints(docs).count() == 5
