import numpy as np
import pytest
import xxhash

from strideline.llm import simhash
from strideline.llm.simhash import fingerprint, join_keys, links, near_duplicates


def test_keys_meet_within_four_bits_of_any_pattern():
    rng = np.random.default_rng(5)
    for _ in range(1500):
        x = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        y = x
        for i in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            y ^= 1 << int(i)
        a, b = (set(join_keys(np.array([z], np.uint64))[0].tolist()) for z in (x, y))
        assert a & b


def brute(texts):
    out = []
    for text in texts:
        w = (text or "").translate({i: i + 32 for i in range(65, 91)})
        w = [x for x in w.replace("\t", " ").replace("\n", " ").split(" ") if x]
        s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        out.append(sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h)))
    return out


def test_fingerprint():
    texts = ["", "One", "a b\tc", "The CAT sat  on the mat\nthe cat sat on É é", "x " * 9000]
    assert [fingerprint(x.encode()) for x in texts] == brute(texts)


@pytest.mark.parametrize("wide,held", [(8192, 1 << 20), (2, 1 << 20), (2, 3)])
def test_components_as_brute_force(spark, monkeypatch, wide, held):
    monkeypatch.setattr(simhash, "HELD", held)
    rng = np.random.default_rng(7)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 150)) for _ in range(25)]
    texts = [None, "", " \n", "tiny", "tiny"]
    for x in base:
        words = x.split()
        for k in range(int(rng.integers(1, 9))):
            words[int(rng.integers(0, len(words)))] = f"new{k}"
            texts.append(" ".join(words))
        texts += [x, x.upper()]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: (r.fingerprint & (1 << 64) - 1, r.component_id) for r in near_duplicates(docs, wide=wide).collect()}
    prints = brute(texts)
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert got == {i: (prints[i], root(i)) for i in range(len(texts))}
    assert len({c for _, c in got.values()}) < len(texts) - 2 * len(base)


def test_links_are_a_forest_not_all_pairs(spark):
    prints = spark.createDataFrame([(i,) for i in range(256)], "fingerprint long")
    assert 255 <= links(prints.repartition(1)).distinct().count() < 256 * 40


def test_nulls_and_repeats(spark):
    rows = [(5, "a b c d e f", 1), (5, "a b c d e f", 1), (2, "A b c d e f", 2), (None, None, 3), (None, "", 4), (9, "q r s t u v w", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in near_duplicates(docs).collect()) == [(0, 0), (0, 0), (2, 2), (5, 2), (5, 2), (9, 9)]
    assert near_duplicates(docs.limit(0)).count() == 0
