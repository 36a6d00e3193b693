import re

import numpy as np
import pytest

from strideline.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc, items, window):
    w, hit, ids = split(doc), set(), set()
    for item_id, text in items:
        v = split(text)
        m = min(window, len(v))
        for j in range(len(v) - m + 1 if v else 0):
            for p in range(len(w) - m + 1):
                if w[p : p + m] == v[j : j + m]:
                    hit |= set(range(p, p + m))
                    ids.add(item_id)
    return len(w), len(hit), sorted(str(x) for x in ids if x is not None)


@pytest.mark.parametrize("block_words", [10**6, 3])
def test_as_brute_force(spark, monkeypatch, block_words):
    monkeypatch.setattr(D, "BLOCK_WORDS", block_words)
    rng = np.random.default_rng(3)
    some = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 4, n))
    items = [(1, some(12)), (2, some(3)), (None, some(4)), (10, some(30)), (4, None), (5, " -"), (7, "É2 x"), (2, some(9))]
    items += [(11, items[0][1]), (None, items[1][1]), (12, items[3][1].upper()), (13, "w1"), (14, "w1"), (14, "W1")]
    docs = [(i, some(int(rng.integers(0, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "a É2 X É2"), (92, "a É2 X É2"), (None, items[3][1] * 3)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, matches string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(frame, bench, 5).collect()
    want = sorted(((i or 0), *brute(t, items, 5)) for i, t in docs)
    assert sorted(((r.doc_id or 0), r.n_words, r.n_hit, r.item_ids) for r in got) == want
    for r in got:
        for m in r.matches:
            texts = [split(t) for i, t in items if (None if i is None else str(i)) == m.item_id]
            assert any(t[m.item_word : m.item_word + m.n_words] == split(r.text)[m.doc_word : m.doc_word + m.n_words] for t in texts)
    kept = D.decontaminated(frame, bench, 5)
    assert kept.columns == frame.columns and kept.count() == sum(x[2] == 0 for x in want)


def test_equal_items_are_searched_once(spark):
    """Hundreds of equal one-word items and a text full of the word: one match, all ids."""
    bench = spark.createDataFrame([(i, "word") for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "word " * 50_000), (2, "other " * 50_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in D.contamination(docs, bench).collect()}
    assert got[1].n_hit == 50_000 and len(got[1].item_ids) == 300 and len(got[1].matches) == 50_000 and got[2].n_hit == 0


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.contamination(docs, bench.limit(0)).first().n_hit == 0
    assert D.contamination(docs.limit(0), bench).count() == 0


def test_suffixes_are_sorted_and_longest_matches_found():
    rng = np.random.default_rng(9)
    ranks = rng.integers(0, 3, 400)
    order = D.suffix_array(ranks, 8)
    keys = [tuple(ranks[i : i + 8][: (list(ranks[i : i + 8]) + [0]).index(0)]) for i in order]
    assert keys == sorted(keys) and len(order) == (ranks > 0).sum()
