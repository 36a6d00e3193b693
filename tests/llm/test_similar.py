import numpy as np
import pyarrow as pa
import pytest

from strideline.llm import similar as S
from strideline.llm.common import picked, saved


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(rng, groups, edits):
    texts = []
    for g in range(groups):
        words = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(60, 260)))]
        texts.append(" ".join(words))
        for k in range(edits):
            copy = list(words)
            for at in rng.integers(0, len(copy), max(1, int(len(copy) * rng.uniform(0.002, 0.03)))):
                copy[at] = f"new{g}-{k}-{at}"
            texts.append(" ".join(copy))
    return texts


def root_of(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i


def brute(texts, similarity):
    sets, parent, links = [shingles(t) for t in texts], list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= similarity:
                links += sets[i] != sets[j]
                a, b = sorted((root_of(parent, i), root_of(parent, j)))
                parent[b] = a
    return [root_of(parent, i) for i in range(len(texts))], links


def grouped(spark, texts, **options):
    rows = spark.createDataFrame([(i, (i,), t) for i, t in enumerate(texts)], "n long, order struct<id: long>, text string")
    got = {r.n: r.group for r in S.groups(rows, **options).collect()}
    return [got[i] for i in range(len(texts))]


def test_groups_as_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [*corpus(rng, 40, 5), None, "", " \n", "tiny", "TINY", "one two three four", "x " * 5000, "long one " * 30000]
    want, links = brute(texts, 0.8)
    got = grouped(spark, texts)
    # Never together without links, and nearly all that links join is together.
    assert all(want[i] == want[got[i]] and got[i] <= i for i in range(len(texts)))
    assert links > 60 and sum(x == y for x, y in zip(got, want, strict=True)) >= 0.95 * len(texts)
    assert got[-8:-3] == [240, 240, 240, 243, 243]


def test_keys_find_pairs_at_the_threshold():
    """Sets of 400 hashes at a given Jaccard index; the shares are those of the docstring."""
    rng = np.random.default_rng(5)
    for similarity, least in ((0.8, 0.8), (0.85, 0.9), (0.9, 0.95), (0.95, 0.98)):
        sets, n = [], 400
        for _ in range(n):
            common = int(round(2 * 400 * similarity / (1 + similarity)))
            pool = rng.integers(0, 1 << 63, 800 - common, np.uint64)
            sets += [np.sort(pool[:400]), np.sort(np.concatenate([pool[:common], pool[400:]]))]
        low, high, compared = S.wide_prints(sets)
        found, rows = S.join_keys(low, high)
        own = [set() for _ in sets]
        for k, r in zip(found.tolist(), rows.tolist(), strict=True):
            own[r].add(k)
        hit = [bool(own[2 * i] & own[2 * i + 1]) and np.bitwise_count(compared[2 * i] ^ compared[2 * i + 1]) <= S.APART for i in range(n)]
        assert np.mean(hit) >= least


def test_fingerprint_as_brute_force():
    sets = S.shingle_sets(pa.array(["a b c d e f g h", None, "One two", "x " * 200_000 + "y"]))
    low, high, compared = S.wide_prints(sets)
    for s, x, y, z in zip(sets, low.tolist(), high.tolist(), compared.tolist(), strict=True):
        second, third = S.mixed(s ^ S.SECOND), S.mixed(s ^ S.THIRD)
        assert z == sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in third) > len(s))
        assert x == sum(1 << k for k in range(64) if 2 * sum(int(h) >> k & 1 for h in s) > len(s))
        assert y == sum(1 << k for k in range(28) if 2 * sum(int(h) >> k & 1 for h in second) > len(s))
    assert [len(s) for s in sets] == [4, 0, 1, 2]


@pytest.mark.parametrize("wide", [(8192, 1 << 19), (3, 40)])
def test_groups_of_copies_in_wide_keys(spark, monkeypatch, wide):
    """A text with hundreds of light edits: one group, with few candidates kept, whichever way its keys go."""
    monkeypatch.setattr(S, "WIDE", wide[0])
    monkeypatch.setattr(S, "HELD", wide[1])
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*words[:k], f"edit{k}", *words[k + 1 :]]) for k in range(10, 290)]
    keys, nodes = [], []
    low, high, compared = S.wide_prints(S.shingle_sets(pa.array(texts)))
    key, row = S.join_keys(low, high)
    order = np.lexsort((row, key))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[o]), pa.array(row[o]), pa.array(compared[row[o]].view(np.int64))], names=["key", "node", "print"]) for o in np.array_split(order, 50)]
    for out in S._candidates(iter(batches)):
        keys += out.column(0).to_pylist()
        nodes += out.column(1).to_pylist()
    assert len(set(zip(keys, nodes, strict=True))) < 40 * len(texts)
    parent = S.forest(len(texts), np.array(keys), np.array(nodes))
    assert (parent == 0).all()


def star(rng, copies):
    """A text and copies that are just like enough to it and less like each other, though their fingerprints are often nearer."""
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words)]
    for k in range(copies):
        copy = list(words)
        for at in rng.choice(60, 6, replace=False) * 5:
            copy[at] = f"new{k}-{at}"
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("limits", [(8192, 1 << 19, 1 << 20, 32, 1 << 20), (3, 40, 3000, 1 << 30, 0)])
def test_no_candidate_is_lost_behind_nearer_ones_that_fail(spark, monkeypatch, limits):
    """All pairs that share a key, are near by the other bits and like enough are together, in one block or in many."""
    for name, value in zip(("WIDE", "HELD", "BLOCK", "STAR", "FEW"), limits, strict=True):
        monkeypatch.setattr(S, name, value)
    texts = star(np.random.default_rng(7), 150)
    sets = S.shingle_sets(pa.array(texts))
    low, high, compared = S.wide_prints(sets)
    found, rows = S.join_keys(low, high)
    own = [set(found[rows == i].tolist()) for i in range(len(texts))]
    want, links = brute(texts, 0.8)
    met = [(i, j) for i in range(len(texts)) for j in range(i) if own[i] & own[j] and np.bitwise_count(compared[i] ^ compared[j]) <= S.APART]
    real = [(i, j) for i, j in met if jaccard(shingles(texts[i]), shingles(texts[j])) >= 0.8]
    assert links == 150 and len(real) > 100 and len(met) > 20 * len(real)
    got = grouped(spark, texts)
    assert all(got[i] == got[j] for i, j in real) and all(want[i] == want[g] for i, g in enumerate(got))


def test_copies_of_a_large_group_are_few_candidates(spark, monkeypatch):
    """Rows much alike share most of their join keys; a pair of a heap isn't handed on again by each of them."""
    counts = []

    def counted(df, name, *more):
        out = saved(df, name, *more)
        counts.extend([out.count()] if name == "candidates" else [])
        return out

    monkeypatch.setattr(S, "saved", counted)
    texts = star(np.random.default_rng(9), 500)
    got = grouped(spark, texts)
    assert max(counts) < 15 * len(texts)
    assert got == brute(texts, 0.8)[0]


@pytest.mark.parametrize("limits", [(8192, 1 << 19, 32), (3, 1 << 19, 32), (3, 40, 4)])
def test_two_rounds_connect_what_one_does(monkeypatch, limits):
    """Heaps and connected candidates are those of all keys at once, from fewer rows."""
    for name, value in zip(("WIDE", "HELD", "STAR"), limits, strict=True):
        monkeypatch.setattr(S, name, value)
    rng = np.random.default_rng(13)
    texts = [*star(rng, 150), *corpus(rng, 40, 6)]
    low, high, compared = S.wide_prints(S.shingle_sets(pa.array(texts)))

    def found(first, *label):
        key, row = S.join_keys(low, high, first)
        order, out = np.lexsort((row, key)), []
        columns = [key, row, compared[row].view(np.int64), *(x[row] for x in label)]
        batches = [pa.RecordBatch.from_arrays([pa.array(x[o]) for x in columns], names=["key", "node", "print", "label"][: len(columns)]) for o in np.array_split(order, 60)]
        for batch in S._candidates(iter(batches)):
            out.append(np.stack([np.asarray(x.cast("int64")) for x in batch.columns]))
        return np.concatenate(out, 1)

    def joined(pairs):
        return [S.forest(len(texts), *x[:2]).tolist() for x in (pairs, pairs[:, pairs[2] == 1])]

    assert sorted(zip(*(np.concatenate(x) for x in zip(S.join_keys(low, high, True), S.join_keys(low, high, False), strict=True)), strict=True)) == sorted(zip(*S.join_keys(low, high), strict=True))
    one, first = found(None), found(True)
    both = np.concatenate([first, found(False, np.array(joined(first)[1]))], 1)
    assert joined(both)[0] == joined(one)[0] and (both[0] != both[1]).all()
    assert 2 * both.shape[1] < one.shape[1]
    if limits[0] > 3:  # all pairs of a wide key count as of one with more
        assert joined(both)[1] == joined(one)[1]


@pytest.mark.parametrize("close", [0, 4])
def test_wide_keys_connect_what_pairs_connect(monkeypatch, close):
    """Walks of a few bits a step, whose parts meet at any distance; against all pairs."""
    monkeypatch.setattr(S, "CLOSE", close)
    rng, prints = np.random.default_rng(11), []
    for _ in range(40):
        at = int(rng.integers(0, 1 << 63)) if not prints or rng.random() < 0.4 else prints[int(rng.integers(len(prints)))]
        for _ in range(30):
            for bit in rng.choice(64, int(rng.integers(0, 19)) if rng.random() < 0.2 else 2, replace=False).tolist():
                at ^= 1 << bit
            prints.append(at)
    prints = np.array(prints, np.uint64)[rng.permutation(len(prints))]
    n, found, wide = len(prints), [], S._Wide()
    for part in np.array_split(np.arange(n), 7):
        found.append(wide(part, prints[part]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    assert (np.bitwise_count(prints[a] ^ prints[b]) <= S.APART).all() and len(a) < 3 * n
    x, y = np.nonzero(np.bitwise_count(prints[:, None] ^ prints) <= S.APART)
    want = S.forest(n, x, y)
    assert (S.forest(n, a, b) == want).all() and 5 < len(np.unique(want)) < n / 2


def test_links_across_pieces_as_brute_force():
    rng = np.random.default_rng(2)
    pools = [rng.choice(1 << 20, 120, replace=False) for _ in range(6)]
    sets = [np.sort(rng.choice(pools[int(rng.integers(6))], int(rng.integers(85, 115)), replace=False)).astype("<u4") for _ in range(90)]
    label = rng.integers(0, 60, 90)
    pairs = [(i, j) for i in range(90) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert len(pairs) > 20
    own = [(int(x) + 90, i) for i, x in enumerate(label)]  # rows of a label are together before

    def parts(links):
        return S.forest(150, np.array([x for x, _ in [*own, *links]]), np.array([y for _, y in [*own, *links]])).tolist()

    for blocks in (np.zeros(90, np.int64), rng.integers(0, 2, 90)):
        links = []
        for i, j in {(0, 0), (0, int(blocks.max())), (int(blocks.max()),) * 2}:
            k = np.flatnonzero((blocks == i) | (blocks == j))
            table = pa.table({"i": [i] * len(k), "j": [j] * len(k), "block": blocks[k], "label": label[k] + 90, "hashes": [sets[x].tobytes() for x in k]})
            out = S._across(table, 0.8)
            links += zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True)
        assert parts(links) == parts(pairs)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(5, text, 1, "k"), (5, text, 1, "k"), (2, text.upper(), 2, "k"), (8, text.replace("w50", "other"), 2, None), (None, None, 3, "k"), (None, "", 4, "k"), (9, "q r s t u v w", None, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, group string")
    kept = S.without_similar(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 9]
    assert S.without_similar(docs.limit(0)).count() == 0


def test_picked_rows_as_a_set_of_numbers(spark):
    """Every value of a byte, several blocks, partitions' high numbers; by bitmaps and by a join; clashing names stay."""
    rng = np.random.default_rng(8)
    numbers = [*range(4096), *(p << 33 | int(x) for p in (1, 2, 700) for x in np.unique(rng.integers(0, 100_000, 3000)))]
    chosen = [n for n in numbers if rng.random() < 0.5]
    rows = spark.createDataFrame([((n, "x"), n) for n in numbers], "row struct<_bits: long, at: string>, n long")
    ids = saved(spark.createDataFrame([(n,) for n in chosen], "n long"), "ids")
    for limit in (4096, 0):
        assert sorted(r.n for r in picked(rows, ids, True, limit).collect()) == chosen
        left = picked(rows, ids, False, limit)
        assert sorted(r.n for r in left.collect()) == sorted(set(numbers) - set(chosen))
        assert left.columns == ["row", "n"] or limit == 0
        assert picked(rows, ids.where("false"), True, limit).count() == 0
        assert picked(rows, ids.where("false"), False, limit).count() == len(numbers)
