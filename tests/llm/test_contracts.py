"""The queries themselves, by name, against plain Python on small tables: columns, types, splits and values."""

import base64
import hashlib
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

import __spark_entry__

UPPER = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = {"aa": "ka lo mi tu re", "bb": "søn gå ære flå dyt", "cc": "що на пер ний дом"}


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def lowered(text):
    return (text or "").translate(UPPER)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("corpus"), np.random.default_rng(12)

    def words(lang, n):
        parts = SYLLABLES[lang].split()
        return ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(n)]

    items = [" ".join(words("aa", n)) for n in (25, 14, 10, 4)] + ["", None, "Twice here", "twice HERE"]
    docs = []
    for i in range(150):
        lang = ("aa", "bb", "cc")[i % 3]
        good = i % 2
        body = words(lang, int(rng.integers(3, 120)))
        body = body if good else [w for x in body for w in (x, "BUY", "now!!")]
        if i % 10 == 0:
            body += items[int(rng.integers(0, 4))].split() + words(lang, 5)
        docs.append((3 * i, " ".join(body), lang, good))
    copy = docs[7][1]
    near = copy.split(" ")
    near[len(near) // 2] = "other"
    docs += [(1000, copy, "bb", 1), (1001, " ".join(near), "bb", 1), (1002, None, None, 0), (1003, "", "aa", 0), (1004, "One", None, 1), (1005, "12 - ... 7", "aa", 1)]
    docs += [(1006, f"token = \"{hashlib.sha256(b'x').hexdigest()}\" password: 'hunter2Q!x9Zp'", "aa", 1), (1007, "é" * 5001, "bb", 0), (1008, "It's　twice here<|endoftext|>", "cc", 1)]
    frame = pd.DataFrame(docs, columns=["doc_id", "text", "lang", "good"])
    frame["source"], frame["n_chars"] = "s", frame.text.map(lambda t: len(t or "")).astype("int64")
    frame[["doc_id", "text", "lang", "source", "n_chars"]].to_parquet(f"{folder}/documents.parquet")
    labels = frame[["doc_id"]].assign(quality=frame.good.astype("int64"), toxic=0)[:150]
    labels.to_parquet(f"{folder}/labels.parquet")
    pd.DataFrame({"item_id": [f"item-{i}" for i in range(len(items))], "text": items}).to_parquet(f"{folder}/benchmark.parquet")
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 70000, "<p>b</p>", "<p>a</p>"]
    pd.DataFrame({"page_id": [5, 9, 2, 4, 1, 30, 8, 7], "url": [f"http://x.example/{i}" for i in range(8)], "html": html}).to_parquet(f"{folder}/pages.parquet")
    texts = {r.doc_id: r.text for r in frame.itertuples()}
    return str(folder), texts, items, dict(zip([5, 9, 2, 4, 1, 30, 8, 7], html, strict=True)), {r.doc_id: (r.lang, r.good) for r in frame.itertuples()}


def run(spark, tables, number):
    name = next(n for n in __spark_entry__.queries() if n.startswith(f"op{number}_"))
    df = __spark_entry__.queries()[name](spark, tables[0])
    return dict(df.dtypes), [r.asDict() for r in df.collect()]


def by_id(rows, texts):
    out = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(out) and set(out) == set(texts)
    return out


def test_op1(spark, tables):
    folder, texts, items, *_ = tables
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    types, rows = run(spark, tables, 1)
    got = by_id(rows, texts)
    assert {types[c] for c in ("doc_id", "n_words", "n_hit", "n_items")} == {"bigint"} and types["contaminated"] == "boolean"
    windows = {}
    for i, t in enumerate(items):
        w = word.findall(lowered(t))
        windows[f"item-{i}"] = {tuple(w[a : a + 10]) for a in range(max(1, len(w) - 9))} if w else set()
    for doc, text in texts.items():
        w, hit, found = word.findall(lowered(text)), set(), set()
        for item, some in windows.items():
            for win in some:
                for a in range(len(w) - len(win) + 1):
                    if tuple(w[a : a + len(win)]) == win:
                        hit |= set(range(a, a + len(win)))
                        found.add(item)
        want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        assert tuple(got[doc][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == want


def test_op2(spark, tables):
    texts = tables[1]
    types, rows = run(spark, tables, 2)
    got = by_id(rows, texts)
    assert {types[c] for c in ("doc_id", "n_tokens", "n_known", "train_tokens")} == {"bigint"} and types["base_score"] == types["score"] == "double"
    tokens = {d: [*SPACED.findall(lowered(t)), None] for d, t in texts.items()}
    count = Counter(w for d, t in tokens.items() if crc(d) % 7 != 2 for w in t)
    n, v = sum(count.values()), len(count)
    for d, t in tokens.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(d) % 7 == 2, len(t), sum(count[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in t)) and r["score"] < 0


def test_op3(spark, tables):
    texts = tables[1]
    _, rows = run(spark, tables, 3)
    got, order = by_id(rows, texts), sorted(texts, reverse=True)
    prints = {}
    for d, after in zip(order, [*order[1:], order[0]], strict=True):
        own, other = texts[d] or "", texts[after] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        assert got[d]["n_chars"] == len(own) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
        assert prints.setdefault(own, got[d]["fingerprint"]) == got[d]["fingerprint"]
        assert edited != own or got[d]["edited_fingerprint"] == got[d]["fingerprint"]
        assert got[d]["near_next"] == (1 if own == other else got[d]["near_next"])


def test_op4(spark, tables):
    texts = tables[1]
    _, rows = run(spark, tables, 4)
    got = by_id(rows, texts)
    lines = [x.split() for x in Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes().splitlines() if x]
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})
    for d, text in texts.items():
        ids = library.encode_ordinary(text or "")
        want = len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
        assert tuple(got[d][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")) == want


def test_op5(spark, tables):
    texts, kinds = tables[1], tables[4]
    _, rows = run(spark, tables, 5)
    got = by_id(rows, texts)
    assert all(r["held_out"] == (crc(d) % 5 == 0) and 0 <= r["score"] <= 1 for d, r in got.items())
    letters = {d: any(c.isalpha() for c in t or "") for d, t in texts.items()}
    assert all((got[d]["lang_pred"] == "und") == (not letters[d]) for d in texts)
    held = [d for d in texts if d < 1000 and crc(d) % 5 == 0]
    assert np.mean([got[d]["lang_pred"] == kinds[d][0] for d in held]) > 0.9


def test_op6(spark, tables):
    pages = tables[3]
    _, rows = run(spark, tables, 6)
    raw = {p: (h or "").encode() for p, h in pages.items()}
    first = {}
    for p in sorted(raw):
        first.setdefault(raw[p], p)
    assert sorted(r["page_id"] for r in rows) == sorted(raw)
    for r in rows:
        p = r["page_id"]
        digest = base64.b32encode(hashlib.sha1(raw[p]).digest()).decode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw[p]), digest)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[raw[p]] == p else ("revisit", first[raw[p]]))


def test_op7(spark, tables):
    texts = tables[1]
    _, rows = run(spark, tables, 7)
    assert {r["doc_id"] for r in rows if r["secret"]} == {1006}
    for r in rows:
        match = texts[r["doc_id"]][r["start"] : r["start"] + r["n_chars"]]
        assert hashlib.sha256(match.encode()).hexdigest() == r["match_sha256"]


def test_op8(spark, tables):
    texts = tables[1]
    _, rows = run(spark, tables, 8)
    got, prints = by_id(rows, texts), {}
    for d, text in texts.items():
        w = SPACED.findall(lowered(text))
        shingles = [" ".join(w[a : a + 4]) for a in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert got[d]["fingerprint"] == f"{prints[d]:016x}"
    component = {d: d for d in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and component[b] > component[a]:
                    component[b], changed = component[a], True
    assert {d: r["component_id"] for d, r in got.items()} == component


def test_op9(spark, tables):
    texts = tables[1]
    _, rows = run(spark, tables, 9)
    got, start = by_id(rows, texts), 0
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d in sorted(texts):
        ids = [*library.encode(texts[d] or "", add_special_tokens=False).ids, 2]
        assert tuple(got[d][c] for c in ("start", "n_tokens", "ids_crc32")) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op10(spark, tables):
    texts, kinds = tables[1], tables[4]
    types, rows = run(spark, tables, 10)
    got = by_id(rows, texts)
    assert (types["score"], types["predicted"]) == ("double", "int")
    assert all(r["held_out"] == (crc(d) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in got.items())
    held = [d for d in texts if d < 450 and crc(d) % 5 == 0]
    good, bad = ([got[d]["score"] for d in held if kinds[d][1] == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.9
