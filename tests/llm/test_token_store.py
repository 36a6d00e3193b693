import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strideline.llm import token_store as S

FILE = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(FILE)  # as it comes: the answer
CLASSES = S.classes(TOKENIZER)
ENCODER = S.Encoder(S.load(FILE), CLASSES)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="ab's \n\t'relvdm1½é你.,!　", max_size=30)), min_size=1, max_size=4))
def test_ids_as_the_library_gives_them(texts):
    ids, first = ENCODER(texts)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [x.ids for x in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def test_ids_from_a_table_that_forgets():
    encode, rng = S.Encoder(S.load(FILE), CLASSES, 8), np.random.default_rng(2)
    for _ in range(40):
        texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, 20)), "", " the cat's"]
        ids, first = encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [x.ids for x in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def test_special_tokens_as_the_library_or_as_text():
    texts = ["a<|endoftext|>b", "", "plain", "<|endoftext|>", "<|endoftext |>"]
    ids, first = ENCODER(texts)
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [x.ids for x in TOKENIZER.encode_batch(texts, add_special_tokens=False)]
    assert 50256 in ids and first[1] == 3
    as_text = S.load(FILE, special_as_text=True)
    ids, first = S.Encoder(as_text, CLASSES)(texts)
    assert ids[: first[1]].tolist() == as_text.encode(texts[0], add_special_tokens=False).ids and first[1] == 9


def test_chunks_depend_on_content_and_have_a_bound():
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 50000, 60000).astype(np.uint32)
    a = set(S.cuts(ids, np.array([0, len(ids)])).tolist())
    b = {x - 100 for x in S.cuts(np.concatenate([np.arange(100, dtype=np.uint32), ids]), np.array([0, len(ids) + 100])).tolist()}
    assert len(a & b) > 0.9 * len(a) and 60 < len(a) < 240
    same = np.zeros(50000, np.uint32)
    assert np.diff(np.concatenate([[0], S.cuts(same, np.array([0, 50000]))])).max() <= S.MOST
    x, y = bytes(range(200)), b"abc" * 999
    assert S.joined_crc(zlib.crc32(x), zlib.crc32(y), len(y)) == zlib.crc32(x + y)


def test_store_round_trip_shares_chunks(spark, tmp_path):
    rng = np.random.default_rng(8)
    long = " ".join(f"word{x}" for x in rng.integers(0, 3000, 9000))
    rows = [(4, long), (2, long), (9, long + " more"), (7, None), (1, ""), (None, "no id"), (2, long), (30, "It's 12!<|endoftext|>"), (31, "very long " * 60000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string").repartition(4)
    chunks, manifest, root = S.write_store(docs, FILE, f"file://{tmp_path}/store")
    got = sorted(S.read_back(chunks, manifest, root).collect(), key=lambda r: r.start)
    with pytest.raises(ValueError, match="manifest differs"):
        S.read_back(chunks, manifest.where("row <> 3"), root)
    assert chunks.count() == chunks.select("digest").distinct().count()
    stored, total = chunks.selectExpr("sum(n)").first()[0], sum(r.n_tokens for r in got)
    assert stored < 0.5 * total
    start, texts = 0, {r[0]: r[1] for r in rows}
    assert [r.doc_id for r in got] == [None, 1, 2, 2, 4, 7, 9, 30, 31]
    whole = {r.start: r.ids for r in S.documents(chunks, manifest).collect()}
    for r in got:
        ids = [*TOKENIZER.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert whole[r.start] == ids
        start += len(ids)
    lost = chunks.where("n > 300")
    with pytest.raises(Exception, match="chunk is missing"):
        S.read_back(lost, manifest).collect()
    assert S.read_back(*S.write_store(docs.limit(0), FILE, f"file://{tmp_path}/none")).count() == 0


def test_store_without_end_ids(spark, tmp_path):
    rows = [(1, ""), (2, "two words"), (3, None), (4, ""), (5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chunks, manifest, root = S.write_store(docs, FILE, f"file://{tmp_path}/store", end_id=None)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in S.read_back(chunks, manifest, root).collect()}
    whole, start = {r.doc_id: r.ids for r in S.documents(chunks, manifest).collect()}, 0
    for i, text in rows:
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids
        assert whole[i] == ids and got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_manifest_tree_has_levels(spark, monkeypatch):
    monkeypatch.setattr(S, "FAN", 4)
    entries = spark.range(70).selectExpr("id AS doc_id", "id AS row", "id AS n", "id AS start", "cast('' AS binary) AS root")
    root = S.manifest_root(entries)
    assert len(root) == 20 and root == S.manifest_root(entries.repartition(3)) and root != S.manifest_root(entries.where("row < 69"))
