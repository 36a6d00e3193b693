import numpy as np
from test_decontamination import brute as leaks
from test_similar import brute as alike

import corpus_pipeline as P
from strideline.llm import quality, secrets
from strideline.llm.byte_bpe import ByteBpe


def corpus(rng):
    some = lambda n: " ".join("".join(rng.choice(["the", "ing", "er", "on", "an", "th"], 2)) for _ in range(n))
    rows = [(i, some(60) if i % 4 else " ".join(w + "###" for w in some(60).split()), "en", "s", 0) for i in range(120)]
    item = some(14)
    rows += [(200, rows[1][1], "en", "s", 0), (201, rows[1][1].upper(), "en", "s", 0), (202, some(30) + " " + item + " " + some(30), "en", "s", 0)]
    rows += [(203, some(20) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + some(30), "en", "s", 0), (None, None, None, None, None), (204, "", "en", "s", 0), (205, "", "en", "s", 0)]
    return rows, [(7, item), (8, None)], [(i, int(i % 4 > 0)) for i in range(0, 120, 2)] + [(i, int(i % 4 > 0)) for i in range(1, 40)]


def test_stages_as_brute_force(spark, tmp_path):
    rows, items, labels = corpus(np.random.default_rng(12))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    good = [r for r in quality.scored(docs, model).collect() if r.score >= quality.THRESHOLD]
    assert {r.doc_id for r in good} >= {i for i in range(120) if i % 4} and not {i for i in range(0, 120, 4)} & {r.doc_id for r in good}
    group, _ = alike([r.text for r in good], 0.8)
    best = {}
    for i, r in enumerate(good):
        key = (r.doc_id is None, r.doc_id or 0)
        if group[i] not in best or key < best[group[i]][0]:
            best[group[i]] = key, r
    kept = [r for _, r in best.values() if not leaks(r.text, items, 10)[1]]
    trees = secrets.train(spark)
    codec = ByteBpe(P.RANK_FILE)
    want = {}
    for r in kept:
        text = r.text or ""
        found = secrets.scan(spark.createDataFrame([(text,)], "text string"), trees).first().findings if "token" in text else []
        for f in sorted(found, key=lambda f: -f.start):
            if f.secret:
                text = text[: f.start] + secrets.MASK + text[f.start + len(f.match) :]
        want[r.doc_id] = codec.encoding.encode_ordinary(text)
    got = {r.doc_id: (np.frombuffer(r.token_ids, "<u4").tolist(), r.round_trip) for r in P.run(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in got.items()} == want and all(v[1] for v in got.values())
    assert 202 not in got and 200 not in got and 1 in got and 203 in got and len([k for k in (None, 204, 205) if k in got]) <= 1


def test_stages_keep_the_columns(spark, tmp_path):
    rows, items, labels = corpus(np.random.default_rng(1))
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, token_ids string")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() > 20
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).where("NOT round_trip").count() == 0


def test_lengths_follow_masked_texts_only(spark, tmp_path):
    secret = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    rows = [(1, "plain words", 11), (2, f"a {secret} b", len(secret) + 4), (3, None, 0), (4, "counted otherwise", 99), (5, f"a {secret} b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = {r.doc_id: r for r in P.mask_secrets(spark, docs, str(tmp_path)).collect()}
    assert [got[i].n_chars for i in range(1, 6)] == [11, len(got[2].text), 0, 99, None] and secrets.MASK in got[2].text
    assert P.mask_secrets(spark, docs, str(tmp_path)).schema["n_chars"] == docs.schema["n_chars"]
