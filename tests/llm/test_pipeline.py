"""The pipeline stage by stage against brute-force versions."""

import random
from collections import Counter

import pytest
from tests.llm.test_nearcopies import brute as near_brute

import corpus_pipeline
from lodestone.llm import bpe, mixing, nearcopies, quality, secrets

WORDS = ["ther", "and", "onre", "ing", "eath", "lyes", "tion", "ble", "st", "of", "the", "wh", "re"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(5)
    prose = lambda n: [rnd.choice(WORDS) + rnd.choice(WORDS) + rnd.choice(["", "", "s."]) for _ in range(n)]
    rows, labels = [], []
    for i in range(240):
        words = prose(rnd.randint(30, 120))
        if i % 4 == 0:
            words = [w.upper() + "!!" for w in words]
        if i % 10 == 1:
            words.insert(5, f"password=abc{i:06d}")
        if i % 6 == 5:
            words = rows[-1][1].split(" ")
            words[-1] = "end"
        rows.append((i, " ".join(words), "en", f"src{i % 5 if i % 3 else 0}", None))
        labels.append((i, int(i % 4 > 0 and not (i % 6 == 5 and (i - 1) % 4 == 0)), 0))
    rows = [(*r[:4], len(r[1])) for r in rows]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_take_effect(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, corpus)
        if stage is not corpus_pipeline.byte_bpe:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append((docs, spark.read.parquet(f"{tmp_path}/{name}")))
        docs = seen[-1][1]

    (before, good), (_, single), (_, clean), (_, mixed), (_, tokens) = seen
    model = quality.fit(before, spark.read.parquet(f"{corpus}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.score(before, model).collect()}
    assert sorted(r.doc_id for r in good.collect()) == sorted(d for d, s in scores.items() if s >= 0.5)
    assert 100 < good.count() < 240

    want = near_brute([(r.doc_id, r.text) for r in good.collect()], corpus_pipeline.SHINGLE, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, x in want.items() if x[2])
    assert single.count() < good.count()

    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in single.collect())
    assert not any("password=abc" in r.text for r in clean.collect())
    assert all(r.n_chars == len(r.text) for r in clean.collect())

    plan = {r.doc_id: r.copies for r in mixing.plan_mix(clean).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in plan.items() if n})

    texts = {r.doc_id: r.text for r in mixed.collect()}
    back = bpe.decode(tokens).collect()
    assert len(back) == mixed.count() and all(bytes(r.bytes).decode() == texts[r.doc_id] for r in back)
    assert sorted(corpus_pipeline.run(spark, corpus).collect()) == sorted(tokens.collect())


def test_odd_rows(spark, tricky, no_docs):
    model = quality.Model.fit(*(lambda n: (n.zeros((0, quality.WIDTH), n.float32), n.zeros(0, n.float32)))(__import__("numpy")))
    steps = [lambda d: quality.keep_good(d, model), lambda d: nearcopies.keep_one_of_each(d), secrets.redact_secrets, mixing.mix_documents]
    for rows in (tricky, no_docs):
        docs = rows
        for step in steps:
            docs = step(docs)
            assert docs.columns == rows.columns
        assert bpe.encode(docs).count() == docs.count()
