import random
import zlib

import numpy as np

from lodestone.llm import quality


def corpus(spark, n=600):
    rnd = random.Random(2)
    words = ["ther", "and", "onre", "ing", "eath", "lyes", "tion", "ble", "st", "of", "the"]
    docs, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        base = [rnd.choice(words) + rnd.choice(words) for _ in range(rnd.randint(20, 200))]
        text = " ".join(base) if good else rnd.choice([" ".join(w.upper() + "!!" for w in base), " ".join(w + "###" for w in base), " ".join([base[0]] * 90 + [base[1]] * 40)])
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = quality.fit(docs, labels, per_class=100)
    assert len(model.vectors) <= 200
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 100
    assert np.mean([(got[r.doc_id] >= 0.5) == bool(r.quality) for r in held]) >= 0.97
    kept = {r.doc_id for r in quality.keep_good(docs, model).collect()}
    assert kept == {d for d, s in got.items() if s >= 0.5}


def test_held_out_labels_are_never_read(spark):
    docs, labels = corpus(spark, 200)
    flipped = spark.createDataFrame([(r.doc_id, 1 - r.quality if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 else r.quality, 0) for r in labels.collect()], labels.schema)
    one, two = (quality.score(docs, quality.fit(docs, x)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert one == two


def test_blocked_products_match_brute_force():
    rng = np.random.default_rng(1)
    raw = rng.poisson(0.3, (60, quality.WIDTH)).astype(np.float32)
    labels = rng.integers(0, 2, 60).astype(np.float32)
    model = quality.Model.fit(raw, labels)
    new = rng.poisson(0.3, (25, quality.WIDTH)).astype(np.float32)
    want = []
    for v in model.embed(new):
        c = model.vectors @ v
        near = np.argsort(c)[-quality.NEIGHBOURS :]
        w = np.clip(c[near], 0, 1).astype(float) ** quality.SHARPNESS
        want.append((w * labels[near]).sum() / w.sum())
    assert np.allclose(model.score(new, block=7), want)


def test_odd_rows(spark, tricky, no_docs):
    docs, labels = corpus(spark, 120)
    model = quality.fit(docs, labels.unionByName(spark.createDataFrame([(1, None, 0), (None, 1, 0), (1, 0, 0)], labels.schema)))
    rows = quality.score(tricky, model).collect()
    assert len(rows) == tricky.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.keep_good(tricky, model).columns == tricky.columns
    assert quality.score(no_docs, model).count() == 0
    empty = quality.fit(no_docs, labels)
    assert {r.score for r in quality.score(tricky, empty).collect()} == {0.5}
