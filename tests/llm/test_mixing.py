import re
from collections import defaultdict

import pytest

from lodestone.llm import mixing


def water_fill(sizes, weights, most=3):
    """By rounds: cap what is above, reshare the rest by weight."""
    total, capped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in capped)
        share = sum(w for i, w in enumerate(weights) if i not in capped)
        targets = [most * s if i in capped else left * weights[i] / share for i, s in enumerate(sizes)]
        over = {i for i, t in enumerate(targets) if i not in capped and t > most * sizes[i]}
        if not over:
            return targets
        capped |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 1, 2, 3], [5, 0, 7, 900, 1, 1], [10], [1, 1, 1, 1, 1, 1, 500]])
def test_targets_match_rounds(spark, sizes):
    docs = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size bigint")
    got = [r.target for r in mixing.targets(docs).orderBy("source").collect()]
    assert got == pytest.approx(water_fill(sizes, [i % 3 + 1 for i in range(len(sizes))]))


def test_plan(spark, tricky, no_docs):
    rows = mixing.plan_mix(tricky).collect()
    texts = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in tricky.collect()}
    assert len(rows) == tricky.count()
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        source, size = texts[r.doc_id]
        assert r.size == size and r.taken == size * r.copies and 0 <= r.copies <= 3
        taken[source] += r.taken
        largest[source] = max(largest[source], size)
    target = {texts[r.doc_id][0]: r.target for r in rows}
    for source in taken:
        assert abs(taken[source] - target[source]) <= largest[source] / 2 + 1
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.plan_mix(tricky).collect()), key=repr)
    assert mixing.plan_mix(no_docs).count() == 0
    assert mixing.mix_documents(no_docs).count() == 0
    assert mixing.mix_documents(tricky).columns == tricky.columns


def test_positions_follow_the_integrated_schedule(spark):
    docs = spark.createDataFrame([(i, "a b c d e", f"s{i % 3}") for i in range(3000)], "doc_id bigint, text string, source string")
    plan = mixing.plan_mix(docs)
    used = mixing.mix_positions(plan).join(docs, "doc_id").collect()
    for s, (a, b) in enumerate(mixing.RAMPS):
        at = sorted(r.position for r in used if r.source == f"s{s}")
        for t in (0.25, 0.5, 0.75):
            share = sum(x <= t for x in at) / len(at)
            assert abs(share - (a * t + (b - a) * t * t / 2)) < 0.01
    order = [r.position for r in mixing.mix_positions(plan).collect()]
    assert order == sorted(order)


def test_mixed_documents_come_in_training_order(spark):
    docs = spark.createDataFrame([(i, "a b c d e", f"s{i % 3}") for i in range(600)], "doc_id bigint, text string, source string").repartition(3)
    want = [r.doc_id for r in mixing.mix_positions(mixing.plan_mix(docs)).collect()]
    assert len(want) > len(set(want))
    assert [r.doc_id for r in mixing.mix_documents(docs).collect()] == want


def test_documents_without_an_id_are_mixed(spark):
    rows = [(None if i % 3 == 0 else i, f"a b c {i}", "s") for i in range(30)]
    out = mixing.mix_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert sorted(map(tuple, out), key=repr) == sorted(rows, key=repr)


def test_clashing_columns_pass_through(spark):
    names = ["row", "number", "position", "epoch", "size", "copies", "_row", "_gone", "key", "bucket", "target"]
    rows = [(i, f"a b c {i}", "s", *[f"{n}{i}" for n in names]) for i in range(20)]
    docs = spark.createDataFrame([*rows, rows[3]], ["doc_id", "text", "source", *names])
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted([*rows, rows[3]])
    assert mixing.mix_positions(mixing.plan_mix(docs)).count() == 21


def test_no_python_in_the_plan(spark, tricky):
    plan = mixing.plan_mix(tricky)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
