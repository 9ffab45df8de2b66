import random
import re

import numpy as np
import pytest

from lodestone.llm import nearcopies
from lodestone.llm.components import components


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent):
    sets = {d: shingles(t, size) for d, t in rows if d is not None}
    ids, parent = sorted(sets), {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def random_rows(seed, groups=25):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefghij") + str(rnd.randint(0, 99))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(1, 150))]
        for _ in range(rnd.choice([1, 1, 2, 3, 12])):
            own = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 30))):
                own[rnd.randrange(len(own))] = word()
            rows.append((len(rows) * 7 % 1009, " ".join(own).title() if rnd.random() < 0.2 else " ".join(own)))
    return rows + [rows[4], rows[5], (2000, rows[5][1]), (2001, None), (2002, "")]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_matches_brute_force(spark, size, percent):
    rows = random_rows(size)
    got = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), size, percent / 100).collect()
    want = brute(rows, size, percent)
    assert len(got) == len(rows) and not all(r.kept for r in got)
    assert {r.doc_id: tuple(r[1:]) for r in got} == want


@pytest.mark.parametrize("edits", [5, 16])
def test_a_large_group_is_blocked(spark, monkeypatch, edits):
    monkeypatch.setattr(nearcopies, "LEAF", 16)
    monkeypatch.setattr(nearcopies, "STAR", 8)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(150):
        own = list(base)
        for i in rnd.sample(range(200), rnd.randint(0, edits)):
            own[i] = f"x{rnd.randint(0, 10**6)}"
        rows.append((d, " ".join(own)))
    got = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 0.85).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == brute(rows, 3, 85)


def test_near_copies_in_different_blocks(spark, monkeypatch):
    # one blocked node and no small leaf of another tree that could make up for it
    monkeypatch.setattr(nearcopies, "_leaves", lambda reps: reps.selectExpr("1L AS node", "doc_id", "20 AS blocks"))
    monkeypatch.setattr(nearcopies, "SCREEN", 16)
    monkeypatch.setattr(nearcopies, "CELL_DOCS", 16)
    rnd = random.Random(4)
    fixed = [f"t{i}" for i in range(130)]
    rows = []
    for d in range(60):
        own = fixed + [f"d{d}x{i}" for i in range(70)]
        rows.append((d, " ".join(own)))
        if d % 3 == 0:
            own[rnd.randrange(200)] = "edit"
            rows.append((500 + d, " ".join(own)))
    got = nearcopies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 0.85).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == brute(rows, 3, 85)


def test_recall_on_pages_of_one_template(spark, monkeypatch):
    # unlinked pages at a similarity of about 0.75, pairs at the threshold among them, a chain and a large group
    monkeypatch.setattr(nearcopies, "LEAF", 32)
    monkeypatch.setattr(nearcopies, "CELL_DOCS", 100)
    rnd = random.Random(12)
    fixed = [f"t{i}" for i in range(172)]
    page = lambda d: fixed + [f"d{d}x{i}" for i in range(28)]
    rows = [(d, page(d)) for d in range(600)]
    for d in range(0, 300, 3):
        own = page(d)
        for i in rnd.sample(range(172, 200), 2):
            own[i] = f"e{d}y{i}"
        rows.append((1000 + d, own))
    for k in range(30):  # each like its neighbours only
        rows.append((2000 + k, [f"c{i}" for i in range(4 * k, 4 * k + 150)]))
    rows += [(3000 + k, fixed[:100] + [f"g{k}" if i == k % 100 else f"h{i}" for i in range(100)]) for k in range(200)]
    rows = [(d, " ".join(x)) for d, x in rows]
    rnd.shuffle(rows)
    got = {r.doc_id: tuple(r[1:]) for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 0.85).collect()}
    want = brute(rows, 3, 85)
    joined = [d for d in want if not want[d][2]]
    assert len(joined) > 300 and sum(got[d] == want[d] for d in joined) >= 0.99 * len(joined)


@pytest.mark.parametrize("chains", [1, 3])
def test_stars_cover_documents_whose_partners_are_covered(chains):
    # 57 mutual copies, c like 32 of them, d like c only
    n = 57 + 2 * chains
    near = np.zeros((n, n), dtype=bool)
    near[:57, :57] = True
    for k in range(chains):
        c, d = 57 + 2 * k, 58 + 2 * k
        near[c, :32] = near[:32, c] = near[c, d] = near[d, c] = True
    np.fill_diagonal(near, False)
    found = list(nearcopies.star_pairs(near.copy()))
    assert all(near[a, b] for a, b in found)
    assert {x for pair in found for x in pair} == set(range(n))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    s = nearcopies.sketches([a, np.sort(b), a[:0]])
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.17 and not s[2].any()


def test_odd_rows(spark, tricky, no_docs):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    got = nearcopies.near_copies(tricky).collect()
    assert len(got) == len(rows) and {r.doc_id: tuple(r[1:]) for r in got} == brute(rows, 5, 80)
    assert nearcopies.near_copies(no_docs).count() == 0
    kept = nearcopies.keep_one_of_each(tricky)
    assert kept.columns == tricky.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}
    unnamed = spark.createDataFrame([(None, rows[7][1]), (1, rows[7][1])], "doc_id bigint, text string")
    assert all(r.kept for r in nearcopies.near_copies(unnamed).collect())


def test_clashing_columns_pass_through(spark):
    names = ["_gone", "gone", "digest", "component", "node", "rep", "kept"]
    rows = [(i, f"some words for document {i // 2} and some more of them", *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = nearcopies.keep_one_of_each(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == rows[::2]


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, i) for i in range(200, 400)] + [(3, 399)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain + hub + [(5, 5)], "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 3 for i in [3, 7, *range(200, 400)]}


def test_trees_follow_the_similarity():
    assert [nearcopies.trees_for(s) for s in (1.0, 0.95, 0.85, 0.8)] == [1, 5, 12, 18]
    for s in (0.6, 0.8, 0.85, 0.9):
        assert (1 - s**nearcopies.DEPTH) ** nearcopies.trees_for(s) <= 1 - nearcopies.RECALL + 1e-12
