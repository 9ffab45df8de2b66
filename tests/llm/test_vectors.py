import numpy as np
import pytest

from lodestone.llm import vectors
from lodestone.llm.components import spanning_tree

SCHEMA = "vec_id bigint, embedding array<float>, label int, other string"


def brute(rows, least=vectors.COSINE):
    keep = {}
    for vec_id, e, label, _ in rows:
        if vec_id is not None and label is not None and e and None not in e and np.isfinite(e).all() and np.any(e):
            keep[vec_id] = (label, np.array(e, dtype=np.float32).astype(float))
    ids = sorted(keep)
    parent = {r[0]: r[0] for r in rows if r[0] is not None}
    links = dict.fromkeys(parent, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (la, x), (lb, y) = keep[a], keep[b]
            if la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[a] += 1
                links[b] += 1
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {d: (links[d], find(d), find(d) == d) for d in parent}


def random_rows(seed, n=400, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(6)] + rng.standard_normal(dim) * rng.choice([0.05, 0.3]) if rng.random() < 0.7 else rng.standard_normal(dim)
        rows.append((i * 3 % 1201, [float(x) for x in v.astype(np.float32)], int(rng.integers(3)), "x"))
    rows += [rows[3], (5000, rows[3][1], rows[3][2], None), (5001, [2 * x for x in rows[3][1]], rows[3][2], None)]
    odd = [None, [], [0.0] * dim, [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] * dim, [1.0] * (dim - 1)]
    rows += [(6000 + i, e, 1, None) for i, e in enumerate(odd)]
    return rows + [(7000, rows[0][1], None, None), (7001, [1e-30] * dim, 2, None), (7002, [1e30] * dim, 2, None)]


@pytest.mark.parametrize(("cell", "block"), [(2048, 1024), (40, 16)])
def test_matches_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = random_rows(cell)
    got = vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: tuple(r[1:]) for r in got} == brute(rows)


def test_replication_is_complete_and_prunes():
    rng = np.random.default_rng(2)
    pivots = rng.standard_normal((12, 3))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    x = rng.standard_normal((500, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    home, visits, _ = vectors.homes_and_guests(x, pivots, np.sqrt(2 - 2 * 0.99))
    a, b = np.nonzero(x @ x.T >= 0.99)
    assert (visits[a, home[b]] | (home[a] == home[b])).all()
    assert visits.mean() < 0.4


def test_bands_hold_all_partners():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    radius = np.sqrt(2 - 2 * 0.95)
    band = vectors.bands(np.linalg.norm(x - [1, 0, 0], axis=1), radius)
    a, b = np.nonzero(x @ x.T >= 0.95)
    assert (abs(band[a] - band[b]) <= 1).all() and band.max() > 3


def test_small_labels_cross_cells(spark):
    # as many vectors as a label of the smallest tables has, and near pairs on cell borders
    rows = random_rows(11, n=60)
    usable = vectors._usable(spark.createDataFrame(rows, SCHEMA)).groupBy("kind", "vec").agg(vectors.F.min("vec_id").alias("rep"), vectors.F.count("*").alias("copies"))
    cells = vectors._celled(usable, vectors.choose_pivots(usable), np.sqrt(2 - 2 * vectors.COSINE))
    assert cells.select("cell").distinct().count() > 1 and cells.where("not home").count() > 0
    assert {r.vec_id: tuple(r[1:]) for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_spanning_trees():
    rng = np.random.default_rng(3)
    for _ in range(50):
        near = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.25
        edges = spanning_tree(near)
        assert all(near[i, j] for i, j in edges)
        rows, cols = near.shape

        def groups(pairs, rows=rows, cols=cols):
            label = list(range(rows + cols))
            for i, j in pairs:
                old, new = label[i], label[rows + j]
                label = [new if x == old else x for x in label]
            return sorted(map(label.count, label)), len(set(label))

        assert groups(edges) == groups(zip(*np.nonzero(near), strict=True)) and len(edges) == rows + cols - groups(edges)[1]


def test_no_rows(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
