import hashlib
import random
import re

import pytest

from lodestone.llm import substrings


def brute(rows, width):
    docs = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows if d is not None}
    first = {}
    for d in sorted(docs):
        for i in range(len(docs[d]) - width + 1):
            first.setdefault(tuple(docs[d][i : i + width]), d)
    out = {}
    for d, words in docs.items():
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < d:
                gone |= set(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[d] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def random_rows(seed, n=80):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randint(0, 300)}"
    pool = [[word() for _ in range(rnd.randint(10, 90))] for _ in range(8)]
    rows = []
    for d in range(n):
        words = []
        for _ in range(rnd.randint(0, 5)):
            part = list(rnd.choice(pool)) if rnd.random() < 0.6 else [word() for _ in range(rnd.randint(1, 60))]
            if rnd.random() < 0.4:
                part[rnd.randrange(len(part))] = word()
            words += part[rnd.randint(0, 3) :]
        rows.append((d * 3, rnd.choice([" ", "\n", "  "]).join(words)))
    return rows + [(rows[5][0], rows[5][1]), (1000, rows[7][1]), (1001, rows[7][1]), (1002, None), (1003, "")]


@pytest.mark.parametrize("width", [50, 21])
def test_matches_brute_force(spark, width):
    rows = random_rows(width)
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), width).collect()
    want = brute(rows, width)
    assert len(got) == len(rows) and any(r.n_removed for r in got)
    for r in got:
        assert tuple(r[1:4]) == want[r.doc_id], r


def test_odd_rows(spark, tricky, no_docs):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    want = brute(rows, 50)
    got = substrings.remove_repeats(tricky).collect()
    assert len(got) == len(rows) and all(tuple(r[1:4]) == want[r.doc_id] for r in got)
    assert substrings.remove_repeats(no_docs).count() == 0
    unnamed = spark.createDataFrame([(None, rows[7][1]), (1, rows[7][1])], "doc_id bigint, text string")
    assert all(r.n_removed == 0 for r in substrings.remove_repeats(unnamed).collect())


@pytest.mark.parametrize("times", [2, 3])
def test_a_segment_repeated_inside_its_first_document(spark, times):
    unique = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    own = f"{unique('y', 70)} {unique('p', 60)} {unique('z', 70)}"
    rows = [(1, f"{unique('a', 80)} {unique('p', 60)} {unique('b', 80)}"), (5, " ".join([own] * times)), (6, f"{unique('c', 60)} {own}")]
    want = brute(rows, 50)
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert want[5][1] == 60 * times
    assert {r.doc_id: tuple(r[1:4]) for r in got} == want


def test_doubling_until_nothing_survives(spark):
    words = [f"a{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, "x " + " ".join(words[:110]) + " y"), (3, "z " + " ".join(words[10:250])), (4, " ".join(f"b{i}" for i in range(99)))]
    got = {r.doc_id: r.longest for r in substrings.longest_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {2: 100, 3: 200}
