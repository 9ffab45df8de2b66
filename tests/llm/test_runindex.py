import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import runindex


def brute(rows, width):
    """(n_bytes, n_removed, n_spans, kept_sha256) by row."""
    docs = [(t or "").encode() for _, t in rows]
    many = Counter(b[i : i + width] for b in docs for i in range(len(b) - width + 1))
    out = []
    for b in docs:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - width + 1):
            if many[b[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def random_rows(seed, n=60):
    rnd = random.Random(seed)
    chunk = lambda: "".join(rnd.choice("abcdé\0 ") for _ in range(rnd.randint(30, 400)))
    pool = [chunk() for _ in range(6)]
    rows = []
    for d in range(n):
        text = ""
        for _ in range(rnd.randint(0, 4)):
            part = rnd.choice(pool) if rnd.random() < 0.6 else chunk()
            if rnd.random() < 0.4:
                i = rnd.randrange(len(part))
                part = part[:i] + "X" + part[i + 1 :]
            text += part[rnd.randint(0, 5) :]
        rows.append((d, text))
    rows += [(100, "ab" * 300), (101, "q" * 199), (102, "z" * 201), (103, None), (104, ""), (105, rows[3][1]), (106, rows[3][1]), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize(("width", "part"), [(200, 64), (60, 20), (24, 24)])
@pytest.mark.parametrize(("each", "most"), [(1000, 8), (1, 1), (2, 3)])
def test_matches_brute_force(spark, monkeypatch, width, part, each, most):
    """With one index a group, with refined groups, and with groups split over indexes."""
    monkeypatch.setattr(runindex, "PER_INDEX", each)
    monkeypatch.setattr(runindex, "MOST_INDEXES", most)
    rows = random_rows(width)
    got = runindex.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), width, part).collect()
    want = brute(rows, width)
    assert any(x[1] for x in want)
    assert sorted(map(tuple, got)) == sorted((d, *w) for (d, _), w in zip(rows, want, strict=True))


def test_statistics_match_brute_force():
    rnd = random.Random(4)
    for _ in range(60):
        segments = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 8))]
        segments += [segments[0], segments[-1][: len(segments[-1]) // 2 + 1]]
        offsets = np.append(0, np.cumsum([len(s) for s in segments]))
        index = runindex.RunIndex(np.frombuffer(b"".join(segments), dtype=np.uint8), offsets)
        suffixes = [s[i:] for s in segments for i in range(len(s))]
        for i, (a, got) in enumerate(zip(suffixes, index.statistics(), strict=True)):
            best = 0
            for j, b in enumerate(suffixes):
                if i != j:
                    n = 0
                    while n < min(len(a), len(b)) and a[n] == b[n]:
                        n += 1
                    best = max(best, n)
            assert got == best


def test_streamed_statistics_match_brute_force():
    rnd = random.Random(5)
    draw = lambda: bytes(rnd.choice(b"ab\0c") for _ in range(rnd.randint(0, 30)))
    pack = lambda xs: (np.frombuffer(b"".join(xs), dtype=np.uint8), np.append(0, np.cumsum([len(x) for x in xs])))
    for _ in range(60):
        texts, others = [draw() + b"a" for _ in range(rnd.randint(1, 6))], [draw() for _ in range(4)]
        others += [texts[0], texts[0][1:] + b"d", b""]
        got = runindex.RunIndex(*pack(texts)).stream(*pack(others))
        want = [max(n for n in range(len(o) - i + 1) if any(o[i : i + n] in t for t in texts)) for o in others for i in range(len(o))]
        assert got.tolist() == want


def test_a_long_text_is_walked_in_pieces(spark, monkeypatch):
    monkeypatch.setattr("lodestone.llm.blocks.PIECE_BYTES", 700)
    rnd = random.Random(6)
    noise = lambda n: "".join(rnd.choice("abcdé") for _ in range(n))
    shared = noise(900)
    with_copies = noise(1000) + shared + noise(2000) + shared[100:650] + noise(500) + "q" * 1700
    rows = [(1, with_copies), (2, noise(800) + shared[50:] + noise(10)), (3, noise(3000))]
    batch = runindex.pa.RecordBatch.from_arrays([runindex.pa.array([t for _, t in rows])], ["text"])
    assert max(len(list(p.pieces(200))) for p in runindex.slices(batch, max_bytes=100)) > 5
    got = collected_in_process(rows, 200)
    want = [(b, m) for b, m in ((len(t.encode()), w[1]) for (_, t), w in zip(rows, brute(rows, 200), strict=True))]
    assert got == want


def collected_in_process(rows, width):
    """(n_bytes, n_removed) from segments alone: every window compared by its fingerprint."""
    batch = runindex.pa.RecordBatch.from_arrays([runindex.pa.array([t for _, t in rows])], ["text"])
    where = {}
    for part in runindex.slices(batch, max_bytes=100):
        raw = part.raw(0)
        for units, offset in runindex.byte_units(part, width):
            seg, _ = runindex.anchors.segments(units, width, 64)
            for anchor, start, many in zip(seg.anchor.tolist(), seg.start.tolist(), seg.many.tolist(), strict=True):
                for i in range(start + offset, start + offset + many):
                    where.setdefault((anchor, raw[i : i + width]), []).append((part.first, i))
    gone = [np.zeros(len(t.encode()), dtype=bool) for _, t in rows]
    assert sum(len(x) for x in where.values()) == sum(max(0, len(g) - width + 1) for g in gone)
    for places in where.values():
        if len(places) > 1:
            for r, i in places:
                gone[r][i : i + width] = True
    return [(len(g), int(g.sum())) for g in gone]


def test_runs_are_few_in_repetitive_text():
    text = bytes(random.Random(1).choice(b"abcdefgh") for _ in range(400))
    one = runindex.RunIndex(np.frombuffer(text, dtype=np.uint8), np.array([0, 400]))
    many = runindex.RunIndex(np.frombuffer(text * 20, dtype=np.uint8), np.arange(21) * 400)
    assert many.runs < 1.2 * one.runs + 20


def test_odd_rows(spark, tricky, no_docs):
    rows = [(r.doc_id, r.text) for r in tricky.collect()]
    want = brute(rows, 200)
    got = runindex.remove_repeats(tricky).collect()
    assert sorted(map(tuple, got)) == sorted((d, *w) for (d, _), w in zip(rows, want, strict=True))
    assert runindex.remove_repeats(no_docs).count() == 0
    unnamed = spark.createDataFrame([(None, rows[7][1]), (1, rows[7][1])], "doc_id bigint, text string")
    assert all(r.n_removed == 0 or r.doc_id == 1 for r in runindex.remove_repeats(unnamed).collect())
