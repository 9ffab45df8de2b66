import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.engine import SearchEngine, StrategyNotFound
from lodestone.functions import text as tx
from lodestone.operators import fusion as fu
from lodestone.operators import graph as gr
from lodestone.operators import postprocess as pp
from lodestone.operators import rag
from lodestone.operators import scoring as sc
from lodestone.operators import topk as tk

CHUNKS = [(0, "paper_a.pdf", 1, "Introduction", "Deep learning architectures for retrieval augmented generation."), (1, "paper_a.pdf", 2, "Methods", "Reciprocal rank fusion combines sparse and dense rankings."), (2, "paper_b.pdf", 1, "Overview", "Knowledge graph traversal enhances POMDP belief state filtering.")]
CHUNK = "chunk_id bigint, doc_name string, page_num int, section string, text string"


@pytest.fixture(scope="module")
def engine(spark):
    return SearchEngine(spark, spark.createDataFrame(CHUNKS, CHUNK))


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query_text string")


@pytest.mark.parametrize("strategy", ["bm25", "tfidf", "linear_0.5", "rrf", "rrf_dedup_mmr", "ppmi", "cross_encoder", "adaptive", "vector", "graph", "rrf_graph_dedup"])
def test_strategies_find_the_chunk(spark, engine, strategy):
    top = engine.search(asked(spark, "rank fusion of sparse and dense rankings"), strategy, 3).where("rank = 1").collect()
    assert [r.chunk_id for r in top] == [1]


def test_strategy_names(engine):
    assert engine.resolve("graph") == "rrf_graph_dedup_mmr" and engine.resolve("TFID") == "tfidf"
    with pytest.raises(StrategyNotFound):
        engine.resolve("nothing")


def test_ask_and_evaluate(spark, engine):
    answer = engine.ask("How does rank fusion combine sparse rankings?")
    assert "Reciprocal rank fusion" in answer["answer"] and answer["citations"][0]["level"] == "medium"
    truth = spark.createDataFrame([(0, 1)], "query_id bigint, chunk_id bigint")
    row = engine.evaluate(asked(spark, "rank fusion"), truth, ["bm25"]).first()
    assert row.mrr == row.recall_1 == row.ndcg_5 == 1.0 and row.multihop_mrr is None


def test_bm25_floor_for_terms_in_every_chunk(spark):
    docs = ["all one", "all two", "all three"]
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "chunk_id bigint, fmt string")
    got = {r.chunk_id: r.score for r in sc.bm25(asked(spark, "all"), chunks).collect()}
    raw = {"all": math.log(0.5) - math.log(3.5)} | {w: math.log(2.5) - math.log(1.5) for w in ("one", "two", "three")}
    want = 0.25 * sum(raw.values()) / 4 * 2.5 / (1 + 1.5)
    assert all(abs(got[i] - want) < 1e-12 for i in range(3))


def test_min_max_of_constant_scores(spark):
    scores = spark.createDataFrame([(0, i, 3.0) for i in range(3)], "query_id bigint, chunk_id bigint, score double")
    assert {r.score for r in fu.min_max(scores).collect()} == {0.5}


def test_rrf_weights_ties_and_missing_entries(spark):
    ranking = lambda *ids: spark.createDataFrame([(0, c, r + 1) for r, c in enumerate(ids)], "query_id bigint, chunk_id bigint, rank int")
    fused = fu.ranked_by_fusion(fu.rrf([ranking(5, 6), ranking(6, 5), ranking(7)], [1.0, 1.0, 0.35]))
    got = [(r.chunk_id, r.score) for r in fused.orderBy("rank").collect()]
    assert [c for c, _ in got] == [5, 6, 7] and abs(got[2][1] - 0.35 / 61) < 1e-12


@pytest.mark.parametrize(("text", "alpha"), [("what is it then", 0.3), ("what is the best way", 0.7), ("please list the best ways", 0.3), ("tell me the best what?", 0.3)])
def test_adaptive_alpha(spark, text, alpha):
    assert asked(spark, text).select(fu.adaptive_alpha(F.col("query_text")).alias("a")).first().a == alpha


def plain_dedup(rows, most, threshold):
    kept = []
    for rank, chunk, text in sorted(rows):
        words = set(text.lower().split())
        if len(kept) < most and not any(w and words and len(w & words) / len(w | words) >= threshold for _, w in kept):
            kept.append((chunk, words))
    return [c for c, _ in kept]


def test_dedup_matches_a_plain_walk(spark):
    rnd = random.Random(1)
    for pool in (30, 200):
        rows = [(i + 1, 1000 - i, " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 5)))) for i in range(pool)]
        ranking = spark.createDataFrame([(0, c, 1.0 / r, r) for r, c, _ in rows], "query_id bigint, chunk_id bigint, score double, rank int")
        texts = spark.createDataFrame([(c, t) for _, c, t in rows], "chunk_id bigint, fmt string")
        got = [r.chunk_id for r in pp.dedup(ranking, texts, 25).orderBy("rank").collect()]
        assert got == plain_dedup(rows, 25, 0.65)


def test_mmr_matches_a_plain_loop(spark):
    rnd = random.Random(2)
    for flat in (False, True):
        pool = [(i + 1, 50 + i, 1.0 if flat else round(rnd.random(), 3)) for i in range(24)]
        pool = [(r, c, s) for r, (_, c, s) in enumerate(sorted(pool, key=lambda x: -x[2]), start=1)]
        vec = {c: [rnd.random() for _ in range(3)] for _, c, _ in pool}
        vec = {c: [x / math.sqrt(sum(y * y for y in v)) for x in v] for c, v in vec.items()}
        ranking = spark.createDataFrame([(0, c, s, r) for r, c, s in pool], "query_id bigint, chunk_id bigint, score double, rank int")
        vectors = spark.createDataFrame([(c, f"t{i}", x) for c, v in vec.items() for i, x in enumerate(v)], "chunk_id bigint, term string, w double")
        got = [r.chunk_id for r in pp.mmr(ranking, vectors).orderBy("rank").collect()]
        head = pool[:20]
        low, high = min(s for *_, s in head), max(s for *_, s in head)
        rel = {c: (s - low) / (high - low) if high > low else 1.0 for _, c, s in head}
        picked = []
        while len(picked) < 5:
            value = lambda c: rel[c] if not picked else 0.7 * rel[c] - 0.3 * max(sum(a * b for a, b in zip(vec[c], vec[p], strict=True)) for p in picked)  # noqa: E731, B023
            picked.append(max((c for _, c, _ in head if c not in picked), key=value))
        assert got == picked


@pytest.mark.parametrize(("rank", "fusion", "overlap", "level"), [(1, 0.8, 0.4, "high"), (3, 0.8, 0.4, "medium"), (4, 0.3, 0.1, "medium"), (10, 0.2, 0.05, "low"), (9, 0.5, 0.2, "medium")])
def test_confidence(spark, rank, fusion, overlap, level):
    assert spark.range(1).select(rag.confidence(F.lit(rank), F.lit(fusion), F.lit(overlap)).alias("l")).first().l == level


@pytest.mark.parametrize(("a", "b", "want"), [("test query", "test query", 1.0), ("quantum mechanics", "machine learning algorithms", 0.0), ("", "some text", 0.0)])
def test_overlap(spark, a, b, want):
    assert spark.range(1).select(rag.lexical_overlap(F.lit(a), F.lit(b)).alias("x")).first().x == want


def test_context_keeps_one_passage_and_stops_at_overflow(spark):
    rows = [(q, r, "d", 1, "s", "x" * n) for q, sizes in enumerate([(50, 10, 10), (500, 1), (30, 400, 1)]) for r, n in enumerate(sizes, start=1)]
    got = {r.query_id: r.n_sources for r in rag.build_context(spark.createDataFrame(rows, "query_id bigint, rank int, doc_name string, page_num int, section string, text string"), budget=200).collect()}
    assert got == {0: 3, 1: 1, 2: 1}


def test_entities_relations_and_noise(spark):
    text = "The RRF-K2 method and StarShell agree. Binding Constraint Thesis uses StarShell with THE RRF-K2. Ada Lovelace of Oxford University Press Board spoke."
    chunks = spark.createDataFrame([(0, "d", 1, "2.1 Error Bounds", text), (1, "d", 1, "Overview", "StarShell and RRF-K2 again.")], CHUNK)
    found = {(r.name, r.priority) for r in gr.mentions(chunks).where("chunk_id = 0").collect()}
    assert {("Error Bounds", 0), ("RRF-K2", 1), ("StarShell", 2), ("Binding Constraint Thesis", 3)} <= found
    assert not any("University" in n or n == "Ada Lovelace" or n == "THE" for n, _ in found)
    vertices, edges = gr.extract(chunks)
    assert "Error Bounds" not in {r.name for r in vertices.collect()}
    pair = edges.where("src = 'RRF-K2' AND dst = 'StarShell'").first()
    assert abs(pair.weight - (1 + math.log(4))) < 1e-9 and pair.chunk_ids == [0, 1]


def test_fuzzy_resolution(spark):
    rows = [("Belief State Filter", "CONCEPT", [1]), ("Belief State Filters", "CONCEPT", [2]), ("Other Thing Entirely", "CONCEPT", [3])]
    ents = spark.createDataFrame(rows, "name string, entity_type string, chunk_ids array<bigint>").withColumn("key", F.lower("name"))
    got = {r.name: r.canonical for r in gr.resolve_fuzzy(ents).collect()}
    assert got == {"Belief State Filter": "Belief State Filter", "Belief State Filters": "Belief State Filter", "Other Thing Entirely": "Other Thing Entirely"}


def test_toy_graph(spark):
    edges = spark.createDataFrame([("a", "b", "T", 1.0, [1]), ("a", "b", "T", 2.0, [2]), ("c", "b", "T", 1.0, [3]), ("d", "c", "T", 1.0, [4])], "src string, dst string, relation_type string, weight double, chunk_ids array<bigint>")
    vertices = spark.createDataFrame([(x,) for x in "abcdz"], "name string")
    merged = {(r.src, r.dst): r.weight for r in gr.merge_edges(edges).collect()}
    assert merged == {("a", "b"): 3.0, ("c", "b"): 1.0, ("d", "c"): 1.0}
    starts = spark.createDataFrame([("a",)], "start string")
    met = {(r.hop, r.src, r.dst) for r in gr.neighbours(gr.merge_edges(edges), starts, 2).collect()}
    assert met == {(1, "a", "b"), (2, "a", "b"), (2, "c", "b")}
    assert {r.name: r.community for r in gr.communities(vertices, edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "z": "z"}
    assert {r.name: r.degree for r in gr.degrees(vertices, edges).collect()}["z"] == 0


def test_tokenisers(spark):
    row = spark.range(1).select(tx.words_by_space(F.lit(" A b c\n")).alias("a"), tx.word_tokens(F.lit("Don't é_1")).alias("b"), tx.alnum_tokens(F.lit("x_y-2")).alias("c"), tx.ascii_words(F.lit("the éabc ab1 word")).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (["a", "b", "c"], ["don", "t", "é_1"], ["x", "y", "2"], ["the", "word"])


def test_limiter_refunds_and_router_rests():
    now = [0.0]
    limiter = rag.RateLimiter(60, 60, 6000, clock=lambda: now[0])
    assert not limiter.acquire("x" * 4000, 10) and limiter.buckets[0].level == 60
    assert limiter.acquire("x" * 40, 10)
    calls = []

    def bad(_):
        calls.append(1)
        raise rag.GenerationError("no")

    router = rag.Router([("bad", bad), ("good", lambda p: p.upper())], clock=lambda: now[0])
    assert [router.generate("x") for _ in range(5)] == [("good", "X")] * 5 and len(calls) == 3
    now[0] = 61
    router.generate("x")
    assert len(calls) == 4
    waits = []
    with pytest.raises(rag.GenerationError):
        rag.with_retries(lambda: bad(""), 3, 1.0, waits.append)
    assert len(waits) == 2 and 2 <= waits[1] <= 2.2


def test_louvain_raises_modularity(spark):
    rnd = random.Random(3)
    names = [f"{g}{i}" for g in "abc" for i in range(8)]
    pairs = {tuple(sorted(rnd.sample([n for n in names if n[0] == g], 2))) for g in "abc" for _ in range(40)} | {("a0", "b0"), ("b1", "c1"), ("a2", "c2")}
    edges = spark.createDataFrame([(a, b, "R", 1.0, [1]) for a, b in sorted(pairs)], "src string, dst string, relation_type string, weight double, chunk_ids array<bigint>")
    vertices = spark.createDataFrame([(n,) for n in [*names, "z"]], "name string")
    found = gr.louvain(vertices, edges)
    got = {r.name: r.community for r in found.collect()}
    assert got == {n: f"{n[0]}0" for n in names} | {"z": "z"}

    degree = {n: sum(n in p for p in pairs) for n in names}
    m2 = 2 * len(pairs)
    plain = sum(2 for a, b in pairs if got[a] == got[b]) / m2 - sum((sum(degree[n] for n in names if n[0] == g) / m2) ** 2 for g in "abc")
    assert abs(gr.modularity(edges, found) - plain) < 1e-9
    assert gr.modularity(edges, found) > gr.modularity(edges, gr.communities(vertices, edges)) + 0.3
    assert sorted(gr.louvain(vertices, edges.limit(0)).collect()) == sorted((n, n) for n in [*names, "z"])


def test_ppmi_matches_plain_counts_and_shuffles_no_postings(spark):
    rnd = random.Random(5)
    names = [f"w{i}" for i in range(40)]
    texts = ["", "of the", "w1", *(" ".join(rnd.choices(names, k=rnd.randint(1, 60))) for _ in range(600))]
    queries = ["w1 w2 w2 zz", "zz", "", *(" ".join(rnd.choices(names, k=5)) for _ in range(300))]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id bigint, fmt string")
    freq = Counter(w for t in texts for w in t.split() if w in names and len(w) > 2)
    seqs = [[w for w in t.split() if w in freq] for t in texts]
    pairs = Counter(p for s in seqs for i, a in enumerate(s) for b in s[i + 1 : i + 6] for p in ((a, b), (b, a)))
    vocabulary = sc.ppmi_vocabulary(chunks)
    assert {(r.term, r.ctx): r.n for r in sc.ppmi_cooccurrence(chunks, vocabulary).collect()} == pairs
    w = {(a, b): round(math.log2(n * sum(freq.values()) / (freq[a] * freq[b] * 10)), 9) for (a, b), n in pairs.items()}
    of = lambda t: Counter({b: sum(v * t.split().count(a) for (a, c), v in w.items() if c == b and v > 0) for b in freq})
    norm = lambda e: math.sqrt(sum(v * v for v in e.values()))
    embedded = [of(t) for t in texts[:60]]
    scores = sc.ppmi(asked(spark, *queries), chunks)
    got = {(r.query_id, r.chunk_id): r.score for r in scores.where("query_id < 20 and chunk_id < 60").collect()}
    want = {}
    for i, q in enumerate(map(of, queries[:20])):
        for j, c in enumerate(embedded):
            if (dot := sum(v * c[b] for b, v in q.items())) > 0:
                want[i, j] = dot / norm(q) / norm(c)
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-7 for k, v in want.items())
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()


def test_jaccard_of_all_pairs_builds_no_grid_of_sets(spark):
    rnd = random.Random(6)
    sets = lambda n: [[], *(rnd.sample("abcdefghijklmnop", rnd.randint(0, 9)) for _ in range(n))]
    a, b = sets(300), sets(530)
    scores = sc.jaccard(spark.createDataFrame(list(enumerate(a)), "query_id bigint, words array<string>"), spark.createDataFrame(list(enumerate(b)), "chunk_id bigint, words array<string>"))
    got = {(r.query_id, r.chunk_id): r.score for r in scores.collect()}
    want = {(i, j): round(len({*x} & {*y}) / len({*x} | {*y}), 9) if x and y else 0.0 for i, x in enumerate(a) for j, y in enumerate(b)}
    assert got == want
    none = spark.createDataFrame([], "query_id bigint, words array<string>")
    assert sc.jaccard(none, spark.createDataFrame(list(enumerate(b)), "chunk_id bigint, words array<string>")).count() == 0


def test_mean_idf_does_not_depend_on_the_order_of_terms(spark):
    docs = [" ".join(["all", *(f"d{i}x{j}" for j in range(60_000 + 10_000 * i))]) for i in range(3)]
    raw = {"all": math.log(0.5) - math.log(3.5), "one": math.log(2.5) - math.log(1.5)}
    n, avgdl = 210_000, 70_001
    mean = math.fsum([raw["all"], *[raw["one"]] * n]) / (n + 1)
    for parts in (1, 3):
        chunks = spark.createDataFrame(list(enumerate(docs)), "chunk_id bigint, fmt string").repartition(parts)
        got = {r.chunk_id: r.score for r in sc.bm25_indexed(asked(spark, "all"), sc.TermIndex.build(chunks)).collect()}
        for i in range(3):
            want = 0.25 * mean * 2.5 / (1 + 1.5 * (0.25 + 0.75 * (60_001 + 10_000 * i) / avgdl))
            assert abs(got[i] - want) < 2e-15 * want


def test_units_round_as_spark_does(spark):
    rnd = random.Random(7)
    halves = [(2 * rnd.randrange(10**9) + 1) / 2e6 for _ in range(3000)]
    xs = [0.0, -0.0, 1e-7, 5e-7, 4.999999999999999e-7, 0.1234565, 123456.7890125]
    xs += [y for x in halves for y in (x, math.nextafter(x, 0), math.nextafter(x, math.inf), rnd.random())]
    xs += [-x for x in xs]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", F.round("x", 6).alias("x")).orderBy("i").collect()
    assert (sc.units(np.array(xs)) / 1e6).tolist() == [r.x for r in got]


@pytest.mark.parametrize(("n", "depth", "entries"), [(1500, 10, None), (1500, 3, 200), (25, 10, None), (7, 10, None), (0, 10, None)])
def test_ppmi_fusion_equals_whole_rankings_and_writes_no_grid(spark, monkeypatch, n, depth, entries):
    rnd = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta", "kappa", "of", "w1"]
    # few texts, so that many scores are equal, and ids in no order of the rows
    pool = ["", "of the", "rare word", *(" ".join(rnd.choices(words, k=rnd.randint(2, 9))) for _ in range(60))]
    ids = rnd.sample(range(-50, 5 * n + 50), n)
    chunks = spark.createDataFrame([(i, "d", 1, "s", rnd.choice(pool)) for i in ids], CHUNK).repartition(5)
    engine = SearchEngine(spark, chunks)
    asks = ["alpha beta beta", "", "zz", "rare", "word of", *(" ".join(rnd.choices(words, k=4)) for _ in range(15))]
    queries = asked(spark, *asks)

    rows = []

    def counted(df, made=tk.cut):
        out = made(df)
        rows.append(out.count())
        return out

    if entries:
        monkeypatch.setattr(tk, "HEAD_ENTRIES", entries)  # several passes
    monkeypatch.setattr(tk, "cut", counted)
    if depth < n:
        found = engine.search(queries, "ppmi", depth).collect()
    else:
        index = sc.TermIndex.build(engine.chunks, tx.alnum_tokens)
        found = tk.top_fused_blocks(index, sc.ppmi_and_bm25(queries, engine.chunks, index), 2, queries, depth).collect()
    monkeypatch.undo()
    assert max(rows) <= max(len(asks) * 2 * (2 * (60 + depth) - 60), n)

    ranks = []
    index = sc.TermIndex.build(engine.chunks, tx.alnum_tokens)
    for scores in (sc.ppmi(queries, engine.chunks), sc.bm25_indexed(queries, index, floor=None, tokens=tx.alnum_tokens)):
        known = {(r.query_id, r.chunk_id): r.score for r in scores.select("query_id", "chunk_id", F.round("score", 6).alias("score")).collect()}
        ranks.append({(q, c): r for q in range(len(asks)) for r, c in enumerate(sorted(ids, key=lambda c: (-known.get((q, c), 0.0), c)), start=1)})
    one, two = ranks
    want = {}
    for q in range(len(asks)):
        score = {c: round(1 / (60 + one[q, c]) + 1 / (60 + two[q, c]), 12) for c in ids}
        want[q] = sorted(ids, key=lambda c: (-score[c], one[q, c], two[q, c], c))[:depth]
    got = {q: [r.chunk_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in range(len(asks))}
    assert got == want
