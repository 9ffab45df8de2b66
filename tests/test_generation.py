import pytest

from lodestone.engine import SearchEngine
from lodestone.operators import generation as gn
from lodestone.operators import rag


def test_names_and_detection():
    aliases = {"acme": {"big": "acme-big-2", "acme-small": "acme-small-1"}}
    assert gn.model_name(" Acme ", "BIG", aliases) == "acme-big-2"
    assert gn.model_name("acme", "acme_small", aliases) == "acme-small-1"
    assert gn.model_name("acme", "Other", aliases) == "Other"

    def broken():
        raise ImportError("no client")

    providers = {"a": ("A_KEY", broken), "b": ("B_KEY", lambda: str.upper)}
    assert gn.detect(providers, env={"A_KEY": "x", "B_KEY": "y"})("q") == "Q"
    assert gn.detect(providers, prefer="B", env={})("q") == "Q"
    with pytest.raises(ImportError):
        gn.detect(providers, prefer="a", env={})
    with pytest.raises(ValueError, match="A_KEY, B_KEY"):
        gn.detect(providers, env={})


def test_pipeline_routes_retries_and_limits(spark):
    chunks = spark.createDataFrame([(1, "d", 1, "Overview", "HNSW and RRF meet in rank fusion."), (2, "e", 1, "Overview", "HNSW needs memory.")], "chunk_id bigint, doc_name string, page_num int, section string, text string")
    queries = spark.createDataFrame([(0, "what is HNSW"), (1, "anything")], "query_id bigint, query_text string")
    calls = []

    def refused(text):
        calls.append("refused")
        raise gn.NotAuthorized("key", provider="a")

    def flaky(text):
        calls.append("flaky")
        if calls.count("flaky") == 1:
            raise gn.RateLimited("slow down", "rpm")
        return "an answer"

    engine = SearchEngine(spark, chunks)
    pipeline = gn.GenerationPipeline(routes=[("a", refused), ("b", flaky)], sleep=lambda s: None)
    got = engine.generate(queries.where("query_id = 0"), pipeline, "graph_only", 2)
    assert [(a.answer, a.route) for a in got] == [("an answer", "b")]
    assert calls == ["refused", "flaky", "flaky"]
    assert "what is HNSW" in got[0].prompt and "(HNSW) -[CO_OCCURS_WITH]-> (RRF)" in got[0].prompt
    assert [c.rank for c in got[0].citations] == [1, 2]
    none = engine.search(queries, "bm25", 1).where("query_id = 0")
    answers = gn.GenerationPipeline(generator=lambda t: "yes").answer(queries, none)
    assert [a.answer for a in answers] == ["yes", gn.NOTHING_FOUND]
    now = [0.0]
    limiter = rag.RateLimiter(1, 1e6, 1e6, lambda: 0.0)
    limited = gn.GenerationPipeline(generator=lambda t: "yes", limiter=limiter, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + 1))
    assert limited.answer(queries, none)[0].answer == "yes"
    with pytest.raises(gn.RateLimited):
        limited.answer(queries, none)
