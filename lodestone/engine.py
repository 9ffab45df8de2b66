"""The facade: one corpus of chunks, searched by named strategies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import dense, rag
from lodestone.operators import evaluation as ev
from lodestone.operators import fusion as fu
from lodestone.operators import generation as gn
from lodestone.operators import graph as gr
from lodestone.operators import postprocess as pp
from lodestone.operators import scoring as sc
from lodestone.operators import topk as tk
from lodestone.functions.text import alnum_tokens, word_tokens, words_by_space
from lodestone.sources.cut import cut
from lodestone.sources.tables import with_format


class StrategyNotFound(KeyError):
    """No strategy has this name or holds it."""


class SearchEngine:
    """Searches chunks (chunk_id, doc_name, page_num, section, text).

    Every method takes a batch of queries (query_id, query_text); one query is a batch of
    one. Only what a strategy needs is planned.
    """

    def __init__(self, spark: SparkSession, chunks: DataFrame, encoder: Callable = dense.hashing_encoder, scorer: Callable = dense.overlap_scorer, query_encoder: Callable | None = None):
        self.spark, self.chunks = spark, with_format(chunks)
        self.encoder, self.scorer = encoder, scorer
        #: Of asymmetric encoders, the one for queries.
        self.query_encoder = query_encoder or encoder
        self._graph: tuple[DataFrame, DataFrame, DataFrame] | None = None
        self._indexes: dict[str, sc.TermIndex] = {}
        #: Each gives (query_id, chunk_id, score, rank) to some depth.
        self.strategies: dict[str, Callable[[DataFrame, int], DataFrame]] = {
            "bm25": lambda q, k: self._top(self._bm25(q, k=k), q, k),
            "tfidf": lambda q, k: self._top(self._tfidf(q, k=k), q, k),
            "linear_0.3": lambda q, k: self._linear(q, F.lit(0.3), k),
            "linear_0.5": lambda q, k: self._linear(q, F.lit(0.5), k),
            "linear_0.7": lambda q, k: self._linear(q, F.lit(0.7), k),
            "rrf": self._rrf,
            "rrf_dedup": lambda q, k: self._dedup(self._to_depth(self._rrf, q), pp.MAX_RESULTS),
            "rrf_dedup_mmr": lambda q, k: self._mmr(self._dedup(self._to_depth(self._rrf, q), pp.MMR_POOL)),
            "ppmi": self._ppmi,
            "cross_encoder": self._cross_encoder,
            "sentence_transformer": lambda q, k: self._dense(q, "", "", k),
            "adaptive": lambda q, k: self._linear(q, fu.adaptive_alpha(F.col("query_text")), k),
            "asymmetric": lambda q, k: self._dense(q, "query: ", "passage: ", k),
            "rrf_graph_dedup_mmr": lambda q, k: self._mmr(self._dedup(self._to_depth(self._rrf_graph, q), pp.MMR_POOL)),
            "vector": lambda q, k: self._dense(q, "", "", k),
            "graph_only": lambda q, k: self._graph_top(q, 50),
            "rrf_graph": self._rrf_graph,
            "rrf_graph_dedup": lambda q, k: self._dedup(self._to_depth(self._rrf_graph, q), pp.MAX_RESULTS),
        }
        self.aliases = {"graph": "rrf_graph_dedup_mmr"}

    def _index(self, tokens) -> sc.TermIndex:
        """The corpus' postings under a tokenizer, made once."""
        if tokens.__name__ not in self._indexes:
            self._indexes[tokens.__name__] = sc.TermIndex.build(self.chunks, tokens)
        return self._indexes[tokens.__name__]

    def save_indexes(self, path: str) -> None:
        """Writes the postings that searches need, for ``load_indexes`` of a later engine."""
        for tokens in (words_by_space, word_tokens, alnum_tokens):
            self._index(tokens).save(f"{path}/{tokens.__name__}")

    def load_indexes(self, path: str) -> None:
        for tokens in (words_by_space, word_tokens, alnum_tokens):
            self._indexes[tokens.__name__] = sc.TermIndex.load(self.spark, f"{path}/{tokens.__name__}")

    def _bm25(self, q, digits=sc.DIGITS, k=None):
        return tk.Sparse.of(sc.bm25_indexed(q, self._index(words_by_space), k=k), q, digits=digits)

    def _tfidf(self, q, digits=sc.DIGITS, k=None):
        return tk.Sparse.of(sc.tfidf_indexed(q, self._index(word_tokens), k=k), q, digits=digits)

    def _top(self, sparse, q, k):
        return tk.top_ranked(sparse, q, self.chunks, k)

    def _linear(self, q, alpha, k):
        alphas = q.select("query_id", alpha.alias("alpha"))
        return self._top(tk.scaled_linear([self._tfidf(q, None), self._bm25(q, None)], alphas, q, self.chunks), q, k)

    @staticmethod
    def _to_depth(fused, q):
        """A fused ranking to any depth; its lists are scored once."""
        lists = fused(q, None)
        return lambda depth: lists(depth)

    def _rrf(self, q, k, extra=()):
        lists = [self._bm25(q), self._tfidf(q)]
        to_depth = lambda depth: tk.top_fused(lists, q, self.chunks, depth, list(extra))
        return to_depth if k is None else to_depth(k)

    def _dedup(self, ranking, most):
        return pp.dedup(ranking, self.chunks.select("chunk_id", "fmt"), most)

    def _mmr(self, pool):
        pool = cut(pool)
        return pp.mmr(pool, sc.tfidf_vectors(self._index(word_tokens), pool))

    def _ppmi(self, q, k):
        index = self._index(alnum_tokens)
        if k < index.n_chunks:
            return tk.top_fused_blocks(index, sc.ppmi_and_bm25(q, self.chunks, index), 2, q, k)
        # every rank is asked for
        lists = [sc.ppmi(q, self.chunks), sc.bm25_indexed(q, index, floor=None, tokens=alnum_tokens)]
        return tk.top_fused([tk.Sparse.of(x, q) for x in lists], q, self.chunks, k)

    def _cross_encoder(self, q, k):
        """The reranked and deduplicated head, then the rest of the fused ranking, ranked on."""
        fused = cut(self._rrf(q, max(k, 50)))
        again = pp.rerank(fused, dense.pair_scores(fused.where("rank <= 50"), q, self.chunks, self.scorer))
        head = self._dedup(again.where("rank <= 50"), pp.MAX_RESULTS)
        both = head.withColumn("part", F.lit(0)).unionByName(again.where("rank > 50").withColumn("part", F.lit(1)))
        order = Window.partitionBy("query_id").orderBy("part", "rank")
        return both.withColumn("rank", F.row_number().over(order)).drop("part")

    def _dense(self, q, query_prefix, passage_prefix, k):
        asked = dense.encode(q, "query_text", self.query_encoder if query_prefix else self.encoder, query_prefix).select("query_id", F.col("vector").alias("qv"))
        table = dense.encode(self.chunks, "fmt", self.encoder, passage_prefix).select("chunk_id", F.col("vector").alias("v"))
        return sc.dense_top(asked, table, k)

    @property
    def graph(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(vertices, edges, communities), mined once."""
        if self._graph is None:
            vertices, edges = map(cut, gr.extract(self.chunks))
            self._graph = vertices, edges, gr.communities(vertices, edges)
        return self._graph

    def _graph_top(self, q, most):
        scores = gr.graph_scores(q, *self.graph, self.chunks.count())
        return sc.ranked(scores.where("score >= 0.2"), most)

    def _rrf_graph(self, q, k):
        return self._rrf(q, k, [(cut(self._graph_top(q, 5)), 0.35)])

    def resolve(self, name: str) -> str:
        """The strategy of this name or alias, else the first that holds it in any case."""
        name = self.aliases.get(name, name)
        if name in self.strategies:
            return name
        for known in self.strategies:
            if name.lower() in known.lower():
                return known
        raise StrategyNotFound(name)

    def rank(self, queries: DataFrame, strategy: str = "rrf_dedup_mmr", depth: int = 100) -> DataFrame:
        """(query_id, chunk_id, score, rank), to some depth."""
        return self.strategies[self.resolve(strategy)](queries, depth).where(F.col("rank") <= depth)

    def search(self, queries: DataFrame, strategy: str = "rrf_dedup_mmr", top_k: int = 5) -> DataFrame:
        """The best chunks of each query with their columns, score and rank."""
        top = self.rank(queries, strategy, top_k)
        return top.join(self.chunks.drop("fmt"), "chunk_id").withColumn("strategy", F.lit(self.resolve(strategy)))

    def ask(self, query: str, strategy: str = "graph", top_k: int = 3) -> dict:
        """An extractive answer with its sources, context and citation levels."""
        queries = self.spark.createDataFrame([(0, query)], "query_id bigint, query_text string")
        results = cut(self.search(queries, strategy, top_k))
        answer = rag.extractive_answer(queries, results).first()
        context = rag.build_context(results).first()
        levels = rag.citations(results, queries).orderBy("rank").select("rank", "doc_name", "level").collect()
        return {"query": query, "answer": answer.answer, "context": context.context if context else "", "citations": [r.asDict() for r in levels], "strategy": self.resolve(strategy)}

    def generate(self, queries: DataFrame, pipeline: gn.GenerationPipeline, strategy: str = "graph", top_k: int = 3) -> list[gn.Answer]:
        """Answers of a generator to a batch of queries, from the strategy's best chunks and, with
        a graph strategy, the relations around the entities that a query names."""
        results = cut(self.search(queries, strategy, top_k))
        triplets = gn.triplets(queries, *self.graph[:2]) if "graph" in self.resolve(strategy) else None
        return pipeline.answer(queries, results, triplets, self.resolve(strategy))

    def evaluate(self, queries: DataFrame, truth: DataFrame, strategies: list[str]) -> DataFrame:
        """Per strategy the mean metrics over queries, with truth (query_id, chunk_id)."""
        results = None
        for name in strategies:
            one = self.rank(queries, name, self.chunks.count()).select("query_id", "chunk_id", "rank", F.lit(self.resolve(name)).alias("strategy"))
            results = one if results is None else results.unionByName(one)
        several = truth.groupBy("query_id").agg((F.count("*") > 1).alias("is_multihop"))
        return ev.averages(ev.metrics(results, truth), several)
