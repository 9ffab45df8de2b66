"""Queries over scorers, fusion, post-processing, strategies and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import evaluation as ev
from lodestone.operators import fusion as fu
from lodestone.operators import postprocess as pp
from lodestone.operators import scoring as sc
from lodestone.operators import topk as tk
from lodestone.plans.base import ALNUM, SPLIT, TFIDF, C, bm25_sql, dedup_sql, mmr_sql, norm_sql, query, rank_sql, rrf_sql, top_sql
from lodestone.sources import tables as tb
from lodestone.sources.cut import cut

TOP_K = 10
BM, BM2 = bm25_sql("bm"), bm25_sql("b2", ALNUM, floor=False)


class Base:
    """The inputs and base scores of one corpus, each tokenised and scored once a query."""

    def __init__(self, spark, sf_dir):
        self.chunks, self.queries = tb.chunks(spark, sf_dir), tb.search_queries(spark, sf_dir)
        self.made = {}

    def once(self, name: str, make):
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    def index(self, tokens) -> sc.TermIndex:
        return self.once(tokens.__name__, lambda: sc.TermIndex.build(self.chunks, tokens))

    def everywhere(self, scores: DataFrame) -> DataFrame:
        return sc.on_all(scores, self.queries, self.chunks)

    def bm25_matched(self, k: int | None = None) -> DataFrame:
        return sc.bm25_indexed(self.queries, self.index(tx.words_by_space), k=k)

    def tfidf_matched(self, k: int | None = None) -> DataFrame:
        return sc.tfidf_indexed(self.queries, self.index(tx.word_tokens), k=k)

    def bm25(self) -> DataFrame:
        return self.everywhere(self.bm25_matched())

    def tfidf(self) -> DataFrame:
        return self.everywhere(self.tfidf_matched())

    def sparse(self, name: str, digits: int | None = sc.DIGITS) -> tk.Sparse:
        """Scores of matched chunks, written once."""
        make = {"bm25": self.bm25_matched, "tfidf": self.tfidf_matched}
        return self.once(f"sparse {name} {digits}", lambda: tk.Sparse.of(make[name](), self.queries, digits=digits))

    def top(self, name: str, k: int) -> DataFrame:
        """The head of one scorer's ranking, from the best of each block of chunks."""
        best = {"bm25": self.bm25_matched, "tfidf": self.tfidf_matched}[name](k)
        return tk.top_ranked(tk.Sparse.of(best, self.queries), self.queries, self.chunks, k)

    def linear(self, alphas: DataFrame) -> tk.Sparse:
        return tk.scaled_linear([self.sparse("tfidf", None), self.sparse("bm25", None)], alphas, self.queries, self.chunks)

    def fused(self, depth: int, extra=()) -> DataFrame:
        """The head of the reciprocal-rank fusion of BM25 and TF-IDF."""
        return tk.top_fused([self.sparse("bm25"), self.sparse("tfidf")], self.queries, self.chunks, depth, list(extra))

    def texts(self) -> DataFrame:
        return self.chunks.select("chunk_id", "fmt")

    def mmr(self, pool: DataFrame) -> DataFrame:
        return pp.mmr(pool, sc.tfidf_vectors(self.index(tx.word_tokens), pool))


def _scores(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("r1_bm25_okapi", f"WITH {C}, {BM} SELECT query_id, chunk_id, round(score, 6) AS score FROM bm")
def bm25_okapi(spark, sf_dir):
    return _scores(Base(spark, sf_dir).bm25())


@query("r2_bm25_positive", f"WITH {C}, {BM2} SELECT query_id, chunk_id, round(score, 6) AS score FROM b2_s")
def bm25_positive(spark, sf_dir):
    b = Base(spark, sf_dir)
    return _scores(sc.bm25(b.queries, b.chunks, floor=None, tokens=tx.alnum_tokens))


@query("r3_tfidf_cosine", f"WITH {C}, {TFIDF} SELECT query_id, chunk_id, round(score, 6) AS score FROM ti")
def tfidf_cosine(spark, sf_dir):
    return _scores(Base(spark, sf_dir).tfidf())


@query("r4_tfidf_query_vectors", f"WITH {C}, {TFIDF} SELECT query_id, term, round(qw, 9) AS qw FROM ti_q")
def tfidf_query_vectors(spark, sf_dir):
    b = Base(spark, sf_dir)
    return sc.tfidf_query_vectors(b.queries, sc.tfidf_weights(b.chunks)).select("query_id", "term", F.round("qw", 9).alias("qw"))


STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)
VOCAB = f"""tok AS (SELECT chunk_id, unnest({ALNUM.format('fmt')}) AS term, generate_subscripts({ALNUM.format('fmt')}, 1) AS pos FROM c),
voc AS (SELECT term, count(*) AS freq FROM tok WHERE length(term) > 2 AND term NOT IN ({STOP}) GROUP BY term ORDER BY freq DESC, term LIMIT 1500)"""
COOC = f"""{VOCAB},
seq AS (SELECT chunk_id, term, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS p FROM tok JOIN voc USING (term)),
co AS (SELECT a.term AS term, b.term AS ctx, count(*) AS n FROM seq a JOIN seq b ON a.chunk_id = b.chunk_id AND b.p BETWEEN a.p - 5 AND a.p + 5 AND a.p <> b.p GROUP BY ALL)"""
PPMI = f"""{COOC},
pw AS (SELECT term, ctx, w FROM (SELECT co.term, ctx, round(log2(n * (SELECT sum(freq) FROM voc)::DOUBLE / (t.freq * x.freq * 10.0::DOUBLE)), 9) AS w
  FROM co JOIN voc t ON t.term = co.term JOIN voc x ON x.term = co.ctx) WHERE w > 0
  QUALIFY row_number() OVER (PARTITION BY term ORDER BY w DESC, ctx) <= 50)"""
PPMI_SCORE = f"""{PPMI},
qe AS (SELECT query_id, ctx, sum(w) AS v FROM (SELECT query_id, unnest({ALNUM.format('query_text')}) AS term FROM q) JOIN pw USING (term) GROUP BY ALL),
ce AS (SELECT chunk_id, ctx, sum(tf * w) AS v FROM (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL) JOIN pw USING (term) GROUP BY ALL),
qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM qe GROUP BY ALL), cn AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM ce GROUP BY ALL),
pp_s AS (SELECT query_id, chunk_id, sum(qe.v * ce.v) / any_value(qn.n) / any_value(cn.n) AS score FROM qe JOIN ce USING (ctx) JOIN qn USING (query_id) JOIN cn USING (chunk_id) GROUP BY ALL)"""


@query("r5_ppmi_vocabulary", f"WITH {C}, {VOCAB} SELECT term, freq FROM voc")
def ppmi_vocabulary(spark, sf_dir):
    return sc.ppmi_vocabulary(tb.chunks(spark, sf_dir))


@query("r6_ppmi_cooccurrence", f"WITH {C}, {COOC} SELECT term, ctx, n FROM co")
def ppmi_cooccurrence(spark, sf_dir):
    chunks = tb.chunks(spark, sf_dir)
    return sc.ppmi_cooccurrence(chunks, sc.ppmi_vocabulary(chunks))


@query("r7_ppmi_weights", f"WITH {C}, {PPMI} SELECT term, ctx, w FROM pw")
def ppmi_weights(spark, sf_dir):
    chunks = tb.chunks(spark, sf_dir)
    vocabulary = sc.ppmi_vocabulary(chunks)
    return sc.ppmi_weights(sc.ppmi_cooccurrence(chunks, vocabulary), vocabulary)


@query("r8_ppmi_query_embeddings", f"WITH {C}, {PPMI_SCORE} SELECT query_id, ctx, round(v, 9) AS v FROM qe")
def ppmi_query_embeddings(spark, sf_dir):
    b = Base(spark, sf_dir)
    vocabulary = sc.ppmi_vocabulary(b.chunks)
    weights = sc.ppmi_weights(sc.ppmi_cooccurrence(b.chunks, vocabulary), vocabulary)
    return sc.ppmi_embeddings(b.queries, "query_id", "query_text", weights).select("query_id", "ctx", F.round("v", 9).alias("v"))


@query("r10_ppmi_scores", f"WITH {C}, {PPMI_SCORE} SELECT query_id, chunk_id, round(score, 6) AS score FROM pp_s WHERE score > 0")
def ppmi_scores(spark, sf_dir):
    b = Base(spark, sf_dir)
    return _scores(sc.ppmi(b.queries, b.chunks))


# --- dense: every fiftieth vector is a query against all vectors


def _vectors(spark, sf_dir):
    table = tb.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    asked = table.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("v").alias("qv"), F.col("label").alias("query_label"))
    return asked, table


DENSE = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), d AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_cosine_similarity(a.v, b.v) AS score, a.label AS ql, b.label AS cl FROM e a CROSS JOIN e b WHERE a.vec_id % 50 = 0)"


@query("r11_dense_cosine", f"WITH {DENSE} SELECT query_id, chunk_id, round(score, 6) AS score FROM d")
def dense_cosine(spark, sf_dir):
    asked, table = _vectors(spark, sf_dir)
    return _scores(sc.dense(asked.drop("query_label"), table.drop("label")))


@query("r16_vector_search", f"WITH {DENSE}, {rank_sql('k', 'd')} {top_sql('k')}")
def vector_search(spark, sf_dir):
    asked, table = _vectors(spark, sf_dir)
    return sc.dense_top(asked.drop("query_label"), table.drop("label"), TOP_K)


@query("r17_filtered_vector_search", f"WITH {DENSE}, s AS (SELECT * FROM d WHERE ql = cl), {rank_sql('k', 's')} {top_sql('k')}")
def filtered_vector_search(spark, sf_dir):
    asked, table = _vectors(spark, sf_dir)
    pairs = asked.join(table, F.col("query_label") == F.col("label")).select("query_id", "chunk_id", tx.cosine(F.col("qv"), F.col("v")).alias("score"))
    return sc.ranked(pairs, TOP_K)


@query("r13_prefixed_texts", f"WITH {C} SELECT chunk_id AS id, 'passage: ' || fmt AS prefixed FROM c UNION ALL SELECT query_id, 'query: ' || query_text FROM q")
def prefixed_texts(spark, sf_dir):
    b = Base(spark, sf_dir)
    return b.chunks.select(F.col("chunk_id").alias("id"), F.concat(F.lit("passage: "), "fmt").alias("prefixed")).unionByName(b.queries.select(F.col("query_id").alias("id"), F.concat(F.lit("query: "), "query_text").alias("prefixed")))


# --- aggregates over postings


POST = f"p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({ALNUM.format('fmt')}) AS term FROM c) GROUP BY ALL)"


@query("a1_term_frequency", f"WITH {C}, {POST} SELECT * FROM p")
def term_frequency(spark, sf_dir):
    return sc.postings(tb.chunks(spark, sf_dir), tx.alnum_tokens)


@query("a2_document_frequency", f"WITH {C}, {POST} SELECT term, count(*) AS df FROM p GROUP BY term")
def document_frequency(spark, sf_dir):
    return sc.postings(tb.chunks(spark, sf_dir), tx.alnum_tokens).groupBy("term").agg(F.count("*").alias("df"))


@query("a3_average_length", f"WITH {C} SELECT count(*) AS n, round(avg(len({SPLIT.format('fmt')})), 9) AS avgdl FROM c")
def average_length(spark, sf_dir):
    return sc.lengths(tb.chunks(spark, sf_dir)).agg(F.count("*").alias("n"), F.round(F.avg("dl"), 9).alias("avgdl"))


@query("a4_cooccurrence_totals", f"WITH {C}, {COOC} SELECT (SELECT sum(n)::BIGINT FROM co) AS pairs, (SELECT sum(freq)::BIGINT FROM voc) AS tokens")
def cooccurrence_totals(spark, sf_dir):
    chunks = tb.chunks(spark, sf_dir)
    vocabulary = sc.ppmi_vocabulary(chunks)
    return sc.ppmi_cooccurrence(chunks, vocabulary).agg(F.sum("n").alias("pairs")).crossJoin(vocabulary.agg(F.sum("freq").alias("tokens")))


# --- rankings and fusion


@query("w1_total_ranking", f"WITH {C}, {BM}, {rank_sql('k', 'bm')} SELECT query_id, chunk_id, score, rank FROM k")
def total_ranking(spark, sf_dir):
    return sc.ranked(Base(spark, sf_dir).bm25())


@query("w8_pool_split", f"WITH {C}, {BM}, {rank_sql('k', 'bm')} SELECT query_id, rank <= 50 AS head, count(*) AS n, min(rank)::INTEGER AS first_rank FROM k GROUP BY ALL")
def pool_split(spark, sf_dir):
    return sc.ranked(Base(spark, sf_dir).bm25()).groupBy("query_id", (F.col("rank") <= 50).alias("head")).agg(F.count("*").alias("n"), F.min("rank").alias("first_rank"))


@query("u1_min_max", f"WITH {C}, {BM}, {norm_sql('x', 'bm')} SELECT query_id, chunk_id, round(score, 6) AS score FROM x")
def min_max(spark, sf_dir):
    return _scores(fu.min_max(Base(spark, sf_dir).bm25()))


@query("u3_adaptive_alpha", f"WITH {C} SELECT query_id, CASE WHEN len({SPLIT.format('query_text')}) <= 4 THEN 0.3::DOUBLE WHEN len(list_intersect({SPLIT.format('query_text')}, [{', '.join(repr(w) for w in tx.INTERROGATIVES)}])) > 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS alpha FROM q")
def adaptive_alpha(spark, sf_dir):
    return tb.search_queries(spark, sf_dir).select("query_id", fu.adaptive_alpha(F.col("query_text")).alias("alpha"))


LINEAR = f"WITH {C}, {BM}, {TFIDF}, {norm_sql('nb', 'bm')}, {norm_sql('nt', 'ti')}"
BOTH = f"WITH RECURSIVE {C}, {BM}, {TFIDF}, {rank_sql('kb', 'bm')}, {rank_sql('kt', 'ti')}"
RRF = f"{BOTH}, {rrf_sql('f', [('kb', 1.0), ('kt', 1.0)])}"
ALPHA = f"(SELECT query_id, CASE WHEN len({SPLIT.format('query_text')}) <= 4 THEN 0.3::DOUBLE WHEN len(list_intersect({SPLIT.format('query_text')}, [{', '.join(repr(w) for w in tx.INTERROGATIVES)}])) > 0 THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS alpha FROM q)"


def _linear_sql(alpha: str) -> str:
    return f"{LINEAR}, l AS (SELECT query_id, chunk_id, a.alpha * nt.score + (1 - a.alpha) * nb.score AS score FROM nt JOIN nb USING (query_id, chunk_id) JOIN {alpha} a USING (query_id)), {rank_sql('k', 'l')} {top_sql('k')}"


@query("strategy_01_bm25", f"WITH {C}, {BM}, {rank_sql('k', 'bm')} {top_sql('k')}")
def strategy_bm25(spark, sf_dir):
    return Base(spark, sf_dir).top("bm25", TOP_K)


@query("strategy_02_tfidf", f"WITH {C}, {TFIDF}, {rank_sql('k', 'ti')} {top_sql('k')}")
def strategy_tfidf(spark, sf_dir):
    return Base(spark, sf_dir).top("tfidf", TOP_K)


def _linear(alpha: float):
    def run(spark, sf_dir):
        b = Base(spark, sf_dir)
        return tk.top_ranked(b.linear(b.queries.select("query_id", F.lit(alpha).alias("alpha"))), b.queries, b.chunks, TOP_K)

    return run


for _n, _alpha in ((3, 0.3), (4, 0.5), (5, 0.7)):
    query(f"strategy_0{_n}_linear_{_alpha}", _linear_sql(f"(SELECT query_id, {_alpha}::DOUBLE AS alpha FROM q)"))(_linear(_alpha))


@query("strategy_06_rrf", f"{RRF} {top_sql('f')}")
def strategy_rrf(spark, sf_dir):
    return Base(spark, sf_dir).fused(TOP_K)


@query("strategy_07_rrf_dedup", f"{RRF}, {dedup_sql('z', 'f', 10)} SELECT query_id, chunk_id, score, rank FROM z")
def strategy_rrf_dedup(spark, sf_dir):
    b = Base(spark, sf_dir)
    return pp.dedup(b.fused, b.texts())


@query("strategy_08_rrf_dedup_mmr", f"{RRF}, {dedup_sql('z', 'f', 20)}, {mmr_sql('m', 'z')} SELECT * FROM m")
def strategy_rrf_dedup_mmr(spark, sf_dir):
    b = Base(spark, sf_dir)
    return b.mmr(cut(pp.dedup(b.fused, b.texts(), most=pp.MMR_POOL)))


@query("strategy_09_ppmi", f"WITH {C}, {BM2}, {PPMI_SCORE}, pa AS (SELECT q.query_id, c.chunk_id, coalesce(score, 0) AS score FROM q CROSS JOIN c LEFT JOIN pp_s s ON s.query_id = q.query_id AND s.chunk_id = c.chunk_id), {rank_sql('kp', 'pa')}, {rank_sql('k2', 'b2')}, {rrf_sql('f', [('kp', 1.0), ('k2', 1.0)])} {top_sql('f')}")
def strategy_ppmi(spark, sf_dir):
    b = Base(spark, sf_dir)
    index = b.index(tx.alnum_tokens)
    return tk.top_fused_blocks(index, sc.ppmi_and_bm25(b.queries, b.chunks, index), 2, b.queries, TOP_K)


#: The stand-in pair scorer in SQL: the share of a query's words that a passage has.
PAIRS = f"""f50 AS (SELECT f.query_id, f.chunk_id, f.rank, list_distinct({SPLIT.format('query_text')}) AS a, list_distinct({SPLIT.format('fmt')}) AS b FROM f JOIN q USING (query_id) JOIN c USING (chunk_id) WHERE f.rank <= 50),
ps AS (SELECT query_id, chunk_id, rank AS before, round(len(list_intersect(a, b))::DOUBLE / greatest(1, len(a)), 9) AS score FROM f50),
ag AS (SELECT query_id, chunk_id, before, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before)::INTEGER AS rank FROM ps)"""


@query("strategy_10_cross_encoder", f"{RRF}, {PAIRS}, {dedup_sql('z', 'ag', 10)} SELECT query_id, chunk_id, score, rank FROM z")
def strategy_cross_encoder(spark, sf_dir):
    """Reranks the fused pool with a pair scorer; here the offline stand-in of ``dense.pair_scores``."""
    from lodestone.operators.dense import pair_scores

    b = Base(spark, sf_dir)
    pool = cut(b.fused(50))
    return pp.dedup(pp.rerank(pool, pair_scores(pool, b.queries, b.chunks)), b.texts(), TOP_K)


@query("strategy_11_sentence_transformer")
def strategy_sentence_transformer(spark, sf_dir):
    """Dense ranking of encoded texts; here with the offline hashing encoder."""
    from lodestone.operators.dense import encode

    b = Base(spark, sf_dir)
    asked = encode(b.queries, "query_text").select("query_id", F.col("vector").alias("qv"))
    return sc.dense_top(asked, encode(b.chunks, "fmt").select("chunk_id", F.col("vector").alias("v")), TOP_K)


@query("strategy_12_adaptive", _linear_sql(ALPHA))
def strategy_adaptive(spark, sf_dir):
    b = Base(spark, sf_dir)
    alphas = b.queries.select("query_id", fu.adaptive_alpha(F.col("query_text")).alias("alpha"))
    return tk.top_ranked(b.linear(alphas), b.queries, b.chunks, TOP_K)


@query("strategy_13_asymmetric")
def strategy_asymmetric(spark, sf_dir):
    """Dense ranking with one encoder for queries and one for passages."""
    from lodestone.operators.dense import encode

    b = Base(spark, sf_dir)
    asked = encode(b.queries, "query_text", prefix="query: ").select("query_id", F.col("vector").alias("qv"))
    return sc.dense_top(asked, encode(b.chunks, "fmt", prefix="passage: ").select("chunk_id", F.col("vector").alias("v")), TOP_K)


@query("strategy_15_vector", f"WITH {DENSE}, {rank_sql('k', 'd')} {top_sql('k')}")
def strategy_vector(spark, sf_dir):
    asked, table = _vectors(spark, sf_dir)
    return sc.dense_top(asked.drop("query_label"), table.drop("label"), TOP_K)


@query("u5_rrf_multi", f"{LINEAR}, {rank_sql('kb', 'bm')}, {rank_sql('kt', 'ti')}, h AS (SELECT query_id, chunk_id, 0.5::DOUBLE * nt.score + 0.5::DOUBLE * nb.score AS score FROM nt JOIN nb USING (query_id, chunk_id)), {rank_sql('kl', 'h')}, {rrf_sql('f', [('kb', 1.0), ('kt', 1.0), ('kl', 1.0)])} {top_sql('f')}")
def rrf_multi(spark, sf_dir):
    b = Base(spark, sf_dir)
    lists = [b.sparse("bm25"), b.sparse("tfidf"), b.linear(b.queries.select("query_id", F.lit(0.5).alias("alpha")))]
    return tk.top_fused(lists, b.queries, b.chunks, TOP_K)


@query("u9_jaccard", f"WITH {C}, w AS (SELECT query_id, list_distinct({SPLIT.format('query_text')}) AS w FROM q), x AS (SELECT chunk_id, list_distinct({SPLIT.format('text')}) AS w FROM c) SELECT query_id, chunk_id, CASE WHEN len(w.w) = 0 OR len(x.w) = 0 THEN 0 ELSE round(len(list_intersect(w.w, x.w))::DOUBLE / len(list_distinct(list_concat(w.w, x.w))), 9) END AS score FROM w CROSS JOIN x")
def jaccard(spark, sf_dir):
    b = Base(spark, sf_dir)
    q = b.queries.select("query_id", F.array_distinct(tx.words_by_space(F.col("query_text"))).alias("words"))
    c = b.chunks.select("chunk_id", F.array_distinct(tx.words_by_space(F.col("text"))).alias("words"))
    return sc.jaccard(q, c)


@query("f9_decorated_results", f"WITH {C}, {BM}, {rank_sql('k', 'bm')} SELECT query_id, 'bm25' AS strategy, rank, chunk_id, score, doc_name, page_num, section, text FROM k JOIN c USING (chunk_id) WHERE rank <= 10")
def decorated_results(spark, sf_dir):
    b = Base(spark, sf_dir)
    return b.top("bm25", TOP_K).join(b.chunks.drop("fmt"), "chunk_id").select("query_id", F.lit("bm25").alias("strategy"), "rank", "chunk_id", "score", "doc_name", "page_num", "section", "text")


@query("e13_ranking_only", f"WITH {C}, {TFIDF}, {rank_sql('k', 'ti')} SELECT query_id, 'tfidf' AS strategy, chunk_id, rank FROM k WHERE rank <= 10")
def ranking_only(spark, sf_dir):
    return Base(spark, sf_dir).top("tfidf", TOP_K).select("query_id", F.lit("tfidf").alias("strategy"), "chunk_id", "rank")


# --- evaluation: a chunk that holds the first sixty characters of an item is its truth


def _truth(spark, sf_dir, base: Base | None = None):
    """Found through the rarest inner word of an item's head: a text that holds the head holds it."""
    b = base or Base(spark, sf_dir)
    items = b.queries.select("query_id", F.substring("query_text", 1, 60).alias("head"))
    # runs of letters and digits with something else on both sides within the head
    inner = F.regexp_extract_all(F.lower("head"), F.lit("(?<=[^\\p{L}\\p{N}])[\\p{L}\\p{N}]+(?=[^\\p{L}\\p{N}])"), F.lit(0))
    words = items.select("query_id", "head", inner.alias("w"))
    index = b.index(tx.alnum_tokens)
    rare = words.select("query_id", "head", F.explode("w").alias("term")).join(index.posts.groupBy("term").agg(F.count("*").alias("df")), "term").groupBy("query_id", "head").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    texts = b.chunks.select("chunk_id", "text", F.col("doc_name").alias("target_doc"))
    found = rare.join(index.posts.select("term", "chunk_id"), "term").join(texts, "chunk_id").where(F.contains("text", "head")).select("query_id", "chunk_id", "target_doc")
    plain = words.where(F.size("w") == 0)
    if not plain.isEmpty():  # heads of a word or two can only be looked for everywhere
        found = found.unionByName(plain.join(texts, F.contains("text", "head")).select("query_id", "chunk_id", "target_doc"))
    return found


def _results(spark, sf_dir, base: Base | None = None):
    """Whole rankings of three strategies; each is scored and ranked once."""
    b = base or Base(spark, sf_dir)
    named = lambda df, s: df.select("query_id", "chunk_id", "rank", F.lit(s).alias("strategy"))
    one, two = (cut(sc.ranked(b.sparse(name).everywhere(b.queries, b.chunks))) for name in ("bm25", "tfidf"))
    return named(one, "bm25").unionByName(named(two, "tfidf")).unionByName(named(fu.ranked_by_fusion(fu.rrf([one, two])), "rrf"))


TRUTH = "tr AS (SELECT query_id, chunk_id, doc_name AS target_doc FROM q JOIN c ON contains(c.text, substr(query_text, 1, 60)))"
RESULTS = f"{RRF}, {TRUTH}, res AS (SELECT 'bm25' AS strategy, query_id, chunk_id, rank FROM kb UNION ALL SELECT 'tfidf', query_id, chunk_id, rank FROM kt UNION ALL SELECT 'rrf', query_id, chunk_id, rank FROM f), mk AS (SELECT res.*, tr.chunk_id IS NOT NULL AS rel FROM res LEFT JOIN tr USING (query_id, chunk_id))"
METRICS = "me AS (SELECT strategy, query_id, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE rel), 0) AS mrr, max((rel AND rank <= 1)::INT)::DOUBLE AS recall_1, max((rel AND rank <= 3)::INT)::DOUBLE AS recall_3, max((rel AND rank <= 5)::INT)::DOUBLE AS recall_5, round(sum(CASE WHEN rel AND rank <= 5 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END), 9) AS ndcg_5 FROM mk GROUP BY ALL)"
HOP = "hop AS (SELECT query_id, count(*) > 1 AS is_multihop FROM tr GROUP BY query_id)"


@query("e1_relevant_ranks", f"{RESULTS} SELECT strategy, query_id, chunk_id, rank FROM mk WHERE rel")
def relevant_ranks(spark, sf_dir):
    b = Base(spark, sf_dir)
    return ev.relevant_ranks(_results(spark, sf_dir, b), _truth(spark, sf_dir, b)).where("rel").select("strategy", "query_id", "chunk_id", "rank")


@query("e7_query_metrics", f"{RESULTS}, {METRICS} SELECT * FROM me")
def query_metrics(spark, sf_dir):
    b = Base(spark, sf_dir)
    return ev.metrics(_results(spark, sf_dir, b), _truth(spark, sf_dir, b))


@query("e8_harness_means", f"{RESULTS}, {METRICS}, {HOP} SELECT strategy, " + ", ".join(f"round(avg({m}), 9) AS {m}" for m in ("mrr", "recall_1", "recall_3", "recall_5", "ndcg_5")) + ", " + ", ".join(f"round(avg({m}) FILTER (WHERE is_multihop), 9) AS multihop_{m}" for m in ("mrr", "ndcg_5")) + " FROM me JOIN hop USING (query_id) GROUP BY strategy")
def harness_means(spark, sf_dir):
    """Items with several true chunks stand for multihop questions; items without any are left out."""
    b = Base(spark, sf_dir)
    truth = cut(_truth(spark, sf_dir, b))
    hop = truth.groupBy("query_id").agg((F.count("*") > 1).alias("is_multihop"))
    return ev.averages(ev.metrics(_results(spark, sf_dir, b), truth), hop)


def _items(spark, sf_dir):
    """First true chunk of each item, with the item's longest words as target entities."""
    words = F.slice(F.array_sort(F.array_distinct(tx.ascii_words(F.col("query_text")))), 1, 3)
    first = _truth(spark, sf_dir).groupBy("query_id").agg(F.min(F.struct("chunk_id", "target_doc")).alias("t"))
    return first.join(tb.search_queries(spark, sf_dir), "query_id").select("query_id", "t.chunk_id", "t.target_doc", words.alias("target_entities"))


ITEMS = f"it AS (SELECT t.*, list_slice(list_sort(list_distinct(list_filter(regexp_extract_all(lower(query_text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{3,}}$')))), 1, 3) AS ents FROM (SELECT query_id, min(chunk_id) AS target, arg_min(target_doc, chunk_id) AS target_doc FROM tr GROUP BY query_id) t JOIN q USING (query_id))"


@query("e5_entity_coverage", f"{RESULTS}, {ITEMS}, top AS (SELECT query_id, string_agg(text, ' ' ORDER BY rank) AS whole FROM kb JOIN c USING (chunk_id) WHERE rank <= 5 GROUP BY query_id), x AS (SELECT query_id, unnest(ents) AS e FROM it) SELECT query_id, avg(list_contains(regexp_extract_all(lower(whole), '[\\p{{L}}\\p{{N}}_]+'), e)::INT) AS coverage FROM x JOIN top USING (query_id) GROUP BY query_id")
def entity_coverage(spark, sf_dir):
    b = Base(spark, sf_dir)
    top = b.top("bm25", 5).join(b.chunks, "chunk_id").select("query_id", "rank", "text")
    return ev.entity_coverage(top, _items(spark, sf_dir))


@query("e6_relation_coverage", f"{RESULTS}, {ITEMS}, top AS (SELECT query_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM kb JOIN c USING (chunk_id) WHERE rank <= 5) SELECT query_id, max((list_contains(w, ents[1]) AND list_contains(w, ents[2]) AND list_contains(w, ents[3]))::INT)::DOUBLE AS coverage FROM it JOIN top USING (query_id) WHERE len(ents) = 3 GROUP BY query_id")
def relation_coverage(spark, sf_dir):
    b = Base(spark, sf_dir)
    top = b.top("bm25", 5).join(b.chunks, "chunk_id").select("query_id", "rank", "text")
    e = F.col("target_entities")
    items = _items(spark, sf_dir).where(F.size("target_entities") == 3).select("query_id", F.array(F.struct(e[0].alias("src"), e[1].alias("pred"), e[2].alias("tgt"))).alias("target_relations"))
    return ev.relation_coverage(top, items)


@query("e9_truth_drift", f"WITH {C}, {TRUTH}, shifted AS (SELECT query_id, chunk_id + query_id % 3 AS chunk_id, target_doc FROM tr) SELECT query_id, s.chunk_id, target_doc FROM shifted s LEFT JOIN c USING (chunk_id) WHERE c.fmt IS NULL OR NOT contains(substr(c.fmt, 1, 200), target_doc)")
def truth_drift(spark, sf_dir):
    """Truth whose ids were shifted for two items in three must be reported."""
    shifted = _truth(spark, sf_dir).withColumn("chunk_id", F.col("chunk_id") + F.col("query_id") % 3)
    return ev.drifted(shifted, tb.chunks(spark, sf_dir))


@query("e10_ablation_ranks", f"{RESULTS}, {ITEMS} SELECT strategy, query_id, min(rank) FILTER (WHERE chunk_id = target OR (doc_name = target_doc AND len(list_filter(ents, lambda e: contains(lower(text), e))) > 0))::INTEGER AS rank FROM res JOIN c USING (chunk_id) JOIN it USING (query_id) WHERE rank <= 5 GROUP BY ALL")
def ablation_ranks(spark, sf_dir):
    return ev.ablation_ranks(_results(spark, sf_dir), tb.chunks(spark, sf_dir), _items(spark, sf_dir))


@query("e11_recalibrated_targets", f"WITH {C} SELECT doc_name, min(chunk_id) AS chunk_id FROM c GROUP BY doc_name")
def recalibrated_targets(spark, sf_dir):
    return ev.first_chunks(tb.chunks(spark, sf_dir))


@query("e12_rerank_diagnostic", f"{RRF}, {PAIRS} SELECT query_id, chunk_id, before, rank AS after FROM ag")
def rerank_diagnostic(spark, sf_dir):
    """Ranks before and after pair scoring for every pool entry."""
    from lodestone.operators.dense import pair_scores

    b = Base(spark, sf_dir)
    fused = cut(b.fused(50))
    after = pp.rerank(fused, pair_scores(fused, b.queries, b.chunks))
    return fused.select("query_id", "chunk_id", F.col("rank").alias("before")).join(after.select("query_id", "chunk_id", F.col("rank").alias("after")), ["query_id", "chunk_id"])
