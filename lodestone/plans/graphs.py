"""Queries over mined graphs and graph-based retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import fusion as fu
from lodestone.operators import generation as gn
from lodestone.operators import graph as gr
from lodestone.operators import postprocess as pp
from lodestone.operators import scoring as sc
from lodestone.plans.base import TFIDF, C, bm25_sql, dedup_sql, mmr_sql, query, rank_sql, rrf_sql, top_sql
from lodestone.plans.search import Base
from lodestone.sources import tables as tb
from lodestone.sources.cut import cut

IGNORED = "[" + ", ".join(repr(w) for w in gr.IGNORED) + "]"
STOP = ", ".join(repr(w) for w in gr.COMMUNITY_STOPWORDS)
AFF = gr.AFFILIATION.replace("'", "''")
MENTIONS = f"""b AS (SELECT chunk_id, doc_name, text, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS t FROM c),
m0 AS (SELECT chunk_id, doc_name, unnest(list_distinct(list_filter(regexp_extract_all(t, '{gr.ACRONYM}'), lambda w: NOT list_contains({IGNORED}, w)))) AS name, 1 AS priority FROM b
 UNION ALL SELECT chunk_id, doc_name, unnest(list_distinct(list_filter(regexp_extract_all(t, '{gr.CAMEL_CASE}'), lambda w: NOT list_contains({IGNORED}, upper(w))))), 2 FROM b
 UNION ALL SELECT chunk_id, doc_name, unnest(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(t, '{gr.PROPER_NOUN}'), lambda w: len(list_filter(regexp_split_to_array(w, '\\s+'), lambda x: NOT list_contains({IGNORED}, upper(x)))) > 0), lambda w: regexp_replace(w, '\\s+', ' ', 'g')), lambda w: length(w) > 4 AND NOT regexp_matches(w, '{AFF}') AND NOT regexp_matches(w, '{gr.PERSON}')))), 3 FROM b),
m AS (SELECT chunk_id, doc_name, name, min(priority) AS priority FROM m0 GROUP BY ALL)"""
ENTITIES = f"""{MENTIONS},
en AS (SELECT name, ['SECTION_CONCEPT', 'TECHNICAL_ACRONYM', 'FRAMEWORK_COMPONENT', 'CONCEPT'][arg_min(priority, chunk_id * 10 + priority) + 1] AS entity_type, count(DISTINCT chunk_id) AS n_chunks, min(chunk_id) AS first_chunk, list_sort(list_distinct(list(chunk_id))) AS chunk_ids FROM m GROUP BY name)"""
RESOLVED = f"""{ENTITIES},
rs AS (SELECT lower(name) AS key, arg_min(name, (first_chunk, name)) AS name, arg_min(entity_type, (first_chunk, name)) AS entity_type, list_sort(list_distinct(flatten(list(chunk_ids)))) AS chunk_ids FROM en WHERE length(name) >= 2 GROUP BY 1),
vx AS (SELECT key, name, entity_type, len(chunk_ids)::INTEGER AS n_chunks, chunk_ids FROM rs
 WHERE NOT (len(chunk_ids) <= 1 AND NOT (entity_type = 'TECHNICAL_ACRONYM' AND length(name) >= 3) AND length(name) < 5)
 AND NOT regexp_matches(name, '{AFF}') AND NOT (entity_type = 'CONCEPT' AND regexp_matches(name, '{gr.PERSON}')) AND NOT regexp_matches(name, '\\b\\d+\\s+[A-Z]'))"""
PAIRS = f"""{RESOLVED},
st AS (SELECT chunk_id, unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentence, generate_subscripts(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS pos FROM c),
si AS (SELECT DISTINCT st.chunk_id, pos, sentence, name FROM st JOIN m USING (chunk_id) WHERE contains(sentence, name)),
pr AS (SELECT x.name AS a, y.name AS b, count(*) AS n, list_sort(list_distinct(list(x.chunk_id))) AS chunk_ids FROM si x JOIN si y ON x.chunk_id = y.chunk_id AND x.pos = y.pos AND x.name < y.name GROUP BY ALL),
ed AS (SELECT a AS src, b AS dst, 1 + ln(1 + n) AS weight, chunk_ids FROM pr WHERE a IN (SELECT name FROM vx) AND b IN (SELECT name FROM vx))"""
ASKED = f"""{PAIRS},
ql AS (SELECT query_id, lower(query_text) AS low, ' ' || regexp_replace(lower(query_text), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g') || ' ' AS spaced, regexp_replace(query_text, '[^\\x00-\\x7F]', '_', 'g') AS t FROM q),
qe0 AS (SELECT query_id, name FROM ql JOIN vx ON lower(name) NOT IN ({STOP}) AND length(name) >= 3 AND contains(low, lower(name)) AND contains(spaced, ' ' || regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g') || ' ')
 UNION SELECT query_id, name FROM (SELECT query_id, lower(unnest(regexp_extract_all(t, '\\b[A-Z]{{2,10}}\\b'))) AS a FROM ql) JOIN vx ON a = lower(name)),
qw AS (SELECT query_id, list_distinct(list_filter(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{3,}}$') AND w NOT IN ({STOP}))) AS w FROM ql),
vw AS (SELECT name, list_distinct(list_filter(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{3,}}$') AND w NOT IN ({STOP}))) AS w FROM vx),
qe AS (SELECT * FROM qe0 UNION ALL SELECT query_id, name FROM qw JOIN vw ON len(vw.w) >= 2 AND list_has_all(qw.w, vw.w) WHERE query_id NOT IN (SELECT query_id FROM qe0))"""
LOCAL = f"""{ASKED},
mt AS (SELECT query_id, src, dst, weight, chunk_ids FROM qe JOIN ed ON name = src UNION ALL SELECT query_id, src, dst, weight, chunk_ids FROM qe JOIN ed ON name = dst),
pt AS (SELECT query_id, unnest(chunk_ids) AS chunk_id, CASE WHEN entity_type = 'SECTION_CONCEPT' THEN 1 ELSE 5 * ln(((SELECT count(*) FROM c) - n_chunks + 0.5::DOUBLE) / (n_chunks + 0.5::DOUBLE) + 1) END AS s FROM qe JOIN vx USING (name)
 UNION ALL SELECT query_id, unnest(chunk_ids), 1.5::DOUBLE * least(weight, 3) FROM mt
 UNION ALL SELECT query_id, unnest(chunk_ids), 0.8::DOUBLE FROM (SELECT DISTINCT query_id, name FROM (SELECT query_id, src AS name FROM mt UNION SELECT query_id, dst FROM mt) EXCEPT SELECT query_id, name FROM qe) JOIN vx USING (name) WHERE entity_type <> 'SECTION_CONCEPT'),
ls AS (SELECT query_id, chunk_id, s / max(s) OVER (PARTITION BY query_id) AS score FROM (SELECT query_id, chunk_id, sum(s) AS s FROM pt GROUP BY ALL))"""
COMPONENTS = f"""{PAIRS},
bo AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed),
re(a, b) AS (SELECT name, name FROM vx UNION SELECT re.a, bo.b FROM re JOIN bo ON bo.a = re.b),
cm AS (SELECT a AS name, min(b) AS community FROM re GROUP BY a)"""
GLOBAL = f"""{COMPONENTS},
gt AS (SELECT query_id, unnest(w) AS t FROM qw),
gh AS (SELECT DISTINCT query_id, community, t FROM gt JOIN cm ON contains(lower(name), t)),
go AS (SELECT query_id, community, count(*) AS n FROM gh GROUP BY ALL HAVING count(*) >= 2 OR max(length(t)) >= 6),
gz AS (SELECT community, count(*) AS members FROM cm GROUP BY ALL),
gb AS (SELECT query_id, community, s FROM (SELECT query_id, community, round(n / (sqrt(members) + 1e-6), 9) AS s FROM go JOIN gz USING (community)) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, community) <= 2),
gp AS (SELECT query_id, unnest(chunk_ids) AS chunk_id, s FROM gb JOIN cm USING (community) JOIN vx USING (name)),
gs AS (SELECT query_id, chunk_id, s / max(s) OVER (PARTITION BY query_id) AS score FROM (SELECT query_id, chunk_id, sum(s) AS s FROM gp GROUP BY ALL))"""
WITH_LOCAL = LOCAL[len(PAIRS):] + GLOBAL[len(PAIRS):]
SCORES = f"{PAIRS}{WITH_LOCAL}, gr AS (SELECT * FROM ls UNION ALL SELECT * FROM gs WHERE query_id NOT IN (SELECT query_id FROM ls))"
GRAPH = f"WITH RECURSIVE {C}, {SCORES}, {bm25_sql('bm')}, {TFIDF}, g AS (SELECT * FROM gr WHERE score >= 0.2), {rank_sql('kg0', 'g')}, kg AS (SELECT * FROM kg0 WHERE rank <= 5), {rank_sql('kb', 'bm')}, {rank_sql('kt', 'ti')}, {rrf_sql('f', [('kb', 1.0), ('kt', 1.0), ('kg', 0.35)])}"


class Graph(Base):
    """A corpus with its mined graph, cut once: every query below reads it several times."""

    def __init__(self, spark, sf_dir):
        super().__init__(spark, sf_dir)
        vertices, edges = gr.extract(self.chunks)
        self.vertices, self.edges = cut(vertices), cut(edges)


@query("i12_entity_mentions", f"WITH {C}, {MENTIONS} SELECT chunk_id, name, priority FROM m0")
def entity_mentions(spark, sf_dir):
    return gr.mentions(tb.chunks(spark, sf_dir)).select("chunk_id", "name", "priority")


@query("i12_entities", f"WITH {C}, {ENTITIES} SELECT name, entity_type, n_chunks, chunk_ids FROM en")
def entities(spark, sf_dir):
    return gr.entities(gr.mentions(tb.chunks(spark, sf_dir))).select("name", "entity_type", "n_chunks", "chunk_ids")


@query("i13_normalized_names", "SELECT doc_id, trim(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')), '.,;:()[]{}\"''') AS name FROM documents")
def normalized_names(spark, sf_dir):
    return tb.read(spark, sf_dir, "documents").select("doc_id", gr.normalize_name(F.col("text")).alias("name"))


@query("i14_stripped_sections", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Methods ' || lang WHEN 1 THEN 'Results' WHEN 2 THEN 'Error Bounds' ELSE 'Setup' END AS section FROM documents")
def stripped_sections(spark, sf_dir):
    heading = F.expr("CASE doc_id % 4 WHEN 0 THEN '1.2. Methods ' || lang WHEN 1 THEN 'IV. Results' WHEN 2 THEN 'A. Error Bounds' ELSE '§ Setup' END")
    return tb.read(spark, sf_dir, "documents").select("doc_id", gr.strip_prefix(heading).alias("section"))


@query("i15_cooccurrence", f"WITH {C}, {PAIRS} SELECT a, b, n, chunk_ids FROM pr")
def cooccurrence(spark, sf_dir):
    chunks = tb.chunks(spark, sf_dir)
    return gr.cooccurrence(chunks, gr.mentions(chunks)).select("a", "b", "n", "chunk_ids")


@query("i16_resolved_entities", f"WITH {C}, {RESOLVED} SELECT key, name, entity_type, chunk_ids FROM rs")
def resolved_entities(spark, sf_dir):
    return gr.resolve_exact(gr.entities(gr.mentions(tb.chunks(spark, sf_dir)))).select("key", "name", "entity_type", "chunk_ids")


@query("i16_fuzzy_resolution")
def fuzzy_resolution(spark, sf_dir):
    return gr.resolve_fuzzy(gr.resolve_exact(gr.entities(gr.mentions(tb.chunks(spark, sf_dir)))))


@query("i17_vertices", f"WITH {C}, {RESOLVED} SELECT name, entity_type, n_chunks FROM vx")
def vertices(spark, sf_dir):
    return gr.extract(tb.chunks(spark, sf_dir))[0].select("name", "entity_type", "n_chunks")


@query("i18_relationships", f"WITH {C}, {PAIRS} SELECT src, dst, round(weight, 9) AS weight, chunk_ids FROM ed")
def relationships(spark, sf_dir):
    return gr.extract(tb.chunks(spark, sf_dir))[1].select("src", "dst", F.round("weight", 9).alias("weight"), "chunk_ids")


@query("g1_vertex_upsert", f"WITH {C}, {ENTITIES} SELECT entity_type, count(*) AS n, sum(n_chunks)::BIGINT AS mentions FROM en GROUP BY entity_type")
def vertex_upsert(spark, sf_dir):
    return gr.entities(gr.mentions(tb.chunks(spark, sf_dir))).groupBy("entity_type").agg(F.count("*").alias("n"), F.sum("n_chunks").alias("mentions"))


@query("g1_upserted_entities", f"WITH {C}, {ENTITIES} SELECT name, entity_type, '' AS description, chunk_ids FROM en")
def upserted_entities(spark, sf_dir):
    """Entities upserted into themselves are themselves."""
    found = gr.entities(gr.mentions(tb.chunks(spark, sf_dir)))
    return gr.upsert_entities(gr.upsert_entities(None, found), found).drop("doc_names")


@query("g2_created_endpoints", f"WITH {C}, {PAIRS} SELECT name, 'CONCEPT' AS entity_type FROM (SELECT src AS name FROM ed UNION SELECT dst FROM ed)")
def created_endpoints(spark, sf_dir):
    """Relationships put into an empty graph bring their ends along."""
    g = Graph(spark, sf_dir)
    none = gr.upsert_entities(None, g.vertices.where(F.lit(False)))
    return gr.with_endpoints(none, gr.upsert_relationships(None, g.edges)).select("name", "entity_type")


@query("g2_edge_merge", f"WITH {C}, {PAIRS} SELECT src, dst, 'CO_OCCURS_WITH' AS relation_type, round(2 * weight, 9) AS weight FROM ed")
def edge_merge(spark, sf_dir):
    """Every edge inserted twice is one edge of twice the weight."""
    edges = Graph(spark, sf_dir).edges.select("src", "dst", "relation_type", "weight", "chunk_ids")
    return gr.merge_edges(edges.unionByName(edges)).select("src", "dst", "relation_type", F.round("weight", 9).alias("weight"))


@query("a9_undirected_edges", f"WITH {C}, {PAIRS} SELECT src AS a, dst AS b, round(weight, 9) AS weight FROM ed")
def undirected_edges(spark, sf_dir):
    return gr.undirected(Graph(spark, sf_dir).edges).select("a", "b", F.round("weight", 9).alias("weight"))


@query("a10_degrees", f"WITH {C}, {PAIRS} SELECT name, (SELECT count(*) FROM ed WHERE src = name OR dst = name) AS degree FROM vx")
def degrees(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return gr.degrees(g.vertices, g.edges)


@query("g4_neighbours", f"WITH {C}, {PAIRS}, s AS (SELECT name AS start FROM vx WHERE entity_type = 'CONCEPT') SELECT start, 1 AS hop, src, dst FROM s JOIN ed ON start = src UNION ALL SELECT start, 1, src, dst FROM s JOIN ed ON start = dst")
def neighbours(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return gr.neighbours(g.edges, g.vertices.where("entity_type = 'CONCEPT'").select(F.col("name").alias("start"))).select("start", "hop", "src", "dst")


@query("g5_communities", f"WITH RECURSIVE {C}, {COMPONENTS} SELECT name, community FROM cm")
def communities(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return gr.communities(g.vertices, g.edges)


@query("g5_louvain")
def louvain(spark, sf_dir):
    """Communities by modularity; SQL cannot express the moves, so tests hold them against a plain measure."""
    g = Graph(spark, sf_dir)
    return gr.louvain(g.vertices, g.edges)


@query("g6_counts", f"WITH {C}, {PAIRS} SELECT (SELECT count(*) FROM vx) AS nodes, (SELECT count(*) FROM ed) AS edges")
def counts(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return g.vertices.agg(F.count("*").alias("nodes")).crossJoin(g.edges.agg(F.count("*").alias("edges")))


@query("r19_query_entities", f"WITH {C}, {ASKED} SELECT query_id, name FROM qe")
def query_entities(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return gr.query_entities(g.queries, g.vertices)


@query("r20_local_graph", f"WITH {C}, {LOCAL} SELECT query_id, chunk_id, round(score, 6) AS score FROM ls")
def local_graph(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return gr.local_scores(g.queries, g.vertices, g.edges, g.chunks.count()).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def _graph_scores(g: Graph):
    return gr.graph_scores(g.queries, g.vertices, g.edges, gr.communities(g.vertices, g.edges), g.chunks.count())


@query("r21_global_graph", f"WITH RECURSIVE {C}, {PAIRS}{WITH_LOCAL} SELECT query_id, chunk_id, round(score, 6) AS score FROM gs")
def global_graph(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return gr.global_scores(g.queries, g.vertices, gr.communities(g.vertices, g.edges)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query("r22_graph_scores", f"WITH RECURSIVE {C}, {SCORES} SELECT query_id, chunk_id, round(score, 6) AS score FROM gr")
def graph_scores(spark, sf_dir):
    return _graph_scores(Graph(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def _graph_ranking(g: Graph, most: int):
    """Chunks with a graph score of 0.2 or more, the best ``most`` of each query."""
    return sc.ranked(_graph_scores(g).where("score >= 0.2"), most)


def _graph_rrf(g: Graph, depth: int):
    hits = g.once("graph ranking", lambda: cut(_graph_ranking(g, 5)))
    return g.fused(depth, [(hits, 0.35)])


@query("f7_local_threshold", f"WITH {C}, {LOCAL}, g AS (SELECT * FROM ls WHERE score >= 0.2), {rank_sql('k', 'g')} SELECT query_id, chunk_id, score, rank FROM k WHERE rank <= 5")
def local_threshold(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return sc.ranked(gr.local_scores(g.queries, g.vertices, g.edges, g.chunks.count()).where("score >= 0.2"), 5)


@query("u10_graph_weighted_rrf", f"WITH {C}, {LOCAL}, {bm25_sql('bm')}, {TFIDF}, g AS (SELECT * FROM ls WHERE score >= 0.2), {rank_sql('kg0', 'g')}, kg AS (SELECT * FROM kg0 WHERE rank <= 5), {rank_sql('kb', 'bm')}, {rank_sql('kt', 'ti')}, {rrf_sql('f', [('kb', 1.0), ('kt', 1.0), ('kg', 0.35)])} {top_sql('f')}")
def graph_weighted_rrf(spark, sf_dir):
    """Fusion of word scores with the local graph's; queries without hits are fused plainly."""
    g = Graph(spark, sf_dir)
    hits = sc.ranked(gr.local_scores(g.queries, g.vertices, g.edges, g.chunks.count()).where("score >= 0.2"), 5)
    return g.fused(10, [(cut(hits), 0.35)])


@query("strategy_14_graph", f"{GRAPH}, {dedup_sql('z', 'f', 20)}, {mmr_sql('mm', 'z')} SELECT * FROM mm")
def strategy_graph(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return g.mmr(cut(pp.dedup(lambda depth: _graph_rrf(g, depth), g.texts(), most=pp.MMR_POOL)))


@query("ablation_a_graph_only", f"WITH RECURSIVE {C}, {SCORES}, g AS (SELECT * FROM gr WHERE score >= 0.2), {rank_sql('k', 'g')} SELECT query_id, chunk_id, score, rank FROM k WHERE rank <= 50")
def graph_only(spark, sf_dir):
    return _graph_ranking(Graph(spark, sf_dir), 50)


@query("ablation_b_rrf_graph", f"{GRAPH} {top_sql('f')}")
def rrf_graph(spark, sf_dir):
    return _graph_rrf(Graph(spark, sf_dir), 10)


@query("ablation_c_rrf_graph_dedup", f"{GRAPH}, {dedup_sql('z', 'f', 10)} SELECT query_id, chunk_id, score, rank FROM z")
def rrf_graph_dedup(spark, sf_dir):
    g = Graph(spark, sf_dir)
    return pp.dedup(lambda depth: _graph_rrf(g, depth), g.texts())


@query("n2_graph_triplets", f"WITH {C}, {ASKED}, n3 AS (SELECT query_id, name FROM qe QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY name) <= 3), me AS (SELECT query_id, name, src, dst FROM n3 JOIN ed ON name = src UNION ALL SELECT query_id, name, src, dst FROM n3 JOIN ed ON name = dst) SELECT * FROM me QUALIFY row_number() OVER (PARTITION BY query_id, name ORDER BY src, dst) <= 3")
def graph_triplets(spark, sf_dir):
    """The first three edges of the first three entities of each query."""
    g = Graph(spark, sf_dir)
    return gn.first_edges(g.queries, g.vertices, g.edges)
