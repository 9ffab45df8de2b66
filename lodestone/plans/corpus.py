"""Queries over sources, ingestion, lookups and generation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import text as tx
from lodestone.operators import chunking as ck
from lodestone.operators import rag
from lodestone.plans.base import ALNUM, SPLIT, C, bm25_sql, query, rank_sql
from lodestone.plans.search import Base
from lodestone.sources import tables as tb

SENT = r"""list_filter(list_transform(regexp_split_to_array(regexp_replace(trim(array_to_string(list_filter(list_transform(regexp_split_to_array({}, '\r\n|[\n\x0b\x0c\r]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ')), '([.?!])\s+([A-Z0-9"“])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""


def _pages(spark, sf_dir):
    return tb.read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("doc_name"), F.lit(1).alias("page_num"), F.coalesce("text", F.lit("")).alias("raw_text"))


@query("s1_document_listing", "SELECT source || '/' || doc_id AS name, length(text) AS size FROM documents")
def document_listing(spark, sf_dir):
    return _pages(spark, sf_dir).select(F.col("doc_name").alias("name"), F.length("raw_text").cast("bigint").alias("size")).orderBy("name")


@query("s2_html_pages", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n\x0b\x0c]+', ' ', 'g')) AS text FROM pages")
def html_pages(spark, sf_dir):
    """Pages as plain text: scripts, styles and tags dropped, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return tb.read(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(bare, "[ \\t\\r\\n\\x0b\\f]+", " ")).alias("text"))


@query("s4_chunk_scan", f"WITH {C} SELECT chunk_id, doc_name, page_num, section, text FROM c")
def chunk_scan(spark, sf_dir):
    return tb.chunks(spark, sf_dir).drop("fmt").orderBy("chunk_id")


@query("s5_formatted_texts", f"WITH {C} SELECT chunk_id, fmt FROM c")
def formatted_texts(spark, sf_dir):
    return tb.chunks(spark, sf_dir).select("chunk_id", "fmt")


@query("s14_vector_upsert", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: -x) ELSE embedding::DOUBLE[] END AS embedding FROM embeddings")
def vector_upsert(spark, sf_dir):
    """A third of the vectors is replaced by new values, the rest stays."""
    old = tb.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    new = old.where("vec_id % 3 = 0").withColumn("embedding", F.transform("embedding", lambda x: -x))
    return tb.upsert(old, new, "vec_id")


@query("s15_vector_scan", "SELECT vec_id, label, len(embedding) AS dims FROM embeddings")
def vector_scan(spark, sf_dir):
    return tb.read(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").cast("bigint").alias("dims")).orderBy("vec_id")


TITLE_SQL = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: length(x) > 10 AND length(x) < 200 AND upper(x) <> x AND lower(x) <> x AND NOT contains(lower(x), 'http') AND NOT starts_with(lower(x), 'doi:'))[1]"


def _title(text):
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    skip = lambda x: F.contains(F.lower(x), F.lit("http")) | F.startswith(F.lower(x), F.lit("doi:"))
    return F.get(F.filter(lines, lambda x: (F.length(x) > 10) & (F.length(x) < 200) & (F.upper(x) != x) & (F.lower(x) != x) & ~skip(x)), F.lit(0))


@query("s21_metadata_fields", f"SELECT doc_id, {TITLE_SQL} AS title, sha256(text) AS digest, substr(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')), 1, 500) AS preview FROM documents")
def metadata_fields(spark, sf_dir):
    """Title heuristic, digest and preview of every document."""
    return tb.read(spark, sf_dir, "documents").select("doc_id", _title(F.col("text")).alias("title"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.substring(F.trim(F.regexp_replace("text", "[ \\t\\r\\n]+", " ")), 1, 500).alias("preview"))


@query("s21b_author_line", r"WITH l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), w AS (SELECT *, list_filter(string_split(line, ' '), lambda x: x <> '') AS ws FROM l WHERE length(line) < 200) SELECT doc_id, arg_min(line, pos) AS authors FROM w WHERE len(ws) BETWEEN 2 AND 10 AND 2 * len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]'))) >= len(ws) GROUP BY doc_id")
def author_line(spark, sf_dir):
    """First short line of two to ten words of which at least half are capitalised."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    words = lambda x: F.filter(F.split(x, " "), lambda w: w != "")
    good = F.filter(lines, lambda x: (F.length(x) < 200) & F.size(words(x)).between(2, 10) & (2 * F.size(F.filter(words(x), lambda w: w.rlike("^[A-Z]"))) >= F.size(words(x))))
    return tb.read(spark, sf_dir, "documents").select("doc_id", F.get(good, F.lit(0)).alias("authors")).where("authors is not null")


@query("i1_sentences", f"SELECT doc_id, unnest({SENT.format('text')}) AS sentence, generate_subscripts({SENT.format('text')}, 1) - 1 AS pos FROM documents")
def sentences(spark, sf_dir):
    return tb.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(ck.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("bigint"))


@query("i2_sections", "SELECT source || '/' || doc_id AS doc_name, 1 AS page_num, 'Overview' AS section FROM documents")
def sections(spark, sf_dir):
    return ck.with_sections(_pages(spark, sf_dir)).select("doc_name", "page_num", "section")


@query("i3_structured_chunks")
def structured_chunks(spark, sf_dir):
    return ck.chunk_pages(_pages(spark, sf_dir))


@query("i4_chunk_ids", "SELECT source || '/' || doc_id AS doc_name, row_number() OVER (ORDER BY source || '/' || doc_id) - 1 + 1000 AS chunk_id FROM documents")
def chunk_ids(spark, sf_dir):
    """Ids that go on from 1000 in document order, by range and place within the range."""
    names = _pages(spark, sf_dir).select("doc_name", F.col("doc_name").substr(1, 5).alias("range"))
    before = names.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("doc_name"))
    return names.withColumn("place", place).join(before, "range").select("doc_name", (F.col("before") + F.col("place") - 1 + 1000).cast("bigint").alias("chunk_id"))


@query("i5_parsed_format", f"WITH {C} SELECT chunk_id, doc_name, page_num, section, text FROM c UNION ALL SELECT query_id, 'Unknown', 1, 'Overview', query_text FROM q")
def parsed_format(spark, sf_dir):
    """Formatted chunks, and texts without a header, back as columns."""
    b = Base(spark, sf_dir)
    both = b.chunks.select("chunk_id", "fmt").unionByName(b.queries.select(F.col("query_id").alias("chunk_id"), F.col("query_text").alias("fmt")))
    return both.select("chunk_id", ck.parse_formatted(F.col("fmt")).alias("p")).select("chunk_id", "p.*")


@query("i6_metadata_json", "SELECT doc_id AS chunk_id, lang, CASE WHEN lang = 'en' THEN NULL ELSE '{\"lang\":\"' || lang || '\"}' END AS metadata_json FROM documents")
def metadata_json(spark, sf_dir):
    """Metadata to JSON and back; an empty map is stored as NULL."""
    docs = tb.read(spark, sf_dir, "documents")
    meta = F.when(F.col("lang") == "en", F.from_json(F.lit("{}"), "map<string,string>")).otherwise(F.create_map(F.lit("lang"), "lang"))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.lit("d").alias("doc_name"), F.lit(1).alias("page_num"), F.lit("s").alias("section"), "text", meta.alias("metadata"))
    stored = tb.to_table(chunks, "metadata")
    return stored.join(tb.from_table(stored).select("chunk_id", F.coalesce(F.col("metadata")["lang"], F.lit("en")).alias("lang")), "chunk_id").select("chunk_id", "lang", "metadata_json")


@query("i7_regime_hash", "SELECT substr(sha256('max_words:120,overlap:1,v:1'), 1, 16) AS regime")
def regime_hash(spark, sf_dir):
    return spark.range(1).select(tb.regime_hash().alias("regime"))


def _listing(spark, sf_dir):
    return tb.read(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"), (F.col("doc_id") * 10).alias("mtime"), F.length("text").cast("bigint").alias("size"))


@query("i8_cache_key", "SELECT substr(sha256('corpus' || '|' || string_agg(source || '/' || doc_id || ':' || doc_id * 10 || ':' || length(text), '|' ORDER BY source || '/' || doc_id || ':' || doc_id * 10 || ':' || length(text))), 1, 16) AS cache_key FROM documents")
def cache_key(spark, sf_dir):
    return tb.cache_key(_listing(spark, sf_dir), "corpus")


@query("i9_incremental_diff", "SELECT source || '/' || doc_id AS name, CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'modified' WHEN 2 THEN 'removed' ELSE 'unchanged' END AS status FROM documents")
def incremental_diff(spark, sf_dir):
    """Against a manifest that lacks, or has other times of, some documents, and has others besides."""
    every = _listing(spark, sf_dir).withColumn("k", (F.col("mtime") / 10).cast("bigint") % 4)
    then = every.where("k <> 0").withColumn("mtime", F.when(F.col("k") == 1, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return tb.changed_files(every.where("k <> 2"), then)


@query("f1_point_lookup", f"WITH {C} SELECT chunk_id, doc_name, text FROM c WHERE chunk_id = 7")
def point_lookup(spark, sf_dir):
    return tb.chunks(spark, sf_dir).where("chunk_id = 7").select("chunk_id", "doc_name", "text")


@query("f2_ordered_lookup", f"WITH {C}, ids AS (SELECT unnest([42, 7, 999999999, 3]) AS chunk_id, unnest([0, 1, 2, 3]) AS pos) SELECT pos, chunk_id, doc_name FROM ids JOIN c USING (chunk_id)")
def ordered_lookup(spark, sf_dir):
    """Chunks in the order asked for; unknown ids are skipped."""
    ids = spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("bigint") for x in (42, 7, 999999999, 3)])).alias("pos", "chunk_id"))
    return ids.join(tb.chunks(spark, sf_dir), "chunk_id").select("pos", "chunk_id", "doc_name").orderBy("pos")


@query("f3_predicate_filter", "SELECT doc_id, source, lang FROM documents WHERE source = 'src3' AND contains(lower(lang), 'e')")
def predicate_filter(spark, sf_dir):
    """Equality, which reaches the scan, and a substring in any case."""
    return tb.read(spark, sf_dir, "documents").where((F.col("source") == "src3") & F.contains(F.lower("lang"), F.lower(F.lit("E")))).select("doc_id", "source", "lang")


@query("f4_token_filter", f"SELECT doc_id FROM documents WHERE list_has_all({ALNUM.format('text')}, ['the', 'and'])")
def token_filter(spark, sf_dir):
    """Documents that hold all tokens of a phrase, in any order."""
    tokens = tx.alnum_tokens(F.col("text"))
    return tb.read(spark, sf_dir, "documents").where(F.size(F.array_except(tx.alnum_tokens(F.lit("the and")), tokens)) == 0).select("doc_id")


@query("f6_count", "SELECT count(*) AS n FROM documents")
def count(spark, sf_dir):
    return tb.chunks(spark, sf_dir).agg(F.count("*").alias("n"))


@query("a12_document_summary", "SELECT source AS doc, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY source")
def document_summary(spark, sf_dir):
    return tb.read(spark, sf_dir, "documents").groupBy(F.col("source").alias("doc")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


SETS = f"t AS (SELECT query_id, list_distinct({ALNUM.format('query_text')}) AS w FROM q)"


@query("so_token_sets", f"WITH {C}, {SETS}, s AS (SELECT [{', '.join(repr(w) for w in tx.STOPWORDS)}] AS s) SELECT query_id, len(list_filter(w, lambda x: NOT list_contains(s, x))) AS content, len(list_intersect(w, s)) AS stop, len(list_distinct(list_concat(w, s))) AS together, len(list_filter(w, lambda x: NOT list_contains(s, x))) = 0 AS all_stop FROM t, s")
def token_sets(spark, sf_dir):
    """Difference, intersection, union and subset test against the stop words."""
    stop = F.array(*[F.lit(w) for w in tx.STOPWORDS])
    w = F.array_distinct(tx.alnum_tokens(F.col("query_text")))
    size = lambda c: F.size(c).cast("bigint")
    return tb.search_queries(spark, sf_dir).select("query_id", size(F.array_except(w, stop)).alias("content"), size(F.array_intersect(w, stop)).alias("stop"), size(F.array_union(w, stop)).alias("together"), (F.size(F.array_except(w, stop)) == 0).alias("all_stop"))


@query("so1_concatenation", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id, text FROM benchmark")
def concatenation(spark, sf_dir):
    return tb.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(tb.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"))


# --- generation


BM = bm25_sql("bm")
TOP = f"WITH {C}, {BM}, {rank_sql('k', 'bm')}, top AS (SELECT * FROM k JOIN c USING (chunk_id) JOIN q USING (query_id) WHERE rank <= 5)"


def _top(spark, sf_dir):
    b = Base(spark, sf_dir)
    return b, b.top("bm25", 5).join(b.chunks.drop("fmt"), "chunk_id")


@query("n1_context", TOP + """, blk AS (SELECT query_id, rank, '[Source ' || rank || ': ' || doc_name || ' | Page 1 | § Overview]' || chr(10) || text AS block FROM top),
fit AS (SELECT * FROM (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM blk) WHERE used <= 8000 OR rank = 1)
SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context, count(*)::INTEGER AS n_sources FROM fit GROUP BY query_id""")
def context(spark, sf_dir):
    return rag.build_context(_top(spark, sf_dir)[1])


@query("n3_prompts", TOP + """ SELECT query_id, rank, 'Answer the question from the sources below and cite them as [Source n].' || chr(10) || chr(10) || 'Sources:' || chr(10) || text || chr(10) || chr(10) || 'Question: ' || query_text || chr(10) || 'Answer:' AS prompt FROM top""")
def prompts(spark, sf_dir):
    b, top = _top(spark, sf_dir)
    return top.join(b.queries, "query_id").select("query_id", "rank", rag.prompt(F.col("query_text"), F.col("text")).alias("prompt"))


OVERLAP = f"lv AS (SELECT query_id, rank, score, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) END AS overlap FROM (SELECT *, list_distinct({SPLIT.format('query_text')}) AS a, list_distinct({SPLIT.format('text')}) AS b FROM top))"


@query("n8_citation_levels", TOP + f""", {OVERLAP}, fs AS (SELECT *, least(greatest(greatest(1.0::DOUBLE - 0.1::DOUBLE * (rank - 1), 0) / 10, 0), 1) AS f FROM lv)
SELECT query_id, rank, overlap, CASE WHEN rank <= 2 AND f >= 0.7 AND overlap >= 0.3 THEN 'high' WHEN rank <= 4 OR (f >= 0.5 AND overlap >= 0.2) THEN 'medium' ELSE 'low' END AS level FROM fs""")
def citation_levels(spark, sf_dir):
    b, top = _top(spark, sf_dir)
    return rag.citations(top, b.queries).select("query_id", "rank", "overlap", "level")


@query("n6_normalized_scores", TOP + " SELECT query_id, rank, round(least(greatest(score / 10, 0), 1), 9) AS normalized, round(greatest(1.0::DOUBLE - 0.1::DOUBLE * (rank - 1), 0), 9) AS simulated FROM top")
def normalized_scores(spark, sf_dir):
    return _top(spark, sf_dir)[1].select("query_id", "rank", F.round(rag.normalized_score(F.col("score")), 9).alias("normalized"), F.round(rag.simulated_score(F.col("rank")), 9).alias("simulated"))


@query("n9_extractive_answers", TOP + f""", sn AS (SELECT query_id, rank, query_text, unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))) AS sentence, generate_subscripts(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0b\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), 1) AS pos FROM top),
so AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) END AS s FROM (SELECT *, list_distinct({SPLIT.format('query_text')}) AS a, list_distinct({SPLIT.format('sentence')}) AS b FROM sn)),
be AS (SELECT query_id, sentence, rank FROM so QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank, pos) = 1)
SELECT query_id, sentence AS answer, [rank] AS citations FROM be""")
def extractive_answers(spark, sf_dir):
    b, top = _top(spark, sf_dir)
    return rag.extractive_answer(b.queries, top)


@query("n1b_conversation_context", """WITH blk AS (SELECT conv_id AS query_id, turn, '[Source ' || turn || ': ' || role || ' | Page 1 | § Overview]' || chr(10) || coalesce(text, '') AS block FROM conversations),
fit AS (SELECT * FROM (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY turn) AS used, row_number() OVER (PARTITION BY query_id ORDER BY turn) AS n FROM blk) WHERE used <= 8000 OR n = 1)
SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY turn) AS context, count(*)::INTEGER AS n_sources FROM fit GROUP BY query_id""")
def conversation_context(spark, sf_dir):
    turns = tb.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.col("role").alias("doc_name"), F.lit(1).alias("page_num"), F.lit("Overview").alias("section"), F.coalesce("text", F.lit("")).alias("text"))
    return rag.build_context(turns)
