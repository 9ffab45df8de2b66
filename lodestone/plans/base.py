"""Registration of queries, and the SQL that oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame with its DuckDB SQL."""

    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


#: Chunks and queries of the driver's tables.
C = """c AS (SELECT doc_id AS chunk_id, source || '/' || doc_id AS doc_name, 1 AS page_num, 'Overview' AS section, coalesce(text, '') AS text,
  '[' || source || '/' || doc_id || ' | Page 1 | § Overview] ' || coalesce(text, '') AS fmt FROM documents),
q AS (SELECT item_id AS query_id, coalesce(text, '') AS query_text FROM benchmark)"""

SPACES = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
SPLIT = "list_filter(regexp_split_to_array(lower({}), '" + SPACES.replace("{", "{{").replace("}", "}}") + "'), lambda w: w <> '')"
WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
ALNUM = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def tokens(pattern: str, column: str) -> str:
    return pattern.format(column)


def bm25_sql(name: str, tok: str = SPLIT, floor: bool = True) -> str:
    """CTEs that end in ``name`` (query_id, chunk_id, score) over all pairs."""
    idf = "CASE WHEN raw < 0 THEN 0.25::DOUBLE * avg(raw) OVER () ELSE raw END" if floor else "raw"
    raw = "ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE)" if floor else "ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1)"
    return f"""{name}_t AS (SELECT chunk_id, {tok.format('fmt')} AS w FROM c),
{name}_l AS (SELECT chunk_id, len(w) AS dl, avg(len(w)) OVER () AS avgdl, count(*) OVER () AS n FROM {name}_t),
{name}_p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM {name}_t) GROUP BY ALL),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_r AS (SELECT term, {raw} AS raw FROM {name}_d, (SELECT count(*) AS n FROM c)),
{name}_i AS (SELECT term, {idf} AS idf FROM {name}_r),
{name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tok.format('query_text')}) AS term FROM q) GROUP BY ALL),
{name}_s AS (SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM {name}_q JOIN {name}_i USING (term) JOIN {name}_p USING (term) JOIN {name}_l USING (chunk_id) GROUP BY ALL),
{name} AS (SELECT q.query_id, c.chunk_id, coalesce(score, 0) AS score FROM q CROSS JOIN c LEFT JOIN {name}_s s ON s.query_id = q.query_id AND s.chunk_id = c.chunk_id)"""


TFIDF = f"""ti_p AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({WORDS.format('fmt')}) AS term FROM c) GROUP BY ALL),
ti_i AS (SELECT term, ln((1 + (SELECT count(*) FROM c))::DOUBLE / (1 + count(*))) + 1 AS idf FROM ti_p GROUP BY term),
ti_w AS (SELECT chunk_id, term, (1 + ln(tf)) * idf / sqrt(sum(((1 + ln(tf)) * idf) ** 2) OVER (PARTITION BY chunk_id)) AS w FROM ti_p JOIN ti_i USING (term)),
ti_q AS (SELECT query_id, term, (1 + ln(tf)) * idf / sqrt(sum(((1 + ln(tf)) * idf) ** 2) OVER (PARTITION BY query_id)) AS qw
  FROM (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest({WORDS.format('query_text')}) AS term FROM q) GROUP BY ALL) JOIN ti_i USING (term)),
ti_s AS (SELECT query_id, chunk_id, sum(qw * w) AS score FROM ti_q JOIN ti_w USING (term) GROUP BY ALL),
ti AS (SELECT q.query_id, c.chunk_id, coalesce(score, 0) AS score FROM q CROSS JOIN c LEFT JOIN ti_s s ON s.query_id = q.query_id AND s.chunk_id = c.chunk_id)"""


def rank_sql(name: str, of: str, digits: int = 6) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM (SELECT query_id, chunk_id, round(score, {digits}) AS score FROM {of}))"


def norm_sql(name: str, of: str) -> str:
    return f"{name} AS (SELECT query_id, chunk_id, CASE WHEN hi - lo < 1e-9 THEN 0.5::DOUBLE ELSE (score - lo) / (hi - lo + 1e-9) END AS score FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {of}))"


def rrf_sql(name: str, lists: list[tuple[str, float]]) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, chunk_id, {i} AS l, rank, {w}::DOUBLE AS w FROM {r}" for i, (r, w) in enumerate(lists))
    firsts = ", ".join(f"min(rank) FILTER (WHERE l = {i}) AS r{i}" for i in range(len(lists)))
    order = ", ".join(f"r{i} NULLS LAST" for i in range(len(lists)))
    return f"""{name}_u AS ({union}),
{name} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {order}, chunk_id)::INTEGER AS rank
  FROM (SELECT query_id, chunk_id, round(sum(w / (60 + rank)), 12) AS score, {firsts} FROM {name}_u GROUP BY query_id, chunk_id))"""


def top_sql(name: str, k: int = 10) -> str:
    return f"SELECT query_id, chunk_id, score, rank FROM {name} WHERE rank <= {k}"


def dedup_sql(name: str, of: str, most: int, pool: int = 400) -> str:
    """Greedy dedup as a recursion over ranks that carries the accepted token lists."""
    return f"""{name}_p AS (SELECT r.query_id, r.rank, r.chunk_id, r.score, list_distinct({SPLIT.format('fmt')}) AS w FROM {of} r JOIN c USING (chunk_id) WHERE rank <= {pool}),
{name}_r(query_id, lvl, kept, words) AS (
  SELECT query_id, 0, []::STRUCT(chunk_id BIGINT, score DOUBLE)[], []::VARCHAR[][] FROM q
  UNION ALL
  SELECT r.query_id, p.rank,
    CASE WHEN ok THEN list_append(kept, {{'chunk_id': p.chunk_id, 'score': p.score}}) ELSE kept END,
    CASE WHEN ok THEN list_append(words, p.w) ELSE words END
  FROM {name}_r r JOIN {name}_p p ON p.query_id = r.query_id AND p.rank = r.lvl + 1,
  LATERAL (SELECT len(list_filter(words, lambda x: len(x) > 0 AND len(p.w) > 0 AND len(list_intersect(x, p.w)) >= 0.65 * (len(x) + len(p.w) - len(list_intersect(x, p.w))))) = 0 AS ok)
  WHERE len(kept) < {most}),
{name} AS (SELECT query_id, k.chunk_id AS chunk_id, k.score AS score, pos::INTEGER AS rank FROM (
  SELECT query_id, unnest(kept) AS k, generate_subscripts(kept, 1) AS pos FROM (SELECT query_id, arg_max(kept, lvl) AS kept FROM {name}_r GROUP BY query_id)))"""


def mmr_sql(name: str, of: str, k: int = 5) -> str:
    """Maximal marginal relevance over the first 4 * k of ``of``, as a recursion over the picks. Needs TFIDF."""
    return f"""{name}_p AS (SELECT query_id, chunk_id, score, rank, round(CASE WHEN hi - lo > 0 THEN (score - lo) / (hi - lo) ELSE 1 END, 9) AS rel FROM (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {of} WHERE rank <= {4 * k})),
{name}_v AS (SELECT p.query_id, p.chunk_id, term, w FROM {name}_p p JOIN ti_w USING (chunk_id)),
{name}_s AS (SELECT a.query_id, a.chunk_id, list({{'b': b.chunk_id, 'sim': sim}}) AS sims FROM (SELECT x.query_id, x.chunk_id, y.chunk_id AS other, round(sum(x.w * y.w), 9) AS sim FROM {name}_v x JOIN {name}_v y ON x.query_id = y.query_id AND x.term = y.term AND x.chunk_id <> y.chunk_id GROUP BY ALL) a JOIN {name}_p b ON b.query_id = a.query_id AND b.chunk_id = a.other GROUP BY a.query_id, a.chunk_id),
{name}_x AS (SELECT p.*, s.sims FROM {name}_p p LEFT JOIN {name}_s s ON s.query_id = p.query_id AND s.chunk_id = p.chunk_id),
{name}_r(query_id, lvl, picked) AS (
  SELECT DISTINCT query_id, 0, []::BIGINT[] FROM {name}_p
  UNION ALL
  SELECT query_id, any_value(lvl) + 1, list_append(any_value(picked), arg_min(chunk_id, (-v, rank))) FROM (
    SELECT r.query_id, r.lvl, r.picked, x.chunk_id, x.rank,
      CASE WHEN len(r.picked) = 0 THEN x.rel ELSE round(0.7::DOUBLE * x.rel - (1 - 0.7::DOUBLE) * coalesce(list_max(list_transform(list_filter(x.sims, lambda e: list_contains(r.picked, e.b)), lambda e: e.sim)), 0), 9) END AS v
    FROM {name}_r r JOIN {name}_x x ON x.query_id = r.query_id WHERE r.lvl < {k} AND NOT list_contains(r.picked, x.chunk_id))
  GROUP BY query_id),
{name} AS (SELECT l.query_id, l.chunk_id, p.score, l.rank FROM (SELECT query_id, unnest(picked) AS chunk_id, generate_subscripts(picked, 1)::INTEGER AS rank FROM (SELECT query_id, arg_max(picked, lvl) AS picked FROM {name}_r GROUP BY query_id)) l JOIN {name}_p p ON p.query_id = l.query_id AND p.chunk_id = l.chunk_id)"""
