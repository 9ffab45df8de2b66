"""Entity-relation graphs mined from chunks, their traversal, communities and graph scoring."""

from __future__ import annotations

import difflib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import COMMUNITY_STOPWORDS, SPACES, ascii_words
from lodestone.sources.cut import cut

# Patterns and word lists that define entities.
ACRONYM = "\\b[A-Z]{2,10}(?:-[A-Z0-9]+)?\\b"
PROPER_NOUN = "\\b[A-Z][a-z]+(?:\\s+[A-Z][a-z]+){1,3}\\b"
CAMEL_CASE = "\\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\\b"
IGNORED = """THE AND FOR THAT THIS WITH FROM HAVE BEEN THEIR WHICH MORE THESE TABLE FIGURE SECTION PAGE RESULTS METHOD METHODS MODEL MODELS PAPER STUDY APPROACH SYSTEM DATA USING BASED SUCH BOTH EACH OTHER WHERE WHEN INTO ONLY ALSO SOME MANY MOST""".split()
GENERIC_SECTIONS = ["overview", "abstract", "introduction", "references", "conclusion", "acknowledgments", "appendix", "related work"]
AFFILIATION = "(?i)\\b(?:University|College|Department|Institut(?:e|o)|School\\s+of|Faculty\\s+of|Laboratory|Lab\\s+of|Center\\s+for|Centre\\s+for|Division\\s+of|Program\\s+in|Graduate\\s+School|Foundation|Corporation|Research\\s+Group)\\b"
SECTION_ARTIFACT = "(?i)^(?:§\\s*|\\d+(?:\\.\\d+)*\\.?\\s+|[IVXLCDM]+\\.\\s+|[A-Z]\\.\\s+|Abstract|Introduction|Conclusion|References|Acknowledgm|Appendix|Related Work)"
PERSON = "^[A-Z][a-z]{2,15}\\s+[A-Z][a-z]{2,15}$"
SECTION_PREFIX = "^(?:§\\s*|\\d+(?:\\.\\d+)*\\.?\\s+|[IVXLCDM]+\\.\\s+|[A-Z]\\.\\s+)"
TYPES = ["SECTION_CONCEPT", "TECHNICAL_ACRONYM", "FRAMEWORK_COMPONENT", "CONCEPT"]
STRIPPED = ".,;:()[]{}\"'"


def word_bounded(text: Column) -> Column:
    """Text in which ASCII word borders are Unicode word borders: other letters become ``_``."""
    return F.regexp_replace(text, "[[\\p{L}\\p{N}]&&[^\\x00-\\x7F]]", "_")


def normalize_name(name: Column) -> Column:
    """White space collapsed, surrounding punctuation stripped."""
    return F.btrim(F.btrim(F.regexp_replace(name, SPACES, " ")), F.lit(STRIPPED))


def strip_prefix(section: Column) -> Column:
    """A heading without its number, letter or Roman numeral."""
    return F.btrim(F.regexp_replace(F.btrim(section), SECTION_PREFIX, ""))


def mentions(chunks: DataFrame) -> DataFrame:
    """(chunk_id, doc_name, name, priority): distinct surface forms; priority is the index of their type."""
    ignored = F.array(*[F.lit(w) for w in IGNORED])
    text = word_bounded(F.col("text"))
    found = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    section = strip_prefix(normalize_name(F.col("section")))
    good_section = ~F.lower("section").isin(GENERIC_SECTIONS) & (F.length(section) > 4) & ~F.array_contains(ignored, F.upper(section)) & ~section.rlike(SECTION_ARTIFACT) & ~section.rlike(AFFILIATION)
    sections = F.when(good_section, F.array(section)).otherwise(F.array().cast("array<string>"))
    acronyms = F.filter(found(ACRONYM), lambda w: ~F.array_contains(ignored, w))
    camels = F.filter(found(CAMEL_CASE), lambda w: ~F.array_contains(ignored, F.upper(w)))
    proper = F.filter(found(PROPER_NOUN), lambda w: F.exists(F.split(w, SPACES), lambda x: ~F.array_contains(ignored, F.upper(x))))
    concepts = F.filter(F.transform(proper, normalize_name), lambda w: (F.length(w) > 4) & ~w.rlike(AFFILIATION) & ~w.rlike(PERSON))

    def tagged(names: Column, priority: int) -> Column:
        return F.transform(F.array_distinct(names), lambda w: F.struct(w.alias("name"), F.lit(priority).alias("priority")))

    every = F.concat(*[tagged(names, i) for i, names in enumerate((sections, acronyms, camels, concepts))])
    return chunks.select("chunk_id", "doc_name", F.explode(every).alias("m")).select("chunk_id", "doc_name", "m.name", "m.priority")


def entities(found: DataFrame) -> DataFrame:
    """(name, entity_type, n_chunks, chunk_ids, doc_names): the first mention fixes the type."""
    types = F.array(*[F.lit(t) for t in TYPES])
    return found.groupBy("name").agg(
        F.element_at(types, F.min(F.struct("chunk_id", "priority"))["priority"] + 1).alias("entity_type"),
        F.countDistinct("chunk_id").alias("n_chunks"),
        F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"),
        F.array_sort(F.collect_set("doc_name")).alias("doc_names"),
    )


def resolve_exact(ents: DataFrame) -> DataFrame:
    """Entities whose normalised lower-case names agree, merged under the one seen first."""
    key = F.lower(normalize_name(F.col("name")))
    first = F.min(F.struct(F.element_at("chunk_ids", 1).alias("c"), "name", "entity_type"))
    merged = ents.withColumn("key", key).where(F.length("key") >= 2).groupBy("key").agg(first.alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("chunk_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("doc_names")))).alias("doc_names"))
    return merged.select("key", F.col("f.name").alias("name"), F.col("f.entity_type").alias("entity_type"), F.size("chunk_ids").alias("n_chunks"), "chunk_ids", "doc_names")


def resolve_fuzzy(ents: DataFrame, threshold: float = 0.88) -> DataFrame:
    """(name, canonical): names mapped to the first earlier name that is similar enough.

    ents: (name, key, entity_type, chunk_ids). Candidates share a character trigram and have
    lengths that allow the ratio; an earlier entity matches if it has the same type or the
    later one is a CONCEPT. Each later name goes to its earliest match, then to that one's.
    """
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("key") - 2, F.lit(1))), lambda i: F.substring(F.col("key"), i, F.lit(3))))
    order = F.struct(F.element_at("chunk_ids", 1).alias("c"), F.col("name").alias("n"))
    base = ents.select("name", "key", "entity_type", order.alias("o"), F.explode(grams).alias("g"))
    a, b = base.alias("a"), base.alias("b")
    near = a.join(b, "g").where("a.o > b.o AND (a.entity_type = b.entity_type OR a.entity_type = 'CONCEPT')").where(2.0 * F.least(F.length("a.key"), F.length("b.key")) / (F.length("a.key") + F.length("b.key")) >= threshold)
    pairs = near.select(F.col("a.name").alias("name"), F.col("a.key").alias("ka"), F.col("b.name").alias("other"), F.col("b.key").alias("kb"), F.col("b.o").alias("o")).distinct()
    close = pairs.where(ratio("ka", "kb") >= threshold).groupBy("name").agg(F.min(F.struct("o", "other"))["other"].alias("canonical"))
    direct = ents.select("name").join(close, "name", "left").select("name", F.coalesce("canonical", "name").alias("canonical"))
    again = direct.select(F.col("name").alias("canonical"), F.col("canonical").alias("next"))
    return direct.join(again, "canonical").select("name", F.col("next").alias("canonical"))


def is_noise(name: Column, kind: Column, n_chunks: Column) -> Column:
    """Short singletons, section artefacts, affiliations, personal names, digits before words."""
    once = n_chunks <= 1
    short = once & ~((kind == "TECHNICAL_ACRONYM") & (F.length(name) >= 3)) & (F.length(name) < 5)
    section = (kind == "SECTION_CONCEPT") & (name.rlike(SECTION_ARTIFACT) | once)
    person = name.rlike(PERSON) & (kind == "CONCEPT")
    return short | section | name.rlike(AFFILIATION) | person | name.rlike("\\b\\d+\\s+[A-Z]")


def cooccurrence(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, n, chunk_ids, snippet): entities of a chunk that share a sentence, a < b."""
    sentences = chunks.select("chunk_id", F.posexplode(F.split("text", "(?<=[.!?])\\s+")).alias("pos", "sentence"))
    names = found.select("chunk_id", "name").distinct()
    inside = sentences.join(names, "chunk_id").where(F.contains("sentence", "name"))
    # a sentence holds a bounded number of names
    here = inside.groupBy("chunk_id", "pos", "sentence").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") > 1)
    pairs = here.select("chunk_id", "pos", "sentence", F.explode(F.flatten(F.transform("names", lambda x, i: F.transform(F.slice(F.col("names"), i + 2, F.size("names")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.min(F.struct("chunk_id", "pos", F.btrim("sentence").alias("s")))["s"].alias("snippet"))


def relationships(pairs: DataFrame, valid: DataFrame) -> DataFrame:
    """(src, dst, relation_type, weight, description, chunk_ids) between surviving entities."""
    name = lambda c: valid.select(F.col("name").alias(c))
    both = pairs.join(name("a"), "a", "left_semi").join(name("b"), "b", "left_semi")
    short = F.when(F.length("snippet") > 200, F.concat(F.substring("snippet", 1, 197), F.lit("..."))).otherwise(F.col("snippet"))
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("CO_OCCURS_WITH").alias("relation_type"), (1 + F.log1p("n")).alias("weight"), short.alias("description"), "chunk_ids")


def extract(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of a corpus: mined, resolved, filtered."""
    found = mentions(chunks)
    ents = resolve_exact(entities(found)).where(~is_noise(F.col("name"), F.col("entity_type"), F.col("n_chunks")))
    return ents, relationships(cooccurrence(chunks, found), ents)


#: What an extracting model reads of a chunk. Fixed value.
MODEL_CHARS = 2000
MODEL_ROWS = "chunk_id bigint, doc_name string, ok boolean, entities array<struct<name:string,entity_type:string,description:string>>, relations array<struct<src:string,dst:string,relation_type:string,description:string,weight:double>>"


def parsed_reply(reply: str) -> tuple[list[tuple], list[tuple]]:
    """Entities (name, entity_type, description) and relations (src, dst, relation_type,
    description, weight) of a model's JSON, fenced or not. ValueError if it is none."""
    data = json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", reply.strip(), flags=re.IGNORECASE))
    if not isinstance(data, dict):
        raise ValueError("the reply is no JSON object")
    try:
        ents = [(str(e.get("name", "")), str(e.get("entity_type", "CONCEPT")), str(e.get("description", ""))) for e in data.get("entities", [])]
        rels = [(str(r.get("source", "")), str(r.get("target", "")), str(r.get("relation_type", "RELATED_TO")), str(r.get("description", "")), float(r.get("weight", 1.0))) for r in data.get("relationships", [])]
    except (AttributeError, TypeError) as error:
        raise ValueError(str(error)) from error
    return ents, rels


def extract_by_model(chunks: DataFrame, call: Callable[[str], str] | None, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the replies of a model to each chunk's text.

    A chunk without a usable reply is mined by patterns, as all are without a model; with
    ``strict`` an error of the call itself fails the job. The replies are written once.
    """
    if call is None:
        return extract(chunks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk_id, doc_name, text in zip(batch["chunk_id"], batch["doc_name"], batch["text"], strict=True):
                try:
                    reply = call((text or "")[:MODEL_CHARS])
                except Exception:
                    if strict:
                        raise
                    rows.append((chunk_id, doc_name, False, [], []))
                    continue
                try:
                    rows.append((chunk_id, doc_name, True, *parsed_reply(reply)))
                except ValueError:
                    rows.append((chunk_id, doc_name, False, [], []))
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_name", "ok", "entities", "relations"])

    replies = cut(chunks.select("chunk_id", "doc_name", "text").mapInPandas(run, MODEL_ROWS))
    said = replies.select("chunk_id", "doc_name", F.explode("entities").alias("e")).select(normalize_name(F.col("e.name")).alias("name"), "e.entity_type", F.array("chunk_id").alias("chunk_ids"), F.array("doc_name").alias("doc_names")).where(F.length("name") >= 2)
    pairs = replies.select("chunk_id", F.explode("relations").alias("r")).select(normalize_name(F.col("r.src")).alias("src"), normalize_name(F.col("r.dst")).alias("dst"), "r.relation_type", "r.weight", "r.description", F.array("chunk_id").alias("chunk_ids"))
    mined, edges = extract(chunks.join(replies.where("ok").select("chunk_id"), "chunk_id", "left_anti"))
    vertices = resolve_exact(said.unionByName(mined.select(*said.columns)))
    every = pairs.where("src <> '' AND dst <> '' AND src <> dst").unionByName(edges.select(*pairs.columns))
    name = lambda c: vertices.select(F.col("name").alias(c))
    return vertices, upsert_relationships(None, every.join(name("src"), "src", "left_semi").join(name("dst"), "dst", "left_semi"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """Parallel edges of a type as one: weights added, chunks united."""
    return edges.groupBy("src", "dst", "relation_type").agg(F.sum("weight").alias("weight"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("chunk_ids"))


def upsert_entities(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(name, entity_type, description, chunk_ids, doc_names): new entities added to old ones.

    Provenance is united; the type of the earlier and the first description that says
    something stay. new may lack description, and may name an entity several times: then the
    one of the first chunk is the earlier.
    """
    def part(df: DataFrame, age: int) -> DataFrame:
        text = F.col("description") if "description" in df.columns else F.lit("")
        order = F.struct(F.lit(age).alias("age"), F.coalesce(F.array_min("chunk_ids"), F.lit(-1)).alias("c"), F.col("entity_type").alias("t"), text.alias("d"))
        return df.select("name", "entity_type", text.alias("description"), "chunk_ids", "doc_names", order.alias("o"))

    both = part(new, 1) if old is None else part(old, 0).unionByName(part(new, 1))
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    said = F.min_by("description", F.when(F.coalesce("description", F.lit("")) != "", F.col("o")))
    return both.groupBy("name").agg(F.min_by("entity_type", "o").alias("entity_type"), F.coalesce(said, F.lit("")).alias("description"), united("chunk_ids"), united("doc_names"))


def with_endpoints(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices and, as bare concepts, the ends of edges that they lack."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct().join(vertices.select("name"), "name", "left_anti")
    types = {f.name: f.dataType for f in vertices.schema}
    bare = ends.select("name", F.lit("CONCEPT").alias("entity_type"), F.lit("").alias("description"), F.array().cast(types["chunk_ids"]).alias("chunk_ids"), F.array().cast(types["doc_names"]).alias("doc_names"))
    return vertices.unionByName(bare)


def upsert_relationships(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """(src, dst, relation_type, weight, description, chunk_ids): weights of equal edges added, the first description kept."""
    columns = ["src", "dst", "relation_type", "weight", "description", "chunk_ids"]
    both = new.select(*columns, F.lit(1).alias("age"))
    if old is not None:
        both = old.select(*columns, F.lit(0).alias("age")).unionByName(both)
    order = F.struct("age", F.coalesce(F.array_min("chunk_ids"), F.lit(-1)).alias("c"), "description")
    return both.groupBy("src", "dst", "relation_type").agg(F.sum("weight").alias("weight"), F.min_by("description", order).alias("description"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunk_ids")))).alias("chunk_ids"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight): edge weights added up regardless of direction and type."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("weight"))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, degree) counting every edge end; isolated vertices have 0."""
    ends = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name")))
    return vertices.select("name").join(ends.groupBy("name").agg(F.count("*").alias("degree")), "name", "left").select("name", F.coalesce("degree", F.lit(0)).alias("degree"))


def neighbours(edges: DataFrame, starts: DataFrame, hops: int = 1) -> DataFrame:
    """(start, hop, src, dst, weight, chunk_ids): edges met within some hops, in stored direction.

    starts: (start). Every node is left once; an edge may be met from both its ends.
    """
    frontier, seen, met = starts.select("start", F.col("start").alias("node")), starts.select("start", F.col("start").alias("node")), None
    for hop in range(1, hops + 1):
        out = frontier.join(edges, F.col("node") == F.col("src")).select("start", "src", "dst", "weight", "chunk_ids", F.col("dst").alias("next"))
        into = frontier.join(edges, F.col("node") == F.col("dst")).select("start", "src", "dst", "weight", "chunk_ids", F.col("src").alias("next"))
        step = out.unionByName(into)
        here = step.select("start", F.lit(hop).alias("hop"), "src", "dst", "weight", "chunk_ids")
        met = here if met is None else met.unionByName(here)
        frontier = step.select("start", F.col("next").alias("node")).distinct().join(seen, ["start", "node"], "left_anti")
        seen = seen.unionByName(frontier)
    return met


def communities(vertices: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(name, community): connected components named by their smallest member.

    Labels fall to the smallest among neighbours, then jump to their label's label; each
    round is written to the checkpoint folder. Isolated vertices are their own community.
    """
    both = edges.select(F.col("src").alias("name"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("name"), F.col("src").alias("other"))).distinct()
    both = cut(both)
    labels, before = cut(vertices.select("name", F.col("name").alias("community"))), None
    for _ in range(rounds):
        near = both.join(labels.select(F.col("name").alias("other"), "community"), "other").groupBy("name").agg(F.min("community").alias("m"))
        lower = labels.join(near, "name", "left").select("name", F.least("community", F.coalesce("m", "community")).alias("community"))
        jump = lower.select(F.col("name").alias("community"), F.col("community").alias("next"))
        labels = cut(lower.join(jump, "community").select("name", F.col("next").alias("community")))
        state = labels.agg(F.sum(F.xxhash64("name", "community").cast("decimal(38,0)"))).first()[0]
        if state == before:
            return labels
        before = state
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def modularity(edges: DataFrame, members: DataFrame) -> float:
    """Modularity of (name, community) over the undirected weights; 0 without edges."""
    of = lambda end, c: members.select(F.col("name").alias(end), F.col("community").alias(c))
    both = undirected(edges).join(of("a", "ca"), "a").join(of("b", "cb"), "b")
    ends = both.select(F.col("ca").alias("c"), "weight", (F.col("ca") == F.col("cb")).alias("inner")).unionByName(both.select(F.col("cb").alias("c"), "weight", F.lit(False).alias("inner")))
    # an inner edge counts from both ends, but is marked on one
    sums = ends.groupBy("c").agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("inner"), 2 * F.col("weight")).otherwise(0.0)).alias("within"))
    total = sums.agg(F.sum("k").alias("m2"), F.sum("within").alias("w"), F.sum(F.col("k") * F.col("k")).alias("kk")).first()
    return total.w / total.m2 - total.kk / total.m2**2 if total.m2 else 0.0


def louvain(vertices: DataFrame, edges: DataFrame, rounds: int = 12, levels: int = 4) -> DataFrame:
    """(name, community): communities by local moves that raise modularity, named by their smallest member.

    In each round every node finds the community among its neighbours' with the greatest gain,
    ties to its own, then to the smallest name; the half of the nodes that a hash of name and
    round picks moves, so that neighbours do not swap for ever. Communities then become the
    nodes of the next level, as long as modularity rises. Reruns agree; isolated vertices are
    their own community. Gains come from partial aggregates of links, never from a node's list.
    """
    ends = undirected(edges).where("a <> b")
    links = cut(ends.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(ends.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight")))
    m2 = links.agg(F.sum("weight")).first()[0]
    members = cut(vertices.select("name", F.col("name").alias("community")))
    if not m2:
        return members
    nodes, best = cut(links.groupBy("node").agg(F.sum("weight").alias("k"))), modularity(edges, members)
    for level in range(levels):
        labels = nodes.select("node", F.col("node").alias("community"), "k")
        for turn in range(rounds):
            totals = labels.groupBy("community").agg(F.sum("k").alias("total"))
            near = links.join(labels.select(F.col("node").alias("other"), "community"), "other").select("node", "community", "weight")
            options = near.unionByName(labels.select("node", "community", F.lit(0.0).alias("weight"))).groupBy("node", "community").agg(F.sum("weight").alias("w"))
            rated = options.join(totals, "community").join(labels.select("node", F.col("community").alias("own"), "k"), "node")
            other = F.col("community") != F.col("own")
            gain = F.col("w") - F.col("k") * (F.col("total") - F.when(other, 0.0).otherwise(F.col("k"))) / m2
            choice = rated.groupBy("node").agg(F.min_by("community", F.struct(F.round(-gain, 9).alias("g"), other.alias("o"), F.col("community"))).alias("to"))
            turns = F.pmod(F.xxhash64("node", F.lit(level), F.lit(turn)), F.lit(2)) == 0
            state = cut(labels.join(choice, "node").select("node", F.when(turns, F.col("to")).otherwise(F.col("community")).alias("community"), "k", (F.col("to") != F.col("community")).alias("restless")))
            labels = state.drop("restless")
            if state.where("restless").isEmpty():
                break
        joined = cut(members.join(labels.select(F.col("node").alias("community"), F.col("community").alias("next")), "community", "left").select("name", F.coalesce("next", "community").alias("community")))
        now = modularity(edges, joined)
        if now <= best + 1e-9:
            break
        members, best = joined, now
        name = lambda c: labels.select(F.col("node").alias(c), F.col("community").alias(f"{c}_next"))
        links = cut(links.join(name("node"), "node").join(name("other"), "other").where("node_next <> other_next").groupBy(F.col("node_next").alias("node"), F.col("other_next").alias("other")).agg(F.sum("weight").alias("weight")))
        nodes = cut(labels.groupBy(F.col("community").alias("node")).agg(F.sum("k").alias("k")))
    first = members.groupBy("community").agg(F.min("name").alias("first"))
    return members.join(first, "community").select("name", F.col("first").alias("community"))


# --- queries against a graph


def query_entities(queries: DataFrame, vertices: DataFrame) -> DataFrame:
    """(query_id, name): entities that a query names.

    A name matches as a whole-word phrase or as one of the query's acronyms; only a query
    without such a match falls back to names all of whose content words it contains.
    Phrases are found by joining the query's word runs with the names' runs, never by
    testing every name against every query.
    """
    stop = F.array(*[F.lit(w) for w in COMMUNITY_STOPWORDS])
    pieces = lambda c: F.regexp_extract_all(c, F.lit("[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+"), F.lit(0))
    low = vertices.select("name", F.lower("name").alias("low"))
    usable = low.where(~F.col("low").isin(COMMUNITY_STOPWORDS) & (F.length("low") >= 3)).withColumn("n", F.size(pieces(F.col("low"))))
    widths = usable.select("n").distinct()
    runs = queries.select("query_id", pieces(F.lower("query_text")).alias("p")).join(widths).select("query_id", F.explode(F.when(F.size("p") >= F.col("n"), F.transform(F.sequence(F.lit(1), F.size("p") - F.col("n") + 1), lambda i: F.array_join(F.slice("p", i, F.col("n")), "")))).alias("low")).distinct()
    phrases = runs.join(usable, "low").select("query_id", "name")
    acronyms = queries.select("query_id", F.explode(F.regexp_extract_all(word_bounded(F.col("query_text")), F.lit("\\b[A-Z]{2,10}\\b"), F.lit(0))).alias("a")).select("query_id", F.lower("a").alias("low")).distinct()
    direct = phrases.unionByName(acronyms.join(low, "low").select("query_id", "name")).distinct()
    words = lambda c: F.array_distinct(F.array_except(ascii_words(c), stop))
    parts = low.select("name", words(F.col("low")).alias("w")).where(F.size("w") >= 2).select("name", F.size("w").alias("need"), F.explode("w").alias("word"))
    open_ = queries.join(direct.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.explode(words(F.col("query_text"))).alias("word"))
    subset = open_.join(parts, "word").groupBy("query_id", "name", "need").agg(F.count("*").alias("have")).where("have = need").select("query_id", "name")
    return direct.unionByName(subset)


def local_scores(queries: DataFrame, vertices: DataFrame, edges: DataFrame, n_chunks: int) -> DataFrame:
    """(query_id, chunk_id, score): named entities, their edges and neighbours, scaled to a maximum of 1."""
    named = query_entities(queries, vertices)
    idf = F.log((n_chunks - F.col("n_chunks") + 0.5) / (F.col("n_chunks") + 0.5) + 1)
    weight = F.when(F.col("entity_type") == "SECTION_CONCEPT", F.lit(1.0)).otherwise(5 * idf)
    direct = named.join(vertices, "name").select("query_id", F.explode("chunk_ids").alias("chunk_id"), weight.alias("s"))
    starts = named.select("query_id", "name")
    met = starts.join(edges, F.col("name") == F.col("src")).select("query_id", "src", "dst", "weight", "chunk_ids").unionByName(starts.join(edges, F.col("name") == F.col("dst")).select("query_id", "src", "dst", "weight", "chunk_ids"))
    along = met.select("query_id", F.explode("chunk_ids").alias("chunk_id"), (1.5 * F.least("weight", F.lit(3.0))).alias("s"))
    beside = met.select("query_id", F.explode(F.array("src", "dst")).alias("name")).distinct().join(starts, ["query_id", "name"], "left_anti").join(vertices.where("entity_type <> 'SECTION_CONCEPT'"), "name").select("query_id", F.explode("chunk_ids").alias("chunk_id"), F.lit(0.8).alias("s"))
    return _scaled(direct.unionByName(along).unionByName(beside))


def _scaled(parts: DataFrame) -> DataFrame:
    summed = parts.groupBy("query_id", "chunk_id").agg(F.sum("s").alias("s"))
    return summed.select("query_id", "chunk_id", (F.col("s") / F.max("s").over(Window.partitionBy("query_id"))).alias("score"))


def global_scores(queries: DataFrame, vertices: DataFrame, members: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score): the two best communities by query words in their members' names."""
    stop = F.array(*[F.lit(w) for w in COMMUNITY_STOPWORDS])
    tokens = queries.select("query_id", F.explode(F.array_except(F.array_distinct(ascii_words(F.col("query_text"))), stop)).alias("t"))
    sizes = members.groupBy("community").agg(F.count("*").alias("members"))
    names = members.select("community", F.lower("name").alias("low"))
    # a name that holds a token holds its first three letters: joined on those, then verified
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - 2), lambda i: F.substring(F.col("low"), i, F.lit(3))))
    indexed = names.where(F.length("low") >= 3).select("community", "low", F.explode(grams).alias("gram"))
    hits = tokens.withColumn("gram", F.substring("t", 1, 3)).join(indexed, "gram").where(F.contains("low", "t")).select("query_id", "community", "t").distinct()
    overlap = hits.groupBy("query_id", "community").agg(F.count("*").alias("n"), F.max(F.length("t")).alias("longest")).where("n >= 2 OR longest >= 6")
    scored = overlap.join(sizes, "community").withColumn("s", F.round(F.col("n") / (F.sqrt("members") + 1e-6), 9))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "community"))).where("r <= 2")
    spread = best.join(members, "community").join(vertices.select("name", "chunk_ids"), "name").select("query_id", F.explode("chunk_ids").alias("chunk_id"), "s")
    return _scaled(spread)


def graph_scores(queries: DataFrame, vertices: DataFrame, edges: DataFrame, members: DataFrame, n_chunks: int) -> DataFrame:
    """Local scores where a query has any, else global ones."""
    local = local_scores(queries, vertices, edges, n_chunks)
    rest = queries.join(local.select("query_id").distinct(), "query_id", "left_anti")
    return local.unionByName(global_scores(rest, vertices, members))
