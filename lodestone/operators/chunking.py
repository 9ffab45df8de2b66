"""Sentence-aware chunking as array folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import SPACES
from lodestone.sources.tables import MAX_WORDS, MIN_WORDS, OVERLAP

# The patterns that define sections and sentences.
HEADER = "^(?:(?:\\d+\\.?)+\\s+[A-Z][A-Za-z0-9\\s—–:-]{2,60}|(?:Abstract|Introduction|Conclusion|References|Related Work|Methodology|Discussion|Background))\\s*$"
SENTENCE_END = "(?<=[.?!])\\s+(?=[A-Z0-9\"“])"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def sentences(text: Column) -> Column:
    """Sentences of a text, paragraph by paragraph; lines of a paragraph are joined by spaces."""

    def of_paragraph(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(p, "\\R"), _strip), lambda x: x != "")
        return F.filter(F.transform(F.split(F.array_join(lines, " "), SENTENCE_END), _strip), lambda s: s != "")

    return F.flatten(F.transform(F.split(text, "\n\n"), of_paragraph))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))


def header_of(text: Column) -> Column:
    """The first line of a page that looks like a section header and has at most eight words."""
    lines = F.filter(F.transform(F.split(text, "\\R"), _strip), lambda x: x != "")
    return F.get(F.filter(lines, lambda x: x.rlike(HEADER) & (word_count(x) <= 8)), F.lit(0))


def with_sections(pages: DataFrame) -> DataFrame:
    """pages (doc_name, page_num, raw_text) with their section, carried on from page to page."""
    order = Window.partitionBy("doc_name").orderBy("page_num").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("section", F.coalesce(F.last(header_of(F.col("raw_text")), ignorenulls=True).over(order), F.lit("Overview")))


def fold_sentences(sents: Column, max_words: int, overlap: int, min_words: int) -> Column:
    """Chunk texts of one page: filled greedily, each starting with the last sentences of the one before."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("open"), F.lit(0).alias("words"))

    def step(acc: Column, s: Column) -> Column:
        n = word_count(s)
        full = (acc["words"] + n > max_words) & (F.size(acc["open"]) > 0)
        size = F.size(acc["open"])
        kept = F.when(full, F.slice(acc["open"], F.greatest(size - overlap + 1, F.lit(1)), overlap) if overlap else empty).otherwise(acc["open"])
        words = F.when(full, F.aggregate(kept, F.lit(0), lambda a, x: a + word_count(x))).otherwise(acc["words"])
        done = F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.concat(kept, F.array(s)).alias("open"), (words + n).alias("words"))

    def finish(acc: Column) -> Column:
        tail = (F.size(acc["open"]) > 0) & (acc["words"] >= min_words)
        return F.when(tail, F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).otherwise(acc["done"])

    return F.aggregate(sents, start, step, finish)


def chunk_pages(pages: DataFrame, first_id: int = 0, max_words: int = MAX_WORDS, overlap: int = OVERLAP, min_words: int = MIN_WORDS) -> DataFrame:
    """(chunk_id, doc_name, page_num, section, text): the chunks of pages, ids in page order.

    Ids come from per-document counts and one running sum over documents, so no task
    sees more than one document's chunks.
    """
    texts = with_sections(pages).withColumn("pieces", fold_sentences(sentences(F.col("raw_text")), max_words, overlap, min_words))
    rows = texts.select("doc_name", "page_num", "section", F.posexplode("pieces").alias("pos", "text"))
    counts = texts.groupBy("doc_name").agg(F.sum(F.size("pieces")).alias("n"))
    before = counts.select("doc_name", F.coalesce(F.sum("n").over(Window.orderBy("doc_name").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("doc_name").orderBy("page_num", "pos"))
    return rows.withColumn("place", place).join(before, "doc_name").select((F.col("before") + F.col("place") - 1 + first_id).cast("bigint").alias("chunk_id"), "doc_name", "page_num", "section", "text")


def parse_formatted(fmt: Column) -> Column:
    """The struct back from a formatted text; what does not match is a chunk of unknown provenance."""
    pattern = "(?s)^\\[(.*?) \\| Page (\\d+) \\| § (.*?)\\] (.*)$"
    got = lambda i: F.regexp_extract(fmt, pattern, i)
    ok = fmt.rlike(pattern)
    return F.struct(F.when(ok, got(1)).otherwise("Unknown").alias("doc_name"), F.when(ok, got(2).cast("int")).otherwise(1).alias("page_num"), F.when(ok, got(3)).otherwise("Overview").alias("section"), F.when(ok, got(4)).otherwise(fmt).alias("text"))
