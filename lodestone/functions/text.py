"""Tokenisers and text scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists that define results.
STOPWORDS = """the a an and or but in on at to for with by of from as is was are were be been being have has had do does did this that these those it its we our you your they their he she which can will would should could all any both each more""".split()
INTERROGATIVES = """what how why when where which does do can will should could would explain describe define compare summarize discuss""".split()
COMMUNITY_STOPWORDS = """the and for that this with from have been what does how can are which into their when where model models paper study approach system using based such both each other some many""".split()

#: Unicode white space as a Java class.
SPACES = "[\\s\\u001c-\\u001f\\u0085\\p{Z}]+"


def words_by_space(text: Column) -> Column:
    """Lower-cased tokens between white space."""
    return F.filter(F.split(F.lower(text), SPACES), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def alnum_tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), F.lit(0))


def ascii_words(text: Column) -> Column:
    """Whole words of three or more letters a to z."""
    return F.filter(word_tokens(text), lambda w: w.rlike("^[a-z]{3,}$"))


def content_tokens(text: Column) -> Column:
    """Alphanumeric tokens that are no stop words and longer than one character."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(alnum_tokens(text), lambda w: ~F.array_contains(stop, w) & (F.length(w) > 1))


def formatted(doc: Column, page: Column, section: Column, text: Column) -> Column:
    """The text with its provenance header."""
    return F.concat(F.lit("["), doc, F.lit(" | Page "), page.cast("string"), F.lit(" | § "), section, F.lit("] "), text)


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 if either is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
