"""Operator 2: exact substring dedup over words by level-wise doubling.

Level one looks at windows of half the wanted length, one chosen for each wanted window
(its anchor). Only windows that repeat there are extended to twice that length, where
they are compared in full. ``longest_repeats`` goes on doubling from level to level
until no candidate survives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import anchors
from lodestone.llm.blocks import Slice, slices
from lodestone.llm.shared import documents, written

MIN_WORDS = 50
_I = np.int64


def word_units(part: Slice, width: int = 0) -> Iterator[tuple[anchors.Units, int]]:
    words = part.words()
    yield anchors.Units(lambda k: part.span_codes(words.start, words.end, k), words.row), 0


def joined_words(part: Slice) -> list[bytes]:
    return [b" ".join(part.raw(r).split()) for r in range(part.n)]


def _survivors(docs: DataFrame, min_words: int) -> tuple[anchors.Scan, DataFrame]:
    """The scan, and (doc_id, start, many): windows that start in an earlier document too."""
    half = (min_words + 1) // 2
    scan = anchors.scan(docs, word_units, joined_words, min_words, half, across=True)
    classes = scan.classes.select("anchor", "h1", "h2", F.col("rep.doc_id").alias("first"))
    # tables of their own, so that the rows of a segment that very many documents hold can be split
    settled = written(scan.found.join(classes.hint("merge"), ["anchor", "h1", "h2"]).where("doc_id > first").select("doc_id", "start", "many"), "settled")
    # the first holder of each contested segment: its windows against all others of the anchor
    windows = written(anchors.window_hashes(scan.texts, anchors.contested(scan.classes), word_units, min_words), "windows")
    earliest = written(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h1", "h2", "first"), "earliest")
    single = written(windows.join(earliest.hint("merge"), ["h1", "h2"]).where("doc_id > first").select("doc_id", "start"), "single")
    return scan, settled.unionByName(_as_runs(single.unionByName(_again(scan, single))))


def _as_runs(single: DataFrame) -> DataFrame:
    """(doc_id, start, many) of single windows (doc_id, start), merged within blocks of 63 starts.

    Each block is a bit mask, summed up by an aggregate of fixed width before anything is
    gathered by document.
    """
    block = F.floor(F.col("start") / 63)
    masks = single.groupBy("doc_id", block.alias("block")).agg(F.expr("bit_or(shiftleft(1L, int(pmod(start, 63))))").alias("mask"))
    # the runs of ones: where one begins, and how far it goes
    text = F.reverse(F.lpad(F.bin("mask"), 63, "0"))
    begins = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: (F.substring(text, i + 1, F.lit(1)) == "1") & ((i == 0) | (F.substring(text, i, F.lit(1)) == "0")))
    runs = masks.select("doc_id", "block", text.alias("text"), F.explode(begins).alias("i"))
    many = F.length(F.regexp_extract(F.expr("substring(text, i + 1)"), "^1+", 0))
    return runs.select("doc_id", (F.col("block") * 63 + F.col("i")).cast("int").alias("start"), many.cast("int").alias("many"))


def _again(scan: anchors.Scan, single: DataFrame) -> DataFrame:
    """(doc_id, start): the windows of ``single`` where their document repeats the segment.

    Only one occurrence of a segment in its first document is compared; what repeats there
    repeats in the document's other occurrences at the same place.
    """
    reps = scan.classes.where("n > 1").select("anchor", "h1", "h2", F.col("rep.doc_id").alias("doc_id"), F.col("rep.start").alias("rep_start"))
    # joined by document too, so a segment of very many documents stays spread out
    twins = scan.found.join(reps, ["anchor", "h1", "h2", "doc_id"]).where("start <> rep_start").select("doc_id", "rep_start", "many", (F.col("start") - F.col("rep_start")).alias("shift")).distinct()
    inside = twins.select("doc_id", "rep_start", "many").distinct().select("doc_id", "rep_start", F.explode(F.expr("sequence(rep_start, rep_start + many - 1)")).alias("start"))
    return single.join(inside, ["doc_id", "start"]).join(twins.select("doc_id", "rep_start", "shift"), ["doc_id", "rep_start"]).select("doc_id", (F.col("start") + F.col("shift")).alias("start"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the words that repeat an earlier document: one row for each row.

    A word goes if it lies in ``min_words`` consecutive words that also start in a document
    with a smaller doc_id. Columns: doc_id, n_words, n_removed, kept_sha256 (of the kept
    words joined by one space).

    Windows are judged on the input. Null and empty texts have no words and lose none; so
    do rows with a null doc_id, which neither repeat nor are repeated; equal rows are one
    document (rows that share a doc_id are taken to share the text); other columns are
    ignored; no rows give no rows.
    """
    scan, gone = _survivors(docs, min_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, structs = anchors.spans_of(batch.column(2))
            begin, many = (structs.field(i).to_numpy().astype(_I) for i in range(2))
            for part in slices(batch):
                mine = slice(*np.searchsorted(rows, [part.first, part.first + part.n]))
                words = part.words()
                out = anchors.covered(rows[mine] - part.first, begin[mine], begin[mine] + many[mine] + min_words - 1, words.row)
                kept, removed = [], []
                for r in range(part.n):
                    flags = out[words.row[r] : words.row[r + 1]]
                    kept.append(hashlib.sha256(b" ".join(w for w, x in zip(part.raw(r).split(), flags.tolist(), strict=True) if not x)).hexdigest())
                    removed.append(int(flags.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_removed", "kept_sha256"])

    cut = anchors.with_text(scan.texts, gone).mapInArrow(run, "doc_id bigint, n_removed bigint, kept_sha256 string").dropDuplicates(["doc_id"])
    copy = F.col("first") < F.col("doc_id")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    result = scan.whole.join(cut, "doc_id", "left").select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
    return result.unionByName(_unnamed(docs))


def _unnamed(docs: DataFrame) -> DataFrame:
    """The rows without a doc_id, as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                wholes = joined_words(part)
                counts = part.words().counts().astype(_I)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array(counts), pa.array(np.zeros(part.n, dtype=_I)), pa.array([hashlib.sha256(x).hexdigest() for x in wholes], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.where("doc_id is null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def longest_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, longest): the greatest ``min_words`` * 2**k at which a document still holds a
    window that starts in an earlier document. Documents without any are left out, and so
    are whole copies, which repeat over their full length.

    Each level compares only windows whose two halves both survived the level before.
    """
    scan, level = _survivors(docs, min_words)
    length, best = min_words, None
    while True:
        level = written(level, "level")
        here = level.select("doc_id").distinct().withColumn("longest", F.lit(length))
        if here.isEmpty():
            return best if best is not None else here
        best = here if best is None else best.unionByName(here).groupBy("doc_id").agg(F.max("longest").alias("longest"))
        windows = written(_doubled(scan.texts, level, length), "doubled")
        length *= 2
        earliest = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
        level = windows.where("survives").join(earliest, ["h1", "h2"]).where("doc_id > first").select("doc_id", "start", F.lit(1).alias("many"))


def _doubled(texts: DataFrame, level: DataFrame, length: int) -> DataFrame:
    """Fingerprints at twice the length of every candidate document's windows.

    ``survives``: both halves repeated an earlier document. The other windows are there
    since the earlier holder of a repeat need not itself repeat anything.
    """
    grouped = level.groupBy("doc_id").agg(F.collect_list(F.struct("start", "many")).alias("spans"))
    joined = texts.select("doc_id", "text").join(grouped, "doc_id", "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<struct<start:int,many:int>>")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, structs = anchors.spans_of(batch.column(2))
            begin, many = (structs.field(i).to_numpy().astype(_I) for i in range(2))
            for part in slices(batch):
                ((units, _),) = word_units(part)
                mine = slice(*np.searchsorted(rows, [part.first, part.first + part.n]))
                marks = anchors.covered(rows[mine] - part.first, begin[mine], begin[mine] + many[mine], units.row)
                owner, n = units.owner(), int(units.row[-1])
                at = np.flatnonzero(np.arange(n) + 2 * length <= units.row[1:][owner])
                both = marks[at] & marks[at + length]
                ids = batch.column(0).slice(part.first, part.n).to_numpy()
                hashes = [anchors.Rolling.over(units.code(k), k).spans(at, at + 2 * length).view(_I) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*hashes, ids[owner[at]], (at - units.row[owner[at]]).astype(np.int32), both)], ["h1", "h2", "doc_id", "start", "survives"])

    return joined.mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, start int, survives boolean")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
