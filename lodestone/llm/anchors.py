"""Shared ground of the exact repeat finders (operators 2 and 6).

Both ask which windows of ``width`` units (words or bytes) occur elsewhere, over a whole
corpus, without shuffling every window. A window's *anchor* is the least hash among its
windows of length ``part`` < width. Equal windows have equal anchors, and neighbouring
windows mostly share one, so a corpus has about 2 / (width - part + 2) anchor runs a unit.

1. Anchors are counted; only windows whose anchor occurs twice are candidates.
2. A *segment* is a maximal run of windows around one occurrence of an anchor. Candidate segments are
   compared by 128-bit fingerprints: most repeats are settled here, a segment at a time.
3. Where one anchor has several distinct segments, one representative of each is compared
   window by window (by the operator's own method).

Every step is a partial aggregate or an equi-join that can be split, so an anchor in a
third of all rows stays spread out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import Rolling, Slice, slices, window_min
from lodestone.llm.shared import written

_I = np.int64


@dataclass
class Units:
    """What windows are made of: two code sequences, made on demand, and the rows' offsets."""

    code: Callable[[int], np.ndarray]
    row: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row) - 1), np.diff(self.row))


@dataclass
class Segments:
    """Maximal runs of windows around one occurrence of their anchor.

    Equal windows hold their anchor at the same place, so they are in different segments.
    A segment may be cut in two where a long text is walked in parts; each has its own windows.
    """

    anchor: np.ndarray
    start: np.ndarray
    many: np.ndarray
    row: np.ndarray

    def where(self, keep: np.ndarray) -> Segments:
        return Segments(self.anchor[keep], self.start[keep], self.many[keep], self.row[keep])


def segments(units: Units, width: int, part: int) -> tuple[Segments, Rolling]:
    """The segments of a slice, and the rolling hash they were found with."""
    rolling = Rolling.over(units.code(0))
    grams = rolling.windows(part)
    least = window_min(grams, width - part + 1)
    n = len(least)
    owner = units.owner()[:n]
    fits = np.arange(n) + width <= units.row[1:][owner]
    same = np.zeros(n, dtype=bool)
    # a window that starts with its anchor is the last to hold that occurrence of it
    same[1:] = fits[1:] & fits[:-1] & (least[1:] == least[:-1]) & (owner[1:] == owner[:-1]) & (grams[: max(n - 1, 0)] != least[:-1])
    first = np.flatnonzero(fits & ~same)
    edge = np.append(np.flatnonzero(~same), n)  # where any run, fitting or not, begins
    many = edge[np.searchsorted(edge, first, side="right")] - first
    return Segments(least[first].view(_I), first, many, owner[first]), rolling


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """Values with ascending row numbers as one list a row."""
    off = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values))


def listed(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flattened int64 values of a list column and their row numbers."""
    many = np.diff(col.offsets.to_numpy())
    return col.flatten().to_numpy(zero_copy_only=False).astype(_I), np.repeat(np.arange(len(col)), many)


def among(values: np.ndarray, rows: np.ndarray, set_values: np.ndarray, set_rows: np.ndarray) -> np.ndarray:
    """Which (value, row) pairs are in a set of pairs."""
    pair = np.dtype([("r", _I), ("v", _I)])
    left, right = np.empty(len(values), pair), np.empty(len(set_values), pair)
    left["r"], left["v"], right["r"], right["v"] = rows, values, set_rows, set_values
    order = np.lexsort((right["v"], right["r"]))
    right = right[order]
    if not len(right):
        return np.zeros(len(left), dtype=bool)
    # rank the values so that a pair fits one integer
    names, at = np.unique(right["v"], return_inverse=True)
    keys = right["r"] * len(names) + at
    slot = np.minimum(np.searchsorted(names, left["v"]), len(names) - 1)
    wanted = left["r"] * len(names) + slot
    spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return (names[slot] == left["v"]) & (keys[spot] == wanted)


#: A slice as units, in parts that hold every window once: (units, offset in the only row).
UnitsOf = Callable[[Slice, int], Iterator[tuple[Units, int]]]


@dataclass
class Scan:
    """One corpus scan for repeats: the tables that the operators read."""

    #: doc_id, n (units), digest of the kept whole, first (least doc_id of the same whole), copies
    whole: DataFrame
    #: doc_id, text, anchors: the documents with a repeated anchor
    texts: DataFrame
    #: anchor, h1, h2, doc_id, start, many: their candidate segments
    found: DataFrame
    #: anchor, h1, h2, n, rep (doc_id, start), many: the distinct segments
    classes: DataFrame


def scan(docs: DataFrame, units_of: UnitsOf, whole_of: Callable[[Slice], list[bytes]], width: int, part: int, across: bool) -> Scan:
    """Steps 1 and 2. ``across``: an anchor must be in two documents, not merely occur twice.

    Of documents that are equal as wholes only those with the least doc_id are searched:
    the others hold no window that it lacks.
    """
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found, n = [], np.zeros(piece.n, dtype=_I)
                for units, offset in units_of(piece, width):
                    seg, _ = segments(units, width, part)
                    found.append((seg.anchor, seg.row))
                    n = np.maximum(n, np.diff(units.row) + offset)
                anchor, row = (np.concatenate(x) for x in zip(*found, strict=True))
                digests = [hashlib.sha256(x).digest() for x in whole_of(piece)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(piece.first, piece.n), pa.array(n), pa.array(digests, pa.binary()), per_row(anchor, row, piece.n)], ["doc_id", "n", "digest", "anchors"])

    passed = written(source.mapInArrow(first_pass, "doc_id bigint, n bigint, digest binary, anchors array<bigint>"), "anchors")
    equal = written(passed.where(F.col("n") >= width).groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "equal")
    plain = passed.join(equal.hint("merge"), "digest", "left")
    whole = plain.select("doc_id", "n", "digest", F.coalesce("first", "doc_id").alias("first"), F.coalesce("copies", F.lit(1)).alias("copies"))
    anchors = plain.where("first is null or first = doc_id").select("doc_id", F.explode("anchors").alias("anchor"))
    if across:
        twice = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    else:
        twice = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    # a table of its own: then both sides of the join are dealt out for it, and the rows of an
    # anchor that a third of all documents hold can be split over tasks
    twice = written(twice.select("anchor"), "repeated")
    wanted = anchors.join(twice, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    texts = written(source.join(wanted, "doc_id").select("doc_id", "text", "anchors"), "candidates")

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, rows = listed(batch.column(2))
            for piece in slices(batch):
                mine = slice(*np.searchsorted(rows, [piece.first, piece.first + piece.n]))
                ids = batch.column(0).slice(piece.first, piece.n).to_numpy()
                for units, offset in units_of(piece, width):
                    seg, one = segments(units, width, part)
                    seg = seg.where(among(seg.anchor, seg.row, values[mine], rows[mine] - piece.first))
                    end = seg.start + seg.many + width - 1
                    h1 = one.spans(seg.start, end).view(_I)
                    h2 = Rolling.over(units.code(1), 1).spans(seg.start, end).view(_I)
                    begin = seg.start - units.row[seg.row] + offset
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seg.anchor, h1, h2, ids[seg.row], begin.astype(np.int32), seg.many.astype(np.int32))], ["anchor", "h1", "h2", "doc_id", "start", "many"])

    found = written(texts.mapInArrow(second_pass, "anchor bigint, h1 bigint, h2 bigint, doc_id bigint, start int, many int"), "segments")
    classes = written(found.groupBy("anchor", "h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("rep"), F.first("many").alias("many")), "classes")
    return Scan(whole, texts, found, classes)


def contested(classes: DataFrame) -> DataFrame:
    """Representatives of the segments whose anchor has others: with m, how many."""
    several = written(classes.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1"), "several")
    return classes.join(several, "anchor").select("anchor", "m", "n", F.col("rep.doc_id").alias("doc_id"), F.col("rep.start").alias("start"), "many")


def with_text(texts: DataFrame, spans: DataFrame, *more: str) -> DataFrame:
    """Texts beside their spans: doc_id, text, spans (start, many, *more), one row a document."""
    grouped = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "many", *more)).alias("spans"))
    return texts.select("doc_id", "text").join(grouped, "doc_id")


def spans_of(col: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Row numbers and flattened structs of a list-of-struct column."""
    return np.repeat(np.arange(len(col)), np.diff(col.offsets.to_numpy())), col.flatten()


def window_hashes(texts: DataFrame, spans: DataFrame, units_of: UnitsOf, width: int) -> DataFrame:
    """(h1, h2, doc_id, start) of every window in the spans: 128-bit fingerprints. For units in one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, structs = spans_of(batch.column(2))
            begin, many = (structs.field(i).to_numpy().astype(_I) for i in range(2))
            for piece in slices(batch):
                ((units, _),) = units_of(piece, width)
                mine = slice(*np.searchsorted(rows, [piece.first, piece.first + piece.n]))
                row = np.repeat(rows[mine] - piece.first, many[mine])
                done = np.cumsum(many[mine]) - many[mine]
                inside = np.repeat(begin[mine] - done, many[mine]) + np.arange(int(many[mine].sum()))
                at = inside + units.row[row]
                ids = batch.column(0).slice(piece.first, piece.n).to_numpy()
                hashes = [Rolling.over(units.code(k), k).spans(at, at + width).view(_I) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*hashes, ids[row], inside.astype(np.int32))], ["h1", "h2", "doc_id", "start"])

    return with_text(texts, spans).mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, start int")


def union(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans [begin, end) of rows as maximal runs, ordered: (row, begin, end)."""
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    if not len(row):
        return row, begin, end
    # ranks of (row, end), so that one running maximum serves all rows
    far = int(end.max()) + 1
    reach = np.maximum.accumulate(row * far + end)
    new = np.append(True, row[1:] * far + begin[1:] > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return row[first], begin[first], reach[last] - row[first] * far


def covered(row: np.ndarray, begin: np.ndarray, end: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which units the spans [begin, end) of rows cover; offsets: of the rows."""
    row, begin, end = union(row, begin, end)
    edge = np.zeros(int(offsets[-1]) + 1, dtype=np.int8)
    edge[begin + offsets[row]] = 1
    np.add.at(edge, np.minimum(end + offsets[row], offsets[row + 1]), -1)
    return np.cumsum(edge[:-1], dtype=np.int8) > 0
