"""Operator 6: exact byte-level repeats by a run-length compressed BWT.

The corpus is first reduced to *contested* segments (see ``anchors``): those that share an
anchor with a different segment. Whatever repeats without being equal as a whole segment
is found in a run-length index over the segments of an anchor:

* Suffixes are sorted, the Burrows-Wheeler transform is cut into runs, and only the ends of
  runs keep a sample (text position, length of the match with the neighbour in suffix order).
  Within the indexed text the length of the longest match elsewhere falls by one a byte
  between samples, so r samples give the matching statistics of every position.
* Other text is streamed through the index from right to left, one LF step a byte; where the
  next byte does not extend the match, it goes on from the nearest run ends with that byte.

Positions whose statistic reaches the wanted length start a repeat. An anchor with many
segments is split over several indexes, and the segments of each are streamed through the
others. Where they would be more than ``MOST_INDEXES``, the group is first refined by longer
anchors, which cut its segments where they differ.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import anchors
from lodestone.llm.blocks import _BYTE_CODES, Rolling, Slice, mix64, slices
from lodestone.llm.shared import documents, written

MIN_BYTES = 200
#: Length of the byte strings that anchor a window.
ANCHOR_BYTES = 64
#: Text of one index: groups of anchors together, but for a group that is split.
BIN_BYTES = 1 << 19
#: Segments of one anchor in an index, and the indexes that one anchor is split over.
PER_INDEX = 1000
MOST_INDEXES = 8
_I, _U = np.int64, np.uint64


def byte_units(part: Slice, width: int = 0) -> Iterator[tuple[anchors.Units, int]]:
    for piece, offset in part.pieces(width):
        yield anchors.Units(lambda k, data=piece.data: _BYTE_CODES[k][data], piece.off), offset


def suffix_order(data: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes, each ending with its segment.

    ``room``: bytes from each position to its segment's end. A segment's end sorts before
    any byte, ends among themselves by position. Prefix doubling from seven packed bytes.
    """
    n = len(data)
    width = 7
    padded = np.concatenate([data, np.zeros(width, dtype=np.uint8)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        key = (key << np.uint64(8)) | np.where(room > j, padded[j : j + n], np.uint64(0))
    key = (key << np.uint64(8)) | np.minimum(room, width).astype(np.uint64)
    order = np.argsort(key, kind="stable")
    longest = int(room.max()) if n else 0
    while True:
        ranked = key[order]
        new = np.ones(n, dtype=_I)
        new[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(n, dtype=_I)
        rank[order] = np.cumsum(new)
        if width >= longest or int(new.sum()) == n:
            return order
        ahead = np.zeros(n, dtype=_I)
        far = np.flatnonzero(room > width)
        ahead[far] = rank[far + width]
        key = rank * _I(n + 1) + ahead
        order = np.argsort(key, kind="stable")
        width *= 2


def common(rolling: Rolling, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of positions a and b, by bisection on span hashes."""
    low, high = np.zeros(len(a), dtype=_I), most.astype(_I)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) // 2
        same = rolling.spans(a, a + mid) == rolling.spans(b, b + mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)


class RunIndex:
    """Run-length index over segments of text.

    Every segment ends with a mark below all bytes, so that the order of suffixes is that of
    one string. Kept are: the runs of the BWT (start, symbol, number of that symbol before),
    the symbols' first ranks, and the samples at run ends. ``heads`` are the text positions
    of run starts with their match with the suffix before; ``tails`` those of run ends, with
    the suffix after.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        #: Of every byte, its place in the marked text.
        self.place = np.arange(len(data)) + np.repeat(np.arange(len(size)), size)
        self.n = n = len(data) + len(size)
        ends = offsets[1:] + np.arange(len(size))
        text = np.zeros(n, dtype=np.uint8)
        text[self.place] = data
        self.room = np.repeat(ends, size + 1) - np.arange(n)
        order = suffix_order(text, self.room)
        symbol = text.astype(np.int16) + 1
        symbol[ends] = 0
        before = symbol[order - 1]
        first = np.zeros(n, dtype=bool)
        first[ends - size] = True
        before[first[order]] = -1
        # the byte before a segment is none: a run of its own, which no byte extends
        head = np.append(True, (before[1:] != before[:-1]) | (before[1:] == -1))
        start = np.flatnonzero(head)
        self.rolling = Rolling.over(_BYTE_CODES[0][text])
        self.start, self.symbol = start, before[start]
        self.end = np.append(start[1:], n) - 1
        self.runs = len(start)
        self.heads = order[start], self._match(order, start, -1)
        self.tails = order[self.end], self._match(order, self.end, 1)
        # LF steps: rank of a symbol's first suffix, and how often a run's symbol comes before it
        self.rank = np.append(0, np.cumsum(np.bincount(symbol, minlength=257)))
        self.by_symbol = np.argsort(self.symbol, kind="stable")
        length = (self.end - start + 1)[self.by_symbol]
        total = np.cumsum(length) - length
        kinds = self.symbol[self.by_symbol]
        self.key = kinds.astype(_I) * (self.runs + 1) + self.by_symbol
        self.seen = np.empty(self.runs, dtype=_I)
        self.seen[self.by_symbol] = total - total[np.searchsorted(kinds, kinds)]

    def _match(self, order, ranks, side) -> np.ndarray:
        at, other = order[ranks], ranks + side
        inside = (other >= 0) & (other < self.n)
        beside = order[np.where(inside, other, ranks)]
        return np.where(inside, common(self.rolling, at, beside, np.where(inside, np.minimum(self.room[at], self.room[beside]), 0)), 0)

    def statistics(self) -> np.ndarray:
        """For every byte of the text the length of its longest match elsewhere in the index."""
        best = np.zeros(self.n, dtype=_I)
        for at, length in (self.heads, self.tails):
            by_text = np.argsort(at)
            at, length = at[by_text], length[by_text]
            reach = np.repeat(at + length, np.diff(np.append(at, self.n)))
            best[at[0] :] = np.maximum(best[at[0] :], reach - np.arange(at[0], self.n))
        return best[self.place]

    def stream(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For every byte of other segments the length of its longest match in the index.

        All segments go through the index side by side, a byte at a time from their ends.
        """
        out = np.zeros(len(data), dtype=_I)
        size = np.diff(offsets)
        rank, match = np.zeros(len(size), dtype=_I), np.zeros(len(size), dtype=_I)
        at = np.full(len(size), self.heads[0][0], dtype=_I)
        for step in range(1, int(size.max(initial=0)) + 1):
            live = np.flatnonzero(size >= step)
            spot = offsets[live + 1] - step
            c = data[spot].astype(_I) + 1
            run = np.searchsorted(self.start, rank[live], side="right") - 1
            turn = np.flatnonzero(self.symbol[run] != c)
            if len(turn):
                self._turn(live[turn], c[turn], run, turn, rank, at, match)
            lost = run < 0
            ok, run, c = live[~lost], run[~lost], c[~lost]
            rank[ok] = self.rank[c] + self.seen[run] + rank[ok] - self.start[run]
            at[ok] -= 1
            match[ok] += 1
            gone = live[lost]
            rank[gone], match[gone], at[gone] = 0, 0, self.heads[0][0]
            out[spot] = match[live]
        return out

    def _turn(self, who, c, run, turn, rank, at, match) -> None:
        """Goes on from the nearer end of the runs of symbol c before and after; run: -1 if there is none."""
        spot = np.searchsorted(self.key, c * (self.runs + 1) + run[turn])
        best, to = np.full(len(who), -1, dtype=_I), np.full(len(who), -1, dtype=_I)
        ranks, places = rank[who].copy(), at[who].copy()
        for side, ends, (sample, _) in ((-1, self.end, self.tails), (0, self.start, self.heads)):
            slot = np.clip(spot + side, 0, self.runs - 1)
            near = self.by_symbol[slot]
            there = np.flatnonzero((self.symbol[near] == c) & (spot + side >= 0) & (spot + side < self.runs))
            x, y = at[who[there]], sample[near[there]]
            length = common(self.rolling, x, y, np.minimum(match[who[there]], np.minimum(self.room[x], self.room[y])))
            more = length > best[there]
            win = there[more]
            best[win], to[win] = length[more], near[win]
            ranks[win], places[win] = ends[near[win]], y[more]
        rank[who], at[who], run[turn] = ranks, places, to
        match[who] = np.maximum(best, 0)


def _cut(contested: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(anchor, m, asks, doc_id, start, bytes): contested segments with their text.

    ``asks``: its windows are not known to repeat yet.
    """
    spans = contested.select("doc_id", "start", "many", "anchor", "m", (F.col("n") == 1).alias("asks"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, structs = anchors.spans_of(batch.column(2))
            begin, many = (structs.field(i).to_numpy().astype(_I) for i in range(2))
            for part in slices(batch):
                mine = slice(*np.searchsorted(rows, [part.first, part.first + part.n]))
                raw, row = part.data.tobytes(), rows[mine] - part.first
                lo = part.off[row] + begin[mine]
                hi = lo + many[mine] + width - 1
                ids = batch.column(0).slice(part.first, part.n).to_numpy()
                piece = structs.slice(mine.start, mine.stop - mine.start)
                yield pa.RecordBatch.from_arrays([*(piece.field(i) for i in (2, 3, 4)), pa.array(ids[row]), pa.array(begin[mine]), pa.array([raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())], ["anchor", "m", "asks", "doc_id", "start", "bytes"])

    return anchors.with_text(texts, spans, "anchor", "m", "asks").mapInArrow(cut, "anchor bigint, m bigint, asks boolean, doc_id bigint, start bigint, bytes binary")


def _refined(pieces: DataFrame, width: int, part: int) -> tuple[DataFrame, DataFrame]:
    """Pieces cut anew by longer anchors, and (doc_id, start, many) of those equal as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, asks, ids, start = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4))
            for piece in slices(batch, "bytes"):
                units = anchors.Units(lambda k, data=piece.data: _BYTE_CODES[k][data], piece.off)
                seg, one = anchors.segments(units, width, part)
                end = seg.start + seg.many + width - 1
                two = Rolling.over(units.code(1), 1)
                at, raw = seg.row + piece.first, piece.data.tobytes()
                key = mix64(mix64(group[at].view(_U)) ^ seg.anchor.view(_U)).view(_I)
                begin = start[at] + seg.start - piece.off[seg.row]
                cut = pa.array([raw[a:b] for a, b in zip(seg.start.tolist(), end.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*map(pa.array, (key, one.spans(seg.start, end).view(_I), two.spans(seg.start, end).view(_I), asks[at], ids[at], begin, seg.many)), cut], ["anchor", "h1", "h2", "asks", "doc_id", "start", "many", "bytes"])

    rows = written(pieces.mapInArrow(run, "anchor bigint, h1 bigint, h2 bigint, asks boolean, doc_id bigint, start bigint, many bigint, bytes binary"), "refined")
    names = ["anchor", "h1", "h2"]
    classes = written(rows.groupBy(*names).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start", "asks", "bytes")).alias("rep")), "classes")
    settled = rows.where("asks").join(classes.where("n > 1").select(*names), names).select("doc_id", F.col("start").cast("int").alias("start"), F.col("many").cast("int").alias("many"))
    several = classes.groupBy("anchor").agg(F.count("*").alias("m")).where("m > 1")
    left = classes.join(several, "anchor").select("anchor", "m", (F.col("rep.asks") & (F.col("n") == 1)).alias("asks"), "rep.doc_id", "rep.start", "rep.bytes")
    return written(left, "pieces"), settled


def _indexed(pieces: DataFrame, width: int) -> DataFrame:
    """(doc_id, start, many): windows of the asking pieces that another piece of the group holds.

    A group is dealt over indexes of ``PER_INDEX`` pieces; where there are several, each piece
    that asks is streamed through the others.
    """
    bins = F.ceil(F.col("m") / PER_INDEX).cast("int")
    own = F.pmod(F.xxhash64("doc_id", "start"), bins).cast("int")
    each = F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), bins - 1)).otherwise(F.array(own)))
    rows = pieces.select("anchor", each.alias("bin"), own.alias("own"), "asks", "doc_id", "start", "bytes")
    dealt = rows.select("anchor", "bin", (F.col("bin") == F.col("own")).alias("home"), "asks", "doc_id", "start", "bytes").repartition("anchor", "bin").sortWithinPartitions("anchor", "bin")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column(6).nbytes
            if size < BIN_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            # rows come sorted by group: everything before the last group is complete
            done = int(_groups(table)[-1])
            if done:
                yield from _searched(table.slice(0, done), width)
            held = table.slice(done).to_batches()
            size = sum(b.column(6).nbytes for b in held)
        if held:
            yield from _searched(pa.Table.from_batches(held), width)

    return dealt.mapInArrow(search, "doc_id bigint, start int, many int")


def _groups(table: pa.Table) -> np.ndarray:
    """Where the groups of a sorted table begin."""
    anchor, place = table.column(0).to_numpy(), table.column(1).to_numpy()
    return np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1])))


def _bytes(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    col = table.column(6).combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    off = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1].astype(_I)
    return np.frombuffer(col.buffers()[2], dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def _searched(table: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
    """Indexes whole groups of about BIN_BYTES together and yields what repeats in each.

    A group with guests has an index of its own: they may be at home in another.
    """
    table = table.combine_chunks()
    edges = np.append(_groups(table), table.num_rows)
    total = _bytes(table)[1]
    alone = np.flatnonzero(np.add.reduceat(~table.column(2).to_numpy(), edges[:-1]) > 0)
    alone = np.append(np.union1d(alone, alone + 1), len(edges) - 1)
    lo = 0
    while lo < len(edges) - 1:
        hi = max(lo + 1, int(np.searchsorted(total[edges], total[edges[lo]] + BIN_BYTES, side="right")) - 1)
        hi = min(hi, int(alone[np.searchsorted(alone, lo, side="right")]))
        rows = table.slice(int(edges[lo]), int(edges[hi] - edges[lo]))
        home = rows.column(2)
        inside, guests = rows.filter(home), rows.filter(pa.compute.invert(home))
        lo = hi
        if not inside.num_rows:  # by chance no piece is at home here
            continue
        data, offsets = _bytes(inside)
        index = RunIndex(data, offsets)
        asks = np.repeat(inside.column(3).to_numpy(), np.diff(offsets))
        yield from _marked(inside, offsets, (index.statistics() >= width) & asks)
        if guests.num_rows:
            data, offsets = _bytes(guests)
            yield from _marked(guests, offsets, index.stream(data, offsets) >= width)


def _marked(rows: pa.Table, offsets: np.ndarray, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The marked bytes of pieces as runs of windows of their documents."""
    good = np.flatnonzero(marks)
    if len(good):
        owner = np.searchsorted(offsets, good, side="right") - 1
        first = np.flatnonzero(np.append(True, (good[1:] != good[:-1] + 1) | (owner[1:] != owner[:-1])))
        many = np.diff(np.append(first, len(good)))
        owner = owner[first]
        at = good[first] - offsets[owner] + rows.column(5).to_numpy()[owner]
        yield pa.RecordBatch.from_arrays([pa.array(rows.column(4).to_numpy()[owner]), pa.array(at.astype(np.int32)), pa.array(many.astype(np.int32))], ["doc_id", "start", "many"])


def repeated_windows(docs: DataFrame, min_bytes: int = MIN_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> tuple[anchors.Scan, DataFrame]:
    """The scan, and (doc_id, start, many): the windows of ``min_bytes`` found elsewhere too."""
    scan = anchors.scan(docs, byte_units, lambda part: [part.raw(r) for r in range(part.n)], min_bytes, min(anchor_bytes, min_bytes), across=False)
    several = scan.classes.where("n > 1").select("anchor", "h1", "h2")
    # a table of its own, so that the rows of a segment that very many documents hold can be split
    found = written(scan.found.join(several.hint("merge"), ["anchor", "h1", "h2"]).select("doc_id", "start", "many"), "settled")
    pieces = written(_cut(anchors.contested(scan.classes), scan.texts, min_bytes), "pieces")
    length = min(anchor_bytes, min_bytes)
    while True:
        small = F.col("m") <= PER_INDEX * MOST_INDEXES
        found = found.unionByName(written(_indexed(pieces.where(small), min_bytes), "indexed"))
        large = pieces.where(~small)
        # at full length the pieces of a group are equal, so none is left
        if large.isEmpty():
            return scan, found
        length = (length + min_bytes + 1) // 2
        pieces, equal = _refined(large, min_bytes, length)
        found = found.unionByName(equal)


def remove_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """docs without the bytes that repeat: one row for each row of docs.

    A byte goes if it lies in a string of ``min_bytes`` that also starts elsewhere, in the
    same document or another. Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 (of the remaining bytes).

    Strings are judged on the input and never cross documents. Null and empty texts have no
    bytes; equal rows repeat each other (rows that share a doc_id are taken to share the
    text); rows with a null doc_id stay as they are and match nothing; other columns are
    ignored; no rows give no rows.
    """
    scan, gone = repeated_windows(docs, min_bytes, anchor_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, structs = anchors.spans_of(batch.column(2))
            begin, many = (structs.field(i).to_numpy().astype(_I) for i in range(2))
            for part in slices(batch):
                mine = slice(*np.searchsorted(rows, [part.first, part.first + part.n]))
                row, lo, hi = anchors.union(rows[mine] - part.first, begin[mine], begin[mine] + many[mine] + min_bytes - 1)
                edge = np.searchsorted(row, np.arange(part.n + 1)).tolist()
                kept, removed, spans = [], [], []
                for r, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                    raw, digest, done = memoryview(part.data[part.off[r] : part.off[r + 1]]), hashlib.sha256(), 0
                    for x, y in zip(lo[a:b].tolist(), hi[a:b].tolist(), strict=True):
                        digest.update(raw[done:x])
                        done = y
                    digest.update(raw[done:])
                    kept.append(digest.hexdigest())
                    removed.append(int((hi[a:b] - lo[a:b]).sum()))
                    spans.append(b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_removed", "n_spans", "kept_sha256"])

    cut = anchors.with_text(scan.texts, gone).mapInArrow(run, "doc_id bigint, n_removed bigint, n_spans bigint, kept_sha256 string").dropDuplicates(["doc_id"])
    copied = F.col("copies") > 1
    result = scan.whole.join(cut, "doc_id", "left").select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(copied, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(copied, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    unnamed = docs.where("doc_id is null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))
    return result.unionByName(unnamed)


def op6_run_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
