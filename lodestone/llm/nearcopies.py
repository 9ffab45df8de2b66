"""Operator 4: near-duplicate documents by a chosen-path set similarity join.

Every document has a set of word shingles. Equal sets are collapsed first. Then, in
independent trees, documents descend by minwise tokens: a node is the documents whose
chosen tokens agree so far. A node with few documents is a leaf; a larger one branches
again by its documents' next minwise token. Two documents of similarity s share a node of
depth d with probability s**d, so repeating trees drives the recall to its target.

Leaves are compared exhaustively on minwise sketches, and only stars over the likely
pairs leave a leaf, at most a few pairs a document, never all pairs of a group. Pairs are
confirmed on full sets. A second round compares, leaf by leaf and on full sets, what the
confirmed links have not yet joined, and returns spanning forests of the links it finds;
so a star that was refuted costs no link.

A node that stays large at full depth (a huge group of near copies, pages of one template)
is dealt into blocks that all hold the node's hubs; what finds no likely partner there is
screened on sketches against all members, and what does not join the node's main component
is then compared on full sets, in cells of many megabytes, so that a text is copied once
for each such cell of its node and not once for each block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.blocks import Rolling, Slice, mix64, slices
from lodestone.llm.components import components, spanning_tree
from lodestone.llm.shared import documents, written

DEPTH = 5
#: Share of the pairs at the threshold that meet in a leaf or block of some tree, whatever their nodes.
RECALL = 0.999
#: Documents in a leaf, or in a block of a node that stays larger.
LEAF = 128
HUBS = 4
#: Documents on either side of a cell in which a blocked node is screened on sketches.
SCREEN = 1024
#: Bytes of text, and documents, on either side of a cell in which full sets are compared.
CELL_BYTES, CELL_DOCS = 16 << 20, 2048
#: Standard errors by which a sketch's estimate may fall short of the threshold.
MARGIN = 3.7

_I, _U = np.int64, np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def trees_for(similarity: float, recall: float = RECALL) -> int:
    """Independent trees that a pair of this similarity needs: it shares each to full depth with
    probability similarity**DEPTH, so 12 at 0.85 and 18 at 0.8 for a recall of 0.999."""
    apart = 1 - similarity**DEPTH
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(apart)))) if apart > 0 else 1


def shingle_sets(part: Slice, size: int) -> list[np.ndarray]:
    """Per row the ascending distinct shingle hashes; a short text is one shingle."""
    lower = Slice(part.first, _LOWER[part.data], part.off)
    words = lower.words()
    codes = Rolling.over(lower.span_codes(words.start, words.end))
    grams = codes.windows(size)
    out = []
    for a, b in zip(words.row[:-1].tolist(), words.row[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(grams[a : b - size + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            out.append(codes.spans(np.array([a]), np.array([b])))
        else:
            out.append(grams[:0])
    return out


def sketches(sets: list[np.ndarray], trees: int = 12) -> np.ndarray:
    """(rows, trees * DEPTH) minwise values, 32 bits each; rows of empty sets are zero."""
    width = trees * DEPTH
    masks = mix64(np.arange(1, width + 1, dtype=_U))
    factors = mix64(np.arange((1 << 32) + 1, (1 << 32) + width + 1, dtype=_U)) | _U(1)
    out = np.zeros((len(sets), width), dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        values = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
        for j, (mask, factor) in enumerate(zip(masks, factors, strict=True)):
            out[full, j] = np.minimum.reduceat(((values ^ mask) * factor) >> _U(32), at).astype(np.uint32)
    return out


def _signed(docs: DataFrame, size: int, trees: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part, size)
                sketch = sketches(sets, trees)
                digests = [hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in sketch], pa.binary())], ["doc_id", "n_shingles", "digest", "sketch"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, sketch binary")


def _paths(reps: DataFrame) -> DataFrame:
    """(doc_id, path): one row a tree; path[d] names the node at depth d + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1, DEPTH).astype(_U)
            trees = raw.shape[1]
            node = np.broadcast_to(mix64(np.arange(trees, dtype=_U))[None, :], raw.shape[:2])
            path = np.empty(raw.shape, dtype=_I)
            for d in range(DEPTH):
                node = mix64(node ^ mix64(raw[:, :, d] + _U(d << 40)))
                path[:, :, d] = node.view(_I)
            ids = np.repeat(batch.column(0).to_numpy(), trees)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, path.size + 1, DEPTH, dtype=np.int32)), pa.array(path.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), lists], ["doc_id", "path"])

    return reps.select("doc_id", "sketch").mapInArrow(run, "doc_id bigint, path array<bigint>")


def _leaves(reps: DataFrame) -> DataFrame:
    """(node, doc_id, blocks, hub): members of all leaves with company, and of blocked nodes.

    ``blocks`` is 1 for a leaf; for a node that stays large, the number of its blocks.
    """
    open_, found = _paths(reps), None
    for d in range(DEPTH):
        named = open_.withColumn("node", F.col("path")[d])
        # a table, so that both sides of the join are dealt out for it and a hot node can be split
        sizes = written(named.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        joined = written(named.join(sizes.hint("merge"), "node"), "nodes")
        done = joined.where(F.col("size") <= LEAF) if d + 1 < DEPTH else joined
        leaf = done.select("node", "doc_id", F.ceil(F.col("size") / LEAF).cast("int").alias("blocks"))
        found = leaf if found is None else found.unionByName(leaf)
        open_ = joined.where(F.col("size") > LEAF).select("doc_id", "path")
    return written(found, "leaves")


def _members(leaves: DataFrame, sketched: DataFrame) -> DataFrame:
    """(node, block, doc_id, component, sketch): what each leaf or block is compared on.

    The hubs of a blocked node go to all its blocks. No document has a component yet but
    its own.
    """
    hubs = leaves.where("blocks > 1").groupBy("node").agg(F.slice(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("doc_id", "node"), F.col("blocks")) == 0, F.col("doc_id")))), 1, HUBS).alias("hubs"))
    rows = leaves.join(written(hubs, "hubs").hint("merge"), "node", "left").join(sketched, "doc_id")
    everywhere = F.coalesce(F.array_contains("hubs", F.col("doc_id")), F.lit(False))
    own = F.array(F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    block = F.explode(F.when(everywhere & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(own))
    return rows.select("node", block.alias("block"), "doc_id", F.col("doc_id").alias("component"), "sketch")


def likely(sketch: np.ndarray, component: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of one leaf have an estimate of ``least`` or more and differ in component."""
    n = len(sketch)
    near = np.zeros((n, n), dtype=bool)
    for i in range(n - 1):
        near[i, i + 1 :] = (sketch[i + 1 :] == sketch[i]).mean(1) >= least
    near |= near.T
    near &= component[:, None] != component[None, :]
    return near


def star_pairs(near: np.ndarray) -> Iterator[tuple[int, int]]:
    """A few stars over the likely pairs of a leaf, or all pairs if they are as few.

    The best-connected documents with all their neighbours, then stars over what is left
    uncovered: every document with a likely partner is in some pair.
    """
    n, degree = len(near), near.sum(1)
    if degree.sum() <= 2 * n:
        yield from zip(*np.nonzero(np.triu(near)), strict=True)
        return
    open_, hubs = degree > 0, 0
    while open_.any():
        if hubs < HUBS:
            reach = near.sum(1)
            reach[degree == 0] = 0
        else:
            reach = np.where(open_, (near & open_[None, :]).sum(1), 0)
            if not reach.any():
                # all partners are covered, though not this one: no hub is among them
                reach = np.where(open_, near.sum(1), 0)
        hub = int(np.argmax(reach))
        others = np.flatnonzero(near[hub])
        yield from ((hub, int(o)) for o in others)
        near[hub, :] = near[:, hub] = False
        degree[hub] = 0
        open_[others] = open_[hub] = False
        hubs += 1


def _by_leaf(members: DataFrame, compare, schema: str) -> DataFrame:
    """``compare``(ids, near, node, block) for each leaf or block of members, each in one piece."""

    def compared(table: pa.Table) -> pa.RecordBatch:
        ids, component, node = (table.column(i).to_numpy() for i in (2, 3, 0))
        sketch = np.frombuffer(b"".join(table.column(4).to_pylist()), dtype=np.uint32).reshape(len(ids), -1)
        out = [np.zeros((0, 2), dtype=_I)]
        edges = _borders(table)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo > 1:
                out.append(compare(ids[lo:hi], node[lo], sketch[lo:hi], component[lo:hi]))
        a, b = np.concatenate(out).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 20 * LEAF:
                    table = pa.Table.from_batches(held).combine_chunks()
                    cut = _borders(table)[-2]
                    if cut:
                        yield compared(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
        if held:
            yield compared(pa.Table.from_batches(held).combine_chunks())

    # a leaf or block is bounded by LEAF and the hubs, so the deal is even
    dealt = members.repartition("node", "block").sortWithinPartitions("node", "block", "doc_id")
    return dealt.mapInArrow(search, schema)


def _stars(members: DataFrame, least: float) -> DataFrame:
    """(a, b) with a the star's centre: distinct likely pairs over all leaves."""

    def compare(ids, node, sketch, component):
        found = list(star_pairs(likely(sketch, component, least)))
        return ids[np.array(found, dtype=_I).reshape(-1, 2)]

    return _by_leaf(members, compare, "a bigint, b bigint").distinct()


def _open(members: DataFrame, least: float) -> DataFrame:
    """(node, doc_id): the documents of a leaf with a likely partner in another component."""

    def compare(ids, node, sketch, component):
        some = ids[likely(sketch, component, least).any(1)]
        return np.stack([np.full(len(some), node), some], axis=1)

    return _by_leaf(members, compare, "node bigint, doc_id bigint")


def _screened(leaves: DataFrame, first: DataFrame, sketched: DataFrame, least: float) -> DataFrame:
    """(a, b): for each document of a blocked node in none of ``first``, a likely partner in it.

    Blocks and hubs leave most pairs of such a node uncompared. Its documents without a pair
    are compared with all its members, in a grid of cells; one partner a cell is enough for
    the second round to compare both on full sets.
    """
    big = leaves.where("blocks > 1").select("node", "doc_id")
    lone = big.join(named_in(first), "doc_id", "left_anti")
    parts = lone.groupBy("node").agg(F.ceil(F.count("*") / SCREEN).cast("int").alias("parts"))
    sizes = big.groupBy("node").agg(F.ceil(F.count("*") / SCREEN).cast("int").alias("places"))
    grid = written(parts.join(sizes, "node"), "grid").hint("merge")
    # other bits than those that deal rows to tasks
    hashed = F.xxhash64("doc_id", F.lit(1))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = lone.join(grid, "node").select("node", F.pmod(hashed, F.col("parts")).cast("int").alias("i"), upto("places").alias("j"), F.lit(0).alias("side"), "doc_id")
    right = big.join(grid, "node").select("node", upto("parts").alias("i"), F.pmod(hashed, F.col("places")).cast("int").alias("j"), F.lit(1).alias("side"), "doc_id")
    cells = left.unionByName(right).join(sketched, "doc_id").select("node", "i", "j", "side", "doc_id", "sketch")
    dealt = cells.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j", "side", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sides = None, ([], [])

        def pairs() -> pa.RecordBatch:
            out = []
            if sides[0] and sides[1]:
                ids = np.array([doc for doc, _ in sides[1]], dtype=_I)
                table = np.frombuffer(b"".join(s for _, s in sides[1]), dtype=np.uint32).reshape(len(ids), -1)
                for doc, sketch in sides[0]:
                    alike = np.where(ids == doc, 0.0, (table == np.frombuffer(sketch, dtype=np.uint32)).mean(1))
                    best = int(np.argmax(alike))
                    if alike[best] >= least:
                        out.append((doc, int(ids[best])))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for node, i, j, side, doc, sketch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (node, i, j) != name:
                    yield pairs()
                    name, sides = (node, i, j), ([], [])
                sides[side].append((doc, sketch))
        yield pairs()

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def named_in(pairs: DataFrame) -> DataFrame:
    """(doc_id): the documents in any of the pairs."""
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()


def _borders(table: pa.Table) -> list[int]:
    node, block = table.column(0).to_numpy(), table.column(1).to_numpy()
    new = np.flatnonzero((node[1:] != node[:-1]) | (block[1:] != block[:-1])) + 1
    return [0, *new.tolist(), len(node)]


#: Partners that one copy of a star's centre is compared with in a task.
STAR = 256


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold, 100 * both >= percent * either.

    A pair's texts meet under its centre; a centre of very many pairs is copied to as many
    places as they need. Each row carries one text, and centres come first.
    """
    stars = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("places"))
    centres = stars.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), F.lit(0).alias("leaf"))
    others = pairs.join(stars, "a").select(F.col("b").alias("doc_id"), "a", F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place"), F.lit(1).alias("leaf"))
    rows = centres.unionByName(others).join(texts.select("doc_id", "text"), "doc_id")
    dealt = rows.select("a", "place", "leaf", "doc_id", "text").repartition("a", "place").sortWithinPartitions("a", "place", "leaf")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = None
        for batch in batches:
            a, leaf, ids = (batch.column(i).to_pylist() for i in (0, 2, 3))
            out = []
            for part in slices(batch):
                for r, own in enumerate(shingle_sets(part, size), start=part.first):
                    if not leaf[r]:
                        centre = own
                        continue
                    both = np.concatenate([centre, own])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        out.append((a[r], ids[r]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(compare, "a bigint, b bigint")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by blocked products of 0/1 matrices."""
    sizes = [len(s) for s in (*a, *b)]
    values, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    # an element that only one set has is in no intersection
    often = np.bincount(at, minlength=len(values)) > 1
    place = np.cumsum(often) - 1
    use = often[at]
    at, row = place[at[use]], row[use]
    order = np.argsort(at, kind="stable")
    at, row, n = at[order], row[order], int(often.sum())
    out = np.zeros((len(a), len(b)))
    for lo in range(0, n, columns):
        part = slice(*np.searchsorted(at, [lo, lo + columns]))
        table = np.zeros((len(sizes), min(columns, n - lo)), dtype=np.float32)
        table[row[part], at[part] - lo] = 1
        out += table[: len(a)] @ table[len(a) :].T
    return out.astype(_I)


def _remaining(leaves: DataFrame, reps: DataFrame, joined: DataFrame, texts: DataFrame, size: int, percent: int, least: float) -> DataFrame:
    """(a, b): the links that stars left out, found on full sets without emitting pairs.

    In leaves, the documents with a likely partner in another component are compared with
    each other. In blocked nodes, those outside the node's main component are compared with
    each other and with the main component, in cells (kind, i, j) of bounded parts. A cell
    returns a spanning forest of its links.
    """
    placed = leaves.join(joined, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    members = placed.where("blocks = 1").select("node", F.lit(0).alias("block"), "doc_id", "component").join(reps, "doc_id").select("node", "block", "doc_id", "component", "sketch")
    zero = F.lit(0)
    small = _open(members, least).select("node", zero.alias("kind"), zero.alias("i"), zero.alias("j"), F.lit(2).alias("side"), "doc_id")
    big = written(placed.where("blocks > 1").join(texts.select("doc_id", F.octet_length("text").alias("bytes")), "doc_id").select("node", "doc_id", "component", "bytes"), "blocked")
    main = big.groupBy("node", "component").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("component", F.struct("n", "component")).alias("main"))
    outside = F.col("component") != F.col("main")
    split = big.join(written(main, "main").hint("merge"), "node").select("node", "doc_id", "bytes", outside.alias("outside"))
    parts = lambda test: F.greatest(F.ceil(F.sum(F.when(test, F.col("bytes")).otherwise(0)) / CELL_BYTES), F.ceil(F.sum(test.cast("int")) / CELL_DOCS)).cast("int")
    grid = split.groupBy("node").agg(parts(F.col("outside")).alias("p"), F.greatest(parts(~F.col("outside")), F.lit(1)).alias("m")).where("p > 0")
    dealt = split.join(written(grid, "grid").hint("merge"), "node").withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.when(F.col("outside"), F.col("p")).otherwise(F.col("m"))).cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own, q = F.col("own"), F.col("q")
    rest = dealt.where("outside")
    among = rest.select("node", "doc_id", "own", upto("p").alias("q")).select("node", F.lit(1).alias("kind"), F.least("own", "q").alias("i"), F.greatest("own", "q").alias("j"), F.when(own == q, 2).when(own < q, 0).otherwise(1).alias("side"), "doc_id")
    left = rest.select("node", F.lit(2).alias("kind"), own.alias("i"), upto("m").alias("j"), zero.alias("side"), "doc_id")
    right = dealt.where("not outside").select("node", F.lit(2).alias("kind"), upto("p").alias("i"), own.alias("j"), F.lit(1).alias("side"), "doc_id")
    cells = small.unionByName(among).unionByName(left).unionByName(right).join(joined, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")).join(texts.select("doc_id", "text"), "doc_id")
    key = ["node", "kind", "i", "j"]
    dealt = cells.select(*key, "side", "doc_id", "component", "text").repartition(*key).sortWithinPartitions(*key, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sides = None, ([], [])

        def links() -> pa.RecordBatch:
            out = np.zeros((0, 2), dtype=_I)
            if sides[0] and sides[1]:
                (x, cx, sx), (y, cy, sy) = (list(zip(*s, strict=True)) for s in sides)
                both = shared_counts(list(sx), list(sy))
                either = np.array([len(s) for s in sx])[:, None] + np.array([len(s) for s in sy])[None, :] - both
                near = (both > 0) & (100 * both >= percent * either) & (np.array(cx)[:, None] != np.array(cy)[None, :])
                out = np.array([(x[i], y[j]) for i, j in spanning_tree(near)], dtype=_I).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True))
            for part in slices(batch):
                for r, own in enumerate(shingle_sets(part, size), start=part.first):
                    *cell, side, doc, component = keys[r]
                    if cell != name:
                        yield links()
                        name, sides = cell, ([], [])
                    for k in (0, 1) if side == 2 else (side,):
                        sides[k].append((doc, component, own))
        yield links()

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs.

    Documents whose sets of ``shingle``-word shingles (A-Z lower-cased) reach the Jaccard
    ``similarity`` are linked; component_id is the smallest doc_id reachable by links.

    Texts with fewer words are one shingle, the whole sequence. Null texts and texts
    without words have none and are linked with nothing; equal rows share their component;
    rows with a null doc_id get a null component and are kept; other columns are ignored;
    no rows give no rows. Rows that share a doc_id are taken to share the text.
    """
    percent, trees = round(100 * similarity), trees_for(similarity)
    least = similarity - MARGIN * float(np.sqrt(similarity * (1 - similarity) / (trees * DEPTH)))
    signed = written(_signed(docs, shingle, trees), "signed")
    usable = signed.where("doc_id is not null and n_shingles > 0")
    classes = written(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    # one row an exact class, under its smallest doc_id
    reps = written(usable.join(classes, "digest").where("doc_id = rep").groupBy("doc_id").agg(F.first("sketch").alias("sketch")), "reps")
    leaves = _leaves(reps)
    first = written(_stars(_members(leaves, reps), least), "pairs")
    if not leaves.where("blocks > 1").isEmpty():
        first = first.unionByName(written(_screened(leaves, first, reps, least), "screened"))
    named = named_in(first)
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # one plan at every size: the texts are dealt by id, never held beside a broadcast list
    texts = written(source.join(named.hint("merge"), "doc_id").dropDuplicates(["doc_id"]), "texts")
    links = written(_confirmed(first, texts, shingle, percent), "confirmed")
    joined = written(components(links).select(F.col("id").alias("doc_id"), "component"), "components")
    more = written(_remaining(leaves.join(named, "doc_id", "left_semi"), reps, joined, texts, shingle, percent, least), "remaining")
    if not more.isEmpty():
        joined = written(components(links.unionByName(more)).select(F.col("id").alias("doc_id"), "component"), "components")
    grouped = classes.join(joined, F.col("rep") == F.col("doc_id"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    placed = signed.join(written(grouped, "grouped").hint("merge"), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that are their component's smallest doc_id (or have none).

    Null and empty texts and null ids are kept; of equal texts under several ids the smallest
    id stays, with all its rows; other columns pass through under any names; no rows give no
    rows.
    """
    gone = near_copies(docs, shingle, similarity).where("not kept").select("doc_id").distinct()
    kept = docs.alias("docs").join(gone.alias("gone"), F.col("docs.doc_id") == F.col("gone.doc_id"), "left_anti")
    return kept.select("docs.*")


def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir), shingle=3, similarity=0.85)
