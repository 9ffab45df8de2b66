"""Operator 10: embedding near-duplicates by an exact metric range join.

On unit vectors, cosine >= c means Euclidean distance <= r = sqrt(2 - 2c). Within a label,
pivots cut the vectors into cells, each vector at home with its nearest pivot. By the
triangle inequality a vector x at home with pivot i can have a partner at home with pivot j
only if d(x, j) <= d(x, i) + 2r, or, sharper, if x is within r of the plane between i and
j; it is replicated to exactly those cells. Then every cell has all partners of its home
vectors and joins by itself. Within a cell, vectors are ordered into bands of width r by
their distance to the pivot, and a band is compared with itself and its two neighbours only;
by the same inequality no partner lies further off. Bands of any size are compared in blocks
of bounded size, by exact products.

Pivots of a large label are some of its vectors; small labels share a few directions drawn
from a seed, which serve as well (any point is a right pivot) and need no broadcast.

Equal vectors are collapsed first. Blocks return counts and spanning trees, never pairs.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.components import components, spanning_tree
from lodestone.llm.shared import written

COSINE = 0.93
#: Vectors of one label in a cell, as far as the pivots go; smaller labels have SHARED pivots.
CELL = 2048
SHARED = 2
#: Pivots over all labels, and so the size of what is broadcast, are at most twice this. Cells
#: of a table that would need more are larger: then bands and blocks divide the work further.
MOST_PIVOTS = 4096
#: Vectors on either side of a block.
BLOCK = 2048
_I = np.int64


def _usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, kind, vec): vectors that can be linked, as bytes of doubles; kind: label and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            # null lists have no components; null components become NaN
            size = np.diff(col.offsets.to_numpy())
            size = np.where(col.is_valid().to_numpy(zero_copy_only=False), size, 0)
            v = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.flatnonzero(size)
            at = np.append(0, np.cumsum(size[row]))
            if len(row):
                with np.errstate(all="ignore"):
                    finite = np.logical_and.reduceat(np.isfinite(v), at[:-1])
                    largest = np.maximum.reduceat(np.abs(v), at[:-1])
                    norm = np.add.reduceat(v * v, at[:-1])
                    # squares of extreme components leave the range of doubles
                    extreme = ~((norm > 1e-200) & (norm < 1e200))
                    v = v / np.repeat(np.where(extreme, largest, 1.0), size[row])
                good = finite & (largest > 0)
                v, row = v[np.repeat(good, size[row])], row[good]
            length = size[row].astype(np.int32)
            names = [f"{label}:{n}" for label, n in zip(batch.column(1).take(pa.array(row)).to_pylist(), length.tolist(), strict=True)]
            off = np.append(0, np.cumsum(length * 8)).astype(np.int32)
            vecs = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(v))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(names, pa.string()), vecs], ["vec_id", "kind", "vec"])

    source = vectors.where("label is not null and vec_id is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return source.mapInArrow(run, "vec_id bigint, kind string, vec binary").dropDuplicates(["vec_id"])


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(reps: DataFrame) -> dict[str, np.ndarray]:
    """Own pivots of the large kinds, from a bounded sample by hash."""
    total = reps.count()
    size = max(CELL, -(-total // MOST_PIVOTS))
    # at most MOST_PIVOTS kinds can have more than size rows
    large = {r.kind: r.n for r in reps.groupBy("kind").agg(F.count("*").alias("n")).where(F.col("n") > size).collect()}
    if not large:
        return {}
    sample = reps.where(F.col("kind").isin(list(large))).orderBy(F.xxhash64("rep"), "rep").select("kind", "vec").limit(4 * MOST_PIVOTS).collect()
    by_kind = defaultdict(list)
    for r in sample:
        by_kind[r.kind].append(bytes(r.vec))
    return {kind: unit(found[: -(-large[kind] // size)]) for kind, found in by_kind.items()}


@lru_cache(maxsize=64)
def shared_pivots(dimensions: int) -> np.ndarray:
    """A few directions from a seed, the pivots of small kinds."""
    x = np.random.default_rng(dimensions).standard_normal((SHARED, dimensions))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bands(distance: np.ndarray, radius: float) -> np.ndarray:
    """Bands of the radius' width: points within the radius are in the same or in neighbouring ones."""
    return np.floor(distance / (radius * (1 + 1e-9) + 1e-7)).astype(np.int32)


def homes_and_guests(x: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The home cell of each vector, which cells it must visit besides, and its distances to the pivots."""
    cosine = x @ pivots.T
    home = np.argmax(cosine, axis=1)
    own = np.take_along_axis(cosine, home[:, None], 1)
    far, near = np.sqrt(np.maximum(2 - 2 * cosine, 0)), np.sqrt(np.maximum(2 - 2 * own, 0))
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))[home]
    slack = 1e-9
    # distance of x to the plane between its pivot and another: (d_j^2 - d_i^2) / (2 d_ij)
    visits = (far <= near + 2 * radius + slack) & (own - cosine <= (radius + slack) * between + slack)
    visits[np.arange(len(x)), home] = False
    return home, visits, far


def _celled(reps: DataFrame, pivots: dict[str, np.ndarray], radius: float) -> DataFrame:
    """(kind, cell, band, home, rep, copies, vec): every vector at home, and as a guest elsewhere."""
    sent = reps.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds, raw = np.array(batch.column(0).to_pylist()), batch.column(3).to_pylist()
            row, cell, band, home = [], [], [], []
            # kinds that share pivots go together, by their dimensions
            groups = defaultdict(list)
            for i, kind in enumerate(kinds.tolist()):
                groups[kind if kind in sent.value else len(raw[i]) // 8].append(i)
            for name, members in groups.items():
                at = np.array(members)
                places = sent.value[name] if isinstance(name, str) else shared_pivots(name)
                own, visits, far = homes_and_guests(unit([raw[i] for i in members]), places, radius)
                inner = np.arange(len(at))
                who, where = np.nonzero(visits)
                for some, there, is_home in ((inner, own, True), (who, where, False)):
                    row.append(at[some])
                    cell.append(there)
                    band.append(bands(far[some, there], radius))
                    home.append(np.full(len(some), is_home))
            rows = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(band)), pa.array(np.concatenate(home)), *(batch.column(i).take(rows) for i in (1, 2, 3))], ["kind", "cell", "band", "home", "rep", "copies", "vec"])

    return reps.select("kind", "rep", "copies", "vec").mapInArrow(run, "kind string, cell int, band int, home boolean, rep bigint, copies bigint, vec binary")


def linked(a: list[bytes], b: list[bytes], least: float) -> np.ndarray:
    """Which pairs reach the cosine, in double precision; near ties are summed exactly."""
    x, y = (np.frombuffer(b"".join(v), dtype=np.float64).reshape(len(v), -1) for v in (a, b))
    cosine = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
    near = cosine >= least
    for i, j in zip(*np.nonzero(np.abs(cosine - least) < 1e-12), strict=True):
        dot, nx, ny = (math.fsum((p * q).tolist()) for p, q in ((x[i], y[j]), (x[i], x[i]), (y[j], y[j])))
        near[i, j] = dot / math.sqrt(nx * ny) >= least
    return near


def _joined(cells: DataFrame, least: float) -> DataFrame:
    """(rep, n, other): per block, link counts of home vectors (other null) and tree edges (n null)."""
    key = ["kind", "cell", "band"]
    some = lambda name: F.ceil(F.count("*") / BLOCK).cast("int").alias(name)
    own = cells.where("home").groupBy(*key).agg(some("homes"))
    counts = cells.groupBy(*key).agg(F.count("*").alias("n"))
    near = counts.select("kind", "cell", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band"), "n").groupBy(*key).agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("alls"))
    sizes = written(own.join(near, key), "bands").hint("merge")
    hashed = F.xxhash64("rep")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    around = F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)).alias("band")
    left = cells.where("home").join(sizes, key).select(*key, F.pmod(hashed, F.col("homes")).cast("int").alias("i"), upto("alls").alias("j"), F.lit(0).alias("side"), "rep", "copies", "vec")
    right = cells.select("kind", "cell", around, "rep", "copies", "vec").join(sizes, key).select(*key, upto("homes").alias("i"), F.pmod(hashed, F.col("alls")).cast("int").alias("j"), F.lit(1).alias("side"), "rep", "copies", "vec")
    place = [*key, "i", "j"]
    dealt = left.unionByName(right).repartition(*place).sortWithinPartitions(*place, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sides = None, ([], [])

        def flush():
            if sides[0] and sides[1]:
                (ids, _, x), (others, copies, y) = (list(zip(*s, strict=True)) for s in sides)
                near = linked(x, y, least)
                ids, others = np.array(ids, dtype=_I), np.array(others, dtype=_I)
                near &= ids[:, None] != others[None, :]
                counts = near @ np.array(copies, dtype=_I)
                some = np.flatnonzero(counts)
                yield ids[some], counts[some], None
                edges = np.array(spanning_tree(near), dtype=_I).reshape(-1, 2)
                yield ids[edges[:, 0]], None, others[edges[:, 1]]

        def shaped(found):
            for rep, n, other in found:
                empty = pa.nulls(len(rep), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(rep), empty if n is None else pa.array(n.astype(_I)), empty if other is None else pa.array(other)], ["rep", "n", "other"])

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for *here, side, rep, copies, vec in zip(*cols, strict=True):
                if here != name:
                    yield from shaped(flush())
                    name, sides = here, ([], [])
                sides[side].append((rep, copies, vec))
        yield from shaped(flush())

    return dealt.mapInArrow(run, "rep bigint, n bigint, other bigint")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of vectors.

    Vectors (vec_id, embedding, label) of equal label and length are linked if their cosine
    is at least ``cosine`` (which must be positive). A null label, or a vector that is null,
    empty, zero or has a null or non-finite component, is linked with nothing and is its
    own component. Rows that share a vec_id are one vector; a null vec_id has a null
    component and is kept; other columns are ignored; no rows give no rows.
    """
    usable = written(_usable(vectors), "vectors")
    classes = usable.groupBy("kind", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    cells = written(_celled(classes, choose_pivots(classes), math.sqrt(2 - 2 * cosine)), "cells")
    found = written(_joined(cells, cosine), "found")
    counts = found.where("n is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    joined = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    by_rep = classes.join(counts, "rep", "left").join(joined, F.col("rep") == F.col("id"), "left")
    by_class = by_rep.select("kind", "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    each = usable.join(by_class, ["kind", "vec"]).select(F.col("vec_id").alias("_id"), "n_links", "component")
    ids = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"))
    out = ids.join(each, F.col("vec_id") == F.col("_id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(id, other) AS (
  SELECT a, b FROM links
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other
), c AS (SELECT id, min(other) AS m FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links,
       least(vec_id, coalesce(m, vec_id))::BIGINT AS component_id,
       vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
