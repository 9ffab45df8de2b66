"""Operator 5: a quality classifier by nearest-neighbour voting in a latent space.

A bounded, class-balanced sample of labelled documents is embedded by latent semantic
analysis (hashed byte trigrams and shape features, tf-idf, truncated SVD). The labelled
vectors, a few hundred kilobytes by construction, go to every task; each document is
compared with all of them in exact blocked cosine products, and its nearest neighbours
vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.blocks import Rolling, Slice, byte_mask, slices
from lodestone.llm.shared import bounded_batches, documents

#: Bound of the fit: at most this many labelled documents of each class.
LABELLED_PER_CLASS = 1024
TRIGRAM_BINS = 2048
LATENT = 48
NEIGHBOURS = 15
#: Exponent that turns a cosine into the weight of a vote.
SHARPNESS = 16.0
#: Weight of a shape feature beside the trigrams' unit vector.
SHAPE_WEIGHT = 0.5

_SYMBOL = byte_mask(b"#*$%&|<>!{}[]@^~=_\\/+")
_UPPER = byte_mask(range(0x41, 0x5B))
_DIGIT = byte_mask(range(0x30, 0x3A))
_SHAPES = 6
_LEVELS = 8
WIDTH = TRIGRAM_BINS + _SHAPES * _LEVELS


def _ramp(value: np.ndarray) -> np.ndarray:
    """A value in [0, 1] as overlapping soft levels, so near values share features."""
    at = np.clip(value, 0, 1)[:, None] * (_LEVELS - 1)
    return np.maximum(0, 1 - np.abs(at - np.arange(_LEVELS)[None, :])).astype(np.float32)


def features(part: Slice) -> np.ndarray:
    """(rows, WIDTH): log-scaled hashed trigram counts and shape levels of whole texts."""
    n, data, off = part.n, part.data, part.off
    size = np.diff(off)
    row = np.repeat(np.arange(n), size)
    counts = np.zeros((n, TRIGRAM_BINS), dtype=np.float32)
    if len(data) >= 3:
        b = data.astype(np.uint32)
        h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        inside = row[2:] == row[:-2]
        key = row[:-2][inside] * TRIGRAM_BINS + (h[inside] >> np.uint32(32 - TRIGRAM_BINS.bit_length() + 1)).astype(np.int64)
        counts = np.bincount(key, minlength=n * TRIGRAM_BINS).reshape(n, TRIGRAM_BINS).astype(np.float32)
    np.log1p(counts, out=counts)
    words = part.words()
    n_words = words.counts()
    codes = part.rolling()
    word = codes.spans(words.start, words.end)
    owner = words.owner()

    def total(flags) -> np.ndarray:
        return np.bincount(row[flags], minlength=n)

    def distinct_share(hashes, rows) -> np.ndarray:
        many = np.bincount(rows, minlength=n)
        order = np.lexsort((hashes, rows))
        h, r = hashes[order], rows[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        return np.bincount(r[new], minlength=n) / np.maximum(many, 1)

    pairs = Rolling.over(word).windows(3)
    fits = words.room(3)[: len(pairs)]
    some = np.maximum(size, 1)
    shapes = [
        _ramp(np.log1p(n_words) / 10),
        _ramp(distinct_share(word, owner)),
        _ramp(distinct_share(pairs[fits], owner[: len(pairs)][fits])),
        _ramp(5 * total(_SYMBOL[data]) / some),
        _ramp(total(_UPPER[data]) / some),
        _ramp(2 * total(_DIGIT[data]) / some),
    ]
    return np.concatenate([counts, *shapes], axis=1)


@dataclass
class Model:
    """Everything a task needs; its size depends on the bounds above only."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    @classmethod
    def fit(cls, raw: np.ndarray, labels: np.ndarray) -> Model:
        prior = float(labels.mean()) if len(labels) else 0.5
        seen = (raw[:, :TRIGRAM_BINS] > 0).sum(0)
        idf = np.log((1 + len(raw)) / (1 + seen)).astype(np.float32) + 1
        model = cls(idf, np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), labels.astype(np.float32), prior)
        if not len(raw):
            return model
        weighted = model.weigh(raw)
        # truncated SVD by subspace iteration from a fixed start
        k = min(LATENT, len(raw))
        basis = np.linalg.qr(weighted.T @ np.random.default_rng(0).standard_normal((len(raw), k)).astype(np.float32))[0]
        for _ in range(6):
            basis = np.linalg.qr(weighted.T @ (weighted @ basis))[0]
        model.basis = np.ascontiguousarray(basis, dtype=np.float32)
        model.vectors = model.embed(raw)
        return model

    def weigh(self, raw: np.ndarray) -> np.ndarray:
        grams = raw[:, :TRIGRAM_BINS] * self.idf
        grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
        return np.concatenate([grams, SHAPE_WEIGHT * raw[:, TRIGRAM_BINS:]], axis=1)

    def embed(self, raw: np.ndarray) -> np.ndarray:
        out = self.weigh(raw) @ self.basis
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def score(self, raw: np.ndarray, block: int = 512) -> np.ndarray:
        """Share of label 1 among the nearest labelled documents, weighted by similarity."""
        out = np.full(len(raw), self.prior)
        n = len(self.vectors)
        if not n:
            return out
        k = min(NEIGHBOURS, n)
        for lo in range(0, len(raw), block):
            cosine = self.embed(raw[lo : lo + block]) @ self.vectors.T
            near = np.argpartition(cosine, n - k, axis=1)[:, n - k :]
            weight = np.clip(np.take_along_axis(cosine, near, 1), 0, 1).astype(np.float64) ** SHARPNESS
            whole = weight.sum(1)
            votes = (weight * self.labels[near]).sum(1)
            out[lo : lo + block] = np.where(whole > 0, votes / np.maximum(whole, 1e-300), self.prior)
        return np.clip(out, 0, 1)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = LABELLED_PER_CLASS) -> Model:
    """The model from docs (doc_id, text) and labels (doc_id, column), held-out rows left out.

    Of each class the ``per_class`` rows with the smallest hash of doc_id are used. A doc_id
    with several labels counts by the largest; null labels and ids are left out. Without
    any usable row the model scores 0.5.
    """
    bounded_batches(docs.sparkSession)
    usable = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    one, zero = (usable.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (1, 0))
    # at most 2 * per_class rows of two numbers
    sample = F.broadcast(one.unionByName(zero))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id").dropDuplicates(["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [x.astype(np.float32).tobytes() for x in features(part)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), batch.column(2).slice(part.first, part.n), pa.array(rows, pa.binary())], ["doc_id", "label", "raw"])

    got = sorted(texts.select("doc_id", "text", "label").mapInArrow(run, "doc_id bigint, label int, raw binary").collect())
    raw = np.frombuffer(b"".join(bytes(r.raw) for r in got), dtype=np.float32).reshape(-1, WIDTH)
    return Model.fit(raw, np.array([r.label for r in got], dtype=np.float32))


SCHEMA = "doc_id bigint, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs, from its whole text alone.

    Null and empty texts score by their shape (no words); repeated rows score alike; a null
    doc_id stays null; other columns are ignored; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array(sent.value.score(features(part)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is at least ``least``.

    Null and empty texts score by their shape (no words); repeated rows score alike, so all or
    none of them stay; a null doc_id is as good as any; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [sent.value.score(features(part)) >= least for part in slices(batch.select([at]).rename_columns(["text"]))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
