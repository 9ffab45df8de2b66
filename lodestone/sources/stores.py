"""Sources and sinks beside the chunk table: files with pages, versioned tables, graphs, vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph as gr
from lodestone.operators.scoring import dense_top
from lodestone.sources.tables import upsert

#: Characters that page extractors leave behind: a non-character and the soft hyphen. Fixed values.
LEFTOVERS = "\ufffe\u00ad"


def page_files(spark: SparkSession, folder: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """(name, mtime, size, content) of a folder's files; the suffix counts in any case.

    A listing that selects no ``content`` reads none.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"), "content")


def page_texts(files: DataFrame, extract: Callable[[bytes], list[str]]) -> DataFrame:
    """(doc_name, page_num, raw_text), pages from 1, by an extractor that runs in the executors.

    No library for PDF is required here: the caller's extractor brings its own. A file without
    pages gives no rows; a file that the extractor can't read fails the job with its name.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a file at a time, so that a batch's pages never add up
            for name, content in zip(batch["name"], batch["content"], strict=True):
                try:
                    pages = extract(bytes(content))
                except Exception as error:
                    raise ValueError(f"no pages from {name}: {error}") from error
                if pages:
                    yield pd.DataFrame({"doc_name": [name] * len(pages), "page_num": range(1, len(pages) + 1), "raw_text": pages})

    raw = files.select("name", "content").mapInPandas(run, "doc_name string, page_num int, raw_text string")
    return raw.withColumn("raw_text", F.translate("raw_text", LEFTOVERS, ""))


@dataclass
class VersionedTable:
    """A table whose versions are folders: readers see the last complete one.

    A new version is written beside the old and counts once its job has committed, so a crash
    leaves the old one in force. The last two versions stay.
    """

    spark: SparkSession
    path: str

    def _files(self):
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = hadoop.Path(self.path)
        return hadoop, root, root.getFileSystem(conf)

    def versions(self) -> list[int]:
        """Numbers of the complete versions, ascending."""
        hadoop, root, fs = self._files()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(hadoop.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        """The last version, or None before the first."""
        known = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{known[-1]}") if known else None

    def write(self, df: DataFrame) -> DataFrame:
        """A new version, which may read the present one."""
        known = self.versions()
        new = known[-1] + 1 if known else 0
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/v{new}")
        hadoop, _, fs = self._files()
        for old in known[:-1]:
            fs.delete(hadoop.Path(f"{self.path}/v{old}"), True)
        return self.spark.read.parquet(f"{self.path}/v{new}")


class GraphStore:
    """A graph of entities and relationships that grows by upserts."""

    def __init__(self, spark: SparkSession, path: str):
        self._vertices, self._edges = VersionedTable(spark, f"{path}/vertices"), VersionedTable(spark, f"{path}/edges")

    def add(self, vertices: DataFrame, edges: DataFrame) -> None:
        """Upserts entities, then relationships; endpoints that nobody described are made."""
        known, old = self._vertices.read(), self._edges.read()
        both = gr.upsert_entities(known, vertices)
        self._vertices.write(gr.with_endpoints(both, edges))
        self._edges.write(gr.upsert_relationships(old, edges))

    @property
    def vertices(self) -> DataFrame:
        return self._vertices.read()

    @property
    def edges(self) -> DataFrame:
        return self._edges.read()

    def entity(self, name: str) -> DataFrame:
        """The entity of this name, or no row."""
        return self.vertices.where(F.col("name") == name)

    def export_json(self, path: str) -> None:
        """Both tables as JSON lines."""
        self.vertices.write.mode("overwrite").json(f"{path}/vertices")
        self.edges.write.mode("overwrite").json(f"{path}/edges")


class VectorStore:
    """Chunks with vectors of one size, searched exactly by cosine; vectors may come later."""

    FIELDS = ["chunk_id", "doc_name", "page_num", "section", "text", "metadata_json"]

    def __init__(self, spark: SparkSession, path: str, size: int):
        self.table, self.size = VersionedTable(spark, path), size

    def _checked(self, vectors: DataFrame) -> DataFrame:
        right = F.col("vector").isNull() | (F.size("vector") == self.size)
        return vectors.withColumn("vector", F.when(right, F.col("vector").cast("array<double>")).otherwise(F.raise_error(F.lit(f"a vector must have {self.size} components"))))

    def add(self, chunks: DataFrame, vectors: DataFrame | None = None) -> None:
        """Upserts chunks (FIELDS) with vectors (chunk_id, vector); those without one have null."""
        if vectors is None:
            new = chunks.select(*self.FIELDS).withColumn("vector", F.lit(None).cast("array<double>"))
        else:
            new = chunks.select(*self.FIELDS).join(self._checked(vectors).select("chunk_id", "vector"), "chunk_id", "left")
        old = self.table.read()
        both = new if old is None else upsert(old, new, "chunk_id")
        # clustered by document: its statistics prune lookups by doc_name
        self.table.write(both.repartitionByRange("doc_name", "chunk_id").sortWithinPartitions("doc_name", "chunk_id"))

    def update_vectors(self, vectors: DataFrame) -> None:
        """Replaces the vectors of known ids; unknown ids change nothing."""
        new = self._checked(vectors).select("chunk_id", F.col("vector").alias("_new"), F.lit(True).alias("_hit"))
        old = self.table.read()
        self.table.write(old.join(new, "chunk_id", "left").withColumn("vector", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("vector"))).select(*old.columns))

    def scan(self) -> DataFrame:
        return self.table.read().orderBy("chunk_id")

    def count(self) -> int:
        return self.table.read().count()

    def where(self, doc_names: list[str] | None = None, pages: tuple[int, int] | None = None, section: str | None = None) -> DataFrame:
        """Chunks of some documents, of pages first to last, whose section has all the words of ``section``."""
        found = self.table.read()
        if doc_names is not None:
            found = found.where(F.col("doc_name").isin(doc_names))
        if pages is not None:
            found = found.where(F.col("page_num").between(*pages))
        for word in (section or "").lower().split():
            found = found.where(F.array_contains(F.split(F.lower("section"), "[^\\p{L}\\p{N}]+"), word))
        return found

    def search(self, queries: DataFrame, k: int, **filters) -> DataFrame:
        """(query_id, chunk_id, score, rank) of the nearest chunks, with the filters of ``where``.

        queries: (query_id, vector)."""
        asked = self._checked(queries).select("query_id", F.col("vector").alias("qv"))
        return dense_top(asked, self.where(**filters).where("vector is not null").select("chunk_id", F.col("vector").alias("v")), k)
