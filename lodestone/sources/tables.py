"""Chunk tables: schema, Parquet store, manifest and the driver's tables as chunks."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import formatted

CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("chunk_id", T.LongType(), False),
        T.StructField("doc_name", T.StringType(), False),
        T.StructField("page_num", T.IntegerType(), False),
        T.StructField("section", T.StringType(), False),
        T.StructField("text", T.StringType(), False),
        T.StructField("metadata_json", T.StringType(), True),
    ]
)
MAX_WORDS, OVERLAP, MIN_WORDS = 120, 1, 25


class RegimeMismatch(ValueError):
    """The stored chunks were made with other parameters."""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as one chunk, with its formatted text."""
    docs = read(spark, sf_dir, "documents")
    base = docs.select(
        F.col("doc_id").alias("chunk_id"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("doc_name"),
        F.lit(1).alias("page_num"),
        F.lit("Overview").alias("section"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return with_format(base)


def with_format(chunks_df: DataFrame) -> DataFrame:
    return chunks_df.withColumn("fmt", formatted(F.col("doc_name"), F.col("page_num"), F.col("section"), F.col("text")))


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items as queries."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query_text"))


def to_table(chunks_df: DataFrame, metadata: str | None = None) -> DataFrame:
    """Chunks as stored: an empty metadata map becomes NULL, others JSON text."""
    meta = F.lit(None).cast("string")
    if metadata:
        meta = F.when(F.size(F.map_keys(metadata)) > 0, F.to_json(metadata))
    return chunks_df.select("chunk_id", "doc_name", "page_num", "section", "text", meta.alias("metadata_json"))


def from_table(table: DataFrame) -> DataFrame:
    """Stored chunks with their metadata as a map; NULL or broken JSON gives an empty map."""
    parsed = F.from_json("metadata_json", "map<string,string>", {"mode": "PERMISSIVE"})
    return table.withColumn("metadata", F.coalesce(parsed, F.from_json(F.lit("{}"), "map<string,string>"))).drop("metadata_json")


def regime_hash(max_words: int = MAX_WORDS, overlap: int = OVERLAP, version: str = "1") -> F.Column:
    """Sixteen hex digits that stand for the chunking parameters."""
    return F.substring(F.sha2(F.lit(f"max_words:{max_words},overlap:{overlap},v:{version}"), 256), 1, 16)


def cache_key(listing: DataFrame, prefix: str) -> DataFrame:
    """One digest over a listing (name, mtime, size) in name order."""
    entry = F.concat_ws(":", "name", F.col("mtime").cast("string"), F.col("size").cast("string"))
    joined = F.concat_ws("|", F.lit(prefix), F.array_join(F.array_sort(F.collect_list(entry)), "|"))
    return listing.agg(F.substring(F.sha2(joined, 256), 1, 16).alias("cache_key"))


def changed_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """(name, status): unchanged, modified, new or removed against a manifest of (name, mtime, size)."""
    now, then = listing.alias("n"), manifest.alias("m")
    joined = now.join(then, F.col("n.name") == F.col("m.name"), "full_outer")
    same = (F.col("n.mtime") == F.col("m.mtime")) & (F.col("n.size") == F.col("m.size"))
    status = F.when(F.col("m.name").isNull(), "new").when(F.col("n.name").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return joined.select(F.coalesce("n.name", "m.name").alias("name"), status.alias("status"))


@dataclass
class ChunkStore:
    """A Parquet chunk table partitioned by document, with a JSON manifest beside it."""

    spark: SparkSession
    path: str

    def write(self, table: DataFrame) -> None:
        """Replaces the partitions of the documents in ``table``, and only those."""
        (table.withColumn("doc", F.col("doc_name")).write.mode("overwrite").option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("doc").parquet(f"{self.path}/chunks"))

    def remove(self, names: list[str]) -> None:
        """Drops the partitions of documents that are gone."""
        hadoop, conf = self.spark._jvm.org.apache.hadoop.fs, self.spark.sparkContext._jsc.hadoopConfiguration()
        for row in self.spark.createDataFrame([(n,) for n in names], "n string").selectExpr("replace(url_encode(n), '+', '%20') AS n").collect() if names else []:
            where = hadoop.Path(f"{self.path}/chunks/doc={row.n}")
            where.getFileSystem(conf).delete(where, True)

    def scan(self) -> DataFrame:
        """All chunks by ascending id; the partition column prunes, the schema is fixed."""
        schema = T.StructType([*CHUNK_SCHEMA.fields, T.StructField("doc", T.StringType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/chunks").orderBy("chunk_id")

    def texts(self) -> DataFrame:
        """Formatted texts from four columns only."""
        return with_format(self.scan().select("chunk_id", "doc_name", "page_num", "section", "text")).select("chunk_id", "fmt")

    def get(self, chunk_id: int) -> DataFrame:
        return self.scan().where(F.col("chunk_id") == chunk_id)

    def _manifest_path(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        path = hadoop.Path(f"{self.path}/manifest.json")
        return hadoop, path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save_manifest(self, manifest: dict) -> None:
        """Writes a temporary file and renames it over the manifest."""
        hadoop, path, fs = self._manifest_path()
        temporary = hadoop.Path(f"{self.path}/.manifest.json.tmp")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        # one rename that replaces: a crash leaves the old manifest or the new one
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        where = fs.makeQualified(path)
        hadoop.FileContext.getFileContext(where.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(temporary), where, options)

    def load_manifest(self) -> dict | None:
        """The manifest, or None if there is none or it can't be parsed."""
        _, path, fs = self._manifest_path()
        if not fs.exists(path):
            return None
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.path}/manifest.json").collect())
        try:
            return json.loads(text)
        except ValueError:
            return None

    def ingest(self, pages: DataFrame, listing: DataFrame, max_words: int = MAX_WORDS, overlap: int = OVERLAP) -> dict:
        """Chunks new and modified documents, drops removed ones, keeps the rest as they are.

        pages: (doc_name, page_num, raw_text); listing: (name, mtime, size). Ids go on from
        the manifest's next id. Raises RegimeMismatch if the store was made otherwise.
        """
        from lodestone.operators.chunking import chunk_pages

        regime = self.spark.range(1).select(regime_hash(max_words, overlap)).first()[0]
        old = self.load_manifest() or {"regime": regime, "next_chunk_id": 0, "files": {}}
        if old["regime"] != regime:
            raise RegimeMismatch(f"stored {old['regime']}, asked for {regime}")
        known = self.spark.createDataFrame([(n, float(f["mtime"]), int(f["size"])) for n, f in old["files"].items()], "name string, mtime double, size bigint")
        status = {r.name: r.status for r in changed_files(listing, known).collect()}
        todo = [n for n, s in status.items() if s in ("new", "modified")]
        gone = [n for n, s in status.items() if s == "removed"]
        if todo or gone:
            if todo:
                new = chunk_pages(pages.where(F.col("doc_name").isin(todo)), old["next_chunk_id"], max_words, overlap)
                self.write(to_table(new))
                made = self.scan().agg(F.max("chunk_id")).first()[0]
                old["next_chunk_id"] = max(old["next_chunk_id"], (made if made is not None else -1) + 1)
            self.remove(gone)
            old["files"] = {r.name: {"mtime": r.mtime, "size": r.size} for r in listing.collect()}
            old["total_chunks"] = self.scan().count()
            self.save_manifest(old)
        return old | {"status": status}


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))
