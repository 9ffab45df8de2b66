"""Command line: search, ask, eval and ingest over Parquet tables."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.engine import SearchEngine
from lodestone.sources import tables as tb


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestone")
    verbs = parser.add_subparsers(dest="verb", required=True)
    for verb in ("search", "ask"):
        p = verbs.add_parser(verb)
        p.add_argument("query")
        p.add_argument("--chunks", required=True, help="chunk table (Parquet)")
        p.add_argument("--strategy", default="rrf_dedup_mmr" if verb == "search" else "graph")
        p.add_argument("--top-k", type=int, default=5 if verb == "search" else 3)
    p = verbs.add_parser("eval")
    p.add_argument("--tables", required=True, help="folder with documents.parquet and benchmark.parquet")
    p.add_argument("--strategies", nargs="+", default=["bm25", "tfidf", "rrf"])
    p = verbs.add_parser("ingest")
    p.add_argument("--pages", required=True, help="Parquet of doc_name, page_num, raw_text")
    p.add_argument("--store", required=True)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if args.verb == "ingest":
        pages = spark.read.parquet(args.pages)
        listing = pages.groupBy(F.col("doc_name").alias("name")).agg(F.abs(F.hash(F.array_sort(F.collect_list(F.xxhash64("page_num", "raw_text"))))).cast("double").alias("mtime"), F.sum(F.length("raw_text")).alias("size"))
        done = tb.ChunkStore(spark, args.store).ingest(pages, listing)
        print(json.dumps({"total_chunks": done.get("total_chunks", 0), "next_chunk_id": done["next_chunk_id"]}))
        return 0
    if args.verb == "eval":
        engine = SearchEngine(spark, tb.chunks(spark, args.tables).drop("fmt"))
        queries = tb.search_queries(spark, args.tables)
        truth = queries.join(engine.chunks, F.contains("text", F.substring("query_text", 1, 60))).select("query_id", "chunk_id")
        engine.evaluate(queries, truth, args.strategies).show(truncate=False)
        return 0
    engine = SearchEngine(spark, spark.read.parquet(args.chunks))
    if args.verb == "ask":
        print(json.dumps(engine.ask(args.query, args.strategy, args.top_k), ensure_ascii=False))
        return 0
    queries = spark.createDataFrame([(0, args.query)], "query_id bigint, query_text string")
    for r in engine.search(queries, args.strategy, args.top_k).orderBy("rank").collect():
        print(f"{r['rank']}. {r['doc_name']} p.{r['page_num']} [{r['score']:.6f}] {r['text'][:120]}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
