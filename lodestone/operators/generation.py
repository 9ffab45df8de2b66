"""Answers by an external generator: choice, quota, retries, routes, errors and records.

A generator is any callable from a prompt to a text. No client library is imported here; a caller
brings one as a callable and raises the errors below, or names an environment variable under which
one may be made.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators import rag
from lodestone.operators.graph import neighbours, query_entities

#: Answer where retrieval found nothing.
NOTHING_FOUND = "No relevant passages were found."


class ProviderError(rag.GenerationError):
    """A provider's failure; ``provider`` and ``route`` say whose."""

    def __init__(self, message: str, provider: str | None = None, route: str | None = None, retryable: bool = True):
        super().__init__(message, retryable)
        self.provider, self.route = provider, route


class RateLimited(ProviderError):
    """A quota is used up: ``limit`` is rpm, input_tpm, output_tpm or unknown."""

    def __init__(self, message: str, limit: str = "unknown", retry_after: float | None = None, **whose):
        super().__init__(message, **whose)
        self.limit, self.retry_after = limit, retry_after


class NotAuthorized(ProviderError):
    """Credentials were refused; another try can't help."""

    def __init__(self, message: str, **whose):
        super().__init__(message, retryable=False, **whose)


def model_name(provider: str, model: str, aliases: Mapping[str, Mapping[str, str]]) -> str:
    """A provider's own name of a model; unknown names stay as they are.

    aliases maps a provider to (alias, name); case, surrounding space and ``_`` for ``-`` don't matter.
    """
    known = aliases.get(provider.strip().lower(), {})
    plain = model.strip().lower()
    return known.get(plain.replace("_", "-"), known.get(plain, model))


def detect(providers: Mapping[str, tuple[str, Callable[[], Callable[[str], str]]]], prefer: str | None = None, env: Mapping[str, str] = os.environ) -> Callable[[str], str]:
    """The generator asked for, else the first in order whose environment variable is set.

    providers maps a name to (variable, maker). A maker that fails is passed over unless it was
    asked for. ValueError if none is left.
    """
    if prefer and prefer.strip().lower() in providers:
        return providers[prefer.strip().lower()][1]()
    for variable, make in providers.values():
        if env.get(variable):
            try:
                return make()
            except Exception:  # noqa: BLE001, S112 - the next provider may work
                continue
    raise ValueError("no generator: set one of " + ", ".join(v for v, _ in providers.values()))


def first_edges(queries: DataFrame, vertices: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, name, src, dst): the first edges of the first entities that a query names, by name."""

    def first(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
        return df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r") <= most).drop("r")

    named = first(query_entities(queries, vertices), ["query_id"], ["name"])
    met = neighbours(edges, named.select(F.col("name").alias("start")).distinct())
    return first(named.join(met, F.col("name") == F.col("start")), ["query_id", "name"], ["src", "dst"]).select("query_id", "name", "src", "dst")


def triplets(queries: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, block): the first edges around a query's entities, each once, a line each."""
    met = first_edges(queries, vertices, edges).select("query_id", "src", "dst").distinct().join(edges.select("src", "dst", "relation_type"), ["src", "dst"])
    # at most three edges of three entities
    lines = F.array_sort(F.collect_list(F.format_string("(%s) -[%s]-> (%s)", "src", "relation_type", "dst")))
    return met.groupBy("query_id").agg(F.array_join(F.concat(F.array(F.lit("[Graph relations]")), lines), "\n").alias("block"))


@dataclass(frozen=True)
class Citation:
    """A cited chunk with what its level rests on."""

    chunk_id: int
    rank: int
    fusion_score: float
    lexical_overlap: float
    confidence: str


@dataclass(frozen=True)
class Answer:
    query_id: int
    query: str
    answer: str
    prompt: str
    citations: tuple[Citation, ...]
    strategy: str
    route: str


@dataclass
class GenerationPipeline:
    """Context, prompt and a generator's answer for a batch of queries.

    Generators are tried in order: ``generator`` alone if given, else the ``routes`` with their
    circuit breakers, else what ``detect`` finds among ``providers``. A call waits for its
    quota up to ``patience`` seconds and is retried; only prompts and answers reach the driver.
    """

    generator: Callable[[str], str] | None = None
    routes: list[tuple[str, Callable[[str], str]]] | None = None
    providers: Mapping[str, tuple[str, Callable[[], Callable[[str], str]]]] = field(default_factory=dict)
    limiter: rag.RateLimiter | None = None
    tries: int = 3
    max_output: int = 1024
    patience: float = 10.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def __post_init__(self):
        if self.generator is None and self.routes is None:
            self.generator = detect(self.providers)
        routes = [("direct", self.generator)] if self.generator is not None else self.routes
        self.router = rag.Router([(name, self._retried(call)) for name, call in routes], clock=self.clock)

    def _retried(self, call: Callable[[str], str]) -> Callable[[str], str]:
        return lambda text: rag.with_retries(lambda: call(text), self.tries, sleep=self.sleep)

    def _wait(self, text: str) -> None:
        until = self.clock() + self.patience
        while self.limiter and not self.limiter.acquire(text, self.max_output):
            if self.clock() >= until:
                raise RateLimited(f"no quota within {self.patience} s")
            self.sleep(0.1)

    def answer(self, queries: DataFrame, results: DataFrame, triplets: DataFrame | None = None, strategy: str = "unknown") -> list[Answer]:
        """One answer a query, by query_id. results: (query_id, chunk_id, rank, score, doc_name,
        page_num, section, text). Queries without results get NOTHING_FOUND and no call."""
        contexts = rag.build_context(results, triplets)
        prompts = queries.join(contexts, "query_id", "left").select("query_id", "query_text", rag.prompt(F.col("query_text"), F.col("context")).alias("prompt")).orderBy("query_id")
        cited: dict[int, list[Citation]] = {}
        for r in rag.citations(results, queries).orderBy("query_id", "rank").select("query_id", "chunk_id", "rank", "score", "overlap", "level").toLocalIterator():
            cited.setdefault(r.query_id, []).append(Citation(r.chunk_id, r["rank"], r.score, r.overlap, r.level))
        out = []
        # a batch of queries, each with a prompt bounded by the context's budget
        for row in prompts.toLocalIterator():
            route, text = "", NOTHING_FOUND
            if row.prompt is not None:
                self._wait(row.prompt)
                route, text = self.router.generate(row.prompt)
            out.append(Answer(row.query_id, row.query_text, text, row.prompt or "", tuple(cited.get(row.query_id, ())), strategy, route))
        return out
