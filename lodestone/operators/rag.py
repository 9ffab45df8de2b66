"""Context assembly, prompts, citation confidence and offline answers."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import jaccard, words_by_space

CONTEXT_CHARS = 8000


def build_context(results: DataFrame, triplets: DataFrame | None = None, budget: int = CONTEXT_CHARS) -> DataFrame:
    """(query_id, context, n_sources): numbered source blocks within a budget of characters.

    results: query_id, rank, doc_name, page_num, section, text. The walk stops at the first
    block that would overflow, but one passage always stays. triplets (query_id, block) go
    first and use up budget too.
    """
    head = F.format_string("[Source %d: %s | Page %d | § %s]\n", "rank", "doc_name", "page_num", "section")
    blocks = results.withColumn("block", F.concat(head, "text"))
    if triplets is not None:
        blocks = blocks.join(triplets.withColumnRenamed("block", "graph"), "query_id", "left")
    else:
        blocks = blocks.withColumn("graph", F.lit(None).cast("string"))
    order = Window.partitionBy("query_id").orderBy("rank")
    used = F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.length("graph"), F.lit(0))
    fits = blocks.withColumn("n", F.row_number().over(order)).withColumn("used", used).where((F.col("used") <= budget) | (F.col("n") == 1))
    joined = fits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "block"))).alias("b"), F.first("graph").alias("graph"))
    parts = F.concat(F.when(F.col("graph").isNotNull(), F.array("graph")).otherwise(F.array().cast("array<string>")), F.transform("b", lambda x: x["block"]))
    return joined.select("query_id", F.array_join(parts, "\n\n").alias("context"), F.size("b").alias("n_sources"))


def prompt(query: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer the question from the sources below and cite them as [Source n].\n\nSources:\n"), context, F.lit("\n\nQuestion: "), query, F.lit("\nAnswer:"))


def lexical_overlap(query: Column, passage: Column) -> Column:
    return jaccard(F.array_distinct(words_by_space(query)), F.array_distinct(words_by_space(passage)))


def normalized_score(score: Column, most: float = 10.0) -> Column:
    return F.least(F.greatest(score / most, F.lit(0.0)), F.lit(1.0))


def simulated_score(rank: Column) -> Column:
    return F.greatest(1.0 - 0.1 * (rank - 1), F.lit(0.0))


def confidence(rank: Column, fusion: Column, overlap: Column) -> Column:
    """high, medium or low for a citation."""
    high = (rank <= 2) & (fusion >= 0.7) & (overlap >= 0.3)
    medium = (rank <= 4) | ((fusion >= 0.5) & (overlap >= 0.2))
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def citations(results: DataFrame, queries: DataFrame, real_scores: bool = False) -> DataFrame:
    """results with overlap and level. With ``real_scores`` the results' own scores in [0, 1]
    decide; without, the score is simulated from the rank and normalised by 10."""
    fusion = F.col("score") if real_scores else normalized_score(simulated_score(F.col("rank")))
    joined = results.join(queries, "query_id").withColumn("overlap", F.round(lexical_overlap(F.col("query_text"), F.col("text")), 9))
    return joined.withColumn("level", confidence(F.col("rank"), fusion, F.col("overlap")))


def extractive_answer(queries: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, answer, citations): the sentence closest to the query, without any model."""
    sentences = results.select("query_id", "rank", F.posexplode(F.split("text", "(?<=[.!?])\\s+")).alias("pos", "sentence"))
    scored = sentences.join(queries, "query_id").withColumn("s", F.round(lexical_overlap(F.col("query_text"), F.col("sentence")), 9))
    best = scored.groupBy("query_id").agg(F.min_by(F.struct("sentence", "rank"), F.struct(-F.col("s"), F.col("rank"), F.col("pos"))).alias("b"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("b.sentence", F.lit("No relevant passages were found.")).alias("answer"), F.coalesce(F.array("b.rank"), F.array().cast("array<int>")).alias("citations"))


# --- driver-side control of external generators


class GenerationError(RuntimeError):
    """A generator failed; ``retryable`` says whether another try may help."""

    def __init__(self, message: str, retryable: bool = True):
        super().__init__(message)
        self.retryable = retryable


@dataclass
class TokenBucket:
    """Holds up to ``capacity`` tokens, refilled at ``rate`` a second."""

    capacity: float
    rate: float
    clock: Callable[[], float] = time.monotonic
    level: float = field(init=False)
    at: float = field(init=False)
    lock: threading.Lock = field(init=False, repr=False, default_factory=threading.Lock)

    def __post_init__(self):
        self.level, self.at = self.capacity, self.clock()

    def take(self, n: float = 1) -> bool:
        with self.lock:
            now = self.clock()
            self.level = min(self.capacity, self.level + (now - self.at) * self.rate)
            self.at = now
            if self.level < n:
                return False
            self.level -= n
            return True

    def give_back(self, n: float) -> None:
        with self.lock:
            self.level = min(self.capacity, self.level + n)


@dataclass
class RateLimiter:
    """Requests, input tokens and output tokens a minute; a refused part is refunded."""

    rpm: float
    input_tpm: float
    output_tpm: float
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self):
        self.buckets = [TokenBucket(x, x / 60, self.clock) for x in (self.rpm, self.input_tpm, self.output_tpm)]

    @staticmethod
    def estimate(text: str) -> int:
        return max(1, len(text) // 4)

    def acquire(self, prompt_text: str, max_output: int) -> bool:
        wanted = (1, self.estimate(prompt_text), max_output / 2)
        for i, (bucket, n) in enumerate(zip(self.buckets, wanted, strict=True)):
            if not bucket.take(n):
                for back, m in zip(self.buckets[:i], wanted, strict=False):
                    back.give_back(m)
                return False
        return True


def with_retries(call: Callable[[], str], tries: int = 3, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Calls until it works: exponential waits with up to a tenth of jitter; fatal errors pass."""
    for attempt in range(tries):
        try:
            return call()
        except GenerationError as error:
            if not error.retryable or attempt + 1 == tries:
                raise
            sleep(base * 2**attempt * (1 + 0.1 * random.random()))
    raise AssertionError("unreachable")


@dataclass
class Router:
    """Tries generators in order; one that failed ``most`` times rests for ``rest`` seconds."""

    routes: list[tuple[str, Callable[[str], str]]]
    most: int = 3
    rest: float = 60.0
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self):
        self.failures = {name: 0 for name, _ in self.routes}
        self.until = {name: 0.0 for name, _ in self.routes}

    def generate(self, prompt_text: str) -> tuple[str, str]:
        last: Exception = GenerationError("no route is available")
        for name, call in self.routes:
            if self.clock() < self.until[name]:
                continue
            try:
                answer = call(prompt_text)
            except GenerationError as error:
                last = error
                self.failures[name] += 1
                if self.failures[name] >= self.most:
                    self.until[name], self.failures[name] = self.clock() + self.rest, 0
                continue
            self.failures[name] = 0
            return name, answer
        raise last
