"""Operator 8: quality rules as a short-circuit cascade.

Every rule reads a few per-document statistics. On a bounded sample the cascade estimates
what each rule costs (bytes that the statistics it would be the first to need read and
write) and how many documents it rejects of those that the rules before it pass. It runs the
rules by rejections per cost: cheap, selective rules first, and documents that one of them
rejects are spared the rest. The order changes the cost only; a document is kept exactly if
no rule rejects it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.blocks import IS_SPACE, Rolling, Slice, byte_mask, merged, mix64, slices
from lodestone.llm.shared import documents

SYMBOLS = byte_mask(b"#*$%&|<>")
_UPPER, _LETTER = byte_mask(range(0x41, 0x5B)), byte_mask([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
WINDOW = 5
#: Documents of the sample on which costs and selectivities are estimated, by the least hash of
#: their ids, and the longest text in it: 8 MB at most. It decides the order of rules only.
SAMPLE_DOCS, SAMPLE_BYTES = 256, 32 << 10
#: What a statistic costs beyond those it is made of: passes over bytes, and over words.
PASSES = {"words": (6, 3), "word_chars": (4, 0), "n_symbols": (3, 0), "n_upper": (3, 0), "n_letters": (4, 0), "lines": (8, 0), "n_dup_lines": (6, 0), "word_hash": (6, 2), "n_repeat_words": (0, 16)}


class Stats:
    """Statistics of the rows of a slice, each computed when first asked for.

    ``take`` narrows to the rows still undecided; statistics are over those only. ``spent``
    counts the bytes that the statistics so far have cost.
    """

    def __init__(self, part: Slice):
        self.part, self._have, self.spent = part, {}, 0

    def __getattr__(self, name: str):
        have = self.__dict__["_have"]
        if name not in have:
            have[name] = getattr(self, f"_{name}")()
            by_byte, by_word = PASSES.get(name, (0, 0))
            self.spent += by_byte * len(self.part.data) + (by_word * 8 * len(self.words.start) if by_word else 0)
        return have[name]

    def _per_row(self, flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.part.off[1:]] - total[self.part.off[:-1]]

    def _words(self):
        return self.part.words()

    def _word_hash(self):
        return self.part.span_codes(self.words.start, self.words.end)

    def _n_words(self):
        return self.words.counts()

    def _word_chars(self):
        data = self.part.data
        return self._per_row(~IS_SPACE[data] & ((data & 0xC0) != 0x80))

    def _n_symbols(self):
        return self._per_row(SYMBOLS[self.part.data])

    def _n_upper(self):
        return self._per_row(_UPPER[self.part.data])

    def _n_letters(self):
        data = self.part.data
        return self._per_row(_LETTER[data] & ((data & 0xC0) != 0x80))

    def _lines(self):
        """Start, end and row of the \\n-split lines that hold a word."""
        data, off = self.part.data, self.part.off
        breaks = np.flatnonzero(data == 0x0A)
        full = np.diff(off) > 0
        start = merged(breaks + 1, off[:-1][full], len(data))
        start = start[start < len(data)]
        row = np.searchsorted(off, start, side="right") - 1
        stop = np.append(breaks, len(data))[np.searchsorted(breaks, start)]
        end = np.minimum(stop, off[row + 1])
        seen = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(~IS_SPACE[data], out=seen[1:])
        some = (end > start) & (seen[np.maximum(end, start)] > seen[start])
        return start[some], end[some], row[some]

    def _n_lines(self):
        return np.bincount(self.lines[2], minlength=self.part.n).astype(np.int64)

    def _n_dup_lines(self):
        start, end, row = self.lines
        key = self.part.span_codes(start, end) ^ mix64(row.astype(np.uint64) + np.uint64(1))
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(key), dtype=bool)
        again[first] = False
        return np.bincount(row[again], minlength=self.part.n).astype(np.int64)

    def _n_repeat_words(self):
        words = self.words
        n = len(words.start)
        grams = Rolling.over(self.word_hash).windows(WINDOW)
        starts = np.flatnonzero(words.room(WINDOW)[: len(grams)])
        key = grams[starts] ^ mix64(words.owner()[starts].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key)
        ranked = key[order]
        same = np.zeros(len(key) + 1, dtype=bool)
        same[1:-1] = ranked[1:] == ranked[:-1]
        twice = starts[order[same[:-1] | same[1:]]]
        edge = np.zeros(n + WINDOW + 1, dtype=np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + WINDOW, -1)
        covered = np.cumsum(edge)[:n] > 0
        total = np.zeros(n + 1, dtype=np.int64)
        np.cumsum(covered, out=total[1:])
        return total[words.row[1:]] - total[words.row[:-1]]

    def take(self, rows: np.ndarray) -> Stats:
        """The same statistics over some rows only; what is known of them is kept."""
        part, off = self.part, self.part.off
        size = off[rows + 1] - off[rows]
        new = np.append(0, np.cumsum(size))
        index = np.repeat(off[rows] - new[:-1], size) + np.arange(int(new[-1]))
        out = Stats(Slice(part.first, part.data[index], new))
        out._have.update({k: v[rows] for k, v in self._have.items() if k.startswith("n_") or k == "word_chars"})
        return out


@dataclass(frozen=True)
class Rule:
    """A named predicate: which rows of a slice it rejects."""

    name: str
    rejects: Callable[[Stats], np.ndarray]


#: The base rules of the contract, in integers.
BASE = (
    Rule("few_words", lambda s: s.n_words < 10),
    Rule("repeated_words", lambda s: 100 * s.n_repeat_words > 20 * s.n_words),
)

#: The method's further rules, in integers so that any engine agrees.
RULES = (
    *BASE,
    Rule("symbols", lambda s: 100 * s.n_symbols > 10 * s.n_words),
    Rule("short_words", lambda s: s.word_chars < 2 * s.n_words),
    Rule("long_words", lambda s: s.word_chars > 20 * s.n_words),
    Rule("repeated_lines", lambda s: 100 * s.n_dup_lines > 30 * np.maximum(s.n_lines, 1)),
    Rule("capitals", lambda s: 100 * s.n_upper > 60 * np.maximum(s.n_letters, 1)),
)


def order_rules(texts: list[str | None], rules=RULES) -> list[int]:
    """Indices of rules in the order in which they are to run, from a sample of texts.

    The next rule is the one with the most rejections a byte of cost, both counted over what
    the rules before it left, and after the statistics that they have needed. Ties keep the
    given order; so does an empty sample.
    """
    batch = pa.RecordBatch.from_arrays([pa.array([t if t is not None else "" for t in texts], pa.string())], ["text"])
    alive, left, order = [Stats(p) for p in slices(batch)], list(range(len(rules))), []
    while left:

        def tried(i: int) -> tuple[float, int]:
            rejected = cost = 0
            for stats in alive:
                trial = stats.take(np.arange(stats.part.n))
                rejected += int(np.count_nonzero(rules[i].rejects(trial)))
                cost += trial.spent
            return -rejected / (cost + 1), i

        best = min(map(tried, left))[1]
        order.append(best)
        left.remove(best)
        alive = [stats.take(np.flatnonzero(~rules[best].rejects(stats))) for stats in alive]
    return order


def cascade(stats: Stats, rules) -> np.ndarray:
    """Which rows pass all rules; rows that one rejects are not shown to the next."""
    alive, kept = np.arange(stats.part.n), np.zeros(stats.part.n, dtype=bool)
    for rule in rules:
        if not len(alive):
            break
        passed = ~rule.rejects(stats)
        if not passed.all():
            alive, stats = alive[passed], stats.take(np.flatnonzero(passed))
    kept[alive] = True
    return kept


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def sample_texts(docs: DataFrame, n: int = SAMPLE_DOCS, most: int = SAMPLE_BYTES) -> list[str | None]:
    """Whole texts of up to ``most`` bytes of the n ids of the least hash: for the estimates only.

    The first job reads ids alone; the second reads where they are, as far as the table's
    statistics by row group tell.
    """
    ids = [r[0] for r in docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("i")).orderBy(F.xxhash64("i"), "i").limit(n).collect()]
    rows = docs.where(F.col("doc_id").isin(ids)).select("doc_id", F.col("text").cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most)
    return [r.text for r in rows.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect()]


def apply_rules(docs: DataFrame, rules=RULES, with_counts: bool = True) -> DataFrame:
    """Rule verdicts for each row of docs (doc_id, text): the counts, base_failed, kept.

    A null text has no words and fails ``few_words``; so does an empty one. Repeated rows
    are judged each; a null doc_id stays null; other columns are ignored; an empty table
    gives no rows. The verdict comes from the cascade alone. With ``with_counts`` the counts
    of every row, rejected or not, are computed apart for the result; without, only
    (doc_id, kept) is returned and rejected rows cost nothing further.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = [rules[i] for i in order_rules(sample_texts(docs), rules)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = batch.column(0).slice(part.first, part.n)
                kept = pa.array(cascade(Stats(part), ordered))
                if not with_counts:
                    yield pa.RecordBatch.from_arrays([ids, kept], ["doc_id", "kept"])
                    continue
                stats, base = Stats(part), np.zeros(part.n, dtype=bool)
                for rule in BASE:
                    base |= rule.rejects(stats)
                counts = [pa.array(getattr(stats, c).astype(np.int64)) for c in _COUNTS]
                yield pa.RecordBatch.from_arrays([ids, *counts, pa.array(base), kept], ["doc_id", *_COUNTS, "base_failed", "kept"])

    return source.mapInArrow(run, SCHEMA if with_counts else "doc_id bigint, kept boolean")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(documents(spark, sf_dir))
