"""Operator 1: secret scans by token efficiency.

Three fixed patterns give the base spans. Beyond them, a run of secret-like characters
that a byte-level BPE vocabulary can only cut into many short tokens is random rather
than language: few characters per token expose it. Known digests and identifiers are
excluded first, since they are random by design but not secret.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.blocks import Slice, byte_mask, code_points, runs, slices
from lodestone.llm.shared import bounded_batches, documents

#: The fixed patterns of the base; letters in ASCII only, in either case for the first.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
#: A cheap test on lower-cased bytes for whether ASSIGN can match at all.
_KEYWORD = re.compile(rb"passw(?:or)?d|secret|token|api_?key")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

KINDS = ("assign", "access", "hex", "random")
_HEX = byte_mask(b"0123456789abcdef")
_RUN = byte_mask(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEX_ANY = re.compile(r"[0-9A-Fa-f]+")
#: Numbers, dates and the like; what words in snake, kebab, path or camel form look like.
_NUMBERS = re.compile(r"[0-9+/_=-]+")
_NAMES = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}|[+/_=-]+)+")

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
MIN_RUN = 20
MAX_CHARS_PER_TOKEN = 2.0

SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def is_identifier(run: str) -> bool:
    """Digests, UUIDs and numbers: random-looking at times, never secret."""
    if _UUID.fullmatch(run) or _NUMBERS.fullmatch(run):
        return True
    return bool(_HEX_ANY.fullmatch(run)) and len(run) in DIGEST_LENGTHS


def has_name_form(run: str) -> bool:
    """Whether the run changes between letter case, digits and separators only a few times.

    So do names made of words, and random strings in one letter case.
    """
    pieces = re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", run)
    return bool(_NAMES.fullmatch(run)) and bool(pieces) and sum(map(len, pieces)) / len(pieces) >= 4


def is_random(run: str, encoding, max_ratio: float = MAX_CHARS_PER_TOKEN) -> bool:
    """Many short tokens; for a run in the form of a name also in lower case.

    A vocabulary knows few words in capitals, but the same words in small letters.
    """
    if is_identifier(run):
        return False
    forms = {run, run.lower()} if has_name_form(run) else {run}
    return all(len(run) <= max_ratio * len(encoding.encode_ordinary(x)) for x in forms)


def scan_slice(part: Slice, encoding, min_run: int, max_ratio: float) -> list[list[tuple[int, int, int]]]:
    """Per row the spans (start, end, kind) in code points, ordered by start, then kind."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(part.n)]
    data, off = part.data, part.off
    if not len(data):
        return found
    points = code_points(data)

    def row_of(at) -> int:
        return int(np.searchsorted(off, at, side="right")) - 1

    low = _LOWER[data].tobytes()
    rows = {row_of(m.start()) for m in _KEYWORD.finditer(low)}
    for r in rows:
        for m in ASSIGN.finditer(part.text(r)):
            if len(m[2]) >= ASSIGN_MIN:
                found[r].append((m.start(), m.end(), 0))
    whole, at, rows = data.tobytes(), 0, set()
    while (at := whole.find(b"AKIA", at)) >= 0:
        rows.add(r := row_of(at))
        at = int(off[r + 1])
    for r in rows:
        found[r] += [(m.start(), m.end(), 1) for m in ACCESS.finditer(part.text(r)) if len(m[0]) >= ACCESS_MIN]
    for s, e in zip(*_long_runs(_HEX, data, off, HEX_MIN), strict=True):
        r = row_of(s)
        found[r].append((int(points[s] - points[off[r]]), int(points[e] - points[off[r]]), 2))
    for spans in found:
        spans.sort(key=lambda x: (x[0], x[2]))
    # runs come by row and start, as the base spans do: both lists are walked once
    row, place, reach, base = -1, 0, 0, []
    for s, e in zip(*_long_runs(_RUN, data, off, min_run), strict=True):
        if (r := row_of(s)) != row:
            row, place, reach, base = r, 0, 0, list(found[r])
        a, b = int(points[s] - points[off[r]]), int(points[e] - points[off[r]])
        while place < len(base) and base[place][0] < b:
            reach, place = max(reach, base[place][1]), place + 1
        # of the base spans that start before this run ends, one ends after its start
        if reach > a:
            continue
        if is_random(whole[s:e].decode("ascii"), encoding, max_ratio):
            found[r].append((a, b, 3))
    for spans in found:
        spans.sort(key=lambda x: (x[0], x[2]))
    return found


def _long_runs(table, data, off, least):
    start, end = runs(table[data], off)
    keep = end - start >= least
    return start[keep], end[keep]


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, vocabulary: str | None = None, min_run: int = MIN_RUN, max_ratio: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """One row for each row of docs (doc_id, text): span counts, base digest and all spans.

    Works on whole texts in one narrow stage. A null text counts as empty; an empty text
    has no spans and the digest of the empty string; a null doc_id stays null; repeated
    rows are each scanned; other columns are ignored; an empty table gives no rows.
    ``random`` spans never overlap base spans. Spans are half open, in code points.
    """
    path = vocabulary or vocabulary_path()
    bounded_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            out: list[tuple] = []
            for part in slices(batch):
                for spans in scan_slice(part, encoding, min_run, max_ratio):
                    base = [x for x in spans if x[2] < 3]
                    n = [sum(x[2] == k for x in spans) for k in range(4)]
                    out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, SCHEMA)


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", vocabulary: str | None = None, min_run: int = MIN_RUN, max_ratio: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """docs with every found span replaced by ``mark``; overlapping spans become one mark.

    All columns stay, whatever their names; ``n_chars`` (where there is one) follows the new
    text. Null texts stay null, empty ones empty; repeated rows are each redacted alike; a null
    doc_id changes nothing; every row is kept, and no rows give no rows.
    """
    path = vocabulary or vocabulary_path()
    bounded_batches(docs.sparkSession)
    names, schema = docs.columns, docs.schema

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        at = names.index("text")
        for batch in batches:
            col = batch.column(at)
            changed: dict[int, str] = {}
            for part in slices(batch.select([at])):
                for r, spans in enumerate(scan_slice(part, encoding, min_run, max_ratio)):
                    if spans:
                        text, out, done = part.text(r), [], 0
                        for start, end, _ in spans:
                            if start >= done:
                                out += [text[done:start], mark]
                            done = max(done, end)
                        changed[part.first + r] = "".join(out) + text[done:]
            if changed:
                texts = col.to_pylist()
                for r, text in changed.items():
                    texts[r] = text
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, col.type))
            yield batch

    out = docs.mapInArrow(redact, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(schema["n_chars"].dataType))
    return out


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
