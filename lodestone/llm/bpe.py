"""Operator 7: byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-tokenisation runs no regular expression. Every code point gets a class symbol (with
its look-ahead folded in); a symbol is a transition function over eight states; the
functions are composed by a blocked associative scan, which gives the state before each
code point and with it the boundaries. The pieces between boundaries are hashed, each
distinct piece is merged once per worker, and the id sequence is gathered for all rows
at once. Row offsets into the ids are kept, so decoding is one gather as well.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.blocks import Slice, slices
from lodestone.llm.pieces import PieceCache
from lodestone.llm.shared import bounded_batches, documents

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: White space as the pattern's ``\s`` has it (the Unicode White_Space property). Fixed values.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# symbols
LETTER, NUMBER, OTHER, SPACE_LAST, WHITE_LAST, WHITE_MORE, SHORT_CUT, LONG_CUT, TAIL = range(9)
FIRST = 9  # added to the symbol of a row's first code point
#: Symbols that may not be merged with an equal one before them.
ONCE = np.array([x % FIRST not in (LETTER, NUMBER, OTHER, WHITE_MORE) or x >= FIRST for x in range(2 * FIRST)])
# states: what the open token is
IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, ONE_LEFT, TWO_LEFT, CLOSED = range(8)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a boundary stands before the symbol, by symbol and state."""
    step = np.zeros((2 * FIRST, 8), dtype=np.uint8)
    cut = np.zeros((2 * FIRST, 8), dtype=bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, TAIL: IN_LETTERS}
    for symbol in range(FIRST):
        for state in range(8):
            if symbol == TAIL and state in (ONE_LEFT, TWO_LEFT):  # a letter of a contraction
                step[symbol, state] = CLOSED if state == ONE_LEFT else ONE_LEFT
            elif symbol in runs:
                step[symbol, state] = runs[symbol]
                cut[symbol, state] = state not in (runs[symbol], AFTER_SPACE)
            elif symbol in (SHORT_CUT, LONG_CUT):
                inside = state in (IN_OTHER, AFTER_SPACE)
                step[symbol, state] = IN_OTHER if inside else (ONE_LEFT if symbol == SHORT_CUT else TWO_LEFT)
                cut[symbol, state] = not inside
            elif symbol == WHITE_MORE:
                step[symbol, state] = IN_WHITE
                cut[symbol, state] = state != IN_WHITE
            else:
                step[symbol, state] = AFTER_SPACE if symbol == SPACE_LAST else CLOSED
                cut[symbol, state] = True
        # a row's first code point starts from a closed token whatever came before
        step[symbol + FIRST] = step[symbol, CLOSED]
        cut[symbol + FIRST] = True
    return step, cut


STEP, CUT = _machine()


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The functions that the symbols generate under composition, few and closed.

    Returns each element as a map of states, the element of each symbol, and the table
    of compositions: ``then[a, b]`` applies a first.
    """
    elements = {tuple(range(8)): 0}
    for row in STEP:
        elements.setdefault(tuple(row.tolist()), len(elements))
    generators, todo = list(elements), list(elements)
    while todo:
        f = todo.pop()
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    maps = np.array(list(elements), dtype=np.uint8)
    weight = 8 ** np.arange(8)
    keys = maps.astype(np.int64) @ weight
    order = np.argsort(keys)
    then = maps[:, maps].transpose(1, 0, 2)  # [a, b, state] = maps[b][maps[a][state]]
    found = order[np.searchsorted(keys[order], then.astype(np.int64) @ weight)]
    return maps, np.array([elements[tuple(row.tolist())] for row in STEP], dtype=np.intp), found.astype(np.intp)


MAPS, ELEMENT, THEN = _monoid()
_BLOCK = 64


def states_before(f: np.ndarray, start: int) -> np.ndarray:
    """The state before each transition function of f (indices into MAPS): an exclusive scan."""
    n = len(f)
    if n <= _BLOCK:
        out = np.empty(n, dtype=np.intp)
        for i in range(n):
            out[i] = start
            start = int(MAPS[f[i], start])
        return out
    blocks = -(-n // _BLOCK)
    flat = np.zeros((_BLOCK, blocks), dtype=np.intp)  # element 0 is the identity
    tall = np.zeros(blocks * _BLOCK, dtype=np.intp)
    tall[:n] = f
    flat[:] = tall.reshape(blocks, _BLOCK).T
    then, size = THEN.reshape(-1), len(MAPS)
    whole = flat[0]
    for j in range(1, _BLOCK):
        whole = then[whole * size + flat[j]]
    state = states_before(whole, start)
    out, maps = np.empty((_BLOCK, blocks), dtype=np.intp), MAPS.astype(np.intp).reshape(-1)
    for j in range(_BLOCK):
        out[j] = state
        state = maps[flat[j] * 8 + state]
    return out.T.reshape(-1)[:n]


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE_MORE for each code point, as the tokenizer library has them.

    The regex package and the interpreter carry different Unicode versions. Where they
    disagree, the library itself is asked: under a vocabulary in which "a" or "1" merges
    with any byte, a code point of the same class shortens the encoding.
    """
    import public_tokenizers
    import regex
    import tiktoken

    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\ue000" for c in range(0x110000))
    for kind, name in ((LETTER, "L"), (NUMBER, "N")):
        for m in regex.finditer(rf"\p{{{name}}}+", every):
            table[m.start() : m.end()] = kind
    own = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER) for c in every), dtype=np.uint8, count=len(every))
    doubtful = np.flatnonzero(own != table)
    table[doubtful] = OTHER
    for kind, beside in ((LETTER, b"a"), (NUMBER, b"1")):
        ranks = {bytes([b]): b for b in range(256)} | {beside + bytes([b]): 256 + b for b in range(256)}
        probe = tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for c in doubtful.tolist():
            if len(probe.encode_ordinary(beside.decode() + chr(c))) <= len(chr(c).encode()):
                table[c] = kind
    table[list(WHITE)] = WHITE_MORE
    return table


def piece_starts(part: Slice) -> np.ndarray:
    """Byte offsets at which the pieces of the slice start."""
    data, off = part.data, part.off
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = data if len(lead) == len(data) else np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = class_table()[points]
    first = np.searchsorted(lead, off[:-1][np.diff(off) > 0])
    opens = np.zeros(len(points), dtype=bool)
    opens[first] = True
    # look-ahead: is the next code point of the row a non-space?
    white = kind == WHITE_MORE
    before_full = np.zeros(len(points), dtype=bool)
    before_full[:-1] = ~white[1:] & ~opens[1:]
    symbol = kind.copy()
    symbol[white & before_full] = WHITE_LAST
    symbol[white & before_full & (points == 0x20)] = SPACE_LAST
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        ahead = np.concatenate([points, np.zeros(2, dtype=points.dtype)])
        closed = np.concatenate([opens, np.ones(2, dtype=bool)])
        one = np.where(closed[marks + 1], 0, ahead[marks + 1])
        two = np.where(closed[marks + 1] | closed[marks + 2], 0, ahead[marks + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        symbol[marks[short]] = SHORT_CUT
        symbol[marks[long]] = LONG_CUT
        tails = np.concatenate([marks[short] + 1, marks[long] + 1, marks[long] + 2])
        symbol[tails] = TAIL
    symbol[opens] += FIRST
    # a repeated letter, number, other or white symbol leaves its own state alone, without a boundary
    keep = np.ones(len(symbol), dtype=bool)
    keep[1:] = (symbol[1:] != symbol[:-1]) | ONCE[symbol[1:]]
    at = np.flatnonzero(keep)
    symbol = symbol[at]
    before = states_before(ELEMENT[symbol], CLOSED)
    return lead[at[CUT[symbol, before]]]


class Codec:
    """Ranks of a byte-level BPE, with the pieces merged so far."""

    MOST_PIECES = 400_000

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.cache = PieceCache(self.MOST_PIECES)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank first, the leftmost on ties."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            # stale if i was merged away or either part has grown since
            if not alive[i] or (j := right[i]) >= n or right[j] != end:
                continue
            alive[j] = False
            right[i] = end
            if end < n:
                left[end] = i
                if (r := ranks.get(piece[i : right[end]])) is not None:
                    heapq.heappush(heap, (r, i, right[end]))
            if (k := left[i]) >= 0 and (r := ranks.get(piece[k:end])) is not None:
                heapq.heappush(heap, (r, k, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : right[i]]])
            i = right[i]
        return out

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice and the offsets of the rows in them."""
        starts = piece_starts(part)
        if not len(starts):
            return np.zeros(0, dtype=np.uint32), np.zeros(part.n + 1, dtype=np.int64)
        ends = np.append(starts[1:], len(part.data))
        hashes = part.rolling().spans(starts, ends)
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        raw = part.data.tobytes()
        slots = self.cache.lookup(keys, lambda new: [self.merge(raw[starts[w] : ends[w]]) for w in where[new].tolist()])
        ids, before = self.cache.gather(*self.cache.spans(slots[inverse]))
        piece_of_row = np.searchsorted(starts, part.off)
        off = np.append(before, len(ids))[piece_of_row]
        if not np.array_equal(self.decode(ids), part.data):  # two pieces with one hash: merge each piece by itself
            lists = [self.merge(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            ids = np.array([i for x in lists for i in x], dtype=np.uint32)
            off = np.append(np.cumsum([0] + [len(x) for x in lists])[:-1], len(ids))[piece_of_row]
        return ids, off

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        many = self.length[ids]
        before = np.cumsum(many) - many
        return self.bytes[np.repeat(self.start[ids] - before, many) + np.arange(int(many.sum()))]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


ENCODED = "doc_id bigint, n_tokens bigint, ids array<int>"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Ids of every whole text: one row (doc_id, n_tokens, ids) for each row of docs.

    A null or empty text has no ids; a null doc_id stays null; repeated rows are encoded
    each; other columns are ignored; an empty table gives no rows. One narrow stage.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch):
                ids, off = own.encode(part)
                lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array(np.diff(off)), lists], ["doc_id", "n_tokens", "ids"])

    bounded_batches(docs.sparkSession)
    return _source(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Bytes back from ``encode``'s rows: (doc_id, bytes). A null id list gives no bytes."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            out = [own.decode(np.asarray(ids.values if ids.is_valid else [], dtype=np.int64)).tobytes() for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encodes and decodes every whole text and returns digests of both, not the ids.

    Same cases as ``encode``; the digests of an empty text are those of no bytes.
    """
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part in slices(batch):
                ids, off = own.encode(part)
                little, back = ids.astype("<u4"), own.decode(ids)
                byte_off = np.append(0, np.cumsum(own.length[ids]))[off]
                one = [hashlib.sha256(little[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)]
                two = [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(byte_off[:-1], byte_off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array(np.diff(off)), pa.array(one, pa.string()), pa.array(two, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _source(docs).mapInArrow(run, DIGESTS)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
