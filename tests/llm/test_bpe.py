import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from lodestone.llm import bpe
from lodestone.llm.blocks import slices


@pytest.fixture(scope="module")
def library():
    with open(bpe.vocabulary_path(), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    own = bpe.codec(bpe.vocabulary_path())
    for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]), max_bytes=5000):
        ids, off = own.encode(part)
        assert np.array_equal(own.decode(ids), part.data)
        yield from (ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True))


def test_like_the_library_on_random_texts(library):
    rnd = random.Random(1)
    bits = ["'", "s", "t", "re", "ve", "ll", "l", "d", "m", " ", "  ", "\n", "\t", "a", "é", "1", "½", "!", "-", "　", "中", "😀", "\x1c", "\x85", "́", "S"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["", None, "a" * 3000, "ab" * 5000, " " * 500, "''s 's", "\n"]
    assert list(encoded(texts)) == [library.encode_ordinary(t or "") for t in texts]


def test_like_the_library_on_every_code_point(library):
    texts = [" " + chr(c) + "a" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert list(encoded(texts)) == [library.encode_ordinary(t) for t in texts]


def test_transition_monoid_is_closed():
    for a, f in enumerate(bpe.MAPS):
        for b, g in enumerate(bpe.MAPS):
            assert np.array_equal(bpe.MAPS[bpe.THEN[a, b]], g[f])


def test_digests_and_decoding(tricky, no_docs, library):
    texts = {r.doc_id: r.text or "" for r in tricky.collect()}
    rows = bpe.round_trip(tricky).collect()
    assert len(rows) == tricky.count()
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    for r in bpe.decode(bpe.encode(tricky)).collect():
        assert bytes(r.bytes).decode() == texts[r.doc_id]
    assert bpe.round_trip(no_docs).count() == 0
