import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestone.llm import planes


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("top", [1, 2, 255, 256, 49407, 1 << 20, (1 << 32) - 1])
def test_planes_round_trip(mode, top):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, top, 1001, dtype=np.uint32, endpoint=True)
    ids[0] = top
    parts = planes.split_planes(ids, int(top).bit_length(), mode)
    assert np.array_equal(planes.join_planes([p.tobytes() for p in parts], len(ids), mode), ids)


class Source:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        return self.data[at : at + n]


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_file_round_trip(mode):
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 50000, n).astype(np.uint32) for n in (0, 1, 3000, 0, 7, 100, 1)]
    sink = io.BytesIO()
    writer = planes.Writer(sink, mode, block=64)
    for i, ids in enumerate(docs):
        writer.add(np.array([i]), np.array([len(ids)]), ids)
    assert writer.close() == len(sink.getvalue())
    reader = planes.Reader(Source(sink.getvalue()))
    at = 0
    for i, (doc, start, ids) in enumerate(reader.documents()):
        assert doc == i and start == at and np.array_equal(ids, docs[i]) and np.array_equal(reader.document(i), docs[i])
        at += len(ids)


def test_against_the_library(spark, tricky, no_docs):
    tokenizer = Tokenizer.from_file(planes.vocabulary_path())
    rows = sorted((r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in tricky.collect())
    got = sorted(planes.round_trip(tricky).collect(), key=lambda r: (r.doc_id, r.start))
    start = 0
    for (doc, ids), r in zip(rows, got, strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (doc, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert planes.round_trip(no_docs).count() == 0


def test_pieces_are_independent():
    own, tokenizer = planes.word_codec(planes.vocabulary_path()), Tokenizer.from_file(planes.vocabulary_path())
    texts = ["ΣΑΣ ΟΔΟΣ Σ", "İstanbul IŞIK", "é ́x", "<|endoftext|> a<|startoftext|>b", "don't I'LL 12 3x", " a b\x1cc\x85d", "ﬁ Å ẛ̣", "😀👍🏽 中文字", "‍ a ‍", "'s 's"]
    from lodestone.llm.blocks import slices

    for part in slices(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])):
        ids, off = own.encode(part)
        for r, text in enumerate(texts):
            assert ids[off[r] : off[r + 1] - 1].tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
