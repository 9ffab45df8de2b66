import random
import re

import pytest

from lodestone.operators import chunking as ck
from lodestone.sources import tables as tb
from lodestone.streaming.ingest import event_windows, ingest_stream

PAGES = "doc_name string, page_num int, raw_text string"


def fold(sents, most, overlap, least):
    done, open_, words = [], [], 0
    for s in sents:
        n = len(s.split())
        if words + n > most and open_:
            done.append(" ".join(open_))
            open_ = open_[-overlap:] if overlap else []
            words = sum(len(x.split()) for x in open_)
        open_.append(s)
        words += n
    return done + [" ".join(open_)] if open_ and words >= least else done


def split(text):
    out = []
    for p in text.split("\n\n"):
        joined = " ".join(x.strip() for x in p.splitlines() if x.strip())
        out += [s.strip() for s in re.split(r'(?<=[.?!])\s+(?=[A-Z0-9"“])', joined) if s.strip()]
    return out


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(3)
    sentence = lambda: " ".join(["Word"] + ["word"] * rnd.randint(1, 60)) + rnd.choice(".?!")
    rows = [("a", 1, "1.2 Sparse Methods\n" + "\n".join(sentence() for _ in range(20)) + "\n\nNext part. " + sentence()), ("a", 2, " ".join(sentence() for _ in range(9))), ("a", 3, "Conclusion\nToo short."), ("b", 1, " ".join(["Long"] + ["w"] * 300) + "."), ("b", 2, ""), ("c", 1, "Related Work\nDiscussion\n" + " ".join(sentence() for _ in range(30)))]
    return spark.createDataFrame(rows, PAGES)


@pytest.mark.parametrize(("most", "overlap", "least"), [(120, 1, 25), (40, 2, 5), (60, 0, 1)])
def test_chunks_match_a_plain_fold(spark, pages, most, overlap, least):
    got = ck.chunk_pages(pages, 10, most, overlap, least).orderBy("chunk_id").collect()
    want = [(r.doc_name, r.page_num, t) for r in sorted(pages.collect()) for t in fold(split(r.raw_text), most, overlap, least)]
    assert [(r.doc_name, r.page_num, r.text) for r in got] == want
    assert [r.chunk_id for r in got] == list(range(10, 10 + len(want)))


def test_sections_are_sticky_and_first_on_a_page(spark, pages):
    got = {(r.doc_name, r.page_num): r.section for r in ck.with_sections(pages).collect()}
    assert got[("a", 1)] == got[("a", 2)] == "1.2 Sparse Methods" and got[("a", 3)] == "Conclusion"
    assert got[("b", 2)] == "Overview" and got[("c", 1)] == "Related Work"


def test_formatted_texts_parse_back(spark):
    rows = [("p.pdf", 3, "Intro | x", "a\nb"), ("q", 1, "§", "")]
    df = spark.createDataFrame(rows, "doc_name string, page_num int, section string, text string")
    back = tb.with_format(df).select(ck.parse_formatted(tb.F.col("fmt")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in back] == rows


def test_incremental_ingest(spark, pages, tmp_path):
    store = tb.ChunkStore(spark, str(tmp_path / "store"))
    listing = lambda *names, mtime=1.0: spark.createDataFrame([(n, mtime, 5) for n in names], "name string, mtime double, size bigint")
    first = store.ingest(pages, listing("a", "b", "c"))
    n = store.scan().count()
    assert first["total_chunks"] == n and set(first["status"].values()) == {"new"}
    again = store.ingest(pages, listing("a", "b", "c"))
    assert set(again["status"].values()) == {"unchanged"} and store.scan().count() == n
    third = store.ingest(pages, listing("a").unionByName(listing("c", mtime=2.0)))
    assert third["status"] == {"a": "unchanged", "b": "removed", "c": "modified"}
    assert {r.doc_name for r in store.scan().select("doc_name").distinct().collect()} == {"a", "c"}
    ids = [r.chunk_id for r in store.scan().collect()]
    assert ids == sorted(set(ids)) and max(ids) == third["next_chunk_id"] - 1
    assert store.get(ids[0]).count() == 1 and store.texts().first().fmt.startswith("[a | Page 1 | § 1.2 Sparse Methods] ")
    with pytest.raises(tb.RegimeMismatch):
        store.ingest(pages, listing("a"), max_words=50)


def test_streamed_and_batch_ingest_agree(spark, pages, tmp_path):
    for i, name in enumerate("abc"):
        pages.where(f"doc_name = '{name}'").coalesce(1).write.parquet(str(tmp_path / "in" / f"batch{i}"))
    store = tb.ChunkStore(spark, str(tmp_path / "store"))
    for _ in range(2):
        ingest_stream(spark, str(tmp_path / "in" / "*"), store, str(tmp_path / "check"), files_per_batch=1).awaitTermination()
    got = sorted((r.doc_name, r.page_num, r.text) for r in store.scan().collect())
    assert got == sorted((r.doc_name, r.page_num, r.text) for r in ck.chunk_pages(pages).collect())


def test_broken_metadata_is_an_empty_map(spark):
    table = spark.createDataFrame([(1, "d", 1, "s", "t", x) for x in ('{"a":"b"}', "{bad", None)], tb.CHUNK_SCHEMA)
    assert [r.metadata for r in tb.from_table(table).collect()] == [{"a": "b"}, {}, {}]


def test_event_windows(spark):
    events = spark.sql("SELECT timestamp'2026-01-01 00:00:00' + make_interval(0,0,0,0,0,i) AS ts, 'x' AS event_type, 1.5D AS value FROM (SELECT explode(sequence(0, 24)) AS i)")
    assert [(r.n, r.total) for r in event_windows(events).orderBy("start").collect()] == [(10, 15.0), (10, 15.0), (5, 7.5)]
