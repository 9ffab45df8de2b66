import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation as ev
from lodestone.operators import graph as gr
from lodestone.sources import stores as st

ENTITY = "name string, entity_type string, description string, chunk_ids array<bigint>, doc_names array<string>"
EDGE = "src string, dst string, relation_type string, weight double, description string, chunk_ids array<bigint>"
CHUNK = "chunk_id bigint, doc_name string, page_num int, section string, text string, metadata_json string"


def test_page_files_and_texts(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes("one\fsoft\u00adhy\ufffephen".encode())
    (tmp_path / "B.PDF").write_bytes(b"two")
    (tmp_path / "c.txt").write_bytes(b"not this")
    files = st.page_files(spark, str(tmp_path))
    assert sorted((r.name, r.size) for r in files.select("name", "size").collect()) == [("B.PDF", 3), ("a.pdf", 19)]
    pages = st.page_texts(files, lambda data: data.decode().split("\f"))
    assert sorted(map(tuple, pages.collect())) == [("B.PDF", 1, "two"), ("a.pdf", 1, "one"), ("a.pdf", 2, "softhyphen")]
    assert st.page_texts(files, lambda data: []).count() == 0


def test_versions_survive_an_incomplete_write(spark, tmp_path):
    table = st.VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    for n in range(4):
        table.write(spark.range(n) if table.read() is None else table.read().unionByName(spark.range(1)))
    assert table.versions() == [2, 3] and table.read().count() == 3
    (tmp_path / "t" / "v4").mkdir()
    assert table.read().count() == 3
    assert table.write(spark.range(9)).count() == 9


def test_graph_store(spark, tmp_path):
    store = st.GraphStore(spark, str(tmp_path))
    one = spark.createDataFrame([("BM25", "TECHNICAL_ACRONYM", "", [2], ["x"])], ENTITY)
    two = spark.createDataFrame([("BM25", "CONCEPT", "a scorer", [1], ["y"]), ("RRF", "CONCEPT", None, [1], ["y"])], ENTITY)
    edge = spark.createDataFrame([("BM25", "Fusion", "CO_OCCURS_WITH", 1.5, "first", [2])], EDGE)
    again = spark.createDataFrame([("BM25", "Fusion", "CO_OCCURS_WITH", 2.0, "second", [1])], EDGE)
    store.add(one, edge)
    store.add(two, again)
    assert {tuple(r) for r in store.vertices.select("name", "entity_type", "description").collect()} == {("BM25", "TECHNICAL_ACRONYM", "a scorer"), ("RRF", "CONCEPT", ""), ("Fusion", "CONCEPT", "")}
    assert store.entity("BM25").first().chunk_ids == [1, 2] and store.entity("none").count() == 0
    row = store.edges.first()
    assert (row.weight, row.description, row.chunk_ids) == (3.5, "first", [1, 2])
    store.export_json(str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json" / "vertices")).count() == 3


def test_vector_store(spark, tmp_path):
    store = st.VectorStore(spark, str(tmp_path), 2)
    rows = [(1, "a", 1, "Rank fusion", "x", None), (2, "a", 2, "Overview", "y", None), (3, "b", 1, "Fusion", "z", None)]
    chunks = spark.createDataFrame(rows, CHUNK)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id bigint, vector array<double>")
    store.add(chunks, vectors)
    assert store.count() == 3 and [r.chunk_id for r in store.scan().collect()] == [1, 2, 3]
    asked = spark.createDataFrame([(7, [1.0, 0.1])], "query_id bigint, vector array<double>")
    assert [r.chunk_id for r in store.search(asked, 5).orderBy("rank").collect()] == [1, 2]
    store.update_vectors(spark.createDataFrame([(3, [1.0, 0.1]), (99, [1.0, 1.0])], "chunk_id bigint, vector array<double>"))
    assert [r.chunk_id for r in store.search(asked, 1).collect()] == [3]
    assert [r.chunk_id for r in store.search(asked, 5, doc_names=["a"], pages=(1, 1)).collect()] == [1]
    assert {r.chunk_id for r in store.where(section="fusion").collect()} == {1, 3}
    store.add(chunks.where("chunk_id = 1"))
    assert store.count() == 3 and store.search(asked, 5, doc_names=["a"]).count() == 1
    with pytest.raises(Exception, match="2 components"):
        store.update_vectors(spark.createDataFrame([(1, [1.0])], "chunk_id bigint, vector array<double>"))


def test_model_extractor_falls_back_by_chunk(spark):
    chunks = spark.createDataFrame([(1, "d", 1, "Overview", "good"), (2, "d", 1, "Overview", "HNSW and BM25 meet. HNSW wins."), (3, "d", 1, "Overview", "down")], "chunk_id bigint, doc_name string, page_num int, section string, text string")

    def call(text):
        if text == "down":
            raise RuntimeError("no answer")
        return '```json\n{"entities": [{"name": "Alpha"}, {"name": "Beta"}, {"name": "x"}], "relationships": [{"source": "Alpha", "target": "Beta"}, {"source": "Alpha", "target": "Nobody"}]}\n```' if text == "good" else "not json"

    vertices, edges = gr.extract_by_model(chunks, call)
    names = {r.name for r in vertices.collect()}
    assert {"Alpha", "Beta", "HNSW"} <= names and "x" not in names
    assert ("Alpha", "Beta", "RELATED_TO") in {(r.src, r.dst, r.relation_type) for r in edges.collect()}
    assert "Nobody" not in {r.dst for r in edges.collect()}
    with pytest.raises(Exception, match="no answer"):
        gr.extract_by_model(chunks, call, strict=True)
    for bad in ("[]", '{"entities": [1]}', "{"):
        with pytest.raises(ValueError):
            gr.parsed_reply(bad)


def test_relevance_by_name_and_report(spark):
    results = spark.createDataFrame([(1, "s", 10, 1, "Paper.PDF says"), (1, "s", 11, 2, "x" * 120 + "paper.pdf"), (2, "s", 10, 1, "Paper.PDF says")], "query_id bigint, strategy string, chunk_id bigint, rank int, text string")
    truth = spark.createDataFrame([(1, None, "paper.pdf"), (2, 99, "paper.pdf")], "query_id bigint, chunk_id bigint, target_doc string")
    got = {(r.query_id, r.chunk_id): r.rel for r in ev.relevant_by_name(results, truth).collect()}
    assert got == {(1, 10): True, (1, 11): False, (2, 10): False}
    table = spark.range(1).select(F.lit("a|b").alias("strategy"), F.lit(0.5).alias("mrr"))
    assert ev.markdown(table, "Run") == "# Run\n\n| strategy | mrr |\n| --- | --- |\n| a\\|b | 0.5000 |\n"
