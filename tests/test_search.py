import numpy as np
import pytest

from plexus.functions.embedding import Embedder
from plexus.graph import Graph
from plexus.operators import search
from plexus.queries import QUERIES
from plexus.sources import files


@pytest.fixture
def docs(spark):
    g = Graph(spark=spark)
    guide, notes, target = g.add_nodes(
        [
            {"external_id": "guide", "labels": ["Document"], "properties": {"title": "Graph guide", "content": "Graph  retrieval with Context windows", "published": True}},
            {"external_id": "notes", "labels": ["Document"], "properties": {"title": "Notes", "content": "retrieval notes", "published": False}},
            {"external_id": "target"},
        ]
    )
    g.add_edge(guide, target, "CITES", {"note": "graph evidence"})
    g.create_fulltext_index("docs", ["title", "content"])
    g.create_fulltext_index("cites", ["note"], target="edge")
    g.create_vector_index("vec", 3)
    g.create_vector_index("edges", 2, target="edge", metric="euclidean")
    g.upsert_vectors("vec", {guide: [1.0, 0.0, 0.0], notes: [0.5, 0.5, 0.0]})
    g.upsert_vector("edges", 0, [1.0, 1.0])
    return g


def test_text_modes(docs):
    hit = lambda *a, **k: [r["id"] for r in docs.search_text("docs", *a, **k)]
    top = docs.search_text("docs", "GRAPH retrieval")[0]
    assert top["matched_fields"] == ["title", "content"] and top["score"] == pytest.approx(1.0) and top["kind"] == "node"
    assert hit("graph retrieval") == [0]
    assert hit("graph retrieval", mode="any") == [0, 1]
    assert hit("graph retrieval", mode="phrase") == [0]
    assert hit("contex", mode="prefix") == [0]
    assert hit("retrieval", mode="any", offset=1) == [1]
    assert hit("retrieval", properties={"published": False}) == [1]
    assert hit("retrieval", labels=["Nope"]) == []
    assert docs.search_text("cites", "evidence", edge_type="CITES")[0]["kind"] == "edge"
    assert docs.snapshot().search_text("docs", "notes")[0]["id"] == 1


@pytest.mark.parametrize(
    "call, text",
    [
        (lambda g: g.search_text("docs", " "), "cannot be empty"),
        (lambda g: g.search_text("docs", "x", mode="fuzzy"), "mode"),
        (lambda g: g.search_text("docs", "x", limit=0), "limit"),
        (lambda g: g.search_text("docs", "x", edge_type="T"), "edge_type cannot be used with a node full-text index"),
        (lambda g: g.search_text("cites", "x", labels=["L"]), "labels cannot be used with an edge full-text index"),
        (lambda g: g.create_fulltext_index("docs", ["a"]), "already exists"),
        (lambda g: g.create_vector_index("vec", 3), "already exists"),
        (lambda g: g.search_vector("vec", [1.0]), "dimensions must be"),
        (lambda g: g.search_vector("vec", [0.0, 0.0, 0.0]), "cannot be zero for cosine"),
        (lambda g: g.search_vectors("vec", [[1.0, 0, 0], [float("nan"), 0, 0]]), "query vector at index 1 values must be finite"),
        (lambda g: g.create_vector_index("w", 0), "dimensions must be"),
        (lambda g: g.create_vector_index("w", 2, model_version="1"), "model_version requires model"),
    ],
)
def test_errors(docs, call, text):
    with pytest.raises(ValueError, match=text):
        call(docs)


def test_trigram(spark):
    g = Graph(spark=spark)
    n = g.add_node(properties={"content": "轻量图数据库与检索"})
    g.create_fulltext_index("zh", ["content"], tokenizer="trigram")
    assert [r["id"] for r in g.search_text("zh", "图数据")] == [n]
    with pytest.raises(ValueError, match="must contain at least 3 characters"):
        g.search_text("zh", "图数")
    with pytest.raises(ValueError, match="prefix mode is only supported"):
        g.search_text("zh", "图数据", mode="prefix")


def test_vectors(docs):
    assert [(r["id"], r["score"]) for r in docs.search_vector("vec", [1.0, 0.0, 0.0])] == [(0, 1.0), (1, pytest.approx(0.7071067811))]
    assert docs.search_vector("edges", [1.0, 1.0])[0]["score"] == 1.0
    batch = docs.search_vectors("vec", [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]], limit=1)
    assert [[r["id"] for r in b] for b in batch] == [[0], [1]]
    assert docs.search_vector("vec", [1.0, 0.0, 0.0], min_score=0.9)[0]["id"] == 0
    docs.delete_vector("vec", 0)
    docs.delete_vector("vec", 0)
    assert [r["id"] for r in docs.search_vector("vec", [1.0, 0.0, 0.0])] == [1]
    docs.delete_node(1)
    assert docs.search_vector("vec", [1.0, 0.0, 0.0]) == []
    with pytest.raises(KeyError):
        docs.get_vector("vec", 2)


def test_batch_equals_single(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8)]) for i in range(300)]
    rows = [(i, v) for i, v in rows if any(v)]
    df = spark.createDataFrame(rows, "id long, vector array<float>").repartition(4)
    queries = [rows[0][1], rows[5][1]]
    for metric in search.METRICS:
        best = search.scored(df, queries, metric, keep=7).collect()
        for q, query in enumerate(queries):
            mine = sorted(((-round(r.score, 9), r.id) for r in best if r["query"] == q))[:7]
            every = df.select("id", search.similarity(df.vector, query, metric).alias("s")).collect()
            assert mine == sorted((-round(r.s, 9), r.id) for r in every)[:7]


def test_retrieve_context(docs):
    rows = docs.retrieve_context(text_query="graph", text_index="docs", vector_query=[1.0, 0.0, 0.0], vector_index="vec", radius=1)
    first = rows[0]
    assert first["id"] == 0 and first["distance"] == 0 and first["source_scores"] == {"text": pytest.approx(1.0), "vector": pytest.approx(1.0)}
    assert first["score"] == pytest.approx(1.0 + 0.1 + 1.0 + 0.1)
    near = next(r for r in rows if r["id"] == 2)
    assert near["distance"] == 1 and near["score"] == pytest.approx(1.0 + 0.05 + 1.0 + 0.05)
    assert first["record"]["external_id"] == "guide"
    assert docs.retrieve_context() == []
    with pytest.raises(ValueError, match="together"):
        docs.retrieve_context(text_query="x")


def test_chunks_match_plain_python(spark):
    texts = ["", "One. Two!  Three?", "A" * 50 + ". b. " + "c" * 95, None, "no end " * 40, "x. " * 100]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {}
    for r in files.chunks(df, "k", "t", 100).orderBy("key", "chunk").collect():
        got.setdefault(r.key, []).append(r.text)
    assert got == {i: c for i, t in enumerate(texts) if (c := files.split_text(t, 100))}


def test_hash_embedding():
    e = Embedder(32)
    a, b = e("Graph search"), e("graph  SEARCH!")
    assert np.allclose(a, b) and np.isclose(a @ a, 1.0)
    assert e("")[0] == 1.0 and not e("")[1:].any()
    assert not np.allclose(a, e("other words"))


def test_line_loaders(spark, tmp_path):
    (tmp_path / "p.txt").write_text('CREATE (:User {id: 1, completion_percentage: 14, gender: "man", age: 26});\nCREATE (:User {id: 2, completion_percentage: 5, gender: "woman", age: 30});\nMATCH (n:User {id: 1}), (m:User {id: 9}) CREATE (n)-[e: Friend]->(m);\nMATCH (n:User {id: 1}), (m:User {id: 2}) CREATE (n)-[e: Friend]->(m);\n')
    users, friends = files.pokec(spark, f"file://{tmp_path}/p.txt")
    assert tuple(users.first()) == (1, 14, 26, "man") and [tuple(r) for r in friends.collect()] == [(1, 2)]
    users, friends = files.pokec(spark, f"file://{tmp_path}/p.txt", max_nodes=1, max_edges=5)
    assert users.count() == 1 and friends.count() == 0
    (tmp_path / "w.jsonl").write_text('{"qid":"Q1","label":"a","aliases":["x"]}\n{"qid":"Q1","aliases":["x","y"],"claims":[{"property":"P1","target":"Q2"}]}\n')
    row = files.wikidata(spark, f"file://{tmp_path}/w.jsonl").first()
    assert row.label == "a" and sorted(row.aliases) == ["x", "y"] and row.claims[0].target == "Q2"


def test_streaming_ingest(spark, tmp_path):
    from plexus.model import GraphData
    from plexus.operators.traversal import neighbors
    from plexus.streaming import ingest

    source = f"file://{tmp_path}/in"
    rows = spark.createDataFrame([(0, 1, 2), (1, 1, 3), (2, 2, 3)], "id long, src long, dst long")
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    ingest.append_edges(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination(120)
    g = GraphData(spark, (), (ingest.edge_source(spark, f"file://{tmp_path}/out", "E", {}),))
    assert [r.node for r in neighbors(g, 1).orderBy("position").collect()] == [2, 3]


def test_vector_search_without_limit(docs, spark, sf):
    index = docs.data.vector["vec"]
    assert [r.id for r in search.search_vector(docs.data, index, [1.0, 0.0, 0.0], min_score=0.1, limit=None).collect()] == [0, 1]
    assert [r.id for r in search.search_vector(docs.data, index, [1.0, 0.0, 0.0], limit=None, offset=1).collect()] == [1]
    plan = QUERIES["vec_min_score"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan


def test_search_each_equals_single_searches(docs, spark):
    queries = spark.createDataFrame([(5, [1.0, 0.2, 0.0]), (9, [0.0, 1.0, 0.5])], "query long, vector array<double>")
    index = docs.data.vector["vec"]
    got = {}
    for r in search.search_each(docs.data, index, queries, limit=3, offset=1).orderBy("query", "position").collect():
        got.setdefault(r["query"], []).append((r.id, round(r.score, 9)))
    for k, v in ((5, [1.0, 0.2, 0.0]), (9, [0.0, 1.0, 0.5])):
        assert got.get(k, []) == [(r.id, round(r.score, 9)) for r in search.search_vector(docs.data, index, v, limit=3, offset=1).collect()]
    short = spark.createDataFrame([(1, [1.0])], "query long, vector array<double>")
    with pytest.raises(Exception, match="query vector dimensions must be 3, not 1"):
        search.search_each(docs.data, index, short).collect()


def test_word_table_gives_the_same(spark):
    from plexus.graph import Graph

    g = Graph(spark=spark)
    texts = ["Graph memory, graphs", "memory of a graph_x", "a b", "\x1cgraph é memory", None]
    g.add_nodes([{"labels": ["D"], "properties": {"t": t or "", "u": "memory" if i == 2 else "z"}} for i, t in enumerate(texts)])
    g.create_fulltext_index("i", ["t", "u"])
    asked = [("graph memory", "all"), ("graph a", "any"), ("gra mem", "prefix"), ("g m", "prefix"), ("memory of", "phrase")]
    plain = [g.search_text("i", q, m) for q, m in asked]
    g.rebuild_fulltext_index()
    assert g._tokens("i") is not None and [g.search_text("i", q, m) for q, m in asked] == plain
    assert any(plain)
    assert g.search_text("i", "memory", labels=["D"], properties={"u": "memory"}) == [x for x in g.search_text("i", "memory") if x["id"] == 2]
    g.add_node(labels=["D"], properties={"t": "graph memory"})
    assert g._tokens("i") is None and len(g.search_text("i", "graph memory")) == len(plain[0]) + 1


def test_filters_of_the_wrong_kind_are_errors(docs):
    from plexus.operators.search import retrieve_context

    with pytest.raises(ValueError, match="edge_type cannot be used with a node"):
        retrieve_context(docs.data, text_query="graph", text_index=next(iter(docs.data.fulltext.values())), edge_type="X")


def test_query_normaliser_keeps_separator_controls(spark):
    from pyspark.sql import functions as F

    texts = ["a\x1cB", " \x1d x\u3000y ", "A\u00a0b", "\x1f"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(search.normalize(F.col("t"))).collect()
    assert [r[0] for r in got] == [search.normalize_python(t) for t in texts]
