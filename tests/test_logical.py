import pytest

from plexus.functions.embedding import Embedder
from plexus.graph import Graph
from plexus.logical import PROPERTY, LogicalGraph, Registry
from plexus.operators import chunkretrieval


def test_logical_graphs(spark):
    g = Graph(spark=spark)
    a, b = LogicalGraph(g, "a"), LogicalGraph(g, "b")
    x = a.add_nodes([{"external_id": "x", "properties": {"t": "red fish"}}, {"external_id": "y", "properties": {"t": "blue fish"}}])
    z = b.add_nodes([{"external_id": "z", "properties": {"t": "red fish"}}])
    a.add_edges([{"source": x[0], "target": x[1], "edge_type": "T"}])
    with pytest.raises(ValueError, match="is not in logical graph"):
        a.add_edges([{"source": x[0], "target": z[0], "edge_type": "T"}])
    with pytest.raises(ValueError, match="reserved"):
        a.add_nodes([{"properties": {PROPERTY: "b"}}])
    with pytest.raises(ValueError, match="already exists"):
        b.add_nodes([{"external_id": "x"}])
    assert a.query({"match": [{"node": "n"}]}) == [{"n": x[0]}, {"n": x[1]}]
    assert a.query({"match": [{"node": "n"}, {"type": "T"}, {"node": "m"}]}) == [{"n": x[0], "m": x[1]}]
    with pytest.raises(ValueError, match="conflicts"):
        a.query({"match": [{"node": "n", "properties": {PROPERTY: "b"}}]})
    g.create_fulltext_index("t", ["t"])
    assert [r["id"] for r in b.search_text("t", "fish")] == z
    assert a.view().connected_components() == [x]
    assert a.delete() == 2 and g.node_ids() == z and g.edge_count() == 0


def test_registry(spark, tmp_path):
    now = [0.0]
    r = Registry(spark, f"file://{tmp_path}", lambda: now[0])
    r.open("g").add_node("n")
    key = r.snapshot("g", ttl=10)
    r.open("g").add_node("m")
    assert r.get(key).node_count() == 1 and r.open("g").node_count() == 2 and r.names() == ["g"]
    now[0] = 11.0
    with pytest.raises(KeyError, match="expired"):
        r.get(key)
    with pytest.raises(ValueError):
        r.snapshot("g", ttl=1e6)
    r.backup("g", f"file://{tmp_path}/backup")
    r.open("g").add_node("later")
    with pytest.raises(ValueError, match="already exists"):
        r.restore("g", f"file://{tmp_path}/backup")
    with pytest.raises(KeyError, match="not found"):
        r.restore("g", f"file://{tmp_path}/nothing", overwrite=True)
    assert r.restore("g", f"file://{tmp_path}/backup", overwrite=True).node_count() == 2
    assert r.restore("h", f"file://{tmp_path}/backup").node_count() == 2 and r.open("h").add_node("x") == 2


def test_registry_files(spark, tmp_path):
    r = Registry(spark, f"file://{tmp_path}")
    (tmp_path / "imports").mkdir()
    (tmp_path / "imports" / "n.csv").write_text("external_id\na\nb\n")
    assert r.import_nodes("g", "n.csv") == [0, 1]
    r.export_nodes("g", "out/n")
    assert list((tmp_path / "exports" / "out" / "n").glob("part*"))
    for call in (lambda: r.import_nodes("g", "../n.csv"), lambda: r.export_edges("g", "/tmp/x"), lambda: Registry(spark).import_edges("g", "e.csv")):
        with pytest.raises(ValueError):
            call()


def test_chunk_retrieval(spark):
    g = Graph(spark=spark)
    model = Embedder(32)
    texts = ["graph databases store nodes", "cooking pasta with salt"]
    chunks = g.add_nodes([{"labels": ["WikiChunk"], "properties": {"text": t}} for t in texts])
    ents = g.add_nodes([{"external_id": f"Q{i}", "labels": ["WikiEntity"]} for i in range(3)])
    edge = lambda s, t, k: {"source": s, "target": t, "edge_type": k}
    g.add_edges([edge(chunks[0], ents[0], "ABOUT"), edge(ents[1], ents[0], "P31"), edge(ents[1], ents[2], "P31")])
    g.create_vector_index("v", 32)
    g.upsert_vectors("v", {c: model(t).tolist() for c, t in zip(chunks, texts, strict=True)})
    rows = chunkretrieval.retrieve(g.data, g.data.vector["v"], ["graph nodes", "salt"], top_k=1, hops=2).orderBy("query").collect()
    assert [r.id for r in rows] == chunks
    assert rows[0].entity == ents[0] and rows[0].related == [ents[1], ents[2]] and rows[0].text == texts[0]
    assert rows[1].entity is None and rows[1].related == []
