"""Mutations, Cypher writes, persistence and file round trips, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.embedding import embed
from ..operators.traversal import shared_dir
from ..sources import files
from ..sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _world(spark, d, path=None):
    """Nations and regions as a writable graph; both tables have a fixed size."""
    from ..graph import Graph

    g = Graph(path, spark)
    regions = table(spark, d, "region").orderBy("r_regionkey").collect()
    nations = table(spark, d, "nation").orderBy("n_nationkey").collect()
    ids = g.add_nodes([{"external_id": f"r{r.r_regionkey}", "labels": ["Region"], "properties": {"name": r.r_name}} for r in regions])
    more = g.add_nodes([{"external_id": f"n{n.n_nationkey}", "labels": ["Nation"], "properties": {"name": n.n_name, "key": n.n_nationkey}} for n in nations])
    at = dict(zip((r.r_regionkey for r in regions), ids, strict=True))
    g.add_edges([{"source": i, "target": at[n.n_regionkey], "edge_type": "IN_REGION", "properties": {"since": n.n_nationkey}} for i, n in zip(more, nations, strict=True)])
    return g


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _names(g):
    df = g.data.node_table()
    return df.select("external_id", F.array_join("labels", ",").alias("labels"), F.col("props")["name"]["s"].alias("name"))


@query("select 'r' || r_regionkey as external_id, 'Region' as labels, r_name as name from region union all select case when n_nationkey = 3 then 'three' else 'n' || n_nationkey end, case when n_nationkey = 3 then 'Place' else 'Nation' end, case when n_nationkey = 3 then null else n_name end from nation")
def crud_update(spark, d):
    g = _world(spark, d)
    g.update_node(g.get_node_id("n3"), external_id="three", add_labels=["Place"], remove_labels=["Nation"], remove_properties=["name"])
    return _names(g)


@query("select n_nationkey as key from nation where n_regionkey <> 2 and n_nationkey <> 5")
def crud_delete_detach(spark, d):
    g = _world(spark, d)
    g.delete_node(g.get_node_id("r2"), detach=True)
    g.delete_edge(g.edges_with_property("since", 5)[0])
    return g.data.edge_table().select(F.col("props")["since"]["i"].cast("int").alias("key"))


@query("select n_name as name, case when n_regionkey = 1 then n_regionkey * 10 end as tier, n_regionkey = 1 as big from nation")
def cy_set(spark, d):
    g = _world(spark, d)
    g.cypher("MATCH (n:Nation)-[:IN_REGION]->(r {external_id: 'r1'}) SET n.tier = 10, n += {seen: true}, n:Big")
    df = g.data.node_scan(("Nation",), ["name", "tier"]).df
    return df.select(F.col("p_name.s").alias("name"), F.col("p_tier.i").cast("int").alias("tier"), F.array_contains("labels", "Big").alias("big"))


@query("select n_name as name, case when n_nationkey < 10 then null else n_nationkey end as key from nation")
def cy_remove(spark, d):
    g = _world(spark, d)
    g.cypher("MATCH (n:Nation) WHERE n.key < 10 REMOVE n.key, n:Nation")
    df = g.data.node_scan((), ["name", "key"]).df.where("external_id like 'n%'")
    return df.select(F.col("p_name.s").alias("name"), F.col("p_key.i").cast("int").alias("key"))


@query("select count(*) as nations, 1 as created, 0 as again from nation")
def cy_merge(spark, d):
    g = _world(spark, d)
    one = g.cypher("MERGE (n:Nation {external_id: 'n99', name: 'NEW'}) RETURN n.name AS name")["summary"]["nodes_created"]
    two = g.cypher("MERGE (n:Nation {name: 'NEW'}) RETURN n.name AS name")["summary"]["nodes_created"]
    n = g.cypher("MATCH (n:Nation) WHERE n.name <> 'NEW' RETURN count(*) AS n")["records"][0]["n"]
    return _rows(spark, [(n, one, two)], "nations long, created int, again int")


@query("select 26::bigint as nations, 1 as edges_made, 25::bigint as after_rollback from nation limit 1")
def cy_create_transaction(spark, d):
    g = _world(spark, d)
    t = g.transaction()
    t.run("CREATE (a:Nation {name: 'X'})-[:NEAR {km: 1.5}]->(b:Sea {name: 'Y'})")
    before = g.cypher("MATCH (n:Nation) RETURN count(n) AS n")["records"][0]["n"]
    t.commit()
    edges = len(g.edges_by_type("NEAR"))
    after = g.cypher("MATCH (n:Nation) RETURN count(n) AS n")["records"][0]["n"]
    return _rows(spark, [(after, edges, before)], "nations long, edges_made int, after_rollback long")


@query("select count(*) as nations, (select count(*) from region) - 1 as regions, (select count(*) from nation where n_regionkey <> 0) as edges from nation")
def cy_delete(spark, d):
    g = _world(spark, d)
    g.cypher("MATCH (r:Region {external_id: 'r0'}) DETACH DELETE r")
    n = {k: len(g.nodes_with_label(k)) for k in ("Nation", "Region")}
    return _rows(spark, [(n["Nation"], n["Region"], g.edge_count())], "nations long, regions long, edges long")


@query("select 'r' || r_regionkey as external_id, 'Region' as labels, r_name as name from region union all select 'n' || n_nationkey, 'Nation', n_name from nation")
def store_round_trip(spark, d):
    """Written through the store and opened again."""
    from ..graph import Graph

    path = _folder(spark, "store")
    _world(spark, d, path)
    return _names(Graph.open(path, spark))


@query("select 'update' as change, count(*) as n from nation where n_nationkey < 3 union all select 'delete', 1 union all select 'insert', 1")
def diff_states(spark, d):
    from ..operators import mutate

    g = _world(spark, d)
    before = g.data
    g.cypher("MATCH (n:Nation) WHERE n.key < 3 SET n.name = 'Z'")
    g.delete_node(g.get_node_id("r4"), detach=True)
    g.add_node("fresh")
    return mutate.diff(before, g.data)["node"].groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("select n_name as name, n_nationkey as key, n_regionkey as region from nation")
def import_csv_roundtrip(spark, d):
    from ..graph import Graph

    path = _folder(spark, "csv")
    nation = table(spark, d, "nation")
    nation.select(F.concat(F.lit("n"), "n_nationkey").alias("external_id"), F.lit("Nation|Place").alias("labels"), F.to_json(F.struct(F.col("n_name").alias("name"))).alias("properties"), F.col("n_nationkey").alias("key")).coalesce(1).write.csv(f"{path}/nodes", header=True, escape='"')
    regions = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("external_id"), F.lit("Region").alias("labels"), F.col("r_regionkey").alias("region"))
    regions.coalesce(1).write.csv(f"{path}/regions", header=True)
    nation.select(F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target"), F.lit("IN_REGION").alias("type")).coalesce(1).write.csv(f"{path}/edges", header=True)
    g = Graph(spark=spark)
    g.import_nodes_csv(f"{path}/nodes")
    g.import_nodes_csv(f"{path}/regions")
    g.import_edges_csv(f"{path}/edges")
    from ..plans import cypher

    df = cypher.read(g.data, "MATCH (n:Place)-[:IN_REGION]->(r:Region) RETURN n.name AS name, n.key AS key, r.region AS region").df
    return df.select(F.col("name.s").alias("name"), F.col("key.i").cast("int").alias("key"), F.col("region.i").cast("int").alias("region"))


@query("select 'n' || n_nationkey as external_id, n_name as name, 'r' || n_regionkey as region from nation")
def export_jsonl_roundtrip(spark, d):
    from ..graph import Graph
    from ..plans import cypher

    path = _folder(spark, "jsonl")
    g = _world(spark, d)
    g.export_nodes_jsonl(f"{path}/nodes")
    g.export_edges_jsonl(f"{path}/edges")
    h = Graph(spark=spark)
    h.import_nodes_jsonl(f"{path}/nodes")
    h.import_edges_jsonl(f"{path}/edges")
    df = cypher.read(h.data, "MATCH (n:Nation)-[e:IN_REGION]->(r) RETURN n.external_id AS external_id, n.name AS name, r.external_id AS region").df
    return df.select(F.col("external_id.s").alias("external_id"), F.col("name.s").alias("name"), F.col("region.s").alias("region"))


@query("select c_mktsegment as segment, count(*) as n from customer group by 1")
def export_query_rows(spark, d):
    path = _folder(spark, "rows")
    df = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))
    files.export_rows(spark, path, df)
    return spark.read.schema("segment string, n long").json(path)


# Lifecycles


@query("select 'n' || n_nationkey as external_id, cast(case when n_nationkey = 4 then 99 else n_nationkey end as double) as x, cast(n_regionkey as double) as y from nation where n_nationkey > 2")
def vector_lifecycle(spark, d):
    """Vectors put in, replaced, taken out by name and with their node, and read back."""
    g = _world(spark, d)
    g.create_vector_index("place", 2, metric="euclidean")
    nations = table(spark, d, "nation").orderBy("n_nationkey").collect()
    ids = {n.n_nationkey: g.get_node_id(f"n{n.n_nationkey}") for n in nations}
    g.upsert_vectors("place", {ids[n.n_nationkey]: [n.n_nationkey, n.n_regionkey] for n in nations})
    g.upsert_vector("place", ids[4], [99.0, next(n.n_regionkey for n in nations if n.n_nationkey == 4)])
    g.delete_vectors("place", [ids[0], ids[1]])
    g.delete_node(ids[2], detach=True)
    assert g.get_vector("place", ids[4])[0] == 99.0
    v = g.data.table("vectors").select(F.col("entity_id").alias("id"), F.col("vector")[0].cast("double").alias("x"), F.col("vector")[1].cast("double").alias("y"))
    return g.data.node_scan().df.join(v, "id").select("external_id", "x", "y")


@query("select 0::bigint as indexes, count(*) as hits from nation where lower(n_name) like '%united%'")
def fulltext_lifecycle(spark, d):
    g = _world(spark, d)
    g.create_fulltext_index("names", ["name"])
    g.rebuild_fulltext_index("names")
    hits = len(g.search_text("names", "united", limit=100))
    g.drop_fulltext_index("names")
    return _rows(spark, [(len(g.fulltext_indexes()), hits)], "indexes long, hits long")


@query("select case when n_nationkey = 5 then null else n_nationkey end as since, case when n_nationkey = 5 then 'new' end as note from nation")
def crud_update_edge(spark, d):
    g = _world(spark, d)
    g.update_edge(g.edges_with_property("since", 5)[0], set_properties={"note": "new"}, remove_properties=["since"])
    return g.data.edge_table().select(F.col("props")["since"]["i"].cast("int").alias("since"), F.col("props")["note"]["s"].alias("note"))


@query("select 'variable' as kind, cast(n_nationkey as bigint) as id, cast(n_regionkey as double) as value from nation union all select 'factor', n_nationkey, n_regionkey + 1.0 from nation where n_nationkey < 4 union all select 'evidence', 0, 1.0 union all select 'trace', 0, 0.5")
def factors_reopened(spark, d):
    """Variables, factor tables, evidence and traces written through the store and opened again."""
    from ..graph import Graph

    g = Graph(_folder(spark, "store"), spark)
    nations = table(spark, d, "nation").orderBy("n_nationkey").collect()
    v = [g.add_variable("binary", prior={"region": n.n_regionkey}) for n in nations]
    for n in nations[:3]:
        g.add_factor_table([v[n.n_nationkey]], [n.n_regionkey + 1.0, 1.0])
    g.add_factor([v[0]], [v[1]], "noisy_or", {"region": nations[3].n_regionkey + 1.0})
    g.add_evidence(v[0], {"state": "true", "weight": 1.0})
    g.add_trace({"score": 0.5})
    h = Graph.open(g.store.path, spark)
    t = lambda name: h.data.table(name)
    number = lambda c, k: F.coalesce(F.col(c)[k]["f"], F.col(c)[k]["i"].cast("double"))
    parts = [
        t("variables").select(F.lit("variable").alias("kind"), "id", number("prior", "region").alias("value")),
        t("factor_tables").select(F.lit("factor"), "factor_id", F.col("values")[0]),
        t("factors").where("function = 'noisy_or'").select(F.lit("factor"), "id", number("parameters", "region")),
        t("evidence").select(F.lit("evidence"), "variable_id", number("payload", "weight")),
        t("traces").select(F.lit("trace"), "id", number("payload", "score")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("select n_name as name, count(*) over () as nations, 0::bigint as late from nation")
def compact_and_snapshot(spark, d):
    """A snapshot keeps its state through later writes and a compaction; a second handle sees them after a refresh."""
    from ..graph import Graph

    path = _folder(spark, "store")
    g = _world(spark, d, path)
    other, seen = Graph.open(path, spark), g.snapshot()
    g.add_node("late", ["Nation"], {"name": "LATE"})
    g.compact()
    other.refresh()
    late = other.node_count() - seen.node_count() - 1
    nations = seen.data.node_scan(("Nation",), ["name"]).df
    return nations.select(F.col("p_name.s").alias("name"), F.lit(nations.count()).alias("nations"), F.lit(late).cast("long").alias("late"))


@query("select operation, count(*) as n from (values ('add_nodes'), ('add_nodes'), ('add_edges'), ('add_trace')) t(operation) group by 1")
def operation_log(spark, d):
    g = _world(spark, d, _folder(spark, "store"))
    g.add_trace({"n": 1})
    return _rows(spark, [(o,) for o in g.operations()], "operation string").groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


@query("select 'r' || r_regionkey as external_id, 'Region' as labels, r_name as name from region union all select 'n' || n_nationkey, 'Nation', n_name from nation")
def backup_restore(spark, d):
    from ..logical import Registry

    r = Registry(spark, _folder(spark, "graphs"))
    target = _folder(spark, "backup")
    _world(spark, d, f"{r.root}/world")
    r.backup("world", target)
    r.open("world").add_node("extra")
    r.restore("world", target, overwrite=True)
    return _names(r.open("world"))


@query("select c_custkey as id, c_nationkey as age, 'c' || (c_custkey % 2) as gender, case when c_custkey + 1 in (select c_custkey from customer) then c_custkey + 1 end as friend from customer")
def pokec_loader(spark, d):
    path = _folder(spark, "users")
    c = table(spark, d, "customer")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    k, age = F.col("c_custkey"), F.col("c_nationkey")
    users = c.select(text("CREATE (:User {id: ", k, ", completion_percentage: 10, gender: \"c", k % 2, "\", age: ", age, "});").alias("value"))
    edges = c.select(text("MATCH (n:User {id: ", k, "}), (m:User {id: ", k + 1, "}) CREATE (n)-[e: Friend]->(m);").alias("value"))
    users.unionAll(edges).write.text(path)
    people, friends = files.pokec(spark, path)
    met = friends.select(F.col("source_id").alias("id"), F.col("target_id").alias("friend"))
    return people.join(met, "id", "left").select("id", F.col("age").cast("int").alias("age"), "gender", "friend")


@query("select 'Q' || n_nationkey as qid, n_name as label, 2::bigint as aliases, 1::bigint as claims from nation")
def wikidata_loader(spark, d):
    """Entities whose records come in two lines each, merged."""
    path = _folder(spark, "entities")
    n = table(spark, d, "nation")
    line = lambda alias, label: F.to_json(F.struct(F.concat(F.lit("Q"), "n_nationkey").alias("qid"), label.alias("label"), F.array(F.lit(alias), F.lit("both")).alias("aliases"), F.array(F.struct(F.lit("P1").alias("property"), F.concat(F.lit("R"), "n_regionkey").alias("target"))).alias("claims")))
    n.select(line("both", F.col("n_name")).alias("value")).unionAll(n.select(line("x", F.lit(None).cast("string")).alias("value"))).write.text(path)
    found = files.wikidata(spark, path)
    return found.select("qid", "label", F.size("aliases").cast("long").alias("aliases"), F.size("claims").cast("long").alias("claims"))


# White space as the chunker sees it, without the separators \x1c to \x1f, which are no white space there.
_BLANK = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(rf"""with c as (select doc_id as key, trim(regexp_replace(coalesce(text, ''), '{_BLANK}', ' ', 'g')) as t from documents),
s as (select key, string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)) as s from c where t <> ''),
p as (select key, string_split(list_reduce(s, lambda acc, x: case when length(regexp_extract(acc, '[^\x01]*$')) + 1 + length(x) <= 900 then acc || ' ' || x else acc || chr(1) || x end), chr(1)) as p from s)
select key, cast(unnest(range(len(p))) as int) as chunk, unnest(p) as text from p""")
def text_chunks(spark, d):
    return files.chunks(table(spark, d, "documents"), "doc_id", "text")


@query()
def hash_embedding(spark, d):
    """Hashed embeddings are checked against brute force in the tests."""
    return embed(table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text")), 64)
