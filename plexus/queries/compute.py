"""Traversal, algorithms, search, retrieval and inference queries, with their SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.values import strict_predicate
from ..model import subscript
from ..operators import algorithms, inference, search, traversal
from ..sources.tables import LABELS as L
from ..sources.tables import TYPES as T
from ..sources.tables import geography, graph, library, space, table
from .patterns import EDGES_SQL, GEO_EDGES_SQL

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def one(spark, node):
    return spark.createDataFrame([(node,)], "start long")


# Neighbours: the first edge of a pair, out before in, by edge id

BOTH = f"with e as ({EDGES_SQL}), a as (select src as node, dst as nbr, 0 as dir, id from e union all select dst, src, 1, id from e), d as (select node, nbr, min(dir * 1e15::bigint + id) as k from a where %s group by node, nbr)"


def _neighbors(direction):
    test = {"out": "dir = 0", "in": "dir = 1", "both": "true"}[direction]
    sql = BOTH % test + f" select nbr as node, cast(row_number() over (order by k, nbr) - 1 as bigint) as position from d where node = %d"

    def run(node):
        return sql % node

    return run


@query(_neighbors("out")(7 + L["Customer"]))
def neighbors_out(spark, d):
    return traversal.neighbors(graph(spark, d), 7 + L["Customer"], "out").select("node", F.col("position").cast("long").alias("position"))


@query(_neighbors("in")(3 + L["Nation"]))
def neighbors_in(spark, d):
    return traversal.neighbors(graph(spark, d), 3 + L["Nation"], "in").select("node", F.col("position").cast("long").alias("position"))


@query(_neighbors("both")(5 + L["Supplier"]))
def neighbors_both(spark, d):
    return traversal.neighbors(graph(spark, d), 5 + L["Supplier"], "both").select("node", F.col("position").cast("long").alias("position"))


def reach_sql(edges, start, depth, direction):
    a = {"out": "select src as a, dst as b from e", "in": "select dst as a, src as b from e", "both": "select src as a, dst as b from e union all select dst, src from e"}[direction]
    return f"""with recursive e as ({edges}), adj as (select distinct a, b from ({a})), r(node, depth) as (
  select {start}::bigint, 0 union select adj.b, r.depth + 1 from r join adj on adj.a = r.node where r.depth < {depth})
select node, cast(min(depth) as int) as depth from r group by node"""


@query(f"select node, depth from ({reach_sql(EDGES_SQL, 2 + L['Supplier'], 2, 'both')}) where depth > 0")
def k_hop(spark, d):
    return traversal.k_hop(graph(spark, d), one(spark, 2 + L["Supplier"]), 2, "both").select("node", "depth")


@query(f"select node from ({reach_sql(GEO_EDGES_SQL, 1 + L['Region'], 2, 'in')}) where depth = 2")
def frontier(spark, d):
    return traversal.frontier(geography(spark, d), [1 + L["Region"]], 2, "in").select("node")


@query(reach_sql(GEO_EDGES_SQL, 1 + L["Region"], 4, "in"))
def bfs_levels(spark, d):
    return traversal.bfs(geography(spark, d), one(spark, 1 + L["Region"]), "in").select("node", "depth")


@query(f"""with n as (select n_nationkey + {L['Nation']} as node, n_nationkey + {T['IN_REGION']} as e from nation where n_regionkey = 1),
p as (select node, row_number() over (order by e) as p from n),
c as (select c_custkey + {L['Customer']} as node, c_nationkey + {L['Nation']} as up, c_custkey + {T['IN_NATION']} as e from customer union all select s_suppkey + {L['Supplier']}, s_nationkey + {L['Nation']}, s_suppkey + {T['SUPPLIER_IN_NATION']} from supplier),
o as (select {1 + L['Region']}::bigint as node, 0 as k, 0::bigint as a, 0::bigint as b union all select node, 1, p, 0 from p union all select c.node, 2, p.p, c.e from c join p on c.up = p.node)
select node, cast(row_number() over (order by k, a, b) - 1 as bigint) as position from o""")
def bfs_order(spark, d):
    return traversal.bfs(geography(spark, d), one(spark, 1 + L["Region"]), "in").select("node", F.col("position").cast("long").alias("position"))


@query(f"select 0::bigint as position, 7 + {L['Customer']} as node, 2.0::double as distance union all select 1, c_nationkey + {L['Nation']}, 2.0 from customer where c_custkey = 7 union all select 2, n_regionkey + {L['Region']}, 2.0 from customer join nation on c_nationkey = n_nationkey where c_custkey = 7")
def sp_unweighted(spark, d):
    region = table(spark, d, "customer").where("c_custkey = 7").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first().n_regionkey
    found = algorithms.shortest_path(geography(spark, d), 7 + L["Customer"], region + L["Region"])
    return spark.createDataFrame([(i, n, found["distance"]) for i, n in enumerate(found["nodes"])], "position long, node long, distance double")


@query(f"""with o as (select min(l_orderkey) as k from lineitem),
f as (select l_partkey, arg_min(l_extendedprice, l_linenumber) as w from lineitem, o where l_orderkey = o.k group by l_partkey),
p as (select l_partkey + {L['Part']} as node, w as dist from f),
s as (select l_suppkey + {L['Supplier']} as node, min(dist + 1.0) as dist from p join lineitem on p.node = l_partkey + {L['Part']} group by 1),
n as (select s_nationkey + {L['Nation']} as node, min(dist + 1.0) as dist from s join supplier on s.node = s_suppkey + {L['Supplier']} group by 1),
r as (select n_regionkey + {L['Region']} as node, min(dist + 1.0) as dist from n join nation on n.node = n_nationkey + {L['Nation']} group by 1)
select k + {L['Order']} as node, 0.0::double as dist from o union all select node, round(dist, 6) from p union all select node, round(dist, 6) from s union all select node, round(dist, 6) from n union all select node, round(dist, 6) from r""")
def sp_weighted(spark, d):
    """Distances from one order, each pair's first edge giving the weight."""
    start = table(spark, d, "lineitem").agg(F.min("l_orderkey")).first()[0]
    best = algorithms.distances(graph(spark, d), start + L["Order"], "out", None, "price")
    return best.select("node", F.round("dist", 6).alias("dist"))


@query(f"""select r_regionkey + {L['Region']} as node, r_regionkey + {L['Region']} as component from region
union all select n_nationkey + {L['Nation']}, n_regionkey + {L['Region']} from nation
union all select c_custkey + {L['Customer']}, n_regionkey + {L['Region']} from customer join nation on c_nationkey = n_nationkey
union all select s_suppkey + {L['Supplier']}, n_regionkey + {L['Region']} from supplier join nation on s_nationkey = n_nationkey""")
def components(spark, d):
    return algorithms.component_labels(geography(spark, d))


@query(f"""with g as (select n_nationkey + {L['Nation']} as c, n_nationkey as k from nation)
select r_regionkey + {L['Region']} as component, r_regionkey + {L['Region']} as node, 0::bigint as position from region
union all select c, c, 0 from g
union all select n_nationkey + {L['Nation']}, x.node, cast(row_number() over (partition by n_nationkey order by e) as bigint) from nation join (
  select c_nationkey as k, c_custkey + {L['Customer']} as node, c_custkey + {T['IN_NATION']} as e from customer
  union all select s_nationkey, s_suppkey + {L['Supplier']}, s_suppkey + {T['SUPPLIER_IN_NATION']} from supplier) x on x.k = n_nationkey""")
def components_ordered(spark, d):
    return algorithms.connected_components(geography(spark, d), "IN_NATION").select("component", "node", F.col("position").cast("long").alias("position"))


def pagerank_sql(edges, nodes, iterations, damping):
    """Power iterations written out one after the other."""
    steps = [f"with e as (select distinct src, dst from ({edges})), v as ({nodes}), n as (select count(*)::double as n from v), g as (select src, count(*)::double as k from e group by src), l as (select e.src, dst, k from e join g on g.src = e.src), r0 as (select id, 1.0 / n as r from v, n)"]
    for i in range(iterations):
        steps.append(
            f"s{i} as materialized (select coalesce(sum(r), 0.0) as s from r{i} where id not in (select src from g)), c{i} as (select dst, sum(r / k) as c from l join r{i} on id = src group by dst), "
            f"r{i + 1} as materialized (select id, (1.0 - {damping}) / n + {damping} * s / n + {damping} * coalesce(c, 0.0) as r from r{i} join n on true join s{i} on true left join c{i} on dst = id)"
        )
    return ", ".join(steps) + f" select id as node, round(r, 9) as rank from r{iterations}"


GEO_NODES = f"select r_regionkey + {L['Region']} as id from region union all select n_nationkey + {L['Nation']} from nation union all select c_custkey + {L['Customer']} from customer union all select s_suppkey + {L['Supplier']} from supplier"


@query(pagerank_sql(GEO_EDGES_SQL, GEO_NODES, 8, 0.85))
def pagerank(spark, d):
    return algorithms.pagerank(geography(spark, d), iterations=8).select("node", F.round("rank", 9).alias("rank"))


@query(pagerank_sql(f"select * from ({GEO_EDGES_SQL}) where edge_type = 'IN_NATION'", GEO_NODES, 4, 0.5))
def pagerank_typed(spark, d):
    return algorithms.pagerank(geography(spark, d), iterations=4, damping=0.5, edge_type="IN_NATION").select("node", F.round("rank", 9).alias("rank"))


def walk_sql(edges, steps):
    """Walks with the 64-bit generator written out in 128-bit integers."""
    top = "18446744073709551616::hugeint"
    step = f"(state * 6364136223846793005::hugeint + 1442695040888963407::hugeint) % {top}"
    return f"""with recursive e as ({edges}), a as (select src as node, dst as nbr, 0 as dir, id from e union all select dst, src, 1, id from e),
f as (select node, nbr, min(dir * 1000000000000000::hugeint + id) as k from a group by node, nbr),
n as (select node, nbr, row_number() over (partition by node order by k, nbr) - 1 as place from f), g as (select node, count(*)::hugeint as degree from n group by node),
w(walk, step, node, state) as (select c_custkey, 0, c_custkey + {L['Customer']}, c_custkey::hugeint from customer
  union all select s.walk, s.step + 1, n.nbr, s.state from (select w.walk, w.step, w.node, {step.replace('state', 'w.state')} as state from w where w.step < {steps}) s join g on g.node = s.node
  join n on n.node = s.node and n.place = xor(s.state, s.state >> 33) % g.degree)
select walk, step, node from w"""


@query(walk_sql(EDGES_SQL, 3))
def random_walk(spark, d):
    """Walks from every customer."""
    starts = table(spark, d, "customer").select(F.col("c_custkey").alias("walk"), (F.col("c_custkey") + L["Customer"]).alias("node"), F.col("c_custkey").alias("seed"))
    return algorithms.random_walks(graph(spark, d), starts, 3, "both")


@query(f"select id, edge_type from ({EDGES_SQL}) where src in (select id from s) and dst in (select id from s)".replace("select id, edge_type", f"with s as (select n_nationkey + {L['Nation']} as id from nation where n_nationkey < 8 union all select c_custkey + {L['Customer']} from customer union all select r_regionkey + {L['Region']} from region) select id, edge_type", 1))
def subgraph(spark, d):
    g = graph(spark, d)
    nat = g.node_scan(("Nation",), ["nationkey"]).df.where("p_nationkey < 8").select("id")
    ids = nat.unionAll(g.node_scan(("Customer",)).df.select("id")).unionAll(g.node_scan(("Region",)).df.select("id"))
    return algorithms.subgraph(g, ids).edge_scan().df.select("id", "edge_type")


@query(f"select 'bfs' as op, count(*) as n from customer where c_nationkey = 4 union all select 'components', count(*) from region")
def compute_batch(spark, d):
    from ..graph import Snapshot

    g = Snapshot(geography(spark, d))
    out = g.compute_batch([{"op": "bfs", "start": 4 + L["Nation"], "direction": "in", "max_depth": 1}, {"op": "connected_components"}])
    customers = [n for n in out[0] if L["Customer"] <= n < L["Supplier"]]
    return spark.createDataFrame([("bfs", len(customers)), ("components", len(out[1]))], "op string, n long")


@query(f"with s as (select min(o_orderkey) as a, max(o_orderkey) as b from orders), m as (select a as k, 1.0 as m from s union all select b, 0.5 from s) select k + {L['Order']} as node, round(m, 9) as score from m union all select l_partkey + {L['Part']}, round(sum(m * l_discount), 9) from m join lineitem on l_orderkey = k where l_discount > 0 group by 1")
def propagate(spark, d):
    lo, hi = table(spark, d, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    return traversal.propagate(graph(spark, d), {lo + L["Order"]: 1.0, hi + L["Order"]: 0.5}, 2, "discount", 1.0, "CONTAINS").select("node", F.round("score", 9).alias("score"))


@query(f"with s as (select min(o_orderkey) as k from orders) select k + {L['Order']} as node, 2.0::double as score from s union all select l_partkey + {L['Part']}, round(sum(2.0 * l_discount * 0.5), 9) from s join lineitem on l_orderkey = k group by 1")
def local_propagate(spark, d):
    lo = table(spark, d, "orders").agg(F.min("o_orderkey")).first()[0]
    g = graph(spark, d, ("Order", "Part"), ("CONTAINS",))
    return traversal.local_propagate(g, {lo + L["Order"]: 2.0}, 1, None, "CONTAINS", "discount", 0.5).select("node", F.round("score", 9).alias("score"))


# Full text

TEXT = r"trim(regexp_replace(lower(%s), '\s+', ' ', 'g'))"
WORDS = r"regexp_extract_all(" + TEXT + r", '[\p{L}\p{N}_]+')"


def ft_sql(units, mode, fields=("text", "source"), where="true", kind="words"):
    hit = []
    for f in fields:
        if kind == "contains":
            hit.append([f"contains({TEXT % f}, '{u}')" for u in units])
        elif kind == "prefix":
            hit.append([f"len(list_filter({WORDS % f}, lambda x: starts_with(x, '{u}'))) > 0" for u in units])
        else:
            hit.append([f"list_contains({WORDS % f}, '{u}')" for u in units])
    cols = ", ".join(f"({h})::int as h{i}_{k}" for i, row in enumerate(hit) for k, h in enumerate(row))
    n_units = " + ".join("greatest(" + ", ".join(f"h{i}_{k}" for i in range(len(fields))) + ")" for k in range(len(units)))
    n_fields = " + ".join("greatest(" + ", ".join(f"h{i}_{k}" for k in range(len(units))) + ", 0)" for i in range(len(fields)))
    names = " || ".join(f"case when greatest({', '.join(f'h{i}_{k}' for k in range(len(units)))}, 0) = 1 then '{f},' else '' end" for i, f in enumerate(fields))
    test = f"u = {len(units)}" if mode == "all" else "u > 0"
    return f"""with h as (select doc_id + {L['Document']} as id, {cols} from documents where {where}), s as (select id, {n_units} as u, {n_fields} as f, {names} as matched from h)
select id, round(0.8 * u / {len(units)} + 0.2 * f / {len(fields)}, 9) as score, matched from s where {test}"""


def _ft(spark, d, text, mode, index="docs", **options):
    g = library(spark, d)
    options.setdefault("limit", None)
    found = search.search_text(g, g.fulltext[index], text, mode, **options)
    names = F.array_join(F.transform("matched_fields", lambda x: F.concat(x, F.lit(","))), "")
    return found.select("id", F.round("score", 9).alias("score"), names.alias("matched"))


@query(ft_sql(["the", "and", "thtion"], "all"))
def ft_all(spark, d):
    return _ft(spark, d, "  The AND\tthtion the", "all")


@query(ft_sql(["une", "src3", "heed"], "any"))
def ft_any(spark, d):
    return _ft(spark, d, "une src3 heed", "any")


def _tokens(spark, d):
    g = library(spark, d)
    return search.token_table(g, g.fulltext["docs"], f"{traversal.shared_dir(spark)}/tokens-{uuid.uuid4().hex}")


@query(ft_sql(["the", "and", "thtion"], "all"))
def ft_index_all(spark, d):
    """The same search through the index's written table of words."""
    return _ft(spark, d, "  The AND\tthtion the", "all", tokens=_tokens(spark, d))


@query(ft_sql(["onn", "src1"], "all", kind="prefix"))
def ft_index_prefix(spark, d):
    return _ft(spark, d, "onn src1", "prefix", tokens=_tokens(spark, d))


@query(ft_sql(["of the"], "all", kind="contains"))
def ft_phrase(spark, d):
    return _ft(spark, d, "of  the", "phrase")


@query(ft_sql(["onn", "src1"], "all", kind="prefix"))
def ft_prefix(spark, d):
    return _ft(spark, d, "onn src1", "prefix")


@query(ft_sql(["thti", "and"], "all", ("text",), kind="contains"))
def ft_trigram(spark, d):
    return _ft(spark, d, "thti and", "all", "grams")


@query(f"select id, score, matched, row_number() over (order by score desc, id) as place from (select * from ({ft_sql(['la', 'the'], 'any', where=chr(108) + chr(97) + 'ng = ' + chr(39) + 'en' + chr(39))}) order by score desc, id limit 15 offset 5)")
def ft_filters_paging(spark, d):
    found = _ft(spark, d, "la the", "any", labels=["Document"], properties={"lang": "en"}, limit=15, offset=5)
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


# Vectors


def _query_vector(spark, d, key):
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == key).first().embedding)


def score_sql(metric, a="q", b="v"):
    dot = f"list_dot_product({a}, {b})"
    if metric == "dot":
        return dot
    if metric == "euclidean":
        return f"1.0 / (1.0 + list_distance({a}, {b}))"
    return f"{dot} / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


def vector_sql(metric, where="true", tail="order by score desc, id limit 20", more="true"):
    return f"""with q as (select embedding::double[] as q from embeddings where vec_id = 11), v as (select vec_id + {L['Embedding']} as id, embedding::double[] as v from embeddings where {where}),
s as (select id, {score_sql(metric)} as score from q, v) select id, round(score, 7) as score from (select * from s where {more} {tail})"""


def _vec(spark, d, metric, **options):
    g = space(spark, d)
    return search.search_vector(g, g.vector[metric], _query_vector(spark, d, 11), **options).select("id", F.round("score", 7).alias("score"))


@query(vector_sql("cosine"))
def vec_cosine(spark, d):
    return _vec(spark, d, "cosine")


@query(vector_sql("dot"))
def vec_dot(spark, d):
    return _vec(spark, d, "dot")


@query(vector_sql("euclidean"))
def vec_euclidean(spark, d):
    return _vec(spark, d, "euclidean")


@query(vector_sql("cosine", tail="", more="score >= 0.1"))
def vec_min_score(spark, d):
    return _vec(spark, d, "cosine", min_score=0.1, limit=None)


@query(vector_sql("cosine", "label = 3", "order by score desc, id limit 10 offset 2"))
def vec_filters(spark, d):
    return _vec(spark, d, "cosine", labels=["Embedding"], properties={"label": 3}, limit=10, offset=2)


@query(f"""with q as (select vec_id as query, embedding::double[] as q from embeddings where vec_id % 20 = 0), v as (select vec_id + {L['Embedding']} as id, embedding::double[] as v from embeddings),
s as (select query, id, {score_sql('cosine')} as score from q, v), r as (select *, row_number() over (partition by query order by score desc, id) - 1 as position from s)
select query, cast(position as int) as position, id, round(score, 7) as score from r where position < 10""")
def vec_batch(spark, d):
    """Every vector whose id is divisible by 20 as a query, against all vectors."""
    g = space(spark, d)
    queries = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    found = search.search_each(g, g.vector["cosine"], queries, limit=10)
    return found.select("query", "position", "id", F.round("score", 7).alias("score"))


# Retrieval


def _retrieve_sql():
    base = ft_sql(["the", "erst"], "all")
    return f"""with c as (select id, score from ({base}) order by score desc, id limit 80),
e as (select doc_id + {L['Document']} as a, doc_id + 1 + {L['Document']} as b from documents where doc_id + 1 in (select doc_id from documents)),
adj as (select a, b from e union select b, a from e),
x as (select id, score as s, score * 1.0 + 0.1 as add, 0 as distance from c union all select adj.b, c.score, c.score * 1.0 + 0.05, 1 from c join adj on adj.a = c.id)
select 'node' as kind, id, round(sum(add), 7) as score, min(distance) as distance, round(max(s), 7) as text_score from x group by id order by sum(add) desc, min(distance), id limit 20"""


@query(_retrieve_sql())
def retrieve_context(spark, d):
    g = library(spark, d)
    found = search.retrieve_context(g, text_query="the erst", text_index=g.fulltext["docs"])
    return found.select("kind", "id", F.round("score", 7).alias("score"), "distance", F.round("text_score", 7).alias("text_score"))


# Inference


def _network(spark, d, child_states=("false", "true"), cpd=(0.9, 0.1, 0.2, 0.8)):
    """A chain whose prior is the share of finished orders."""
    from ..graph import Graph

    p = table(spark, d, "orders").agg(F.avg((F.col("o_orderstatus") == "F").cast("double"))).first()[0]
    g = Graph(spark=spark)
    a = g.add_variable("binary", prior={"p": p})
    b = g.add_variable("weather", states=list(child_states))
    g.add_cpd(b, [a], list(cpd))
    return g, a, b


def _beliefs(spark, out):
    rows = [(v, s, round(p, 6)) for v, b in out["beliefs"].items() for s, p in b.items()]
    return spark.createDataFrame(rows, "variable long, state string, belief double")


SHARE = "with t as (select avg((o_orderstatus = 'F')::int::double) as p from orders)"


@query(f"{SHARE} select 0::bigint as variable, 'false' as state, round(1 - p, 6) as belief from t union all select 0, 'true', round(p, 6) from t union all select 1, 'false', round((1 - p) * 0.9 + p * 0.2, 6) from t union all select 1, 'true', round((1 - p) * 0.1 + p * 0.8, 6) from t")
def bp_chain(spark, d):
    g, a, b = _network(spark, d)
    return _beliefs(spark, g.belief_propagation([a, b], tolerance=1e-12, damping=0.0))


@query(f"{SHARE} select 0::bigint as variable, 'false' as state, round((1 - p) * 0.2 / ((1 - p) * 0.2 + p * 0.3), 6) as belief from t union all select 0, 'true', round(p * 0.3 / ((1 - p) * 0.2 + p * 0.3), 6) from t union all select 1, 'sun', 0.0 union all select 1, 'rain', 1.0 union all select 1, 'snow', 0.0")
def bp_categorical(spark, d):
    g, a, b = _network(spark, d, ("sun", "rain", "snow"), (0.7, 0.2, 0.1, 0.1, 0.3, 0.6))
    return _beliefs(spark, g.belief_propagation([a, b], {b: "rain"}, tolerance=1e-12, damping=0.0))


@query("with t as (select c_mktsegment as s, count(*)::double as n from customer group by 1), p as (select s, n / sum(n) over () as p from t) select s as state, round(p, 6) as belief from p")
def posterior_prior(spark, d):
    """A prior by state, here the customers of each segment, normalised."""
    from ..graph import Graph

    rows = table(spark, d, "customer").groupBy("c_mktsegment").count().orderBy("c_mktsegment").collect()
    g = Graph(spark=spark)
    v = g.add_variable("segment", states=[r[0] for r in rows], prior={r[0]: r[1] for r in rows})
    return spark.createDataFrame([(s, round(p, 6)) for s, p in g.posterior(v).items()], "state string, belief double")


@query("select 'variables' as part, 0::bigint as id union all select 'variables', 1 union all select 'variables', 2 union all select 'factors', 0 union all select 'nodes', 0 union all select 'nodes', 1 union all select 'boundary', 2")
def active_subgraph(spark, d):
    from ..graph import Graph

    g = Graph(spark=spark)
    n = g.add_nodes([{"external_id": x} for x in "abc"])
    g.add_edges([{"source": n[0], "target": n[1], "edge_type": "P"}, {"source": n[1], "target": n[2], "edge_type": "P"}])
    v = [g.add_variable("binary", owner_id=x) for x in n]
    g.add_factor_table([v[1], v[2]], [1.0, 2.0, 2.0, 1.0])
    a = g.compile_active_subgraph([v[0]], radius=1, max_nodes=2)
    rows = [(k, i) for k, ids in (("variables", a["variables"]), ("factors", a["factors"]), ("nodes", a["graph_nodes"]), ("boundary", a["boundary_variables"])) for i in ids]
    return spark.createDataFrame(rows, "part string, id long")


FLOOD = "with p as (select s_suppkey as v, 0.1 + 0.8 * s_nationkey / 25.0 as p from supplier)"


@query(f"{FLOOD}, j as (select a.v as a, a.p as pa, b.p as pb from p a join p b on b.v = a.v + 1 where a.v % 2 = 0) select a as variable, round(pa * (2 * pb + (1 - pb)) / (pa * (2 * pb + (1 - pb)) + (1 - pa) * (pb + 2 * (1 - pb))), 6) as belief from j union all select a + 1, round(pb * (2 * pa + (1 - pa)) / (pb * (2 * pa + (1 - pa)) + (1 - pb) * (pa + 2 * (1 - pa))), 6) from j")
def bp_flooding(spark, d):
    """Pairs of suppliers as two-variable factor graphs, all at once."""
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("variable"), (0.1 + 0.8 * F.col("s_nationkey") / 25.0).alias("p"))
    priors = p.select("variable", F.lit(1).alias("state"), "p").unionAll(p.select("variable", F.lit(0).alias("state"), (1 - F.col("p")).alias("p")))
    last = p.select((F.col("variable") - 1).alias("a"))
    pairs = p.where("variable % 2 = 0").select(F.col("variable").alias("a")).join(last, "a").select(F.col("a").alias("factor"), "a", (F.col("a") + 1).alias("b"))
    states = F.explode(F.array(*[F.struct(F.lit(i).alias("sa"), F.lit(j).alias("sb"), F.lit(2.0 if i == j else 1.0).alias("potential")) for i in (0, 1) for j in (0, 1)]))
    pairs = pairs.select("factor", "a", "b", states.alias("s")).select("factor", "a", "b", "s.*")
    out = inference.flooding(priors, pairs, 2)
    paired = pairs.select(F.explode(F.array("a", "b")).alias("variable")).distinct()
    return out.where("state = 1").join(paired, "variable").select("variable", F.round("belief", 6).alias("belief"))


@query(f"select c_custkey + {T['IN_NATION']} as id, c_custkey + {L['Customer']} as src from customer where c_nationkey = 3 union all select s_suppkey + {T['SUPPLIER_IN_NATION']}, s_suppkey + {L['Supplier']} from supplier where s_nationkey = 3")
def scoped_logical_graph(spark, d):
    """The subgraph of the nodes that carry one value of a reserved property."""
    g = geography(spark, d)
    s = g.node_scan((), ["nationkey"])
    ids = s.df.where(strict_predicate(subscript(s, "nationkey"), "eq", 3)).select("id")
    return algorithms.subgraph(g, ids).edge_scan().df.select("id", "src")


def as_json(value) -> str:
    return json.dumps(value, sort_keys=True)
