"""Scans, the structured query language and Cypher reads, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import strict_predicate
from ..model import subscript
from ..operators import introspect
from ..plans import cypher, dsl
from ..sources.tables import LABELS as L
from ..sources.tables import LINES, TYPES as T
from ..sources.tables import geography, graph

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


NODES_SQL = f"""
select r_regionkey + {L['Region']} as id, 'Region' as label from region
union all select n_nationkey + {L['Nation']}, 'Nation' from nation
union all select c_custkey + {L['Customer']}, 'Customer' from customer
union all select s_suppkey + {L['Supplier']}, 'Supplier' from supplier
union all select o_orderkey + {L['Order']}, 'Order' from orders
union all select p_partkey + {L['Part']}, 'Part' from part"""

EDGES_SQL = f"""
select n_nationkey + {T['IN_REGION']} as id, n_nationkey + {L['Nation']} as src, n_regionkey + {L['Region']} as dst, 'IN_REGION' as edge_type from nation
union all select c_custkey + {T['IN_NATION']}, c_custkey + {L['Customer']}, c_nationkey + {L['Nation']}, 'IN_NATION' from customer
union all select s_suppkey + {T['SUPPLIER_IN_NATION']}, s_suppkey + {L['Supplier']}, s_nationkey + {L['Nation']}, 'IN_NATION' from supplier
union all select o_orderkey + {T['PLACED']}, o_custkey + {L['Customer']}, o_orderkey + {L['Order']}, 'PLACED' from orders
union all select l_orderkey * {LINES} + l_linenumber + {T['CONTAINS']}, l_orderkey + {L['Order']}, l_partkey + {L['Part']}, 'CONTAINS' from lineitem
union all select l_orderkey * {LINES} + l_linenumber + {T['SUPPLIED_BY']}, l_partkey + {L['Part']}, l_suppkey + {L['Supplier']}, 'SUPPLIED_BY' from lineitem"""

GEO_EDGES_SQL = "\nunion all ".join(EDGES_SQL.strip().split("\nunion all ")[:3])


# Scans and lookups


@query(NODES_SQL)
def scan_nodes(spark, d):
    return graph(spark, d).node_scan().df.select("id", F.col("labels")[0].alias("label"))


@query(EDGES_SQL)
def scan_edges(spark, d):
    return graph(spark, d).edge_scan().df.select("id", "src", "dst", "edge_type")


@query(f"select c_custkey + {L['Customer']} as id from customer where c_custkey = 7")
def lookup_external_id(spark, d):
    return graph(spark, d).node_scan().df.where("external_id = 'customer:7'").select("id")


@query(f"select o_orderkey + {L['Order']} as id, o_totalprice as totalprice from orders where o_orderkey = 11")
def lookup_node(spark, d):
    s = graph(spark, d).node_scan(("Order",), ["totalprice"])
    return s.df.where(F.col("id") == 11 + L["Order"]).select("id", F.col("p_totalprice").alias("totalprice"))


@query(f"select s_suppkey + {L['Supplier']} as id from supplier")
def label_scan(spark, d):
    return graph(spark, d).node_scan(("Supplier",)).df.select("id")


@query(f"select id, src, dst from ({EDGES_SQL}) where edge_type = 'IN_NATION'")
def type_scan(spark, d):
    return graph(spark, d).edge_scan("IN_NATION").df.select("id", "src", "dst")


@query(f"select c_custkey + {L['Customer']} as id from customer where c_mktsegment is not null")
def property_key_scan(spark, d):
    s = graph(spark, d).node_scan((), ["mktsegment"])
    return s.df.where(subscript(s, "mktsegment").present()).select("id")


@query(f"select c_custkey + {L['Customer']} as id from customer where c_mktsegment = 'BUILDING'")
def property_value_scan(spark, d):
    s = graph(spark, d).node_scan((), ["mktsegment"])
    return s.df.where(strict_predicate(subscript(s, "mktsegment"), "eq", "BUILDING")).select("id")


@query(f"select l_orderkey * {LINES} + l_linenumber + {T['CONTAINS']} as id from lineitem where l_discount = 0.05")
def edge_property_scan(spark, d):
    s = graph(spark, d).edge_scan(None, ["discount"])
    return s.df.where(strict_predicate(subscript(s, "discount"), "eq", 0.05)).select("id")


@query(f"select 'nodes' as what, count(*) as n from ({NODES_SQL}) union all select 'edges', count(*) from ({EDGES_SQL})")
def counts(spark, d):
    return introspect.counts(graph(spark, d)).where("what in ('nodes', 'edges')")


@query(f"select label as name, count(*) as count from ({NODES_SQL}) group by label")
def label_histogram(spark, d):
    return introspect.label_histogram(graph(spark, d))


@query(f"select edge_type as name, count(*) as count from ({EDGES_SQL}) group by edge_type")
def type_histogram(spark, d):
    return introspect.type_histogram(graph(spark, d))


@query(
    """
with p as (
  select 'regionkey' as key, 'int' as t from region union all select 'name', 'string' from region
  union all select 'nationkey', 'int' from nation union all select 'name', 'string' from nation union all select 'regionkey', 'int' from nation
  union all select 'custkey', 'int' from customer union all select 'name', 'string' from customer union all select 'nationkey', 'int' from customer
  union all select 'acctbal', 'float' from customer union all select 'mktsegment', 'string' from customer
  union all select 'suppkey', 'int' from supplier union all select 'name', 'string' from supplier union all select 'nationkey', 'int' from supplier
  union all select 'acctbal', 'float' from supplier
) select key, string_agg(distinct t, ',' order by t) as types, count(*) as count from p group by key"""
)
def property_schema(spark, d):
    return introspect.property_schema(geography(spark, d).node_table()).select("key", F.array_join("types", ",").alias("types"), "count")


@query("select p_size as size, count(*) as n from part group by p_size")
def age_histogram_like(spark, d):
    s = graph(spark, d).node_scan(("Part",), ["size"])
    return s.df.groupBy(F.col("p_size").alias("size")).agg(F.count(F.lit(1)).alias("n"))


# Structured language


def _dsl(spark, d, *match, returns=None, limit=None):
    spec = {"match": list(match)}
    if returns:
        spec["return"] = returns
    if limit is not None:
        spec["limit"] = limit
    return dsl.query(graph(spark, d), spec)


CUST, ORD, NAT, REG, PART, SUPP = ({"node": n, "labels": [x]} for n, x in (("c", "Customer"), ("o", "Order"), ("n", "Nation"), ("r", "Region"), ("p", "Part"), ("s", "Supplier")))


@query(f"select c_custkey + {L['Customer']} as c, o_orderkey + {L['Order']} as o from customer join orders on o_custkey = c_custkey where c_mktsegment = 'HOUSEHOLD' and o_totalprice >= 100000")
def dsl_one_hop(spark, d):
    c = CUST | {"properties": {"mktsegment": "HOUSEHOLD"}}
    o = ORD | {"where": [{"property": "totalprice", "op": "gte", "value": 100000.0}]}
    return _dsl(spark, d, c, {"edge": "e", "type": "PLACED"}, o, returns=["c", "o"])


@query(f"select c_custkey + {L['Customer']} as c, n_nationkey + {L['Nation']} as n, r_regionkey + {L['Region']} as r from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' and c_acctbal > 5000")
def dsl_two_hop(spark, d):
    c = CUST | {"where": [{"property": "acctbal", "op": "gt", "value": 5000}]}
    return _dsl(spark, d, c, {"type": "IN_NATION"}, NAT, {"type": "IN_REGION"}, REG | {"properties": {"name": "ASIA"}}, returns=["c", "n", "r"])


@query(f"select n_nationkey + {L['Nation']} as n, c_custkey + {L['Customer']} as c, c_custkey + {T['IN_NATION']} as e from nation join customer on c_nationkey = n_nationkey where n_regionkey = 1")
def dsl_in(spark, d):
    return _dsl(spark, d, NAT | {"properties": {"regionkey": 1}}, {"edge": "e", "type": "IN_NATION", "direction": "in"}, CUST)


@query(f"with e as ({EDGES_SQL}), b as (select id, src as a, dst as b from e union all select id, dst, src from e where src <> dst) select a as n, id as e, b as m from b join nation on a = n_nationkey + {L['Nation']} where n_nationkey < 5")
def dsl_both(spark, d):
    return _dsl(spark, d, NAT | {"where": [{"property": "nationkey", "op": "lt", "value": 5}]}, {"edge": "e", "direction": "both"}, {"node": "m"})


@query(f"select a.l_orderkey + {L['Order']} as o, a.l_orderkey * {LINES} + a.l_linenumber + {T['CONTAINS']} as x, a.l_partkey + {L['Part']} as p, b.l_orderkey * {LINES} + b.l_linenumber + {T['CONTAINS']} as y from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey")
def dsl_cycle(spark, d):
    return _dsl(spark, d, {"node": "o"}, {"edge": "x", "type": "CONTAINS"}, {"node": "p"}, {"edge": "y", "type": "CONTAINS", "direction": "in"}, {"node": "o"})


@query(f"select a.l_orderkey + {L['Order']} as o, a.l_orderkey * {LINES} + a.l_linenumber + {T['CONTAINS']} as x, a.l_partkey + {L['Part']} as p, b.l_orderkey + {L['Order']} as q from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber and a.l_partkey = b.l_partkey where a.l_quantity < 3")
def dsl_repeated_edge(spark, d):
    q = [{"property": "quantity", "op": "lt", "value": 3}]
    return _dsl(spark, d, {"node": "o"}, {"edge": "x", "type": "CONTAINS", "where": q}, {"node": "p"}, {"edge": "x", "type": "CONTAINS", "direction": "in"}, {"node": "q"})


@query(f"select p_partkey + {L['Part']} as p from part where p_size = 10")
def dsl_eq_strict(spark, d):
    """An int property: equal to the int, never to the float of the same value."""
    a = _dsl(spark, d, PART | {"properties": {"size": 10}})
    return a.unionAll(_dsl(spark, d, PART | {"properties": {"size": 10.0}}))


@query(f"select c_custkey + {L['Customer']} as x from customer where c_mktsegment <> 'BUILDING'")
def dsl_ne(spark, d):
    """Nodes without the property don't differ, whatever their label."""
    return _dsl(spark, d, {"node": "x", "where": [{"property": "mktsegment", "op": "ne", "value": "BUILDING"}]})


@query(f"select o_orderkey + {L['Order']} as o from orders where o_totalprice > 50000 and o_totalprice <= 150000.5")
def dsl_range(spark, d):
    return _dsl(spark, d, ORD | {"where": [{"property": "totalprice", "op": "gt", "value": 50000}, {"property": "totalprice", "op": "lte", "value": 150000.5}]})


@query(f"select p_partkey + {L['Part']} as p from part where p_size in (1, 5, 9)")
def dsl_in_list(spark, d):
    return _dsl(spark, d, PART | {"where": [{"property": "size", "op": "in", "value": [1, 5, 9, "7", 3.0]}]})


@query(f"select s_suppkey + {L['Supplier']} as s from supplier where contains(s_name, '1')")
def dsl_contains(spark, d):
    return _dsl(spark, d, SUPP | {"where": [{"property": "name", "op": "contains", "value": "1"}]})


@query(f"select c, o, row_number() over (order by c, o) as place from (select c_custkey + {L['Customer']} as c, o_orderkey + {L['Order']} as o from customer join orders on o_custkey = c_custkey where c_mktsegment = 'MACHINERY' order by c, o limit 25)")
def dsl_limit(spark, d):
    from pyspark.sql import Window

    df = _dsl(spark, d, CUST | {"properties": {"mktsegment": "MACHINERY"}}, {"edge": "e", "type": "PLACED"}, ORD, returns=["c", "o"], limit=25)
    return df.withColumn("place", F.row_number().over(Window.orderBy("c", "o")).cast("long"))


@query(f"select r_regionkey + {L['Region']} as r from region where r_regionkey = 3")
def dsl_ids(spark, d):
    return _dsl(spark, d, REG | {"external_id": "region:3", "id": 3 + L["Region"]})


# Cypher


def _cy(spark, d, text, **params):
    return cypher.read(graph(spark, d), text, params).df


@query(f"select c_custkey + {L['Customer']} as id, c_name as name, o_totalprice as price from customer join orders on o_custkey = c_custkey where c_mktsegment = 'AUTOMOBILE'")
def cy_match(spark, d):
    return _cy(spark, d, "MATCH (c:Customer {mktsegment: 'AUTOMOBILE'})-[:PLACED]->(o:Order) RETURN id(c) AS id, c.name AS name, o.totalprice AS price")


@query("select c_name as name, o_orderpriority as priority from customer join orders on o_custkey = c_custkey where o_totalprice > 200000 and c_acctbal <= 1000.0 and o_orderstatus <> 'F'")
def cy_where_and(spark, d):
    return _cy(spark, d, "MATCH (c:Customer)-[r:PLACED]->(o:Order) WHERE o.totalprice > 200000 AND c.acctbal <= $most AND o.orderstatus <> 'F' RETURN c.name AS name, o.orderpriority AS priority", most=1000.0)


@query(f"select s_suppkey + {L['Supplier']} as id from supplier")
def cy_ne_null(spark, d):
    """A missing property differs from anything."""
    return _cy(spark, d, "MATCH (s:Supplier) WHERE s.mktsegment <> 'BUILDING' RETURN id(s) AS id")


@query(f"select p_partkey + {L['Part']} as id from part where p_size in (3, 7)")
def cy_in(spark, d):
    return _cy(spark, d, "MATCH (p:Part) WHERE p.size IN [3, 7.0, null, 'x'] RETURN id(p) AS id")


@query("select p_name as name from part where contains(p_type, 'ECON')")
def cy_contains(spark, d):
    return _cy(spark, d, "MATCH (p:Part) WHERE p.type CONTAINS $t RETURN p.name AS name", t="ECON")


@query("select name, bal, row_number() over (order by bal desc, id) as place from (select c_name as name, c_acctbal as bal, c_custkey as id from customer order by c_acctbal desc, c_custkey limit 30)")
def cy_order_limit(spark, d):
    from pyspark.sql import Window

    df = _cy(spark, d, "MATCH (c:Customer) RETURN c.name AS name, c.acctbal AS bal, id(c) AS k ORDER BY bal DESC LIMIT 30")
    return df.select("name", "bal", F.row_number().over(Window.orderBy(F.desc("bal"), "k")).cast("long").alias("place"))


@query(f"select id, seg from (select c_custkey + {L['Customer']} as id, c_mktsegment as seg from customer union all select s_suppkey + {L['Supplier']}, null from supplier) order by seg asc nulls last, id limit 400 offset 1300")
def cy_order_nulls(spark, d):
    g = geography(spark, d)
    return cypher.read(g, "MATCH (x)-[:IN_NATION]->(n) RETURN id(x) AS id, x.mktsegment AS seg ORDER BY seg, id(x) SKIP 1300 LIMIT 400").df


@query("select n_name as name from nation order by n_nationkey limit 5 offset 10")
def cy_skip_limit(spark, d):
    return _cy(spark, d, "MATCH (n:Nation) RETURN n.name AS name LIMIT 5 SKIP 10")


@query("select count(*) as n from lineitem where l_quantity >= 25")
def cy_count_star(spark, d):
    return _cy(spark, d, "MATCH (o)-[r:CONTAINS]->(p) WHERE r.quantity >= 25 RETURN count(*) AS n")


@query("select count(*) as a, count(*) as b, 0 as c from customer join nation on c_nationkey = n_nationkey where n_regionkey = 2")
def cy_count_var(spark, d):
    return _cy(spark, d, "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE n.regionkey = 2 RETURN count(c) AS a, count(*) AS b, count(zzz) AS c")


@query("select n_name as name from nation where n_name = 'NATION_6'")
def cy_optional_hit(spark, d):
    return _cy(spark, d, "OPTIONAL MATCH (n:Nation) WHERE n.name = 'NATION_6' RETURN n.name AS name")


@query("select cast(null as varchar) as name, 1 as one")
def cy_optional_miss(spark, d):
    return _cy(spark, d, "OPTIONAL MATCH (n:Nation {name: 'ATLANTIS'}) RETURN n.name AS name, 1 AS one")


@query("select s_name as supplier, c_name as customer, n_name as nation from supplier join nation on s_nationkey = n_nationkey join customer on c_nationkey = n_nationkey where n_regionkey = 0 and c_acctbal > 9000")
def cy_multi_pattern(spark, d):
    return _cy(spark, d, "MATCH (s:Supplier)-[:IN_NATION]->(n:Nation {regionkey: 0}), (c:Customer)-[:IN_NATION]->(n) WHERE c.acctbal > 9000 RETURN s.name AS supplier, c.name AS customer, n.name AS nation")


@query("select a.r_name as a, b.r_name as b from region a, region b")
def cy_cartesian(spark, d):
    return _cy(spark, d, "MATCH (a:Region), (b:Region) RETURN a.name AS a, b.name AS b")


@query("select n_name as name from nation where n_regionkey = 1 union all select n_name from nation where n_nationkey < 10")
def cy_union(spark, d):
    return _cy(spark, d, "MATCH (n:Nation) WHERE n.regionkey = 1 RETURN n.name AS name UNION MATCH (n:Nation) WHERE n.nationkey < 10 RETURN n.name AS name")


@query(f"select n_nationkey + {T['IN_REGION']} as id, 'relationship:' || (n_nationkey + {T['IN_REGION']}) as element, 'IN_REGION' as type, 'node:' || (n_nationkey + {L['Nation']}) as node, 'Nation' as label from nation")
def cy_functions(spark, d):
    df = _cy(spark, d, "MATCH (n:Nation)-[r:IN_REGION]->(m) RETURN id(r) AS id, elementId(r) AS element, TYPE(r) AS type, elementid(n) AS node, labels(n) AS labels")
    return df.select("id", "element", "type", "node", F.col("labels")[0].alias("label"))


@query(f"select n_nationkey + {L['Nation']} as a, n_regionkey + {L['Region']} as b, 'nation:' || n_nationkey as c from nation")
def cy_start_end_node(spark, d):
    df = _cy(spark, d, "MATCH (r:Region)<-[e:IN_REGION]-(n) RETURN startNode(e) AS s, endNode(e) AS t")
    return df.select(F.col("s.id").alias("a"), F.col("t.id").alias("b"), F.col("s.external_id").alias("c"))


@query(f"with e as ({GEO_EDGES_SQL}) select id as r, b as other from (select id, src as a, dst as b from e union all select id, dst, src from e where src <> dst) join nation on a = n_nationkey + {L['Nation']} where n_name in ('NATION_6', 'NATION_18')")
def cy_undirected(spark, d):
    g = geography(spark, d)
    return cypher.read(g, "MATCH (n:Nation)-[r]-(m) WHERE n.name IN $names RETURN id(r) AS r, id(m) AS other", {"names": ["NATION_6", "NATION_18"]}).df


@query("select 1 as i, 2.5::double as f, 'a' as s, true as b")
def cy_return_const(spark, d):
    return _cy(spark, d, "RETURN 1 AS i, 2.5 AS f, 'a' AS s, true AS b")


@query(f"select n_nationkey + {L['Nation']} as id, n_name as name from nation where n_regionkey = 3")
def cy_external_id(spark, d):
    df = _cy(spark, d, "MATCH (n)-[:IN_REGION]->(r {external_id: 'region:3'}) RETURN n AS node")
    name = F.col("node.properties")["name"]["s"]
    return df.select(F.col("node.id").alias("id"), name.alias("name"))


@query("select l_quantity as q, o_orderstatus as s, c_name as c from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where l_discount >= 0.09 and l_quantity > 48")
def cy_three_hop(spark, d):
    return _cy(spark, d, "MATCH (p:Part)<-[l:CONTAINS]-(o:Order)<-[:PLACED]-(c:Customer) WHERE l.discount >= 0.09 AND l.quantity > 48 RETURN l.quantity AS q, o.orderstatus AS s, c.name AS c")
