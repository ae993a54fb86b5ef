"""Mutations as new graph states: unions, anti-joins and column updates."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import check_properties, pv_python, pv_tuple
from ..model import EDGES, NODES, VECTORS, GraphData, Source
from .search import METRICS, TOKENIZERS, check_vector
from .traversal import cut

RECORD_FIELDS = {"node": {"external_id", "labels", "properties"}, "edge": {"source", "target", "edge_type", "properties"}}
LIST_LIMIT = 500


def not_empty(what: str, text: Any) -> str:
    if not isinstance(text, str) or not text:
        raise ValueError(f"{what} cannot be empty")
    return text


def property_data(data: GraphData) -> GraphData:
    """``data`` with all nodes and edges as property tables, which mutations work on."""
    if len(data.nodes) == len(data.edges) == 1 and not data.nodes[0].native and not data.edges[0].native and data.nodes[0].names is None and data.edges[0].names is None:
        return data
    return data.with_(nodes=(Source(data.node_table()),), edges=(Source(data.edge_table()),))


def _props(properties: dict[str, Any] | None) -> dict[str, tuple]:
    return {k: pv_tuple(v) for k, v in check_properties(properties).items()}


def _matching(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows whose column is among ``values``: a predicate for a few, a semi-join for many."""
    if len(values) <= LIST_LIMIT:
        return df.where(F.col(column).isin(*values)) if values else df.limit(0)
    kind = "string" if isinstance(values[0], str) else "long"
    return df.join(df.sparkSession.createDataFrame([(v,) for v in values], f"{column} {kind}"), column, "left_semi")


def require(df: DataFrame, ids: Iterable[int], what: str) -> None:
    wanted = list(dict.fromkeys(ids))
    if wanted:
        found = {r[0] for r in _matching(df, "id", wanted).select("id").collect()}
        for i in wanted:
            if i not in found:
                raise KeyError(f"{what} {i} not found")


def add_nodes(data: GraphData, records: list[dict[str, Any]]) -> tuple[GraphData, list[int]]:
    """Append a batch, all or nothing; ids are dense and never used twice."""
    data = property_data(data)
    first = data.counters.get("node", 0)
    rows, seen = [], set()
    for i, r in enumerate(records):
        for k in r:
            if k not in RECORD_FIELDS["node"]:
                raise ValueError(f"node record has unknown field '{k}'")
        labels = [not_empty("label", x) for x in r.get("labels") or []]
        external = r.get("external_id")
        external = f"node:{first + i}" if external is None else not_empty("external_id", external)
        if external in seen:
            raise ValueError(f'external_id "{external}" already exists')
        seen.add(external)
        rows.append((first + i, external, list(dict.fromkeys(labels)), _props(r.get("properties"))))
    if not rows:
        return data, []
    taken = _matching(data.nodes[0].df.select("external_id"), "external_id", sorted(seen)).first()
    if taken:
        raise ValueError(f'external_id "{taken.external_id}" already exists')
    df = data.nodes[0].df.unionByName(data.spark.createDataFrame(rows, NODES))
    return data.with_(nodes=(Source(df),), counters={**data.counters, "node": first + len(rows)}), [r[0] for r in rows]


def add_edges(data: GraphData, records: list[dict[str, Any]]) -> tuple[GraphData, list[int]]:
    data = property_data(data)
    first = data.counters.get("edge", 0)
    rows = []
    for i, r in enumerate(records):
        for k in r:
            if k not in RECORD_FIELDS["edge"]:
                raise ValueError(f"edge record has unknown field '{k}'")
        rows.append((first + i, int(r["source"]), int(r["target"]), not_empty("edge type", r["edge_type"]), _props(r.get("properties"))))
    if not rows:
        return data, []
    require(data.nodes[0].df, [x for r in rows for x in r[1:3]], "node")
    df = data.edges[0].df.unionByName(data.spark.createDataFrame(rows, EDGES))
    return data.with_(edges=(Source(df),), counters={**data.counters, "edge": first + len(rows)}), [r[0] for r in rows]


def _numbered(df: DataFrame, first: int) -> tuple[DataFrame, int]:
    """(``df`` with dense ids from ``first`` in its order, how many): a row's place in its partition plus the rows of those before."""
    placed = cut(df.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("low"))
    # A row a partition.
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = cut(counts.select("__part", "n", (F.coalesce(before, F.lit(0)) - F.col("low") + first).alias("__shift")))
    n = shifts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return placed.join(shifts.drop("n"), "__part").withColumn("id", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift"), n


def _check_props(rows: DataFrame) -> None:
    bad = rows.select(F.explode("props").alias("key", "value")).where("key = '' or value.t is null").first()
    if bad is not None and bad.key == "":
        raise ValueError("property key cannot be empty")
    if bad is not None:
        raise TypeError(f'property "{bad.key}" must be a boolean, a 64-bit integer, a number or a string')


def add_node_rows(data: GraphData, rows: DataFrame) -> tuple[GraphData, list[int]]:
    """Append rows (external_id, labels, props) of any number, all or nothing; only their ids' range is on the driver."""
    data = property_data(data)
    first = data.counters.get("node", 0)
    new, n = _numbered(rows, first)
    new = cut(new.select("id", F.coalesce("external_id", F.concat(F.lit("node:"), F.col("id").cast("string"))).alias("external_id"), "labels", "props"))
    if new.where(F.exists("labels", lambda x: F.coalesce(x, F.lit("")) == "")).limit(1).count():
        raise ValueError("label cannot be empty")
    if new.where("external_id = ''").limit(1).count():
        raise ValueError("external_id cannot be empty")
    _check_props(new)
    taken = new.groupBy("external_id").count().where("count > 1").select("external_id").first()
    taken = taken or data.nodes[0].df.select("external_id").join(new.select("external_id"), "external_id", "left_semi").first()
    if taken:
        raise ValueError(f'external_id "{taken.external_id}" already exists')
    out = data.with_(nodes=(Source(data.nodes[0].df.unionByName(new)),), counters={**data.counters, "node": first + n})
    return out, list(range(first, first + n))


def add_edge_rows(data: GraphData, rows: DataFrame) -> tuple[GraphData, list[int]]:
    """Append rows (source, target, edge_type, props), ends as texts, of any number, all or nothing."""
    from ..sources.files import resolved

    data = property_data(data)
    first = data.counters.get("edge", 0)
    new, n = _numbered(rows, first)
    new = cut(resolved(data, new))
    if new.where("edge_type is null").limit(1).count():
        raise ValueError("edge rows require edge_type or type")
    lost = new.where("src is null or dst is null").select(F.when(F.col("src").isNull(), F.col("source")).otherwise(F.col("target")).alias("name")).first()
    if lost is not None:
        raise KeyError(f"node {lost.name} not found")
    _check_props(new)
    out = data.with_(edges=(Source(data.edges[0].df.unionByName(new.select("id", "src", "dst", "edge_type", "props"))),), counters={**data.counters, "edge": first + n})
    return out, list(range(first, first + n))


def replace_rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """``df`` with the rows of the same ids put in place of its own."""
    if not rows:
        return df
    new = df.sparkSession.createDataFrame(rows, schema)
    old = df.where(~F.col("id").isin(*[r[0] for r in rows])) if len(rows) <= LIST_LIMIT else df.join(new.select("id"), "id", "left_anti")
    return old.unionByName(new)


def update_node(data: GraphData, node_id: int, external_id: str | None = None, add_labels=None, remove_labels=None, set_properties=None, remove_properties=None) -> GraphData:
    data = property_data(data)
    df = data.nodes[0].df
    require(df, [node_id], "node")
    if external_id is not None:
        not_empty("external_id", external_id)
        if df.where((F.col("external_id") == external_id) & (F.col("id") != node_id)).limit(1).count():
            raise ValueError(f'external_id "{external_id}" already exists')
    labels = F.col("labels")
    if remove_labels:
        labels = F.filter(labels, lambda x: ~x.isin(*remove_labels))
    if add_labels:
        new = F.array(*[F.lit(not_empty("label", x)) for x in add_labels])
        labels = F.array_union(labels, new)
    mine = F.col("id") == node_id
    cols = {"labels": F.when(mine, labels).otherwise(F.col("labels")), "props": F.when(mine, _changed(set_properties, remove_properties)).otherwise(F.col("props"))}
    if external_id is not None:
        cols["external_id"] = F.when(mine, F.lit(external_id)).otherwise(F.col("external_id"))
    return data.with_(nodes=(Source(df.withColumns(cols).select("id", "external_id", "labels", "props")),))


def _changed(set_properties, remove_properties):
    """The property map after removals and then settings."""
    from ..model import PROPS

    out, new = F.col("props"), check_properties(set_properties)
    gone = [*(remove_properties or []), *new]
    for k in remove_properties or []:
        not_empty("property key", k)
    if gone:
        out = F.map_filter(out, lambda k, _: ~k.isin(*gone))
    if new:
        from ..functions.values import Value, pv_column

        entries = []
        for k, v in new.items():
            value = Value.literal(v)
            entries += [F.lit(k), pv_column(value.kind, value.column)]
        out = F.map_concat(out, F.create_map(*entries))
    return out.cast(PROPS)


def update_edge(data: GraphData, edge_id: int, set_properties=None, remove_properties=None) -> GraphData:
    data = property_data(data)
    df = data.edges[0].df
    require(df, [edge_id], "edge")
    props = F.when(F.col("id") == edge_id, _changed(set_properties, remove_properties)).otherwise(F.col("props"))
    return data.with_(edges=(Source(df.withColumn("props", props).select("id", "src", "dst", "edge_type", "props")),))


def _prune_vectors(data: GraphData, target: str, ids: DataFrame) -> GraphData:
    names = [k for k, d in data.vector.items() if d["target"] == target]
    if not names or "vectors" not in data.tables:
        return data
    v = data.table("vectors")
    mine = F.col("index_name").isin(*names)
    kept = v.where(mine).join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select(v.columns)
    return data.with_table("vectors", v.where(~mine).unionByName(kept))


def delete_edges(data: GraphData, ids: list[int]) -> GraphData:
    data = property_data(data)
    df = data.edges[0].df
    require(df, ids, "edge")
    gone = data.spark.createDataFrame([(i,) for i in ids], "id long")
    return _prune_vectors(data.with_(edges=(Source(df.join(gone, "id", "left_anti")),)), "edge", gone)


def delete_nodes(data: GraphData, ids: list[int] | DataFrame, detach: bool = False) -> tuple[GraphData, int]:
    """(new state, edges deleted with the nodes). A frame of ids holds known nodes and stays off the driver."""
    data = property_data(data)
    nodes, edges = data.nodes[0].df, data.edges[0].df
    if isinstance(ids, DataFrame):
        gone = ids.select("id")
    else:
        require(nodes, ids, "node")
        gone = data.spark.createDataFrame([(i,) for i in ids], "id long")
    owned = data.table("variables").select(F.col("owner_id").alias("id")).join(gone, "id", "left_semi").first()
    if owned:
        raise ValueError(f"node {owned.id} owns probabilistic variables")
    touching = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").unionByName(edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi")).select("id").distinct()
    n = touching.count()
    if n and not detach:
        raise ValueError(f"node {gone.first().id} still has relationships; use detach deletion")
    out = _prune_vectors(data, "node", gone)
    out = _prune_vectors(out, "edge", touching) if n else out
    out = out.with_(nodes=(Source(nodes.join(gone, "id", "left_anti")),))
    if n:
        out = out.with_(edges=(Source(edges.join(touching, "id", "left_anti").select("id", "src", "dst", "edge_type", "props")),))
    return out, n


# Indexes


def create_fulltext_index(data: GraphData, name: str, properties: list[str], target: str = "node", tokenizer: str = "unicode61") -> GraphData:
    not_empty("full-text index name", name)
    if name in data.fulltext:
        raise ValueError(f'full-text index "{name}" already exists')
    if target not in ("node", "edge"):
        raise ValueError("full-text target must be 'node' or 'edge'")
    if tokenizer not in TOKENIZERS:
        raise ValueError("full-text tokenizer must be 'unicode61' or 'trigram'")
    if not properties:
        raise ValueError("full-text properties cannot be empty")
    for p in properties:
        if not_empty("property key", p) == "external_id":
            raise ValueError("external_id cannot be a full-text property")
    if len(set(properties)) < len(properties):
        raise ValueError("full-text properties cannot repeat")
    return data.with_(fulltext={**data.fulltext, name: {"name": name, "target": target, "properties": list(properties), "tokenizer": tokenizer}})


def create_vector_index(data: GraphData, name: str, dimensions: int, target: str = "node", metric: str = "cosine", model: str | None = None, model_version: str | None = None) -> GraphData:
    not_empty("vector index name", name)
    if name in data.vector:
        raise ValueError(f'vector index "{name}" already exists')
    if target not in ("node", "edge"):
        raise ValueError("vector target must be 'node' or 'edge'")
    if metric not in METRICS:
        raise ValueError("vector metric must be 'cosine', 'dot', or 'euclidean'")
    if isinstance(dimensions, bool) or not isinstance(dimensions, int) or dimensions <= 0:
        raise ValueError("vector dimensions must be greater than zero")
    if model_version is not None and model is None:
        raise ValueError("model_version requires model")
    index = {"name": name, "target": target, "dimensions": dimensions, "metric": metric, "model": model, "model_version": model_version}
    return data.with_(vector={**data.vector, name: index})


def drop_index(data: GraphData, kind: str, name: str) -> GraphData:
    known = getattr(data, kind)
    if name not in known:
        raise KeyError(f'{"full-text" if kind == "fulltext" else "vector"} index "{name}" not found')
    data = data.with_(**{kind: {k: v for k, v in known.items() if k != name}})
    if kind == "vector" and "vectors" in data.tables:
        data = data.with_table("vectors", data.table("vectors").where(F.col("index_name") != name))
    return data


def index_of(data: GraphData, kind: str, name: str) -> dict:
    known = getattr(data, kind)
    if name not in known:
        raise KeyError(f'{"full-text" if kind == "fulltext" else "vector"} index "{name}" not found')
    return known[name]


def _entities(data: GraphData, index: dict) -> tuple[DataFrame, str]:
    return (data.node_scan().df, "node") if index["target"] == "node" else (data.edge_scan().df, "edge")


def upsert_vectors(data: GraphData, name: str, items: dict[int, list[float]] | list[tuple[int, list[float]]]) -> GraphData:
    index = index_of(data, "vector", name)
    pairs = list(items.items()) if isinstance(items, dict) else list(items)
    ids = [int(k) for k, _ in pairs]
    if len(set(ids)) < len(ids):
        raise ValueError("vector batch has a duplicate entity id")
    entities, what = _entities(data, index)
    require(entities, ids, what)
    rows = [(name, int(k), [float(x) for x in np.asarray(check_vector(index, v), np.float32)]) for k, v in pairs]
    if not rows:
        return data
    new = data.spark.createDataFrame(rows, VECTORS)
    kept = data.table("vectors").join(new.select("index_name", "entity_id"), ["index_name", "entity_id"], "left_anti").select("index_name", "entity_id", "vector")
    return data.with_table("vectors", kept.unionByName(new))


def delete_vectors(data: GraphData, name: str, ids: list[int]) -> GraphData:
    index = index_of(data, "vector", name)
    entities, what = _entities(data, index)
    require(entities, ids, what)
    v = data.table("vectors")
    return data.with_table("vectors", v.where(~((F.col("index_name") == name) & F.col("entity_id").isin(*ids)))) if ids else data


def diff(before: GraphData, after: GraphData) -> dict[str, DataFrame]:
    """(id, change) of nodes and edges, change being insert, update or delete."""
    out = {}
    for name in ("node_table", "edge_table"):
        a, b = (getattr(x, name)() for x in (before, after))
        key = lambda df: df.select("id", F.xxhash64(F.to_json(F.struct(*[F.array_sort(F.map_entries("props")).alias("p") if c == "props" else F.col(c) for c in df.columns]))).alias("h"))
        j = key(a).withColumnRenamed("h", "ha").join(key(b).withColumnRenamed("h", "hb"), "id", "full")
        change = F.when(F.col("ha").isNull(), "insert").when(F.col("hb").isNull(), "delete").otherwise("update")
        out[name[:4]] = j.where("not (ha <=> hb)").select("id", change.alias("change"))
    return out


def python_record(row, kind: str) -> dict[str, Any]:
    props = {k: pv_python(v) for k, v in (row["props"] or {}).items()}
    if kind == "node":
        return {"id": row["id"], "external_id": row["external_id"], "labels": list(row["labels"]), "properties": props}
    return {"id": row["id"], "source": row["src"], "target": row["dst"], "edge_type": row["edge_type"], "properties": props}
