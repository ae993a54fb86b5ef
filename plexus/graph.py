"""The embedded API: snapshots, writable graphs and transactions.

Methods that list things return Python lists, in contract order; each stands on a
DataFrame operator of ``plexus.operators`` or ``plexus.plans``, which is what to
use where results are large.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import Value, kind_of, pv_python, pv_tuple
from .model import TABLES, GraphData, Source, subscript
from .operators import algorithms, inference, introspect, mutate, search, traversal
from .plans import cypher, cypher_write, dsl
from .sources import files
from .sources.store import StaleGraph, Store

COMPACT_AFTER = 12


def _ids(df: DataFrame, column: str = "node", order: str = "position") -> list[int]:
    return [r[0] for r in df.orderBy(order).select(column).collect()]


class Snapshot:
    """A frozen graph state and all that can be read from it."""

    def __init__(self, data: GraphData):
        self.data = data
        self.spark = data.spark

    # Scans and lookups

    def node_count(self) -> int:
        return self.data.node_scan().df.count()

    def edge_count(self) -> int:
        return self.data.edge_scan().df.count()

    def variable_count(self) -> int:
        return self.data.table("variables").count()

    def factor_count(self) -> int:
        return self.data.table("factors").count()

    def evidence_count(self) -> int:
        return self.data.table("evidence").count()

    def trace_count(self) -> int:
        return self.data.table("traces").count()

    def node_ids(self) -> list[int]:
        return _ids(self.data.node_scan().df, "id", "id")

    def edge_ids(self) -> list[int]:
        return _ids(self.data.edge_scan().df, "id", "id")

    def nodes(self) -> list[dict[str, Any]]:
        return [mutate.python_record(r, "node") for r in self.data.node_table().orderBy("id").collect()]

    def edges(self) -> list[dict[str, Any]]:
        return [mutate.python_record(r, "edge") for r in self.data.edge_table().orderBy("id").collect()]

    def _one(self, df: DataFrame, what: str, ident: int):
        row = df.where(F.col("id") == ident).first()
        if row is None:
            raise KeyError(f"{what} {ident} not found")
        return row

    def get_node(self, node_id: int) -> dict[str, Any]:
        return mutate.python_record(self._one(self.data.node_table(), "node", node_id), "node")

    def get_edge(self, edge_id: int) -> dict[str, Any]:
        return mutate.python_record(self._one(self.data.edge_table(), "edge", edge_id), "edge")

    def _plain(self, table: str, what: str, ident: int) -> dict[str, Any]:
        row = self._one(self.data.table(table), what, ident).asDict()
        return {k: {a: pv_python(b) for a, b in v.items()} if isinstance(v, dict) else v for k, v in row.items()}

    def get_variable(self, ident: int) -> dict[str, Any]:
        return self._plain("variables", "variable", ident)

    def get_factor(self, ident: int) -> dict[str, Any]:
        return self._plain("factors", "factor", ident)

    def get_evidence(self, ident: int) -> dict[str, Any]:
        return self._plain("evidence", "evidence", ident)

    def get_trace(self, ident: int) -> dict[str, Any]:
        return self._plain("traces", "trace", ident)

    def get_node_id(self, external_id: str) -> int | None:
        row = self.data.node_scan().df.where(F.col("external_id") == external_id).first()
        return row.id if row else None

    def nodes_with_label(self, label: str) -> list[int]:
        return _ids(self.data.node_scan((label,)).df, "id", "id")

    def edges_by_type(self, edge_type: str) -> list[int]:
        return _ids(self.data.edge_scan(edge_type).df, "id", "id")

    def _with_property(self, scan, key: str, value: Any) -> DataFrame:
        v: Value = subscript(scan, key)
        from .functions.values import strict_predicate

        return scan.df.where(v.present() if value is None else strict_predicate(v, "eq", value))

    def nodes_with_property(self, key: str, value: Any = None) -> list[int]:
        return _ids(self._with_property(self.data.node_scan((), [key]), key, value), "id", "id")

    def edges_with_property(self, key: str, value: Any = None) -> list[int]:
        return _ids(self._with_property(self.data.edge_scan(None, [key]), key, value), "id", "id")

    # Traversal and algorithms

    def neighbors(self, node_id: int, direction: str = "out", edge_type: str | None = None) -> list[int]:
        traversal.require_nodes(self.data, [node_id])
        return _ids(traversal.neighbors(self.data, node_id, direction, edge_type))

    def _start(self, node_id: int) -> DataFrame:
        traversal.require_nodes(self.data, [node_id])
        return self.spark.createDataFrame([(node_id,)], "start long")

    def k_hop(self, start: int, hops: int, direction: str = "out", edge_type: str | None = None) -> list[int]:
        return _ids(traversal.k_hop(self.data, self._start(start), hops, direction, edge_type))

    def frontier(self, starts: list[int], steps: int, direction: str = "out", edge_type: str | None = None) -> list[int]:
        return _ids(traversal.frontier(self.data, starts, steps, direction, edge_type))

    def bfs(self, start: int, direction: str = "out", edge_type: str | None = None, max_depth: int | None = None) -> list[int]:
        return _ids(traversal.bfs(self.data, self._start(start), direction, edge_type, max_depth))

    def shortest_path(self, start: int, target: int, direction: str = "out", edge_type: str | None = None, weight_property: str | None = None) -> dict[str, Any] | None:
        return algorithms.shortest_path(self.data, start, target, direction, edge_type, weight_property)

    def connected_components(self, edge_type: str | None = None) -> list[list[int]]:
        out: dict[int, list[int]] = {}
        for r in algorithms.connected_components(self.data, edge_type).orderBy("component", "position").collect():
            out.setdefault(r.component, []).append(r.node)
        return list(out.values())

    def pagerank(self, iterations: int = 20, damping: float = 0.85, tolerance: float | None = None, edge_type: str | None = None) -> dict[int, float]:
        return {r.node: r["rank"] for r in algorithms.pagerank(self.data, iterations, damping, tolerance, edge_type).orderBy("node").collect()}

    def random_walk(self, start: int, steps: int, direction: str = "out", edge_type: str | None = None, seed: int | None = None) -> list[int]:
        return algorithms.random_walk(self.data, start, steps, direction, edge_type, seed)

    def subgraph(self, nodes: list[int], edge_type: str | None = None) -> Snapshot:
        return Snapshot(algorithms.subgraph(self.data, nodes, edge_type))

    def compute_batch(self, jobs: list[dict[str, Any]]) -> list[Any]:
        return algorithms.compute_batch(self, jobs)

    def scoped(self, property_key: str, value: Any) -> Snapshot:
        """A logical graph: the subgraph induced by the nodes that carry a property value."""
        scan = self.data.node_scan((), [property_key])
        return Snapshot(algorithms.subgraph(self.data, self._with_property(scan, property_key, value).select("id")))

    # Queries

    def query(self, spec: dict[str, Any], profile: bool = False):
        rows = [r.asDict() for r in dsl.query(self.data, spec).collect()]
        return {"rows": rows, "profile": dsl.profile(self.data, spec)} if profile else rows

    def query_schema(self) -> dict[str, Any]:
        return dsl.schema()

    def cypher(self, text: str, parameters: dict[str, Any] | None = None, profile: bool = False) -> dict[str, Any]:
        return _answer(cypher.read(self.data, text, parameters), profile)

    def schema(self) -> dict[str, Any]:
        return introspect.schema(self.data)

    def stats(self) -> dict[str, Any]:
        return introspect.stats(self.data)

    # Search

    def fulltext_indexes(self) -> list[dict[str, Any]]:
        return [self.data.fulltext[k] for k in sorted(self.data.fulltext)]

    def vector_indexes(self) -> list[dict[str, Any]]:
        return [self.data.vector[k] for k in sorted(self.data.vector)]

    def _tokens(self, index_name: str) -> DataFrame | None:
        """The current word table of an index, if there is one."""
        return None

    def search_text(self, index_name: str, query: str, mode: str = "all", labels=None, edge_type=None, properties=None, limit: int = 20, offset: int = 0) -> list[dict[str, Any]]:
        index = mutate.index_of(self.data, "fulltext", index_name)
        found = search.search_text(self.data, index, query, mode, labels, edge_type, properties, limit, offset, self._tokens(index_name))
        return [{"kind": index["target"], **r.asDict()} for r in found.collect()]

    def get_vector(self, index_name: str, entity_id: int) -> list[float]:
        mutate.index_of(self.data, "vector", index_name)
        row = self.data.table("vectors").where((F.col("index_name") == index_name) & (F.col("entity_id") == entity_id)).first()
        if row is None:
            raise KeyError(f"vector for entity {entity_id} not found")
        return list(row.vector)

    def search_vector(self, index_name: str, query: list[float], labels=None, edge_type=None, properties=None, min_score: float | None = None, limit: int = 20, offset: int = 0) -> list[dict[str, Any]]:
        index = mutate.index_of(self.data, "vector", index_name)
        found = search.search_vector(self.data, index, query, labels, edge_type, properties, min_score, limit, offset)
        return [{"kind": index["target"], **r.asDict()} for r in found.collect()]

    def search_vectors(self, index_name: str, query_vectors: list[list[float]], labels=None, edge_type=None, properties=None, min_score: float | None = None, limit: int = 20, offset: int = 0) -> list[list[dict[str, Any]]]:
        index = mutate.index_of(self.data, "vector", index_name)
        out: list[list[dict[str, Any]]] = [[] for _ in query_vectors]
        found = search.search_vectors(self.data, index, query_vectors, labels, edge_type, properties, min_score, limit, offset)
        for r in found.orderBy("query", "position").collect():
            out[r["query"]].append({"kind": index["target"], "id": r.id, "score": r.score})
        return out

    # Export

    def export_nodes_jsonl(self, path: str, nodes: list[int] | None = None) -> None:
        files.export_nodes(self.data, path, nodes)

    def export_edges_jsonl(self, path: str, edges: list[int] | None = None) -> None:
        files.export_edges(self.data, path, edges)

    def export_query_rows_jsonl(self, path: str, rows: DataFrame | list[dict[str, Any]]) -> None:
        files.export_rows(self.spark, path, rows)


def _answer(result: cypher.Result, profile: bool) -> dict[str, Any]:
    records = result.records()
    out = {"keys": result.keys, "records": records, "summary": {**result.summary, "rows": len(records)}}
    return out | {"profile": result.profile | {"rows": len(records)}} if profile else out


class Graph(Snapshot):
    """A writable graph, in memory or in a versioned store."""

    def __init__(self, path: str | None = None, spark: SparkSession | None = None):
        spark = spark or SparkSession.builder.getOrCreate()
        self.store = Store(spark, path) if path else None
        if self.store:
            data = self.store.load()
        else:
            empty = GraphData(spark)
            data = empty.with_(nodes=(Source(empty.table("nodes")),), edges=(Source(empty.table("edges")),))
        super().__init__(data)
        self.pending = 0
        self.log: list[str] = []
        self.tokens: dict[str, tuple[int, DataFrame]] = {}

    @classmethod
    def open(cls, path: str, spark: SparkSession | None = None) -> Graph:
        return cls(path, spark)

    def _publish(self, data: GraphData, changed: set[str], operation: str, appended: dict[str, DataFrame] | None = None) -> None:
        """Make ``data`` current: through the store if there is one, in memory otherwise.

        A store writes the tables ``changed`` as a whole and the rows ``appended`` to others.
        """
        if self.store:
            self.data = self.store.save(data.with_(version=self.data.version), changed, operation, appended)
            return
        self.data = data.with_(version=self.data.version + 1)
        self.log.append(operation)
        self.pending += 1
        if self.pending >= COMPACT_AFTER:
            self._flatten()

    def _flatten(self) -> None:
        """Write the state to the shared folder, so that plans don't grow with mutations."""
        d = mutate.property_data(self.data)
        tables = {k: traversal.cut(v) for k, v in d.tables.items()}
        self.data = d.with_(nodes=(Source(traversal.cut(d.nodes[0].df)),), edges=(Source(traversal.cut(d.edges[0].df)),), tables=tables)
        self.pending = 0

    def compact(self) -> None:
        if self.store:
            self._publish(self.data, set(TABLES), "compact")
        else:
            self._flatten()

    def refresh(self) -> None:
        if self.store:
            self.data = self.store.load()

    def operations(self) -> list[str]:
        return [o for _, o in self.store.operations()] if self.store else list(self.log)

    def snapshot(self) -> Snapshot:
        return Snapshot(self.data)

    def transaction(self, write: bool = True) -> Transaction:
        return Transaction(self, write)

    # Mutations

    def _add(self, data: GraphData, table: str, ids: list[int], operation: str) -> None:
        """Publish new nodes or edges, whose ids are all above those so far."""
        new = getattr(data, table)[0].df
        self._publish(data, set(), operation, {table: new.where(F.col("id") >= ids[0]) if ids else new.limit(0)})

    def add_nodes(self, records: list[dict[str, Any]]) -> list[int]:
        data, ids = mutate.add_nodes(self.data, records)
        self._add(data, "nodes", ids, "add_nodes")
        return ids

    def add_node(self, external_id: str | None = None, labels: list[str] | None = None, properties: dict[str, Any] | None = None) -> int:
        return self.add_nodes([{"external_id": external_id, "labels": labels, "properties": properties}])[0]

    def add_edges(self, records: list[dict[str, Any]]) -> list[int]:
        data, ids = mutate.add_edges(self.data, records)
        self._add(data, "edges", ids, "add_edges")
        return ids

    def add_edge(self, source: int, target: int, edge_type: str, properties: dict[str, Any] | None = None) -> int:
        return self.add_edges([{"source": source, "target": target, "edge_type": edge_type, "properties": properties}])[0]

    def update_node(self, node_id: int, *, external_id=None, add_labels=None, remove_labels=None, set_properties=None, remove_properties=None) -> dict[str, Any]:
        self._publish(mutate.update_node(self.data, node_id, external_id, add_labels, remove_labels, set_properties, remove_properties), {"nodes"}, "update_node")
        return self.get_node(node_id)

    def update_edge(self, edge_id: int, *, set_properties=None, remove_properties=None) -> dict[str, Any]:
        self._publish(mutate.update_edge(self.data, edge_id, set_properties, remove_properties), {"edges"}, "update_edge")
        return self.get_edge(edge_id)

    def delete_node(self, node_id: int, *, detach: bool = False) -> None:
        self._publish(mutate.delete_nodes(self.data, [node_id], detach)[0], {"nodes", "edges", "vectors"}, "delete_node")

    def delete_edge(self, edge_id: int) -> None:
        self._publish(mutate.delete_edges(self.data, [edge_id]), {"edges", "vectors"}, "delete_edge")

    def cypher(self, text: str, parameters: dict[str, Any] | None = None, profile: bool = False) -> dict[str, Any]:
        s = cypher.parse(text)
        if not s.is_write:
            return super().cypher(text, parameters, profile)
        data, answer = _write(self.data, s, parameters or {}, profile)
        self._publish(data, changed_tables(self.data, data), "cypher")
        return answer

    # Indexes

    def create_fulltext_index(self, name: str, properties: list[str], target: str = "node", tokenizer: str = "unicode61") -> None:
        self._publish(mutate.create_fulltext_index(self.data, name, properties, target, tokenizer), set(), "create_fulltext_index")

    def drop_fulltext_index(self, name: str) -> None:
        self._publish(mutate.drop_index(self.data, "fulltext", name), set(), "drop_fulltext_index")

    def rebuild_fulltext_index(self, name: str | None = None) -> None:
        """Write the word tables of one index or all, which serve searches until the graph changes.

        A search without a current table reads the properties themselves, with equal results.
        """
        names = [name] if name is not None else sorted(self.data.fulltext)
        for n in names:
            index = mutate.index_of(self.data, "fulltext", n)
            if index["tokenizer"] == "unicode61":
                path = f"{traversal.shared_dir(self.spark)}/tokens-{uuid.uuid4().hex}"
                self.tokens[n] = self.data.version, search.token_table(self.data, index, path)

    def _tokens(self, index_name: str) -> DataFrame | None:
        version, table = self.tokens.get(index_name, (None, None))
        return table if version == self.data.version else None

    def create_vector_index(self, name: str, dimensions: int, target: str = "node", metric: str = "cosine", model: str | None = None, model_version: str | None = None) -> None:
        self._publish(mutate.create_vector_index(self.data, name, dimensions, target, metric, model, model_version), set(), "create_vector_index")

    def drop_vector_index(self, name: str) -> None:
        self._publish(mutate.drop_index(self.data, "vector", name), {"vectors"}, "drop_vector_index")

    def upsert_vectors(self, index_name: str, vectors: dict[int, list[float]]) -> None:
        self._publish(mutate.upsert_vectors(self.data, index_name, vectors), {"vectors"}, "upsert_vectors")

    def upsert_vector(self, index_name: str, entity_id: int, vector: list[float]) -> None:
        self.upsert_vectors(index_name, {entity_id: vector})

    def delete_vectors(self, index_name: str, entity_ids: list[int]) -> None:
        self._publish(mutate.delete_vectors(self.data, index_name, entity_ids), {"vectors"}, "delete_vectors")

    def delete_vector(self, index_name: str, entity_id: int) -> None:
        self.delete_vectors(index_name, [entity_id])

    # Import

    def _import(self, table: str, rows: DataFrame, operation: str) -> list[int]:
        add = mutate.add_node_rows if table == "nodes" else mutate.add_edge_rows
        data, ids = add(self.data, rows)
        self._add(data, table, ids, operation)
        return ids

    def import_nodes_csv(self, path: str) -> list[int]:
        return self._import("nodes", files.node_rows_csv(self.spark, path), "import_nodes_csv")

    def import_edges_csv(self, path: str) -> list[int]:
        return self._import("edges", files.edge_rows_csv(self.spark, path), "import_edges_csv")

    def import_nodes_jsonl(self, path: str) -> list[int]:
        return self._import("nodes", files.node_rows_jsonl(self.spark, path), "import_nodes_jsonl")

    def import_edges_jsonl(self, path: str) -> list[int]:
        return self._import("edges", files.edge_rows_jsonl(self.spark, path), "import_edges_jsonl")

    # Hybrid retrieval

    def retrieve_context(self, *, text_query=None, text_index=None, vector_query=None, vector_index=None, **options) -> list[dict[str, Any]]:
        indexes = {
            "text_index": mutate.index_of(self.data, "fulltext", text_index) if text_index is not None else None,
            "vector_index": mutate.index_of(self.data, "vector", vector_index) if vector_index is not None else None,
        }
        rows = search.retrieve_context(self.data, text_query=text_query, vector_query=vector_query, **indexes, **options).collect()
        records = {
            (kind, r.id): mutate.python_record(r, kind)
            for kind, table in (("node", self.data.node_table()), ("edge", self.data.edge_table()))
            if (ids := [r.id for r in rows if r.kind == kind])
            for r in table.where(F.col("id").isin(*ids)).collect()
        }
        scores = lambda r: {s: r[f"{s}_score"] for s in ("text", "vector") if r[f"{s}_score"] is not None}
        return [{"kind": r.kind, "id": r.id, "score": r.score, "distance": r.distance, "source_scores": scores(r), "record": records[r.kind, r.id]} for r in rows]

    # Propagation and inference

    def propagate(self, seeds: dict[int, float], steps: int, edge_property: str = "probability", damping: float = 1.0, edge_type: str | None = None) -> dict[int, float]:
        return {r.node: r.score for r in traversal.propagate(self.data, seeds, steps, edge_property, damping, edge_type).orderBy("node").collect()}

    def local_propagate(self, seeds: dict[int, float], radius: int = 2, query_nodes: list[int] | None = None, edge_type: str | None = None, edge_property: str = "probability", damping: float = 1.0) -> dict[int, float]:
        return {r.node: r.score for r in traversal.local_propagate(self.data, seeds, radius, query_nodes, edge_type, edge_property, damping).orderBy("node").collect()}

    def _append(self, table: str, counter: str, row: Callable[[int], tuple], more: dict[str, Callable[[int], tuple]] | None = None) -> int:
        """Publish a row with the next id, and the rows of other tables that belong to it, as one version."""
        ident, data, new = self.data.counters.get(counter, 0), self.data, {}
        for name, made in {table: row, **(more or {})}.items():
            new[name] = self.spark.createDataFrame([made(ident)], TABLES[name])
            data = data.with_table(name, data.table(name).unionByName(new[name]))
        self._publish(data.with_(counters={**data.counters, counter: ident + 1}), set(), f"add_{counter}", new)
        return ident

    def _props(self, properties: dict[str, Any] | None) -> dict[str, tuple]:
        return {k: pv_tuple(v) for k, v in mutate.check_properties(properties).items()}

    def add_variable(self, domain: str, owner_id: int | None = None, prior=None, posterior=None, states: list[str] | None = None) -> int:
        mutate.not_empty("variable domain", domain)
        if domain == "binary" and states is None:
            states = ["false", "true"]
        if not states:
            raise ValueError("variable states cannot be empty")
        if len(set(states)) < len(states):
            raise ValueError("variable states must be unique")
        for s in states:
            mutate.not_empty("variable state", s)
        if owner_id is not None:
            traversal.require_nodes(self.data, [owner_id])
        return self._append("variables", "variable", lambda i: (i, owner_id, domain, states, self._props(prior), self._props(posterior)))

    def _states(self, ids: list[int]) -> dict[int, list[str]]:
        return {k: v.states for k, v in inference._wanted(self.data, list(dict.fromkeys(ids))).items()}

    def add_factor(self, input_variables: list[int], output_variables: list[int], function: str, parameters=None) -> int:
        mutate.not_empty("factor function", function)
        self._states([*input_variables, *output_variables])
        return self._append("factors", "factor", lambda i: (i, list(input_variables), list(output_variables), function, self._props(parameters)))

    def _factor_table(self, variables: list[int], values: list[float], is_cpd: bool) -> int:
        import math

        if not variables:
            raise ValueError("factor table variables cannot be empty")
        if len(set(variables)) < len(variables):
            raise ValueError("factor table variables must be unique")
        states = self._states(variables)
        size = math.prod(len(states[v]) for v in variables)
        if len(values) != size:
            raise ValueError(f"factor table has {len(values)} values but expected {size}")
        if any(not math.isfinite(x) or x < 0 for x in values):
            raise ValueError("factor table values must be finite and non-negative")
        if not any(values):
            raise ValueError("factor table cannot be all zero")
        if is_cpd:
            n = len(states[variables[0]])
            for i in range(0, size, n):
                if abs(sum(values[i : i + n]) - 1.0) > 1e-9:
                    raise ValueError("conditional distribution must sum to 1.0")
        inputs, outputs = (variables[1:], variables[:1]) if is_cpd else (variables, [])
        name = "cpd" if is_cpd else "table"
        table = lambda i: (i, list(variables), [float(x) for x in values], is_cpd)
        return self._append("factors", "factor", lambda i: (i, list(inputs), list(outputs), name, {}), {"factor_tables": table})

    def add_factor_table(self, variables: list[int], values: list[float]) -> int:
        return self._factor_table(list(variables), list(values), False)

    def add_cpd(self, variable_id: int, parent_variables: list[int], values: list[float]) -> int:
        return self._factor_table([variable_id, *parent_variables], list(values), True)

    def add_evidence(self, variable_id: int, payload: dict[str, Any] | None = None) -> int:
        self._states([variable_id])
        return self._append("evidence", "evidence", lambda i: (i, variable_id, self._props(payload)))

    def add_trace(self, payload: dict[str, Any] | None = None) -> int:
        return self._append("traces", "trace", lambda i: (i, self._props(payload)))

    def compile_active_subgraph(self, query_variables: list[int], evidence: dict[int, str] | None = None, radius: int = 2, max_nodes: int = 10_000, max_factors: int = 50_000) -> dict[str, Any]:
        return inference.compile_active_subgraph(self.data, query_variables, evidence, radius, max_nodes, max_factors).as_dict()

    def belief_propagation(self, query_variables=None, evidence=None, radius: int = 2, max_iters: int = 1000, tolerance: float = 1e-6, damping: float = 0.2, persist: bool = False) -> dict[str, Any]:
        out = inference.belief_propagation(self.data, query_variables, evidence, radius, max_iters, tolerance, damping)
        if persist:
            rows = [(v, [float(p) for p in b.values()]) for v, b in out["beliefs"].items()]
            if rows:
                new = self.spark.createDataFrame(rows, TABLES["posteriors"])
                kept = self.data.table("posteriors").join(new.select("variable_id"), "variable_id", "left_anti")
                self._publish(self.data.with_table("posteriors", kept.unionByName(new)), {"posteriors"}, "belief_propagation")
            d = out["diagnostics"]
            payload = {"kind": "belief_propagation", "schedule": out["schedule"], "iterations": d["iterations"], "messages_updated": d["messages_updated"], "converged": d["converged"], "max_residual": float(d["max_residual"]), "active_variables": d["active_variables"], "active_factors": d["active_factors"]}
            out["trace_id"] = self.add_trace(payload)
        return out

    def posterior(self, variable_id: int) -> dict[str, float]:
        return inference.posterior(self.data, variable_id)


def changed_tables(before: GraphData, after: GraphData) -> set[str]:
    """The tables that are not the same frames in both states."""
    out = {k for k, v in after.tables.items() if before.tables.get(k) is not v}
    same = lambda a, b: len(a) == len(b) and all(x.df is y.df for x, y in zip(a, b, strict=True))
    return out | {k for k in ("nodes", "edges") if not same(getattr(before, k), getattr(after, k))}


def _write(data: GraphData, s, params: dict[str, Any], profile: bool) -> tuple[GraphData, dict[str, Any]]:
    out, keys, rows, summary = cypher_write.write(data, s, params)
    answer = {"keys": keys, "records": [dict(zip(keys, r, strict=True)) for r in rows], "summary": summary}
    if profile:
        answer["profile"] = cypher.profile_of(s) | {"rows": len(rows)}
    return out, answer


class Transaction:
    """Staged writes. A failed statement leaves the staged state as it was."""

    def __init__(self, graph: Graph, write: bool):
        self.graph, self.write, self.active = graph, write, True
        self.base, self.start, self.data, self.dirty = graph.data.version, graph.data, graph.data, False

    def _check(self) -> None:
        if not self.active:
            raise RuntimeError("transaction is no longer active")

    def run(self, text: str, parameters: dict[str, Any] | None = None, profile: bool = False) -> dict[str, Any]:
        self._check()
        s = cypher.parse(text)
        if not s.is_write:
            return _answer(cypher.read(self.data, text, parameters), profile)
        if not self.write:
            raise cypher.CypherError("write query requires a writable Graph transaction")
        self.data, answer = _write(self.data, s, parameters or {}, profile)
        self.dirty = True
        return answer

    def commit(self) -> None:
        self._check()
        self.active = False
        if not self.dirty:
            return
        if self.graph.data.version != self.base:
            raise StaleGraph("graph changed since transaction started")
        self.graph._publish(self.data, changed_tables(self.start, self.data), "transaction")

    def rollback(self) -> None:
        self._check()
        self.active = False

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.active:
            self.rollback() if kind else self.commit()


def query_nl(graph: Snapshot, question: str, compiler: Callable[[str, dict], dict], *, schema: dict | None = None):
    return dsl.query_nl(graph, question, compiler, schema_=schema)


__all__ = ["Graph", "Snapshot", "StaleGraph", "Transaction", "kind_of", "query_nl"]
