"""Logical graphs inside one physical graph, and a registry of graphs and snapshots.

A logical graph is the set of nodes and edges that carry its id under a reserved
property. Writes through it stamp the property, queries and searches are given an
equality on it, and traversals and algorithms run on the induced subgraph.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from copy import deepcopy
from typing import Any

from .functions.values import strict_predicate
from .graph import Graph, Snapshot
from .model import subscript
from .operators import algorithms
from .sources.files import guarded

PROPERTY = "_logical_graph_id"
SNAPSHOT_TTL, LONGEST_TTL = 600.0, 3600.0


class LogicalGraph:
    """One logical graph of ``graph``. External ids stay unique over the physical graph."""

    def __init__(self, graph: Graph, name: str):
        if not name:
            raise ValueError("logical graph id cannot be empty")
        self.graph, self.name = graph, name

    def _stamp(self, properties: dict[str, Any] | None) -> dict[str, Any]:
        out = dict(properties or {})
        if PROPERTY in out:
            raise ValueError(f"property {PROPERTY} is reserved")
        return out | {PROPERTY: self.name}

    def _ids(self):
        s = self.graph.data.node_scan((), [PROPERTY])
        return s.df.where(strict_predicate(subscript(s, PROPERTY), "eq", self.name)).select("id")

    def add_nodes(self, records: list[dict[str, Any]]) -> list[int]:
        return self.graph.add_nodes([{**r, "properties": self._stamp(r.get("properties"))} for r in records])

    def add_edges(self, records: list[dict[str, Any]]) -> list[int]:
        ends = {r[k] for r in records for k in ("source", "target")}
        mine = {r.id for r in self._ids().where(f"id in ({','.join(map(str, map(int, ends)))})").collect()} if ends else set()
        for x in sorted(ends - mine):
            raise ValueError(f"node {x} is not in logical graph {self.name}")
        return self.graph.add_edges([{**r, "properties": self._stamp(r.get("properties"))} for r in records])

    def scope(self, spec: dict[str, Any]) -> dict[str, Any]:
        """A query with the reserved equality on every named pattern; edges without a name stay as they are."""
        out = deepcopy(spec)
        for p in out.get("match") or []:
            if not isinstance(p, dict) or not ("node" in p or "edge" in p):
                continue
            for f in p.get("where") or []:
                if isinstance(f, dict) and f.get("property") == PROPERTY and (f.get("op", "eq"), f.get("value")) != ("eq", self.name):
                    raise ValueError("query scope conflicts with the logical graph")
            own = dict(p.get("properties") or {})
            if own.get(PROPERTY, self.name) != self.name:
                raise ValueError("query scope conflicts with the logical graph")
            p["properties"] = own | {PROPERTY: self.name}
        return out

    def query(self, spec: dict[str, Any]) -> list[dict[str, int]]:
        return self.graph.query(self.scope(spec))

    def _filter(self, properties: dict[str, Any] | None) -> dict[str, Any]:
        if properties and properties.get(PROPERTY, self.name) != self.name:
            raise ValueError("query scope conflicts with the logical graph")
        return {**(properties or {}), PROPERTY: self.name}

    def search_text(self, *args, properties=None, **options) -> list[dict[str, Any]]:
        return self.graph.search_text(*args, properties=self._filter(properties), **options)

    def search_vector(self, *args, properties=None, **options) -> list[dict[str, Any]]:
        return self.graph.search_vector(*args, properties=self._filter(properties), **options)

    def search_vectors(self, *args, properties=None, **options) -> list[list[dict[str, Any]]]:
        return self.graph.search_vectors(*args, properties=self._filter(properties), **options)

    def retrieve_context(self, *, properties=None, **options) -> list[dict[str, Any]]:
        """Candidates are scoped; what they expand to isn't."""
        return self.graph.retrieve_context(properties=self._filter(properties), **options)

    def view(self) -> Snapshot:
        """The induced subgraph, for traversals and algorithms."""
        return Snapshot(algorithms.subgraph(self.graph.data, self._ids()))

    def delete(self) -> int:
        """Delete all nodes of the logical graph with their edges; returns how many nodes."""
        from .operators import mutate
        from .operators.traversal import cut

        gone = cut(self._ids())
        n = gone.count()
        if n:
            data, _ = mutate.delete_nodes(self.graph.data, gone, detach=True)
            self.graph._publish(data, {"nodes", "edges", "vectors"}, "delete_logical_graph")
        return n


class Registry:
    """Graphs by name, and named snapshots that expire."""

    def __init__(self, spark, root: str | None = None, clock: Callable[[], float] = time.monotonic):
        self.spark, self.root, self.clock = spark, root, clock
        self.graphs: dict[str, Graph] = {}
        self.snapshots: dict[str, tuple[Snapshot, float]] = {}

    def open(self, name: str) -> Graph:
        if name not in self.graphs:
            self.graphs[name] = Graph(f"{self.root}/{name}" if self.root else None, self.spark)
        return self.graphs[name]

    def names(self) -> list[str]:
        return sorted(self.graphs)

    def backup(self, name: str, target: str) -> None:
        store = self.open(name).store
        if store is None:
            raise ValueError("only a stored graph can be backed up")
        store.backup(target)

    def restore(self, name: str, source: str, overwrite: bool = False) -> Graph:
        """Open ``name`` at a backup's state; an existing graph is replaced only where ``overwrite`` says so."""
        if not self.root:
            raise ValueError("only a stored graph can be restored")
        graph = self.open(name)
        graph.data = graph.store.restore(source, overwrite=overwrite)
        return graph

    # File import and export, under the registry's own folders only

    def _file(self, kind: str, path: str) -> str:
        if not self.root:
            raise ValueError("file import and export need a registry folder")
        return guarded(self.root, kind, path)

    def import_nodes(self, name: str, path: str, fmt: str = "csv") -> list[int]:
        file = self._file("imports", path)
        return self.open(name).import_nodes_csv(file) if fmt == "csv" else self.open(name).import_nodes_jsonl(file)

    def import_edges(self, name: str, path: str, fmt: str = "csv") -> list[int]:
        file = self._file("imports", path)
        return self.open(name).import_edges_csv(file) if fmt == "csv" else self.open(name).import_edges_jsonl(file)

    def export_nodes(self, name: str, path: str, nodes: list[int] | None = None) -> None:
        self.open(name).export_nodes_jsonl(self._file("exports", path), nodes)

    def export_edges(self, name: str, path: str, edges: list[int] | None = None) -> None:
        self.open(name).export_edges_jsonl(self._file("exports", path), edges)

    def snapshot(self, name: str, ttl: float = SNAPSHOT_TTL) -> str:
        if not 0 < ttl <= LONGEST_TTL:
            raise ValueError(f"ttl must be between 0 and {LONGEST_TTL:.0f} seconds")
        key = uuid.uuid4().hex
        self.snapshots[key] = self.open(name).snapshot(), self.clock() + ttl
        return key

    def get(self, key: str) -> Snapshot:
        self.snapshots = {k: v for k, v in self.snapshots.items() if v[1] > self.clock()}
        if key not in self.snapshots:
            raise KeyError(f"snapshot {key} not found or expired")
        return self.snapshots[key][0]
