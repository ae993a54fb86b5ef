"""The structured path-pattern language: strict parsing, validation and planning."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import kind_of, strict_predicate
from ..model import GraphData
from .pattern import EdgePattern, NodePattern, edge_rows, match_path, node_rows, Needs

OPERATORS = ("eq", "ne", "lt", "lte", "gt", "gte", "in", "contains")
DIRECTIONS = {"out": "out", "outgoing": "out", "in": "in", "incoming": "in", "both": "both", "all": "both"}
FIELDS = {
    "query": ("match", "return", "limit"),
    "node": ("node", "id", "external_id", "labels", "properties", "where"),
    "edge": ("edge", "id", "type", "direction", "properties", "where"),
    "filter": ("property", "op", "value"),
}


def direction(name: str) -> str:
    if name not in DIRECTIONS:
        raise ValueError("direction must be 'out', 'in', or 'both'")
    return DIRECTIONS[name]


#: What each field of a pattern or filter takes.
MEANING = {
    "node": "name that rows give the node under",
    "edge": "name that rows give the edge under; may be left out",
    "id": "this id only",
    "external_id": "this external id only",
    "labels": "labels that the node has, all of them",
    "type": "the edge's type",
    "direction": "which way the edge runs, seen from the node before it; out if left out",
    "properties": "values that properties equal, by key",
    "where": "filters, all of which hold",
    "property": "key that the filter looks at",
    "op": "comparison; eq if left out",
    "value": "what to compare with: a list for in, one scalar for all others",
}


def schema() -> dict[str, Any]:
    """The language's shape, for callers that compile to it."""
    fields = lambda kind: {"allowed_fields": list(FIELDS[kind])} | {f: MEANING[f] for f in FIELDS[kind]}
    return {
        "name": "path_query_v0",
        "description": "A path, given as nodes and edges in turn, to be matched in the graph.",
        "operators": list(OPERATORS),
        "directions": sorted(set(DIRECTIONS.values()), key=list(DIRECTIONS.values()).index),
        "top_level_fields": list(FIELDS["query"]),
        "return": "names to give back; all if left out",
        "limit": "how many rows at most, from 0",
        "node_pattern": fields("node"),
        "edge_pattern": fields("edge"),
        "where_filter": fields("filter"),
    }


def _strict(what: str, given: Any, allowed: str) -> dict:
    if not isinstance(given, dict):
        raise ValueError(f"{what} must be a dict")
    for k in given:
        if k not in FIELDS[allowed]:
            raise ValueError(f"{what} has unknown field '{k}'")
    return given


def _filters(what: str, given: dict) -> list[tuple[str, str, Any]]:
    out = []
    for k, v in (given.get("properties") or {}).items():
        kind_of(v)
        out.append((k, "eq", v))
    for f in given.get("where") or []:
        f = _strict(f"{what} filter", f, "filter")
        if not isinstance(f.get("property"), str):
            raise ValueError(f"{what} filter requires a property")
        if "value" not in f:
            raise ValueError(f"{what} filter requires a value")
        op, value = f.get("op", "eq"), f["value"]
        if op not in OPERATORS:
            raise ValueError(f"unsupported query filter operator '{op}'")
        if op == "in":
            if not isinstance(value, (list, tuple)):
                raise ValueError("query filter op 'in' requires a list value")
            for x in value:
                kind_of(x)
        elif isinstance(value, (list, tuple)):
            raise ValueError(f"query filter op '{op}' requires a scalar value")
        elif op == "contains" and not isinstance(value, str):
            raise ValueError("query filter op 'contains' requires a string value")
        else:
            kind_of(value)
        out.append((f["property"], op, value))
    for k, _, _ in out:
        if not k:
            raise ValueError("property key cannot be empty")
    return out


def _compiled(filters):
    return [((k,), lambda get, k=k, op=op, value=value: strict_predicate(get(k), op, value)) for k, op, value in filters]


def parse(spec: dict) -> tuple[list[NodePattern], list[EdgePattern], list[str], int | None]:
    """(nodes, edges, returned aliases, limit) of a valid spec."""
    spec = _strict("query", spec, "query")
    match = spec.get("match")
    if not isinstance(match, (list, tuple)) or not match:
        raise ValueError("query match must be a non-empty list")
    if len(match) % 2 == 0:
        raise ValueError("query match must alternate node, edge, node")
    nodes, edges, seen = [], [], {}
    for i, element in enumerate(match):
        if i % 2 == 0:
            if not isinstance(element, dict) or "node" not in element:
                raise ValueError("query match must alternate node, edge, node")
            element = _strict("node pattern", element, "node")
            name = element["node"]
            if not isinstance(name, str) or not name:
                raise ValueError("node alias cannot be empty")
            labels = tuple(element.get("labels") or ())
            if any(not isinstance(x, str) or not x for x in labels):
                raise ValueError("label cannot be empty")
            nodes.append(NodePattern(name, labels, element.get("id"), element.get("external_id"), _compiled(_filters("node pattern", element))))
            kind = "node"
        else:
            if not isinstance(element, dict) or "node" in element:
                raise ValueError("query match must alternate node, edge, node")
            element = _strict("edge pattern", element, "edge")
            name = element.get("edge")
            if name is not None and (not isinstance(name, str) or not name):
                raise ValueError("edge alias cannot be empty")
            if element.get("type") == "":
                raise ValueError("edge type cannot be empty")
            edges.append(EdgePattern(name, element.get("type"), element.get("id"), direction(element.get("direction", "out")), _compiled(_filters("edge pattern", element))))
            kind = "edge"
        if name is not None:
            if seen.setdefault(name, kind) != kind:
                raise ValueError(f"alias '{name}' cannot refer to both nodes and edges")
    returns = spec.get("return")
    if returns is None:
        returns = list(seen)
    else:
        for i, a in enumerate(returns):
            if a not in seen:
                raise ValueError(f"return alias '{a}' is not declared in match")
            if a in returns[:i]:
                raise ValueError(f"return alias '{a}' is repeated")
        returns = list(returns)
    limit = spec.get("limit")
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 0):
        raise ValueError("limit must be a non-negative integer")
    return nodes, edges, returns, limit


def anchor(data: GraphData, nodes: list[NodePattern]) -> tuple[int, int]:
    """The node pattern with the fewest candidates, the leftmost of equals, and their count.

    One job counts all patterns; it is only run where a row order shows.
    """
    from functools import reduce

    counts = [node_rows(data, "n", p, Needs())[0].agg(F.count(F.lit(1)).alias("n")).withColumn("i", F.lit(i)) for i, p in enumerate(nodes)]
    rows = reduce(DataFrame.unionAll, counts).collect()
    best = min(rows, key=lambda r: (r.n, r.i))
    return best.i, best.n


def order_keys(at: int, hops: int) -> list[str]:
    """Row order: the anchor, then hops to the left outward, then hops to the right."""
    keys = [f"n{at}_id"]
    for i in [*range(at - 1, -1, -1), *range(at, hops)]:
        keys += [f"e{i}_dir", f"e{i}_id"]
    return keys


def query(data: GraphData, spec: dict) -> DataFrame:
    """A column of ids for each returned alias."""
    nodes, edges, returns, limit = parse(spec)
    found = match_path(data, nodes, edges, {})
    df = found.df
    if limit is not None and limit > 0:
        at, _ = anchor(data, nodes)
        keys = []
        for k in order_keys(at, len(edges)):
            # Seen from the anchor, a hop to the left runs against its edge pattern.
            turn = k.endswith("_dir") and int(k[1:-4]) < at
            keys.append((F.lit(1) - F.col(k)) if turn else F.col(k))
        df = df.orderBy(*keys).limit(limit)
    elif limit == 0:
        df = df.limit(0)
    return df.select(*[found.id(a).alias(a) for a in returns])


def profile(data: GraphData, spec: dict) -> dict[str, Any]:
    """Counters of a query's work, beside its result count."""
    began = time.perf_counter_ns()
    nodes, edges, returns, _ = parse(spec)
    at, candidates = anchor(data, nodes)
    expanded = kept = 0
    for e in edges:
        every = EdgePattern(None, None, None, e.direction)
        expanded += edge_rows(data, "e", every, Needs())[0].count()
        kept += edge_rows(data, "e", e, Needs())[0].count()
    n = query(data, spec).count()
    return {
        "plan_steps": [f"anchor on node pattern {at}", *[f"expand edge pattern {i}" for i in range(len(edges))], "project " + ", ".join(returns)],
        "chosen_anchor_index": at,
        "chosen_anchor_alias": nodes[at].name,
        "anchor_candidates": candidates,
        "expanded_edges": expanded,
        "filtered_edges": expanded - kept,
        "filtered_nodes": 0,
        "alias_conflicts": 0,
        "result_count": n,
        "elapsed_ns": time.perf_counter_ns() - began,
    }


def query_nl(graph, question: str, compiler: Callable[[str, dict], dict], *, schema_: dict | None = None):
    """Answer a question with a spec that the caller's compiler makes of it and the schema."""
    return graph.query(compiler(question, schema_ or schema()))
