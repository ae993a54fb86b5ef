"""Path patterns as join plans, shared by both query languages.

A path is nodes and edges in turn. Every hop is an equi-join of the rows so far
with the edges on one end, then, only where the next node has labels, filters or
columns of its own, with the nodes on the other; edges always join live nodes, so
a bare node needs no join. Filters stand on the scans, so Catalyst pushes them
into Parquet and is free to reorder the joins and to broadcast small sides.

Matching is homomorphic: nothing but a repeated name forces two elements to be
equal.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import Value
from ..model import GraphData, subscript

#: A filter: the property keys it reads and its predicate over a property getter.
Filter = tuple[tuple[str, ...], Callable[[Callable[[str], Value]], Column]]


@dataclass
class NodePattern:
    name: str | None = None
    labels: tuple[str, ...] = ()
    id: int | None = None
    external_id: str | None = None
    filters: list[Filter] = field(default_factory=list)

    def bare(self) -> bool:
        return not (self.labels or self.filters or self.external_id is not None)


@dataclass
class EdgePattern:
    name: str | None = None
    type: str | None = None
    id: int | None = None
    direction: str = "out"
    filters: list[Filter] = field(default_factory=list)


@dataclass
class Needs:
    """What the rest of a query reads of one element besides its id."""

    keys: set[str] = field(default_factory=set)
    whole: bool = False


@dataclass
class Bindings:
    """Matched rows. A name's columns are ``<tag>_id`` and, as needed, ``<tag>_p_<key>`` and ``<tag>_rec``."""

    df: DataFrame
    tags: dict[str, tuple[str, str]]  # name -> (tag, node/edge)
    kinds: dict[tuple[str, str], str]
    order: list[str]

    def id(self, name: str) -> Column:
        return F.col(f"{self.tags[name][0]}_id")

    def value(self, name: str, key: str) -> Value:
        tag = self.tags[name][0]
        kind = self.kinds.get((tag, key), "null")
        return Value(kind, F.lit(None) if kind == "null" else F.col(f"`{tag}_p_{key}`"))

    def record(self, name: str) -> Value:
        tag, kind = self.tags[name]
        return Value(kind, F.col(f"{tag}_rec"))


def node_record(whole: bool = True) -> Column:
    return F.struct("id", "external_id", "labels", F.col("props").alias("properties"))


def edge_record() -> Column:
    return F.struct("id", F.col("src").alias("source"), F.col("dst").alias("target"), "edge_type", F.col("props").alias("properties"))


EXTERNAL = "external_id"


def node_rows(data: GraphData, tag: str, p: NodePattern, need: Needs) -> tuple[DataFrame, dict]:
    keys = {k for ks, _ in p.filters for k in ks} | need.keys
    real = {k for k in keys if not k.startswith("\0")}
    s = data.node_scan(p.labels, real, need.whole)
    df = s.df
    if p.id is not None:
        df = df.where(F.col("id") == p.id)
    if p.external_id is not None:
        df = df.where(F.col("external_id") == p.external_id)

    def get(key: str) -> Value:
        return Value("string", F.col("external_id")) if key == "\0external_id" else subscript(s, key)

    for _, test in p.filters:
        df = df.where(test(get))
    cols = [F.col("id").alias(f"{tag}_id"), *[F.col(f"`p_{k}`").alias(f"{tag}_p_{k}") for k in sorted(need.keys & real)]]
    kinds = {(tag, k): s.kinds[k] for k in need.keys & real}
    if "\0external_id" in need.keys:
        cols.append(F.col("external_id").alias(f"{tag}_p_\0external_id"))
        kinds[(tag, "\0external_id")] = "string"
    if "\0labels" in need.keys:
        cols.append(F.col("labels").alias(f"{tag}_p_\0labels"))
        kinds[(tag, "\0labels")] = "list"
    if need.whole:
        cols.append(node_record().alias(f"{tag}_rec"))
    return df.select(*cols), kinds


def edge_rows(data: GraphData, tag: str, p: EdgePattern, need: Needs) -> tuple[DataFrame, dict]:
    """Oriented edges: near and far end, and dir 0 for out, 1 for in."""
    keys = {k for ks, _ in p.filters for k in ks} | need.keys
    real = {k for k in keys if not k.startswith("\0")}
    s = data.edge_scan(p.type, real, need.whole)
    df = s.df
    if p.id is not None:
        df = df.where(F.col("id") == p.id)
    for _, test in p.filters:
        df = df.where(test(lambda key: subscript(s, key)))
    cols = [F.col("id").alias(f"{tag}_id"), *[F.col(f"`p_{k}`").alias(f"{tag}_p_{k}") for k in sorted(need.keys & real)]]
    kinds = {(tag, k): s.kinds[k] for k in need.keys & real}
    for k, c, kind in (("\0type", "edge_type", "string"), ("\0src", "src", "int"), ("\0dst", "dst", "int")):
        if k in need.keys:
            cols.append(F.col(c).alias(f"{tag}_p_{k}"))
            kinds[(tag, k)] = kind
    if need.whole:
        cols.append(edge_record().alias(f"{tag}_rec"))
    out = df.select(F.col("src").alias(f"{tag}_near"), F.col("dst").alias(f"{tag}_far"), F.lit(0).alias(f"{tag}_dir"), *cols)
    into = df.where("src <> dst" if p.direction == "both" else "true").select(F.col("dst").alias(f"{tag}_near"), F.col("src").alias(f"{tag}_far"), F.lit(1).alias(f"{tag}_dir"), *cols)
    return ({"out": out, "in": into}.get(p.direction) if p.direction != "both" else out.unionAll(into)), kinds


def match_path(data: GraphData, nodes: list[NodePattern], edges: list[EdgePattern], needs: dict[str, Needs], prefix: str = "") -> Bindings:
    """Rows of one path."""
    tags: dict[str, tuple[str, str]] = {}
    kinds: dict[tuple[str, str], str] = {}
    none = Needs()
    need = lambda name: needs.get(name, none) if name else none
    first = f"{prefix}n0"
    df, k = node_rows(data, first, nodes[0], need(nodes[0].name))
    kinds |= k
    if nodes[0].name:
        tags[nodes[0].name] = (first, "node")
    order = [f"{first}_id"]
    at = f"{first}_id"
    for i, e in enumerate(edges):
        tag = f"{prefix}e{i}"
        again = e.name in tags if e.name else False
        rows, k = edge_rows(data, tag, e, none if again else need(e.name))
        kinds |= k
        df = df.join(rows, F.col(at) == F.col(f"{tag}_near"))
        if again:
            df = df.where(F.col(f"{tag}_id") == F.col(f"{tags[e.name][0]}_id"))
        elif e.name:
            tags[e.name] = (tag, "edge")
        n, node_tag = nodes[i + 1], f"{prefix}n{i + 1}"
        again = n.name in tags if n.name else False
        wanted = none if again else need(n.name)
        if n.bare() and not wanted.keys and not wanted.whole:
            df = df.withColumn(f"{node_tag}_id", F.col(f"{tag}_far"))
            if n.id is not None:
                df = df.where(F.col(f"{node_tag}_id") == n.id)
        else:
            rows, k = node_rows(data, node_tag, n, wanted)
            kinds |= k
            df = df.join(rows, F.col(f"{tag}_far") == F.col(f"{node_tag}_id"))
        if again:
            df = df.where(F.col(f"{node_tag}_id") == F.col(f"{tags[n.name][0]}_id"))
        elif n.name:
            tags[n.name] = (node_tag, "node")
        order += [f"{tag}_dir", f"{tag}_id"]
        at = f"{node_tag}_id"
    return Bindings(df, tags, kinds, order)


def join_paths(a: Bindings, b: Bindings) -> Bindings:
    """Natural join of two patterns on the elements they share; without any, their product."""
    shared = [n for n in b.tags if n in a.tags]
    for n in shared:
        if a.tags[n][1] != b.tags[n][1]:
            return Bindings(a.df.crossJoin(b.df.limit(0)), {**a.tags, **{k: v for k, v in b.tags.items() if k not in a.tags}}, {**b.kinds, **a.kinds}, a.order + b.order)
    if shared:
        on = F.lit(True)
        for n in shared:
            on = on & (F.col(f"{a.tags[n][0]}_id") == F.col(f"{b.tags[n][0]}_id"))
        df = a.df.join(b.df, on)
    else:
        df = a.df.crossJoin(b.df)  # the query asks for a product of unrelated patterns
    return Bindings(df, {**b.tags, **a.tags}, {**b.kinds, **a.kinds}, a.order + b.order)
