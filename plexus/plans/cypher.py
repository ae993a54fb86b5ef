"""Cypher reads as one lazy DataFrame: match, filter, pad, project, sort, page."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import FIELDS, Value, contains, equal, is_in, ordered, pv_column, pv_python, sort_keys, unequal
from ..model import GraphData
from .cypher_parser import CypherError, Path, Projection, Statement, parse, uses
from .pattern import Bindings, EdgePattern, Needs, NodePattern, edge_record, join_paths, match_path, node_record

ONE = "__one"


class MissingParameter(CypherError):
    def __init__(self, name: str):
        super().__init__(f"missing Cypher parameter ${name}")


@dataclass
class Result:
    """keys in return order; ``df`` has a column for each, in that order."""

    df: DataFrame
    keys: list[str]
    kinds: list[str]
    summary: dict[str, Any] = field(default_factory=dict)
    profile: dict[str, Any] | None = None

    def records(self) -> list[dict[str, Any]]:
        """Rows as dicts, properties as plain Python values."""
        return [dict(zip(self.keys, map(_python, row), strict=True)) for row in self.df.collect()]


def _python(x: Any) -> Any:
    if isinstance(x, T.Row):
        d = x.asDict()
        if set(d) == {"t", *FIELDS.values()}:
            return pv_python(x)
        return {k: _python(v) for k, v in d.items()}
    if isinstance(x, dict):
        return {k: _python(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_python(v) for v in x]
    return x


@dataclass
class Scope:
    """Evaluates expressions over bindings."""

    data: GraphData
    found: Bindings | None
    params: dict[str, Any]

    def value(self, e: tuple) -> Value:
        kind = e[0]
        if kind == "lit":
            return Value.literal(e[1])
        if kind == "param":
            if e[1] not in self.params:
                raise MissingParameter(e[1])
            return Value.literal(self.params[e[1]])
        if kind == "list":
            return Value("list", None, [self.value(x) for x in e[1]])
        if kind == "map":
            return Value("map", None, {k: self.value(x) for k, x in e[1].items()})
        if kind == "count":
            raise CypherError("count cannot be mixed with other return items")
        name = e[2] if kind == "call" else e[1]
        if self.found is None or name not in self.found.tags:
            return Value("null", F.lit(None))
        tag, what = self.found.tags[name]
        if kind == "var":
            return self.found.record(name)
        if kind == "prop":
            v = self.found.value(name, e[2])
            if what == "node" and e[2] == "external_id":
                other = F.col(f"`{tag}_p_\0external_id`")
                if v.kind == "null":
                    return Value("string", other)
                if v.kind == "string":
                    return Value("string", F.coalesce(v.column, other))
                return Value("any", F.coalesce(pv_column(v.kind, v.column), pv_column("string", other)))
            return v
        ident = self.found.id(name)
        if e[1] == "id":
            return Value("int", ident)
        if e[1] == "elementid":
            return Value("string", F.concat(F.lit("node:" if what == "node" else "relationship:"), ident.cast("string")))
        if e[1] == "labels":
            return Value("list", F.col(f"`{tag}_p_\0labels`")) if what == "node" else Value("null", F.lit(None))
        if what != "edge":
            return Value("null", F.lit(None))
        if e[1] == "type":
            return Value("string", F.col(f"`{tag}_p_\0type`"))
        return Value("node", F.col(f"{tag}_{e[1]}"))

    def column(self, e: tuple) -> tuple[Column, str]:
        """An expression as an output column."""
        v = self.value(e)
        if v.kind == "list" and v.column is None:
            parts = [self.output(x) for x in v.items]
            return (F.array(*parts) if parts else F.array().cast("array<string>")), "list"
        if v.kind == "map":
            return F.struct(*[self.output(x).alias(k) for k, x in v.items.items()]), "map"
        return v.column.cast("string") if v.kind == "null" else v.column, v.kind

    def output(self, v: Value) -> Column:
        if v.kind == "list" and v.column is None:
            return F.array(*[self.output(x) for x in v.items])
        return v.column

    def test(self, left: tuple, op: str, right: tuple) -> Column:
        a, b = self.value(left), self.value(right)
        if op == "=":
            return equal(a, b, sure=False)
        if op in ("<>", "!="):
            return unequal(a, b)
        if op == "CONTAINS":
            return contains(a, b)
        if op == "IN":
            if b.kind == "list" and b.column is not None:
                return F.coalesce(F.array_contains(b.column, a.of("string")), F.lit(False))
            return is_in(a, b)
        return ordered(a, op, b)


def patterns(path: Path, params: dict[str, Any], data: GraphData) -> tuple[list[NodePattern], list[EdgePattern]]:
    scope = Scope(data, None, params)

    def inline(key: str, v: Value, node: bool):
        if node and key == "external_id":
            def test(get):
                own = get("external_id")
                seen = get("\0external_id")
                if own.kind == "null":
                    return equal(seen, v, sure=False)
                return F.when(own.present(), equal(own, v)).otherwise(equal(seen, v))

            return (("external_id", "\0external_id"), test)
        return ((key,), lambda get: equal(get(key), v, sure=False))

    nodes = [NodePattern(n.var, n.labels, None, None, [inline(k, scope.value(e), True) for k, e in n.properties.items()]) for n in path.nodes]
    rels = [EdgePattern(r.var, r.type, None, r.direction, [inline(k, scope.value(e), False) for k, e in r.properties.items()]) for r in path.rels]
    return nodes, rels


def needs_of(read: dict[str, set]) -> dict[str, Needs]:
    return {name: Needs({k for k in keys if k != "\0whole"}, "\0whole" in keys) for name, keys in read.items()}


def bind(data: GraphData, s: Statement, params: dict[str, Any], read: dict[str, set]) -> Bindings:
    """Rows of all patterns of a statement after WHERE."""
    for left, _, right in s.where:
        uses(left, read)
        uses(right, read)
    needs = needs_of(read)
    found = None
    for i, path in enumerate(s.paths):
        nodes, rels = patterns(path, params, data)
        one = match_path(data, nodes, rels, needs, f"q{i}" if i else "")
        found = one if found is None else join_paths(found, one)
    for name, (tag, what) in found.tags.items():
        for mark, fn in (("\0src", "startnode"), ("\0dst", "endnode")):
            if what == "edge" and mark in needs.get(name, Needs()).keys:
                ends = data.node_scan(whole=True).df.select(F.col("id").alias(f"{tag}_{fn}_id"), node_record().alias(f"{tag}_{fn}"))
                found.df = found.df.join(ends, F.col(f"`{tag}_p_{mark}`") == F.col(f"{tag}_{fn}_id"))
    scope = Scope(data, found, params)
    for left, op, right in s.where:
        try:
            found.df = found.df.where(scope.test(left, op, right))
        except MissingParameter:
            # An error while a row is tested makes the row false.
            found.df = found.df.where(F.lit(False))
    return found


def _read_names(s: Statement) -> dict[str, set]:
    read: dict[str, set] = {}
    if s.projection:
        for item in s.projection.items:
            uses(item.expr, read)
        aliases = {i.key for i in s.projection.items}
        for e, _, source in s.projection.order:
            if source not in aliases:
                uses(e, read)
    return read


def project(data: GraphData, found: Bindings | None, p: Projection, params: dict[str, Any], one: DataFrame | None = None) -> tuple[DataFrame, list[str], list[str]]:
    df = found.df if found else one
    scope = Scope(data, found, params)
    keys = [i.key for i in p.items]
    if all(i.expr[0] == "count" for i in p.items):
        cols = []
        for k, item in enumerate(p.items):
            name = item.expr[1]
            if name is None:
                c = F.count(F.lit(1))
            elif found and name in found.tags:
                c = F.count(found.id(name))
            else:
                c = F.count(F.lit(None).cast("int"))
            cols.append(c.alias(f"c{k}"))
        return df.agg(*cols), keys, ["int"] * len(keys)
    if any(i.expr[0] == "count" for i in p.items):
        if df.limit(1).count():
            raise CypherError("count cannot be mixed with other return items")
        return df.limit(0).select(*[F.lit(None).cast("string").alias(f"c{k}") for k in range(len(keys))]), keys, ["null"] * len(keys)
    columns = [scope.column(i.expr) for i in p.items]
    cols = [c.alias(f"c{k}") for k, (c, _) in enumerate(columns)]
    if p.order or p.skip or p.limit is not None:
        sort: list[Column] = []
        for e, down, source in p.order:
            at = keys.index(source) if source in keys else None
            v = Value(columns[at][1], columns[at][0]) if at is not None else scope.value(e)
            sort += sort_keys(v, down)
        # The order of matches breaks ties, as a stable sort would.
        sort += [F.col(c).asc() for c in (found.order if found else [])]
        df = df.orderBy(*sort) if sort else df
        if p.skip:
            df = df.offset(p.skip)
        if p.limit is not None:
            df = df.limit(p.limit)
    return df.select(*cols), keys, [k for _, k in columns]


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.toDF(*keys) if len(set(keys)) == len(keys) else df


def plan_read(data: GraphData, s: Statement, params: dict[str, Any]) -> tuple[DataFrame, list[str], list[str]]:
    """Columns c0, c1, ... with their keys and kinds."""
    if s.kind == "union":
        parts = [plan_read(data, b, params) for b in s.branches]
        if any(p[1] != parts[0][1] for p in parts):
            raise CypherError("UNION queries must return the same columns")
        df, keys, kinds = parts[0]
        for other, _, _ in parts[1:]:
            df = df.unionAll(other)
        return df, keys, kinds
    if s.kind == "return":
        return project(data, None, s.projection, params, data.spark.range(1).select(F.lit(1).alias(ONE)))
    found = bind(data, s, params, _read_names(s))
    if s.optional:
        one = data.spark.range(1).select(F.lit(1).alias(ONE))
        found.df = one.join(found.df, F.lit(True), "left")
    return project(data, found, s.projection, params)


def profile_of(s: Statement) -> dict[str, Any]:
    out: dict[str, Any] = {"statement_type": "write" if s.is_write else "read"}
    if s.kind == "return":
        out |= {"clauses": ["RETURN"], "plan_steps": ["project constant row"]}
    elif s.kind == "union":
        out |= {"clauses": ["UNION"], "plan_steps": [f"execute {len(s.branches)} union branch(es)", "validate aligned return keys", "concatenate branch rows"]}
    elif s.kind in ("create", "merge"):
        verb = "create" if s.kind == "create" else "match-or-create"
        p = s.paths[0]
        out |= {"clauses": [s.kind.upper()], "plan_steps": [f"{verb} {len(p.nodes)} node pattern(s)", f"{verb} {len(p.rels)} relationship pattern(s)", "project write result"]}
    else:
        action = {"match": "project rows", "update": "apply updates"}.get(s.kind) or ("detach delete" if s.detach else "delete")
        clauses = ["OPTIONAL MATCH" if s.optional else "MATCH", *(["WHERE"] if s.where else []), action.upper()]
        nodes, rels = sum(len(p.nodes) for p in s.paths), sum(len(p.rels) for p in s.paths)
        out |= {"clauses": clauses, "plan_steps": [f"match {len(s.paths)} path pattern(s)", f"match {nodes} node pattern(s)", f"expand {rels} relationship pattern(s)", action]}
    return out


def summary(kind: str = "read", **counts: int) -> dict[str, Any]:
    names = ("nodes_created", "relationships_created", "properties_set", "properties_removed", "labels_added", "labels_removed", "nodes_deleted", "relationships_deleted", "rows")
    return {"statement_type": kind} | {n: counts.get(n, 0) for n in names}


def read(data: GraphData, text: str, params: dict[str, Any] | None = None) -> Result:
    """Plan a read query; nothing runs until the result is asked for."""
    s = parse(text)
    if s.is_write:
        raise CypherError("a snapshot cannot execute write queries")
    df, keys, kinds = plan_read(data, s, params or {})
    return Result(_renamed(df, keys), keys, kinds, summary("read"), profile_of(s))


__all__ = ["CypherError", "MissingParameter", "Result", "bind", "edge_record", "parse", "plan_read", "profile_of", "project", "read", "summary"]
