"""The property-graph data model over DataFrames.

A graph is a list of node sources and edge sources. A source is either a property
table (``props``: map of tagged values, any labels per row) or a native table: a
plain columnar DataFrame whose labels or edge type are fixed and whose property
columns keep their own types. Native tables are how large graphs are read: a
pattern on a label touches that label's tables only, and its filters and columns
are pushed into their scans.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.values import PV, Value, pv_column

PROPS = f"map<string,{PV}>"
NODES = f"id bigint, external_id string, labels array<string>, props {PROPS}"
EDGES = f"id bigint, src bigint, dst bigint, edge_type string, props {PROPS}"
VECTORS = "index_name string, entity_id bigint, vector array<float>"
VARIABLES = f"id bigint, owner_id bigint, domain string, states array<string>, prior {PROPS}, posterior {PROPS}"
FACTORS = f"id bigint, input_variables array<bigint>, output_variables array<bigint>, function string, parameters {PROPS}"
FACTOR_TABLES = "factor_id bigint, variables array<bigint>, values array<double>, is_cpd boolean"
POSTERIORS = "variable_id bigint, distribution array<double>"
EVIDENCE = f"id bigint, variable_id bigint, payload {PROPS}"
TRACES = f"id bigint, payload {PROPS}"
TABLES = {
    "nodes": NODES,
    "edges": EDGES,
    "vectors": VECTORS,
    "variables": VARIABLES,
    "factors": FACTORS,
    "factor_tables": FACTOR_TABLES,
    "posteriors": POSTERIORS,
    "evidence": EVIDENCE,
    "traces": TRACES,
}

_KINDS = {T.BooleanType: "bool", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.FloatType: "float", T.DoubleType: "float", T.StringType: "string"}


def native_kind(data_type: T.DataType) -> str:
    for base, kind in _KINDS.items():
        if isinstance(data_type, base):
            return kind
    raise TypeError(f"{data_type.simpleString()} is not a property type; cast it to a string or a number")


@dataclass(frozen=True)
class Source:
    """Nodes or edges. ``names`` are the fixed labels or the fixed edge type; None: a column has them."""

    df: DataFrame
    names: tuple[str, ...] | None = None
    kinds: dict[str, str] | None = None

    @property
    def native(self) -> bool:
        return self.kinds is not None


def native_nodes(df: DataFrame, label: str | Iterable[str], key: str, base: int = 0, external: str | None = None) -> Source:
    """A columnar table as nodes: id is ``key`` + ``base``, every other column a property."""
    labels = (label,) if isinstance(label, str) else tuple(label)
    cols, kinds = [], {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            cols.append(F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss").alias(f.name))
            kinds[f.name] = "string"
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)):
            kinds[f.name] = native_kind(f.dataType)
            wide = {"int": "bigint", "float": "double"}.get(kinds[f.name])
            cols.append(F.col(f.name).cast(wide).alias(f.name) if wide else F.col(f.name))
    name = F.col(external) if external else F.concat(F.lit(f"{labels[0].lower()}:"), F.col(key).cast("string"))
    return Source(df.select((F.col(key) + base).cast("bigint").alias("id"), name.alias("external_id"), *cols), labels, kinds)


def native_edges(df: DataFrame, edge_type: str, id: Column, src: Column, dst: Column, properties: dict[str, Column] | None = None) -> Source:
    """A columnar table as edges of one type."""
    out = df.select(id.cast("bigint").alias("id"), src.cast("bigint").alias("src"), dst.cast("bigint").alias("dst"), *[c.alias(k) for k, c in (properties or {}).items()])
    kinds = {k: native_kind(out.schema[k].dataType) for k in properties or {}}
    wide = {"int": "bigint", "float": "double"}
    out = out.select("id", "src", "dst", *[F.col(k).cast(wide[t]).alias(k) if t in wide else F.col(k) for k, t in kinds.items()])
    return Source(out, (edge_type,), kinds)


@dataclass(frozen=True)
class Scan:
    """A scan's rows and the values of its requested properties, by column prefix ``p_``."""

    df: DataFrame
    kinds: dict[str, str]


def _property(source: Source, key: str) -> Value:
    if source.native:
        return Value(source.kinds[key], F.col(f"`{key}`")) if key in source.kinds else Value("null", F.lit(None))
    return Value("any", F.col("props")[key])


def _map(source: Source) -> Column:
    if not source.native:
        return F.col("props")
    if not source.kinds:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{PV}>"))
    pairs = F.array(*[F.struct(F.lit(k), pv_column(t, F.col(f"`{k}`"))) for k, t in source.kinds.items()])
    return F.map_from_entries(F.filter(pairs, lambda x: x["col2"].isNotNull()))


def scan(sources: tuple[Source, ...], ids: list[str], names: Iterable[str], keys: Iterable[str], whole: bool, spark: SparkSession, edges: bool) -> Scan:
    """Rows of the sources that can have ``names``, with ``ids`` and the properties asked for."""
    names, keys = tuple(names), tuple(sorted(keys))
    column = "edge_type" if edges else "labels"
    fit = [s for s in sources if s.names is None or set(names) <= set(s.names)]
    kinds = {}
    for k in keys:
        seen = {_property(s, k).kind for s in fit} - {"null"}
        kinds[k] = seen.pop() if len(seen) == 1 else "any" if seen else "null"
    parts = []
    for s in fit:
        df = s.df
        if s.names is None:
            for n in names:
                df = df.where(F.col("edge_type") == n if edges else F.array_contains("labels", n))
        cols = [F.col(c) for c in ids]
        cols.append(F.col(column) if s.names is None else F.lit(s.names[0]).alias(column) if edges else F.array(*map(F.lit, s.names)).alias(column))
        for k in keys:
            v, kind = _property(s, k), kinds[k]
            if kind == "any":
                c = F.lit(None).cast(PV) if v.kind == "null" else pv_column(v.kind, v.column)
            else:
                c = v.column if v.kind != "null" else F.lit(None).cast({"int": "bigint", "float": "double", "bool": "boolean"}.get(kind, "string"))
            cols.append(c.alias(f"p_{k}"))
        if whole:
            cols.append(_map(s).alias("props"))
        parts.append(df.select(*cols))
    if not parts:
        schema = ", ".join(f"{c} {'string' if c == 'external_id' else 'bigint'}" for c in ids)
        schema += f", {column} {'string' if edges else 'array<string>'}" + "".join(f", `p_{k}` string" for k in keys) + (f", props {PROPS}" if whole else "")
        return Scan(spark.createDataFrame([], schema), dict.fromkeys(keys, "null"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return Scan(out, kinds)


@dataclass(frozen=True)
class GraphData:
    """An immutable state of a graph; mutations make a new one that shares the rest."""

    spark: SparkSession
    nodes: tuple[Source, ...] = ()
    edges: tuple[Source, ...] = ()
    tables: dict[str, DataFrame] = field(default_factory=dict)
    fulltext: dict[str, dict] = field(default_factory=dict)
    vector: dict[str, dict] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)
    version: int = 0

    def with_(self, **changes) -> GraphData:
        return replace(self, **changes)

    def table(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else self.spark.createDataFrame([], TABLES[name])

    def with_table(self, name: str, df: DataFrame) -> GraphData:
        return replace(self, tables={**self.tables, name: df})

    def node_scan(self, labels=(), keys=(), whole=False) -> Scan:
        return scan(self.nodes, ["id", "external_id"], labels, keys, whole, self.spark, False)

    def edge_scan(self, edge_type: str | None = None, keys=(), whole=False) -> Scan:
        return scan(self.edges, ["id", "src", "dst"], (edge_type,) if edge_type is not None else (), keys, whole, self.spark, True)

    def node_table(self) -> DataFrame:
        return self.node_scan(whole=True).df

    def edge_table(self) -> DataFrame:
        return self.edge_scan(whole=True).df.select("id", "src", "dst", "edge_type", "props")


def subscript(scan_: Scan, key: str) -> Value:
    """A property of a scan's rows."""
    return Value(scan_.kinds.get(key, "null"), F.col(f"`p_{key}`") if key in scan_.kinds else F.lit(None))
