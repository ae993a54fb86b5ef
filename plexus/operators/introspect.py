"""Observed schema and statistics of a graph."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import pv_python
from ..model import GraphData


def label_histogram(data: GraphData) -> DataFrame:
    """(name, count) of node labels."""
    return data.node_scan().df.select(F.explode("labels").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("count"))


def type_histogram(data: GraphData) -> DataFrame:
    """(name, count) of edge types."""
    return data.edge_scan().df.groupBy(F.col("edge_type").alias("name")).agg(F.count(F.lit(1)).alias("count"))


def property_schema(rows: DataFrame, samples: int = 3) -> DataFrame:
    """(key, types, count, samples) over a property column: the first distinct values in id order.

    Values are reduced to one row each, pre-aggregated, before any ranking.
    """
    flat = rows.select("id", F.explode("props").alias("key", "value"))
    values = flat.groupBy("key", "value").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("key").orderBy("first")
    top = values.withColumn("place", F.row_number().over(w)).where(F.col("place") <= samples)
    top = top.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("s")).select("key", F.col("s.value").alias("samples"))
    whole = values.groupBy("key").agg(F.array_sort(F.collect_set("value.t")).alias("types"), F.sum("n").alias("count"))
    return whole.join(top, "key")


def _named(df: DataFrame) -> list[dict[str, Any]]:
    return [{"name": r.name, "count": r["count"]} for r in df.orderBy("name").collect()]


def _properties(df: DataFrame) -> list[dict[str, Any]]:
    return [{"key": r.key, "types": list(r.types), "count": r["count"], "samples": [pv_python(v) for v in r.samples]} for r in property_schema(df).orderBy("key").collect()]


def schema(data: GraphData) -> dict[str, Any]:
    return {
        "labels": _named(label_histogram(data)),
        "edge_types": _named(type_histogram(data)),
        "node_properties": _properties(data.node_table()),
        "edge_properties": _properties(data.edge_table()),
        "fulltext_indexes": [data.fulltext[k] for k in sorted(data.fulltext)],
        "vector_indexes": [data.vector[k] for k in sorted(data.vector)],
    }


def counts(data: GraphData) -> DataFrame:
    """(what, n) of all record kinds, in one plan."""
    parts = [("nodes", data.node_scan().df), ("edges", data.edge_scan().df)]
    parts += [(k, data.table(k)) for k in ("variables", "factors", "evidence", "traces", "vectors")]
    out = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionAll(one)
    return out


def stats(data: GraphData) -> dict[str, Any]:
    n = {r.what: r.n for r in counts(data).collect()}
    return {
        **{k: n[k] for k in ("nodes", "edges", "variables", "factors", "evidence", "traces")},
        "labels": _named(label_histogram(data)),
        "edge_types": _named(type_histogram(data)),
        "fulltext_indexes": len(data.fulltext),
        "vector_indexes": len(data.vector),
        "vectors": n["vectors"],
        "segment": {"base_edges": n["edges"], "delta_edges": 0},
    }
