"""The driver's columnar tables as one property graph, read lazily and natively.

Node ids are a key plus a base for each label, edge ids likewise for each type,
so ids are disjoint and any engine can form them. Nothing is loaded here: each
label and type is a Parquet scan that a query touches only if its pattern can
match it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import GraphData, Source, native_edges, native_nodes

STEP = 1_000_000_000_000
LABELS = {n: i * STEP for i, n in enumerate(("Region", "Nation", "Customer", "Supplier", "Order", "Part", "Document", "Embedding", "Turn"), 1)}
TYPES = {n: i * STEP for i, n in enumerate(("IN_REGION", "IN_NATION", "SUPPLIER_IN_NATION", "PLACED", "CONTAINS", "SUPPLIED_BY", "FOLLOWS", "NEXT"), 1)}
LINES = 8  # line numbers are below this
TURNS = 1_000_000
TRADE = ("Region", "Nation", "Customer", "Supplier", "Order", "Part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plain(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c.removeprefix(prefix)) for c in df.columns])


def nodes(spark: SparkSession, sf_dir: str, label: str) -> Source:
    source = {"Region": ("region", "r_", "regionkey"), "Nation": ("nation", "n_", "nationkey"), "Customer": ("customer", "c_", "custkey"), "Supplier": ("supplier", "s_", "suppkey"), "Order": ("orders", "o_", "orderkey"), "Part": ("part", "p_", "partkey")}
    base = LABELS[label]
    if label in source:
        name, prefix, key = source[label]
        return native_nodes(_plain(table(spark, sf_dir, name), prefix), label, key, base)
    if label == "Document":
        return native_nodes(table(spark, sf_dir, "documents"), label, "doc_id", base)
    if label == "Embedding":
        return native_nodes(table(spark, sf_dir, "embeddings").select("vec_id", "label"), label, "vec_id", base)
    turns = table(spark, sf_dir, "conversations").withColumn("key", F.col("conv_id") * TURNS + F.col("turn"))
    return native_nodes(turns, label, "key", base)


def edges(spark: SparkSession, sf_dir: str, kind: str) -> list[Source]:
    at, t = LABELS, lambda name: table(spark, sf_dir, name)
    c = F.col
    if kind == "IN_REGION":
        return [native_edges(t("nation"), kind, c("n_nationkey") + TYPES[kind], c("n_nationkey") + at["Nation"], c("n_regionkey") + at["Region"])]
    if kind == "IN_NATION":
        return [
            native_edges(t("customer"), kind, c("c_custkey") + TYPES[kind], c("c_custkey") + at["Customer"], c("c_nationkey") + at["Nation"]),
            native_edges(t("supplier"), kind, c("s_suppkey") + TYPES["SUPPLIER_IN_NATION"], c("s_suppkey") + at["Supplier"], c("s_nationkey") + at["Nation"]),
        ]
    if kind == "PLACED":
        return [native_edges(t("orders"), kind, c("o_orderkey") + TYPES[kind], c("o_custkey") + at["Customer"], c("o_orderkey") + at["Order"], {"date": F.date_format("o_orderdate", "yyyy-MM-dd")})]
    line = c("l_orderkey") * LINES + c("l_linenumber")
    if kind == "CONTAINS":
        props = {"quantity": c("l_quantity"), "price": c("l_extendedprice"), "discount": c("l_discount"), "shipdate": F.date_format("l_shipdate", "yyyy-MM-dd")}
        return [native_edges(t("lineitem"), kind, line + TYPES[kind], c("l_orderkey") + at["Order"], c("l_partkey") + at["Part"], props)]
    if kind == "SUPPLIED_BY":
        return [native_edges(t("lineitem"), kind, line + TYPES[kind], c("l_partkey") + at["Part"], c("l_suppkey") + at["Supplier"])]
    if kind == "FOLLOWS":
        docs = t("documents").select("doc_id")
        nxt = docs.select((c("doc_id") - 1).alias("doc_id"))
        return [native_edges(docs.join(nxt, "doc_id"), kind, c("doc_id") + TYPES[kind], c("doc_id") + at["Document"], c("doc_id") + 1 + at["Document"])]
    turns = t("conversations").select("conv_id", "turn")
    nxt = turns.select("conv_id", (c("turn") - 1).alias("turn"))
    key = c("conv_id") * TURNS + c("turn")
    return [native_edges(turns.join(nxt, ["conv_id", "turn"]), "NEXT", key + TYPES["NEXT"], key + at["Turn"], key + 1 + at["Turn"])]


def graph(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = TRADE, types: tuple[str, ...] = ("IN_REGION", "IN_NATION", "PLACED", "CONTAINS", "SUPPLIED_BY")) -> GraphData:
    return GraphData(spark, tuple(nodes(spark, sf_dir, n) for n in labels), tuple(e for k in types for e in edges(spark, sf_dir, k)))


def geography(spark: SparkSession, sf_dir: str) -> GraphData:
    """Regions, nations, customers and suppliers."""
    return graph(spark, sf_dir, ("Region", "Nation", "Customer", "Supplier"), ("IN_REGION", "IN_NATION"))


def library(spark: SparkSession, sf_dir: str) -> GraphData:
    """Documents, each followed by the next, with a full-text index."""
    g = graph(spark, sf_dir, ("Document",), ("FOLLOWS",))
    return g.with_(fulltext={"docs": {"name": "docs", "target": "node", "properties": ["text", "source"], "tokenizer": "unicode61"}, "grams": {"name": "grams", "target": "node", "properties": ["text"], "tokenizer": "trigram"}})


def space(spark: SparkSession, sf_dir: str) -> GraphData:
    """Embeddings as nodes with an index for each metric."""
    g = graph(spark, sf_dir, ("Embedding",), ())
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + LABELS["Embedding"]).alias("entity_id"), F.col("embedding").alias("vector"))
    names = ("cosine", "dot", "euclidean")
    # A literal name a branch: a search of one index prunes the other branches.
    rows = reduce(DataFrame.unionAll, [vectors.select(F.lit(m).alias("index_name"), "entity_id", "vector") for m in names])
    index = {m: {"name": m, "target": "node", "dimensions": 64, "metric": m, "model": None, "model_version": None} for m in names}
    return g.with_table("vectors", rows).with_(vector=index)
