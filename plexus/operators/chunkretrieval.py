"""Batch retrieval of text chunks with their entities and the entities' neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embedding import Embedder
from ..model import GraphData, subscript
from .search import search_vectors
from .traversal import adjacency, cut, distinct_neighbors, number_within

MOST_RELATED = 20


def retrieve(data: GraphData, index: dict, queries: list[str], top_k: int = 5, labels: list[str] | None = None, hops: int = 1, chunk: str = "WikiChunk", entity: str = "WikiEntity", about: str = "ABOUT") -> DataFrame:
    """(query, position, id, score, text, entity, related) of the best chunks of each query.

    entity is the first node a chunk is ABOUT; related are entities within
    ``hops`` undirected steps over entities, nearest first, at most 20. Every
    query and hit goes through the same joins.
    """
    if top_k <= 0:
        raise ValueError("top_k must be greater than zero")
    model = Embedder(index["dimensions"])
    hits = cut(search_vectors(data, index, [model(q).tolist() for q in queries], labels=labels or [chunk], limit=top_k))
    entities = cut(data.node_scan((entity,)).df.select("id"))
    chunks = hits.select("id").distinct()
    out = distinct_neighbors(adjacency(data, "out", about).join(chunks.withColumnRenamed("id", "node"), "node", "left_semi"))
    out = out.join(entities.withColumnRenamed("id", "nbr"), "nbr", "left_semi")
    first = out.groupBy("node").agg(F.min_by("nbr", F.struct("dir", "edge_id")).alias("entity"))
    starts = first.select(F.col("entity").alias("start")).distinct()
    level = seen = cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("order")))
    adj = adjacency(data, "both").join(entities.withColumnRenamed("id", "nbr"), "nbr", "left_semi").select("node", "nbr", "dir", "edge_id")
    for depth in range(1, hops + 1):
        met = distinct_neighbors(adj.join(level.select("node").distinct(), "node", "left_semi")).join(level, "node")
        new = met.groupBy("start", F.col("nbr").alias("node")).agg(F.min(F.struct("order", "dir", "edge_id")).alias("via"))
        new = new.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        flat = new.select("start", "node", "via.order", "via.dir", "via.edge_id")
        level = cut(number_within(flat, "start", ["order", "dir", "edge_id", "node"], "place").select("start", "node", F.lit(depth).alias("depth"), F.col("place").alias("order")))
        if level.isEmpty():
            break
        seen = seen.unionAll(level)
    near = number_within(seen.where("depth > 0"), "start", ["depth", "order"], "place").where(F.col("place") < MOST_RELATED)
    related = near.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("r")).select(F.col("start").alias("entity"), F.col("r.node").alias("related"))
    s = data.node_scan((chunk,), ["text"])
    text = s.df.select("id", subscript(s, "text").of("string").alias("text"))
    joined = hits.join(text, "id", "left").join(first.withColumnRenamed("node", "id"), "id", "left").join(related, "entity", "left")
    return joined.select("query", "position", "id", "score", "text", "entity", F.coalesce("related", F.array().cast("array<long>")).alias("related"))
