"""Graph algorithms as iterative DataFrame plans."""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import GraphData, Source
from ..plans.dsl import direction as parse_direction
from .traversal import FOLD, adjacency, bfs, cut, distinct_neighbors, frontier_neighbors, number_within, require_nodes, shared_dir, weighted_edges

MULTIPLIER, INCREMENT, MASK = 6364136223846793005, 1442695040888963407, (1 << 64) - 1


def weighted_ends(data: GraphData, direction: str, edge_type: str | None, weight_property: str | None) -> DataFrame:
    """(node, nbr, dir, edge_id, w, valid) of every edge end, with the edge's weight."""
    if weight_property is None:
        return adjacency(data, direction, edge_type).withColumns({"w": F.lit(1.0), "valid": F.lit(True)})
    e = weighted_edges(data, weight_property, edge_type, 1.0)
    ends = lambda a, b, k: e.select(F.col(a).alias("node"), F.col(b).alias("nbr"), F.lit(k).alias("dir"), F.col("id").alias("edge_id"), "w", "valid")
    parts = {"out": ends("src", "dst", 0), "in": ends("dst", "src", 1)}
    way = parse_direction(direction)
    return parts[way] if way in parts else parts["out"].unionAll(parts["in"])


def weighted_neighbors(ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, nbr, w, valid) of the neighbours of ``nodes``: the first edge of each pair decides the weight."""
    mine = ends.join(nodes.select("node").distinct(), "node", "left_semi")
    first = mine.groupBy("node", "nbr").agg(F.min(F.struct("dir", "edge_id", "w", "valid")).alias("first"))
    return first.select("node", "nbr", "first.w", "first.valid")


def distances(data: GraphData, start: int, direction: str = "out", edge_type: str | None = None, weight_property: str | None = None) -> DataFrame:
    """(node, dist) of every node that ``start`` reaches.

    Each round reads the edges at the nodes that became nearer and writes those
    only; the rounds' tables are folded into one every few rounds.
    """
    ends = weighted_ends(data, direction, edge_type, weight_property)
    active = cut(data.spark.createDataFrame([(start, 0.0)], "node long, dist double"))
    least = lambda df: df.groupBy("node").agg(F.min("dist").alias("dist"))
    log, rounds = active, 0
    while True:
        rounds += 1
        met = active.join(weighted_neighbors(ends, active), "node")
        if weight_property is not None:
            met = cut(met)
            if met.where("not valid").limit(1).count():
                raise ValueError(f'edge property "{weight_property}" must be finite and non-negative, or is not a floating-point value')
        offers = met.groupBy(F.col("nbr").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("offer"))
        active = cut(offers.join(least(log), "node", "left").where("dist is null or offer < dist").select("node", F.col("offer").alias("dist")))
        if active.isEmpty():
            return least(log)
        log = log.unionAll(active)
        log = cut(least(log)) if rounds % FOLD == 0 else log


def shortest_path(data: GraphData, start: int, target: int, direction: str = "out", edge_type: str | None = None, weight_property: str | None = None) -> dict[str, Any] | None:
    """{"nodes", "distance"}, or None where there is no way.

    Of several shortest paths, each node's predecessor is the one settled first,
    by distance and then by id.
    """
    require_nodes(data, [start, target])
    if start == target:
        return {"nodes": [start], "distance": 0.0}
    best = cut(distances(data, start, direction, edge_type, weight_property))
    end = best.where(F.col("node") == target).first()
    if end is None:
        return None
    nbrs = weighted_neighbors(weighted_ends(data, direction, edge_type, weight_property), best)
    tight = nbrs.join(best, "node").join(best.select(F.col("node").alias("nbr"), F.col("dist").alias("far")), "nbr").where(F.col("dist") + F.col("w") == F.col("far"))
    # A predecessor was settled before: nearer, or as near with a smaller id.
    tight = cut(tight.where((F.col("dist") < F.col("far")) | ((F.col("dist") == F.col("far")) & (F.col("node") != F.col("nbr")))).select("node", "nbr", "dist", "far"))
    path, at = [target], target
    while at != start:
        step = tight.where(F.col("nbr") == at).where(~F.col("node").isin(*path)).orderBy("dist", "node").first()
        at = step.node
        path.append(at)
    return {"nodes": path[::-1], "distance": float(end.dist)}


def component_labels(data: GraphData, edge_type: str | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node id of each weakly connected component.

    Alternating large-star and small-star rounds; isolated nodes label themselves.
    """
    e = data.edge_scan(edge_type).df.where("src <> dst")
    star = cut(e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = star.unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Minima are written tables: a join of two plain tables can be split where a hub is large.
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        star = cut(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())
        now = tuple(star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = data.node_scan().df.select(F.col("id").alias("node"))
    return nodes.join(star.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def connected_components(data: GraphData, edge_type: str | None = None) -> DataFrame:
    """(component, position, node): members in breadth-first order from the smallest id."""
    labels = cut(component_labels(data, edge_type))
    roots = labels.where("node = component").select(F.col("node").alias("start"))
    # Every node is met, so the whole adjacency is needed: once, rather than by steps.
    found = bfs(data, roots, "both", edge_type, adj=cut(distinct_neighbors(adjacency(data, "both", edge_type))))
    return found.select(F.col("start").alias("component"), "position", "node")


def pagerank(data: GraphData, iterations: int = 20, damping: float = 0.85, tolerance: float | None = None, edge_type: str | None = None) -> DataFrame:
    """(node, rank). Out-degree counts distinct targets; dangling mass is spread evenly."""
    if not math.isfinite(damping) or not 0.0 <= damping <= 1.0:
        raise ValueError("damping must be between 0.0 and 1.0")
    if tolerance is not None and (not math.isfinite(tolerance) or tolerance < 0):
        raise ValueError("tolerance must be finite and non-negative")
    spark = data.spark
    nodes = data.node_scan().df.select(F.col("id").alias("node"))
    links = data.edge_scan(edge_type).df.select("src", "dst").distinct()
    links = links.join(links.groupBy("src").agg(F.count(F.lit(1)).alias("degree")), "src")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    # Links are placed by source once; an iteration shuffles ranks and sums, not links.
    name = f"links_{uuid.uuid4().hex}"
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links.write.bucketBy(width, "src").sortBy("src").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    links = spark.table(name)
    sinks = nodes.join(links.select(F.col("src").alias("node")).distinct(), "node", "left_anti").withColumn("sink", F.lit(True))
    ranks = cut(nodes.join(sinks, "node", "left").select("node", F.coalesce("sink", F.lit(False)).alias("sink"), F.lit(1.0 / n).alias("rank")))
    dangling = ranks.where("sink").count() / n
    for _ in range(iterations):
        base = (1.0 - damping) / n + damping * dangling / n
        given = links.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        new = ranks.join(given, F.col("node") == F.col("dst"), "left")
        new = cut(new.select("node", "sink", (F.lit(base) + damping * F.coalesce("given", F.lit(0.0))).alias("rank"), F.abs(F.lit(base) + damping * F.coalesce("given", F.lit(0.0)) - F.col("rank")).alias("delta")))
        ranks = new.drop("delta")
        # What the next iteration spreads and how far this one moved, from one pass over the written ranks.
        dangling, moved = new.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0)), F.sum("delta")).first()
        if tolerance is not None and moved <= tolerance:
            break
    spark.sql(f"DROP TABLE {name}")
    return ranks.select("node", "rank")


def _next(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A step of the 64-bit congruential generator and its output."""
    with np.errstate(over="ignore"):
        state = state * np.uint64(MULTIPLIER) + np.uint64(INCREMENT)
    return state, state ^ (state >> np.uint64(33))


def random_walks(data: GraphData, starts: DataFrame, steps: int, direction: str = "out", edge_type: str | None = None) -> DataFrame:
    """(walk, step, node) of many walks at once; ``starts`` has walk, node and seed.

    A walker carries its generator's state; a step numbers the neighbours of the
    nodes where walkers are, and is one join with the degrees and one with the
    neighbour at the drawn place. Walks end at sinks.
    """
    ends = adjacency(data, direction, edge_type)

    def draw(batches):
        for b in batches:
            walk, node, state, degree = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            state, out = _next(state.view(np.uint64))
            place = (out % degree.astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (walk, node, state.view(np.int64), place)], ["walk", "node", "state", "place"])

    at = cut(starts.select("walk", "node", F.col("seed").cast("long").alias("state")))
    total = at.select("walk", F.lit(0).alias("step"), "node")
    for k in range(1, steps + 1):
        nbrs = cut(number_within(frontier_neighbors(ends, at), "node", ["dir", "edge_id", "nbr"], "place").select("node", "nbr", "place"))
        degrees = nbrs.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
        drawn = at.join(degrees, "node").select("walk", "node", "state", "degree").mapInArrow(draw, "walk long, node long, state long, place long")
        at = cut(drawn.join(nbrs, ["node", "place"]).select("walk", F.col("nbr").alias("node"), "state"))
        if at.isEmpty():
            break
        total = total.unionAll(at.select("walk", F.lit(k).alias("step"), "node"))
    return total


def random_walk(data: GraphData, start: int, steps: int, direction: str = "out", edge_type: str | None = None, seed: int | None = None) -> list[int]:
    require_nodes(data, [start])
    state = (time.time_ns() if seed is None else seed) & MASK
    signed = state - (1 << 64) if state >> 63 else state
    starts = data.spark.createDataFrame([(0, start, signed)], "walk long, node long, seed long")
    return [r.node for r in random_walks(data, starts, steps, direction, edge_type).orderBy("step").collect()]


def subgraph(data: GraphData, nodes: DataFrame | list[int], edge_type: str | None = None) -> GraphData:
    """The induced subgraph: ids and index definitions stay, vectors are pruned, no variables."""
    if isinstance(nodes, DataFrame):
        ids = nodes.toDF("id").distinct()
    else:
        require_nodes(data, nodes)
        ids = data.spark.createDataFrame([(n,) for n in dict.fromkeys(nodes)], "id long")
    kept_nodes = tuple(Source(s.df.join(ids, "id", "left_semi"), s.names, s.kinds) for s in data.nodes)
    ends = [ids.withColumnRenamed("id", c) for c in ("src", "dst")]
    kept_edges = []
    for s in data.edges:
        if edge_type is not None and s.names is not None and edge_type not in s.names:
            continue
        df = s.df if s.names is not None or edge_type is None else s.df.where(F.col("edge_type") == edge_type)
        kept_edges.append(Source(df.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi"), s.names, s.kinds))
    out = data.with_(nodes=kept_nodes, edges=tuple(kept_edges), tables={})
    if "vectors" in data.tables:
        v = data.table("vectors")
        on_nodes = [k for k, d in data.vector.items() if d["target"] == "node"]
        node_vectors = v.where(F.col("index_name").isin(*on_nodes)).join(ids.withColumnRenamed("id", "entity_id"), "entity_id", "left_semi") if on_nodes else v.limit(0)
        edge_ids = out.edge_scan().df.select(F.col("id").alias("entity_id"))
        on_edges = [k for k, d in data.vector.items() if d["target"] == "edge"]
        edge_vectors = v.where(F.col("index_name").isin(*on_edges)).join(edge_ids, "entity_id", "left_semi") if on_edges else v.limit(0)
        out = out.with_table("vectors", node_vectors.select(v.columns).unionAll(edge_vectors.select(v.columns)))
    return out


JOBS = {
    "bfs": ("start", "direction", "edge_type", "max_depth"),
    "shortest_path": ("start", "target", "direction", "edge_type", "weight_property"),
    "connected_components": ("edge_type",),
    "pagerank": ("iterations", "damping", "tolerance", "edge_type"),
    "random_walk": ("start", "steps", "direction", "edge_type", "seed"),
    "subgraph": ("nodes", "edge_type"),
}


def compute_batch(graph, jobs: list[dict[str, Any]]) -> list[Any]:
    """Results of several algorithm calls in order; the first error names its job."""
    calls: list[Callable[[], Any]] = []
    for i, job in enumerate(jobs):
        op = job.get("op")
        if op not in JOBS:
            raise ValueError(f"job {i} has unknown op '{op}'")
        args = {k: v for k, v in job.items() if k != "op"}
        for k in args:
            if k not in JOBS[op]:
                raise ValueError(f"job {i} has unknown field '{k}'")
        calls.append(lambda op=op, args=args: getattr(graph, op)(**args))
    out = []
    for i, call in enumerate(calls):
        try:
            out.append(call())
        except Exception as e:
            text = e.args[0] if e.args else str(e)
            raise type(e)(f"job {i}: {text}") from e
    return out
