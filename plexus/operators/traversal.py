"""Traversals as iterative DataFrame plans.

All starts of a call go through one loop at once. Each step reads the edges at
its frontier, by a semi-join below everything else, joins them and takes away what
was seen; ranks carry the discovery order, so results don't depend on partitioning.
A step's frontier is a written table in the shared checkpoint folder, which keeps
plans flat and survives lost executors.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import Value
from ..model import GraphData, subscript
from ..plans.dsl import direction as parse_direction

BALL_CAP = 10_000
#: Steps after which the tables of the steps so far are written as one.
FOLD = 8


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set only where the session names none, and then for a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="plexus-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table: computed once, with a short lineage."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def adjacency(data: GraphData, direction: str = "out", edge_type: str | None = None) -> DataFrame:
    """(node, nbr, dir, edge_id) of every edge end; a loop has both ends in ``both``."""
    direction = parse_direction(direction)
    e = data.edge_scan(edge_type).df
    out = e.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), F.lit(0).alias("dir"), F.col("id").alias("edge_id"))
    into = e.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), F.lit(1).alias("dir"), F.col("id").alias("edge_id"))
    return out if direction == "out" else into if direction == "in" else out.unionAll(into)


def distinct_neighbors(adj: DataFrame) -> DataFrame:
    """(node, nbr, dir, edge_id): the first edge of each pair, out before in, then by edge id."""
    first = adj.groupBy("node", "nbr").agg(F.min(F.struct("dir", "edge_id")).alias("first"))
    return first.select("node", "nbr", "first.dir", "first.edge_id")


def frontier_neighbors(ends: DataFrame, frontier: DataFrame) -> DataFrame:
    """The distinct neighbours of the frontier's nodes only; nothing else of the adjacency is shuffled."""
    return distinct_neighbors(ends.join(frontier.select("node").distinct(), "node", "left_semi"))


def require_nodes(data: GraphData, ids: Iterable[int]) -> None:
    wanted = set(ids)
    if wanted:
        found = {r.id for r in data.node_scan().df.where(F.col("id").isin(*wanted)).select("id").collect()}
        for x in sorted(wanted - found):
            raise KeyError(f"node {x} not found")


def neighbors(data: GraphData, node_id: int, direction: str = "out", edge_type: str | None = None) -> DataFrame:
    """(position, node): distinct neighbours, out edges first, then by edge id."""
    mine = adjacency(data, direction, edge_type).where(F.col("node") == node_id)
    ranked = _dense(distinct_neighbors(mine), ["dir", "edge_id", "nbr"])
    return ranked.select(F.col("rank").alias("position"), F.col("nbr").alias("node"))


def _dense(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rank rows by ``keys`` without a single-task window over the whole level.

    Rows are range-partitioned, so a rank is the row's number in its partition
    plus the rows of the partitions before it.
    """
    ordered = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = ordered.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("low"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("__part", (F.coalesce(before, F.lit(0)) - F.col("low")).alias("__shift"))
    joined = ordered.withColumn("__part", part).join(shifts, "__part")
    return joined.withColumn("rank", (F.col("__at") + F.col("__shift")).cast("long")).drop("__at", "__part", "__shift")


def levels(data: GraphData, starts: DataFrame, direction: str = "out", edge_type: str | None = None, max_depth: int | None = None, adj: DataFrame | None = None) -> DataFrame:
    """(start, node, depth, rank) reached from each start, start included at depth 0.

    ``starts`` has a column ``start``. rank orders the nodes of a start and depth
    as a breadth-first search meets them.
    """
    ends = adjacency(data, direction, edge_type) if adj is None else None
    frontier = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("rank")).distinct()
    frontier = seen = cut(frontier)
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nbrs = adj if adj is not None else frontier_neighbors(ends, frontier)
        met = frontier.join(nbrs, "node").select("start", F.col("nbr").alias("node"), F.struct("rank", "dir", "edge_id").alias("via"))
        first = met.groupBy("start", "node").agg(F.min("via").alias("via"))
        new = first.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        flat = new.select("start", "node", F.col("via.rank").alias("p"), F.col("via.dir").alias("d"), F.col("via.edge_id").alias("e"))
        frontier = cut(_dense(flat, ["p", "d", "e", "start", "node"]).select("start", "node", F.lit(depth).alias("depth"), "rank"))
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
        seen = cut(seen) if depth % FOLD == 0 else seen
    return seen


def number_within(df: DataFrame, group: str, keys: list[str], name: str) -> DataFrame:
    """Add ``name``: a row's number from 0 in its group, by ``keys``.

    No group meets in one task: rows get their rank over all groups, and the
    group's lowest rank is taken off.
    """
    ranked = _dense(df, [group, *keys])
    low = ranked.groupBy(group).agg(F.min("rank").alias("__low"))
    return ranked.join(low, group).withColumn(name, F.col("rank") - F.col("__low")).drop("rank", "__low")


def bfs(data: GraphData, starts: DataFrame, direction: str = "out", edge_type: str | None = None, max_depth: int | None = None, adj: DataFrame | None = None) -> DataFrame:
    """(start, position, node, depth) in discovery order, start included."""
    found = levels(data, starts, direction, edge_type, max_depth, adj).withColumnRenamed("rank", "order")
    return number_within(found, "start", ["depth", "order"], "position").select("start", "position", "node", "depth")


def k_hop(data: GraphData, starts: DataFrame, hops: int, direction: str = "out", edge_type: str | None = None) -> DataFrame:
    """(start, position, node, depth) within ``hops`` steps, start excluded."""
    found = bfs(data, starts, direction, edge_type, hops).where("depth > 0")
    return found.withColumn("position", F.col("position") - 1)


def frontier(data: GraphData, starts: list[int], steps: int, direction: str = "out", edge_type: str | None = None) -> DataFrame:
    """(position, node): nodes that a search from all starts together first meets at step ``steps``."""
    spark = data.spark
    require_nodes(data, starts)
    distinct = list(dict.fromkeys(starts))
    schema = "node long, rank long"
    level = seen = spark.createDataFrame([(n, i) for i, n in enumerate(distinct)], schema)
    ends = adjacency(data, direction, edge_type)
    for step in range(1, steps + 1):
        met = level.join(frontier_neighbors(ends, level), "node").select(F.col("nbr").alias("node"), F.struct("rank", "dir", "edge_id").alias("via"))
        new = met.groupBy("node").agg(F.min("via").alias("via")).join(seen.select("node"), "node", "left_anti")
        level = cut(_dense(new.select("node", F.col("via.rank").alias("p"), F.col("via.dir").alias("d"), F.col("via.edge_id").alias("e")), ["p", "d", "e", "node"]).select("node", "rank"))
        if level.isEmpty():
            break
        seen = seen.unionAll(level)
        seen = cut(seen) if step % FOLD == 0 else seen
    return level.select(F.col("rank").alias("position"), "node")


NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def edge_number(v: Value) -> Column:
    """A property as a double: integers, floats and numeric strings, never booleans.

    The pattern keeps out padded strings and type suffixes, which a cast would take.
    """
    text = v.of("string")
    return F.coalesce(v.number(), F.when(text.rlike(NUMBER), text.try_cast("double")))


def weighted_edges(data: GraphData, key: str, edge_type: str | None, default: float | None) -> DataFrame:
    """(id, src, dst, w, valid); w is ``default`` where the property is missing."""
    s = data.edge_scan(edge_type, [key])
    v = subscript(s, key)
    w = edge_number(v)
    there = v.present()
    value = F.when(there, w).otherwise(F.lit(default)) if default is not None else w
    valid = ~there | (w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w < F.lit(math.inf)))
    return s.df.select("id", "src", "dst", value.cast("double").alias("w"), valid.alias("valid"), there.alias("there"))


def check_damping(damping: float) -> None:
    if not math.isfinite(damping) or not 0.0 <= damping <= 1.0:
        raise ValueError("damping must be between 0.0 and 1.0")


def propagate(data: GraphData, seeds: dict[int, float], steps: int, edge_property: str = "probability", damping: float = 1.0, edge_type: str | None = None, within: DataFrame | None = None, keep_zero: bool = False) -> DataFrame:
    """(node, score): seeds' mass carried over all parallel out-edges, summed over steps.

    Edges without the property carry nothing. ``within`` keeps to a set of nodes.
    """
    check_damping(damping)
    require_nodes(data, seeds)
    for v in seeds.values():
        if not math.isfinite(v) or v < 0:
            raise ValueError("seed probabilities must be finite and non-negative")
    edges = weighted_edges(data, edge_property, edge_type, None)
    if edges.where("there and not valid").limit(1).count():
        raise ValueError(f'edge property "{edge_property}" must be finite and non-negative')
    edges = edges.where("w is not null" if keep_zero else "w is not null and w > 0")
    if within is not None:
        edges = edges.join(within.select(F.col("node").alias("src")), "src", "left_semi").join(within.select(F.col("node").alias("dst")), "dst", "left_semi")
    edges = cut(edges.select("src", "dst", "w"))
    mass = data.spark.createDataFrame([(int(k), float(v)) for k, v in seeds.items()], "node long, score double")
    total = mass
    for step in range(1, steps + 1):
        moved = mass.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.sum(F.col("score") * F.col("w") * damping).alias("score"))
        mass = cut(moved.select(F.col("dst").alias("node"), "score"))
        if mass.isEmpty():
            break
        total = total.unionAll(mass)
        total = cut(total.groupBy("node").agg(F.sum("score").alias("score"))) if step % FOLD == 0 else total
    return total.groupBy("node").agg(F.sum("score").alias("score"))


def ball(data: GraphData, seeds: list[int], radius: int, cap: int = BALL_CAP) -> tuple[list[int], bool]:
    """Nodes within ``radius`` undirected steps in discovery order, at most ``cap`` of them, and whether the cap cut."""
    seeds = list(dict.fromkeys(seeds))
    kept, seen, truncated = [], set(), False
    level = []
    for n in seeds:
        if len(kept) < cap:
            kept.append(n)
            seen.add(n)
            level.append(n)
        else:
            truncated = True
    adj = adjacency(data, "both")
    for _ in range(radius):
        if not level or len(kept) >= cap:
            break
        rank = data.spark.createDataFrame([(n, i) for i, n in enumerate(level)], "node long, rank long")
        # What comes back is bound: the new nodes that still fit, and one more to see the cut.
        new = distinct_neighbors(adj.join(F.broadcast(rank.select("node")), "node")).join(rank, "node")
        new = new.groupBy("nbr").agg(F.min(F.struct("rank", "dir", "edge_id")).alias("via"))
        if seen:
            known = data.spark.createDataFrame([(n,) for n in seen], "nbr long")
            new = new.join(known, "nbr", "left_anti")
        found = [r.nbr for r in new.orderBy("via").limit(cap - len(kept) + 1).collect()]
        level = found[: cap - len(kept)]
        truncated |= len(found) > len(level)
        kept += level
        seen |= set(level)
    return kept, truncated


def local_propagate(data: GraphData, seeds: dict[int, float], radius: int = 2, query_nodes: list[int] | None = None, edge_type: str | None = None, edge_property: str = "probability", damping: float = 1.0) -> DataFrame:
    """(node, score): propagation for ``radius`` steps inside the ball about seeds and queried nodes."""
    starts = [*seeds, *(query_nodes or [])]
    require_nodes(data, starts)
    nodes, _ = ball(data, starts, radius)
    within = data.spark.createDataFrame([(n,) for n in nodes], "node long")
    return propagate(data, seeds, radius, edge_property, damping, edge_type, within, keep_zero=True)


def is_number_text(text: str) -> bool:
    return bool(re.match(NUMBER, text))
