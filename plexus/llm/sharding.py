"""K-d tree sharding, in DataFrame operations only.

Nodes are split at a distributed weighted median along their widest metadata
dimension until a leaf holds the target bytes. A node that is to become k shards
gives its lower side k // 2 of them, and the median is taken at that share of
its bytes, so any number of shards comes out near equal.

A median is found by narrowing: the driver holds one interval of positions for
each open node, a pass counts bytes in BINS bins of it, and the bin with the
median becomes the next interval, until it holds less than FINE of a shard. What a pass sends
is at most (shards x BINS) sums. Under a position's value come, in its low bits,
a hash of the text, then one of the doc_id, then one of the row's number. So
equal texts with equal metadata lie together and go to one shard, except where
the law needs a cut inside them; and a value, a text or a wholly repeated row
that holds a third of all rows splits like any other. All levels run on a table
of a few numbers a document; texts are never moved.

Slots are gapless: rows are range-partitioned by (shard, doc_id), so a slot is a
row's number in its partition plus the rows before it in the shard, which come
from one small table of counts.

Defined results: null texts have size 1 and the checksum of the empty text; null
and missing metadata count as empty; null doc_ids have the first slots; repeated
rows are placed each; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

BINS = 2048
#: A bin below this share of a shard's bytes is not looked into further.
FINE = 1 / 4096


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, checksum and the dimensions d0.. scaled to [0, 2 ** 20)."""
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    unit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 20)).cast("long")
    low = lambda c, bits, at: F.shiftleft(F.pmod(F.xxhash64(c), F.lit(1 << bits)).cast("long"), at)
    column = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.least(F.lit((1 << 20) - 1), (F.log2(size.cast("double")) * (1 << 15))).cast("long").alias("d0"),
        unit(F.coalesce(column("lang"), F.lit(""))).alias("d1"),
        unit(F.coalesce(column("source"), F.lit(""))).alias("d2"),
        (low(text, 18, 24) + low("doc_id", 14, 10) + low(F.monotonically_increasing_id(), 10, 0)).alias("tie"),
    )


DIMENSIONS = ("d0", "d1", "d2")
TIE_BITS = 42


def _position(dimension) -> F.Column:
    return F.shiftleft(dimension, TIE_BITS).bitwiseOR(F.col("tie"))


def _by_node(values: dict[int, int], kind: str = "long") -> F.Column:
    """The value of a row's node; at most ``shards`` entries."""
    return F.element_at(F.create_map(*[F.lit(x).cast(t) for k, v in values.items() for x, t in ((k, "int"), (v, kind))]), F.col("node"))


def kd_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, tie and shard: int, near equal in bytes."""
    rows = materialize(metadata(docs), "metadata")
    # node -> how many shards it becomes, and the first of them
    open_ = {1: (shards, 0)}
    done: dict[int, int] = {}
    tree: list[tuple[int, str, int]] = []
    node = F.lit(1)
    while open_:
        for k in [k for k, (n, _) in open_.items() if n == 1]:
            done[k] = open_.pop(k)[1]
        if not open_:
            break
        placed = rows.withColumn("node", node).where(F.col("node").isin(list(open_)))
        spans = placed.groupBy("node").agg(F.sum("size").alias("bytes"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        spans = {r.node: r for r in spans}
        axis, interval, goal, fine = {}, {}, {}, {}
        for k, (n, _) in open_.items():
            r = spans.get(k)
            axis[k] = max(DIMENSIONS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) if r else 0)
            interval[k] = (r[f"lo_{axis[k]}"] << TIE_BITS, (r[f"hi_{axis[k]}"] + 1) << TIE_BITS) if r else (0, 1)
            goal[k] = (r.bytes if r else 0) * (n // 2) / n
            fine[k] = (r.bytes if r else 0) / n * FINE
        numbers = {d: i for i, d in enumerate(DIMENSIONS)}
        chosen = _by_node({k: numbers[a] for k, a in axis.items()}, "int")
        along = F.when(chosen == 0, F.col("d0")).when(chosen == 1, F.col("d1")).otherwise(F.col("d2"))
        placed = placed.withColumn("position", _position(along))
        below = dict.fromkeys(open_, 0)
        cut: dict[int, int] = {}
        while len(cut) < len(open_):
            live = {k: interval[k] for k in open_ if k not in cut}
            lo, step = _by_node({k: a for k, (a, _) in live.items()}), _by_node({k: max(1, -(-(b - a) // BINS)) for k, (a, b) in live.items()})
            hi = _by_node({k: b for k, (_, b) in live.items()})
            inside = placed.where(F.col("node").isin(list(live))).where((F.col("position") >= lo) & (F.col("position") < hi))
            bins = inside.groupBy("node", F.floor((F.col("position") - lo) / step).cast("int").alias("bin")).agg(F.sum("size").alias("bytes")).collect()
            by: dict[int, dict[int, int]] = {}
            for r in bins:
                by.setdefault(r.node, {})[r.bin] = r.bytes
            for k, (a, b) in live.items():
                width = max(1, -(-(b - a) // BINS))
                for i in sorted(by.get(k, {})):
                    if below[k] + by[k][i] > goal[k]:
                        a, b = a + i * width, min(b, a + (i + 1) * width)
                        break
                    below[k] += by[k][i]
                else:
                    cut[k] = b
                    continue
                if width == 1 or by[k][i] <= fine[k]:
                    cut[k] = a
                else:
                    interval[k] = (a, b)
        grown = {}
        step_up = F.col("node") * 2 + (F.col("position") >= _by_node(cut)).cast("int")
        # Rows of the open nodes go down one level; their node is written for the next pass.
        rest = rows.withColumn("node", node).where(~F.col("node").isin(list(open_))) if done else None
        lower = placed.select(*[c for c in rows.columns if c != "node"], step_up.alias("node"))
        above, rows = rows, materialize(lower if rest is None else lower.unionByName(rest.select(lower.columns)), "nodes")
        discard(above)
        node = F.col("node")
        for k, (n, first) in open_.items():
            tree.append((k, axis[k], cut[k]))
            grown[2 * k], grown[2 * k + 1] = (n // 2, first), (n - n // 2, first + n // 2)
        open_ = grown
    out = rows.withColumn("node", node) if "node" not in rows.columns else rows
    return out.withColumn("shard", _by_node(done, "int")).drop("node", *DIMENSIONS)


def with_slots(rows: DataFrame) -> DataFrame:
    """Add slot: a row's gapless number from 0 in its shard, by doc_id."""
    order = ["shard", "doc_id", "text_crc32", "tie"]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    sorted_ = materialize(sorted_, "sorted").withColumn("part", F.shiftright("at", 33))
    counts = sorted_.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return sorted_.join(offsets, ["shard", "part"]).withColumn("slot", (F.col("at") + F.col("shift")).cast("long")).drop("at", "part", "shift")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    placed = with_slots(kd_shards(docs, shards))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))
