"""SimHash near-duplicates, linked through a forest of vantage-point trees.

A pair of 64-bit fingerprints at Hamming distance 4 or less differs in at most
one bit of at least one of three bit blocks (21, 21 and 22 bits). Each block has
a vantage-point tree over the block's Hamming metric, searched with radius 1: a
node splits at the mean distance to its vantage value, and by the triangle
inequality a pair can only be torn apart if one side lies exactly on the inner
boundary ring, so the ring also goes to the outer branch. Leaves are compared
exactly on all 64 bits. The vantage values come from a fixed rule, so nothing is
broadcast and every fingerprint is routed by itself; the tree's depth follows
the count of distinct fingerprints. (One tree over all 64 bits with radius 4
sheds 6 % of the work a level on fingerprints, which are nearly random bits;
blocks shed 32 %.)

Inside a leaf only a spanning forest of its links is emitted, never all pairs.
A leaf above ``LEAF_CAP`` is dealt out as pairs of chunks.

Defined results: a text without words (null and empty ones too) has fingerprint
zero and is linked like any other; repeated rows share a fingerprint; the
component of rows whose doc_ids are all null is null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, shuffle_width, utf8

BLOCKS = ((0, 21), (21, 21), (42, 22))
RADIUS = 1
MAX_BITS = 4
LEAF_TARGET = 1500
LEAF_CAP = 16384
SHINGLE = 4
SEED = 42


def shingle_hashes(data: bytes, words_per_shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of a UTF-8 text, repeats included; of the whole sequence where it is shorter."""
    words = data.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n < words_per_shingle:
        return np.array([digest(line, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    last = n - words_per_shingle + 1
    spans = zip((ends - lengths)[:last].tolist(), ends[words_per_shingle - 1 :].tolist(), strict=True)
    return np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64, last)


def majority(hashes: np.ndarray) -> int:
    """SimHash of shingle hashes: a bit is set if over half of them have it; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes, words_per_shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(data, words_per_shingle, seed))


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            raw = data.tobytes()
            out = np.fromiter((fingerprint(raw[at[i] : at[i + 1]], words_per_shingle, seed) for i in range(batch.num_rows)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64: the fixed rule that gives each tree node its vantage value."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def route(fps: np.ndarray, tree: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``fps`` and the leaf each goes to; ring members go to several leaves."""
    shift, width = BLOCKS[tree]
    block = (fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    cut = (width + 1) // 2
    who = np.arange(len(fps))
    node = np.ones(len(fps), np.uint64)
    for _ in range(depth):
        vantage = _mix(node * np.uint64(4) + np.uint64(tree)) & np.uint64((1 << width) - 1)
        far = np.bitwise_count(block[who] ^ vantage)
        inner, outer = far < cut, far >= cut - RADIUS
        who = np.concatenate([who[inner], who[outer]])
        node = np.concatenate([node[inner] * np.uint64(2), node[outer] * np.uint64(2) + np.uint64(1)])
    return who, node


def _hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the pairs (a, b) into ``label``, where label[x] is the root of x."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            deeper = label[label]
            if np.array_equal(deeper, label):
                break
            label[:] = deeper


def leaf_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links at ``max_bits`` or fewer differing bits among ``fps``."""
    fps = np.unique(fps)
    m = len(fps)
    label = np.arange(m)
    step = max(1, min(256, (1 << 21) // max(m, 1)))
    for at in range(0, m, step):
        near = np.bitwise_count(fps[at : at + step, None] ^ fps[None, at:]) <= max_bits
        a, b = np.nonzero(near)
        off = a != b
        if off.any():
            _hook(label, a[off] + at, b[off] + at)
    tied = np.flatnonzero(label != np.arange(m))
    return fps[tied], fps[label[tied]]


def links(distinct: DataFrame, n: int, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) edges that connect all distinct fingerprints linked at ``max_bits`` or fewer bits."""
    if max_bits >= len(BLOCKS) * (RADIUS + 1):
        raise ValueError("more blocks are needed for so many differing bits")
    depth = max(0, min(34, math.ceil(math.log(max(n, 1) / LEAF_TARGET) / -math.log(0.585)) if n > LEAF_TARGET else 0))

    def send(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 20_000):
                part = fps[at : at + 20_000]
                for tree in range(len(BLOCKS)):
                    who, node = route(part, tree, depth)
                    key = node * np.uint64(4) + np.uint64(tree)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[who].view(np.int64))], ["leaf", "fp"])

    def compare(batches):
        held, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            fps = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(fps)]
            found = []
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                now = tuple(keys[:, a].tolist())
                if now != key and held:
                    found.append(leaf_links(np.concatenate(held), max_bits))
                    held = []
                key = now
                held.append(fps[a:b])
            yield from _edges(found)
        if held:
            yield from _edges([leaf_links(np.concatenate(held), max_bits)])

    def _edges(found):
        if found:
            a, b = (np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    routed = materialize(distinct.select("fp").mapInArrow(send, "leaf long, fp long"), "leaves")
    large = routed.groupBy("leaf").count().where(F.col("count") > LEAF_CAP)
    large = large.select("leaf", F.ceil(F.col("count") / LEAF_CAP).cast("int").alias("chunks"))
    dealt = routed.join(large, "leaf", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("leaf", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    key = ["leaf", "lo", "hi"]
    dealt = dealt.repartition(shuffle_width(distinct.sparkSession), *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, words_per_shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id, component_size) of every row.

    component_id is the smallest doc_id reachable over links, component_size the
    number of rows in the component.
    """
    rows = materialize(fingerprints(docs, words_per_shingle), "fingerprints")
    classes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")
    roots = connected_components(links(classes, classes.count(), max_bits))
    joined = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", "copies", F.coalesce("root", "fp").alias("root"))
    # Both sides of the join on the root are written tables, so a large component can be split.
    joined = materialize(joined, "rooted")
    whole = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("component_size"))
    whole = materialize(whole.where("component_size > 1"), "wholes")
    shared = materialize(joined.join(whole, "root").select("fp", "component_id", "component_size"), "components")
    out = rows.join(shared, "fp", "left")
    return out.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("component_size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("component_size", F.lit(1)).cast("long").alias("component_size"),
    )
