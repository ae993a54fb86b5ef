"""Sequence packing: shortest pack first over the length histogram.

1. Every document is tokenized once and cut into pieces of at most ``capacity``
   ids, which are a written table, a few numbers a piece.
2. The histogram of piece lengths has at most ``capacity`` rows, whatever the
   corpus. The driver places lengths longest first, always into the shortest
   pack that has room, updating counts of packing patterns rather than packs; a
   length adds at most two patterns, so there are at most 2 * capacity.
3. Pieces are joined back to patterns by rank. They are range-partitioned by
   length, so a piece's rank in its length is its number in its partition plus
   the length's pieces in the partitions before; that takes a row for each length
   and each partition border, not for each pair of both. The rank falls into the
   interval that a slot of a pattern holds for that length.

Pieces of one length, which may be a third of all, are told apart by the number
that the cutting task gave them, so their range is split like any other.

Defined results: null and empty texts are one piece with the end id; repeated
rows are packed each; null doc_ids stay null; an empty table has no sequence.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, each, materialize
from .tokens import public_path, word_encoder

CAPACITY = 2048


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Packing patterns ((length, times), ...) with how many packs follow each.

    Patterns are runs of equal lengths, longest first.
    """
    room: dict[int, list] = defaultdict(list)  # room left -> [(pattern, packs)]
    open_rooms: list[int] = []  # as a heap, largest room (shortest pack) first

    def put(left: int, pattern: tuple, packs: int) -> None:
        if left not in room:
            heapq.heappush(open_rooms, -left)
        room[left].append((pattern, packs))

    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} ids cannot be packed into {capacity}")
        todo = histogram[length]
        while todo:
            while open_rooms and not room.get(-open_rooms[0]):
                room.pop(-heapq.heappop(open_rooms), None)
            largest = -open_rooms[0] if open_rooms else -1
            if largest < length:
                times = capacity // length
                # New packs are the shortest as long as they are; fill them evenly.
                packs, left = divmod(todo, times) if 2 * length <= capacity else (todo, 0)
                if 2 * length > capacity:
                    put(capacity - length, ((length, 1),), packs)
                else:
                    if packs:
                        put(capacity - times * length, ((length, times),), packs)
                    if left:
                        put(capacity - left * length, ((length, left),), 1)
                break
            pattern, packs = room[largest].pop()
            fit = largest // length
            # Each pack of the pattern takes one more, or a few where one pattern is left.
            now = min(packs, todo)
            times = 1 if now < packs else max(1, min(fit, todo // packs))
            if packs > now:
                room[largest].append((pattern, packs - now))
            put(largest - times * length, (*pattern, (length, times)), now)
            todo -= now * times
    out = []
    for left in sorted(room):
        out += room[left]
    return out


def slots(patterns: list, capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, packs, first sequence, place of each slot interval."""
    found: dict[int, list] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    first = 0
    for pattern, packs in patterns:
        at = 0
        for length, times in pattern:
            for _ in range(times):
                found[length].append((taken[length], packs, first, at))
                taken[length] += packs
                at += length
        first += packs
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in found.items()}


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece; ``tie`` is a number of its own, from the task and its place in that."""
    path = public_path(tokenizer)

    def run(batches):
        encoder, end = word_encoder(path), np.array([end_id], "<u4").tobytes()
        tie = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for key, text in zip(each(batch.column(0)), each(batch.column(1)), strict=True):
                ids = (encoder.encode(text) if text else b"") + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    length = min(capacity, n - start)
                    rows.append((key, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, tie))
                    tie += 1
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "tie"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, tie long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    cut = materialize(pieces(docs, tokenizer, end_id, capacity), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(slots(shortest_pack_first(histogram, capacity), capacity))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    ordered = cut.repartitionByRange("length", "tie").sortWithinPartitions("length").select(*columns, F.monotonically_increasing_id().alias("at"))
    ordered = materialize(ordered, "ordered").withColumn("part", F.shiftright("at", 33))
    discard(cut)
    # At most capacity + partitions rows.
    counts = ordered.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("length", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for each in np.unique(length):
                mine = length == each
                from_rank, _, first, at = table.value[int(each)]
                slot = np.searchsorted(from_rank, rank[mine], "right") - 1
                sequence[mine] = first[slot] + rank[mine] - from_rank[slot]
                offset[mine] = at[slot]
            kept = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = ordered.join(shifts, ["length", "part"]).select(*columns, (F.col("at") + F.col("shift")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
