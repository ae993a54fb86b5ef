"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A document holds a benchmark item if some region of it is within the item's edit
budget of the item; both are lower-cased with white space collapsed. Each edit
destroys at most Q of the item's q-grams, so a region within e edits of an item of
length L shares at least L + 1 - Q (e + 1) of them, all on diagonals within e of
each other. The budget is RATE of the length, or less where that bound would not
be positive; items of any length go the same way.

1. Positions of a text whose q-gram is any item's are found by a hash bitmap; a
   window that can't hold enough of them for the items of a length class is out.
   Random prose ends here.
2. In what is left, shared q-grams are counted by item and by overlapping
   diagonal bands of width 2 (e + 1), and a band below the item's bound is out.
   Places of a q-gram in an item count by cells of e + 1 places, so a q-gram that
   fills an item, as in a run of one character, costs a few cells and not a place
   each; a text's q-grams are counted in blocks of bounded size. Counts can only
   come out too high, so no region is lost.
3. A banded alignment of the item against the region verifies the distance.

Items travel in blocks of at most BLOCK_CHARS characters, a stated query set
against all documents; each block is a pass with a table of bounded size, and a
usual benchmark is one block. Nothing is sampled, and whole texts are read.

Defined results: null, empty and blank items match nothing; an item below Q
characters, which has no q-gram, is matched as it stands between word bounds;
null texts hold nothing; repeated rows are reported or dropped each by itself,
whatever their ids; equal items are each reported.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each, serve

Q = 8
RATE = 0.06
BLOCK_CHARS = 4_000_000
CLASS = 1.15
BITMAP_BITS = 22
#: Cells of shared q-grams that are counted at a time.
CELLS = 1 << 20
#: Characters of a text that one alignment looks at, beside the overlap that an item needs.
REGION = 1 << 14


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def budget(length: int) -> int:
    """Edits allowed for an item: RATE of its length, as far as the q-gram bound stays positive."""
    return max(0, min(int(RATE * length), length // Q - 1))


def grams(c: np.ndarray) -> np.ndarray:
    """32-bit hash of every Q-gram, Q being 8."""
    with np.errstate(over="ignore"):
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:]
        four = two[:-2] * np.uint32(0x85EBCA77) + two[2:]
        eight = four[:-4] * np.uint32(0xC2B2AE3D) + four[4:]
    return eight ^ (eight >> np.uint32(15))


def distance(item: np.ndarray, text: np.ndarray, budget: int) -> tuple[int, int, int]:
    """Least edits that turn ``item`` into a part of ``text``, and the part's place.

    Free ends in the text; cells outside the band of ``budget`` about the text's
    slack are not looked at. Returns (edits, start, stop), edits above the budget
    being reported as budget + 1.
    """
    n, m = len(item), len(text)
    band = m - n + budget
    big = n + m + 1
    row = np.zeros(m + 1, np.int64)
    origin = np.arange(m + 1)
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        new = np.full(m + 1, big)
        lo, hi = max(0, i - budget), min(m, i + max(0, band))
        if lo == 0:
            new[0] = i
        start = origin.copy()
        a = max(1, lo)
        across = row[a - 1 : hi] + (text[a - 1 : hi] != item[i - 1])
        down = row[a : hi + 1] + 1
        take = across <= down
        new[a : hi + 1] = np.where(take, across, down)
        start[a : hi + 1] = np.where(take, origin[a - 1 : hi], origin[a : hi + 1])
        # Insertions: a running minimum along the row.
        level = new - steps
        best = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == best, steps, 0))
        new, start = best + steps, start[source]
        row, origin = new, start
    stop = int(np.argmin(row))
    return (int(min(row[stop], budget + 1)), int(origin[stop]), stop)


def regions(low: np.ndarray, high: np.ndarray, length: int, overlap: int):
    """Pieces (a, b) that cover the intervals within [0, length): overlapping ones as one, long ones cut with an overlap."""
    order = np.argsort(low, kind="stable")
    low, high = np.maximum(low[order], 0), np.maximum.accumulate(np.minimum(high[order], length))
    heads = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    for a, b in zip(low[heads].tolist(), high[np.append(heads[1:], len(low)) - 1].tolist(), strict=True):
        yield a, min(b, a + REGION + overlap)
        while a + REGION + overlap < b:
            a += REGION
            yield a, min(b, a + REGION + overlap)


def place(item: np.ndarray, text: np.ndarray, a: int, b: int, budget: int) -> tuple[int, int, int]:
    """``distance`` in a piece of a text, with places of the whole text."""
    edits, start, stop = distance(item, text[a:b], budget)
    return edits, a + start, a + stop


class ItemBlock:
    """Tables of a block of items, built once by each worker."""

    def __init__(self, items: list[tuple[int, str]]):
        self.exact: list[tuple[int, re.Pattern]] = []
        self.items: list[tuple[int, str, np.ndarray, int, int]] = []  # id, text, codes, budget, bound
        for key, text in items:
            if len(text) < Q:
                self.exact.append((key, re.compile(rf"(?<!\w){re.escape(text)}(?!\w)")))
                continue
            allowed = budget(len(text))
            self.items.append((key, text, codes(text), allowed, len(text) + 1 - Q * (allowed + 1)))
        self.half = np.array([x[3] + 1 for x in self.items], np.int64)
        self.bounds = np.array([x[4] for x in self.items], np.int64)
        hashes, item, cell = [], [], []
        for i, (_, _, c, allowed, _) in enumerate(self.items):
            g = grams(c)
            # One entry for each cell of budget + 1 places that holds the q-gram.
            met = np.unique(g.astype(np.uint64) << np.uint64(32) | (np.arange(len(g)) // (allowed + 1)).astype(np.uint64))
            hashes.append((met >> np.uint64(32)).astype(np.uint32))
            item.append(np.full(len(met), i))
            cell.append((met & np.uint64(0xFFFFFFFF)).astype(np.int64))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint32)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.item = np.concatenate(item)[order] if item else np.zeros(0, np.int64)
        self.cell = np.concatenate(cell)[order] if cell else np.zeros(0, np.int64)
        self.bitmap = np.zeros(1 << BITMAP_BITS, bool)
        self.bitmap[self.hashes >> np.uint32(32 - BITMAP_BITS)] = True
        # Length classes: widest window and lowest bound of the items in each.
        classes: dict[int, list] = defaultdict(list)
        for _, text, _, allowed, bound in self.items:
            classes[int(np.log(len(text)) / np.log(CLASS))].append((len(text) + allowed - Q + 1, bound))
        self.classes = [(max(w for w, _ in v), min(b for _, b in v)) for v in classes.values()]

    def bands(self, g: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item << 40 | 2 * band + shift, shared q-grams) of the bands that the text places ``at`` meet.

        A place w and a cell c of item places lie on the diagonals (w - (c + 1) h, w - c h],
        h = budget + 1, so on at most two bands of width 2 h of either shift.
        """
        first, last = (np.searchsorted(self.hashes, g[at], side) for side in ("left", "right"))
        count = last - first
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        total = np.cumsum(count)
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CELLS, "right")))
            n = count[a:b]
            entry = np.repeat(first[a:b], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            item, where = self.item[entry], np.repeat(at[a:b], n)
            half = self.half[item]
            top = where - self.cell[entry] * half
            low = top - half + 1
            cells = []
            for shift in (0, 1):
                one, two = ((x + shift * half) // (2 * half) for x in (low, top))
                own = item << 40
                marks = np.concatenate([own | (2 * (one + (1 << 30)) + shift), (own | (2 * (two + (1 << 30)) + shift))[two != one]])
                places = np.concatenate([where, where[two != one]])
                if b - a == len(at):
                    # Nothing comes from other blocks, so what is below the bound is out before places are counted.
                    found, which, n_all = np.unique(marks, return_inverse=True, return_counts=True)
                    enough = (n_all >= self.bounds[found >> 40])[which]
                    marks, places = marks[enough], places[enough]
                # A place counts once for a band.
                order = np.lexsort((places, marks))
                marks, places = marks[order], places[order]
                new = np.ones(len(marks), bool)
                if not len(marks):
                    continue
                new[1:] = (marks[1:] != marks[:-1]) | (places[1:] != places[:-1])
                cells.append(np.unique(marks[new], return_counts=True))
            kept += cells
            a = b
        if not kept:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        marks, where = np.unique(np.concatenate([m for m, _ in kept]), return_inverse=True)
        return marks, np.bincount(where, np.concatenate([n for _, n in kept])).astype(np.int64)

    def search(self, text: str):
        """(item, edits, start, stop) of every item that the text holds, at its best place."""
        for key, item in self.exact:
            if hit := item.search(text):
                yield key, 0, hit.start(), hit.end()
        if len(text) < Q or not self.items:
            return
        c = codes(text)
        g = grams(c)
        shared = self.bitmap[g >> np.uint32(32 - BITMAP_BITS)]
        total = np.zeros(len(g) + 1, np.int32)
        np.cumsum(shared, out=total[1:])
        near = None
        for width, bound in self.classes:
            width = min(width, len(g))
            full = total[width:] - total[:-width] >= bound
            if full.any():
                near = np.zeros(len(g) + 1, np.int32) if near is None else near
                at = np.flatnonzero(full)
                near[at] += 1
                near[at + width] -= 1
        if near is None:
            return
        marks, n = self.bands(g, np.flatnonzero(shared & (np.cumsum(near[:-1]) > 0)))
        marks = marks[n >= self.bounds[marks >> 40]]
        for i in np.unique(marks >> 40).tolist():
            key, text_i, c_i, allowed, _ = self.items[i]
            if (exact := text.find(text_i)) >= 0:
                yield key, 0, exact, exact + len(text_i)
                continue
            mine = marks[marks >> 40 == i]
            band, shift = ((mine & ((1 << 40) - 1)) >> 1) - (1 << 30), mine & 1
            low = (2 * band - shift) * (allowed + 1)
            high = low + 2 * (allowed + 1) + len(c_i) + allowed
            best = min(place(c_i, c, a, b, allowed) for a, b in regions(low - allowed, high, len(c), len(c_i) + allowed))
            if best[0] <= allowed:
                yield key, *best


_blocks: dict[str, ItemBlock] = {}


def blocks(items: DataFrame, block_chars: int = BLOCK_CHARS):
    """Blocks of (item_id, normalised text), cut by running size, so that one at a time is on the driver."""
    block, size = [], 0
    known = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    for row in known.orderBy("item_id", "text").toLocalIterator():
        text = normal(row.text)
        if not text:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.item_id, text))
        size += len(text)
    if block:
        yield block


def _tables(name: str, table) -> ItemBlock:
    """The worker's tables of the block ``name``."""
    serve("items", _blocks.clear)
    if name not in _blocks:
        _blocks.clear()
        _blocks[name] = ItemBlock(table.value)
    return _blocks[name]


def find_items(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, stop): every item that a document holds.

    start and stop are places in the normalised text.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, edits int, start int, stop int"

    def searched(block):
        name, table = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

        def run(batches):
            tables = _tables(name, table)
            for batch in batches:
                rows = [(key, *hit) for key, text in zip(each(batch.column(0)), each(batch.column(1)), strict=True) if text for hit in tables.search(normal(text))]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "edits", "start", "stop"])

        return slim.mapInArrow(run, schema)

    out = None
    for block in blocks(items, block_chars):
        out = searched(block) if out is None else out.unionAll(searched(block))
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.

    Each row is judged by its own text in one pass a block, without a join, so
    null and repeated ids make no difference.
    """
    spark, at = docs.sparkSession, docs.columns.index("text")

    def passed(rows, block):
        name, table = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

        def run(batches):
            tables = _tables(name, table)
            for batch in batches:
                held = [bool(text) and next(iter(tables.search(normal(text))), None) is not None for text in each(batch.column(at))]
                yield batch.filter(pa.array([not h for h in held], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    for block in blocks(items, block_chars):
        docs = passed(docs, block)
    return docs
