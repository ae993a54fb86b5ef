"""Exact repeated-passage removal by suffix arrays over content shards.

A byte goes if a 100-byte string that covers it also starts earlier, in a
document with a smaller doc_id or further left in the same one.

1. Runs of windows with one minimizer (the smallest hash among a window's
   32-byte grams) form segments; equal windows have equal minimizers. A task
   sends (minimizer, content hash, document, place) of each segment, copies of a
   segment within an Arrow batch being settled on the spot.
2. By minimizer: one that occurs once is done with. Copies of a segment other
   than the first are repeats as a whole. Only minimizers with several different
   segments, the borders of repeated passages, need their bytes.
3. Those bytes are sharded by minimizer, so all occurrences of a window meet, and
   each shard is sorted by external induced sorting (``inducedsort``), whose
   queues spill to the shared folder; repeats are the windows that share 100
   bytes with a neighbour and aren't the first.
4. A minimizer whose different segments hold more than ``SHARD`` bytes is split:
   each of their windows goes by its own content hash, which equal windows share,
   and copies other than the first are repeats. So no group has to fit in memory.
5. The windows found are joined to their documents and cut out.

Copies of a segment, and windows of a split minimizer, are told by 128 hash bits
(minimizer and content), as is usual for content addressing; other windows are
compared byte by byte.

Defined results: null texts count as empty; a text below 100 bytes stays whole.
Rows with equal or null doc_ids are ordered by doc_id (nulls first), then by
their text's hash, and each is a document of its own; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed, materialize, new_folder, serve, shuffle_width, utf8
from .inducedsort import repeated_windows, spill_folder

WINDOW = 100
GRAM = 32
BLOCK = 1 << 18
SHARD = 1 << 20
SLICE = 2 << 20
BASE = 0x9E3779B97F4A7C15 | 1

_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 ** 64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                factors = np.full(n, np.uint64(base))
                factors[0] = 1
                _powers[name] = np.multiply.accumulate(factors)
    return _powers["up"][:n], _powers["down"][:n]


def _stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def segments(data: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(minimizer, content, document, start, windows) arrays for documents cut at ``at``."""
    found = []
    wide = window - gram + 1
    for lo in range(int(at[0]), int(at[-1]), BLOCK):
        hi = min(int(at[-1]), lo + BLOCK + window - 1)
        n = hi - lo
        m = n - window + 1
        if m <= 0:
            break
        with np.errstate(over="ignore"):
            up, down = _tables(n)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
            grams = _stir((total[gram:] - total[: n - gram + 1]) * down[: n - gram + 1])
        low = (grams & np.uint64(~((1 << 20) - 1) & (2**64 - 1))) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while 2 * span <= wide:
            low = np.minimum(low[: len(low) - span], low[span:])
            span *= 2
        if span < wide:
            low = np.minimum(low[: len(low) - (wide - span)], low[wide - span :])
        place = (low & np.uint64((1 << 20) - 1)).astype(np.int64)
        # Windows that stay inside one document.
        first = max(0, int(np.searchsorted(at, lo, "right")) - 1)
        last = int(np.searchsorted(at, lo + m, "left"))
        begin, end = np.clip(at[first:last] - lo, 0, m), np.clip(at[first + 1 : last + 1] - lo - window + 1, 0, m)
        real = end > begin
        docs, begin, end = np.flatnonzero(real) + first, begin[real], end[real]
        if not len(docs):
            continue
        edge = np.zeros(m + 1, bool)
        edge[1:m] = place[1:] != place[:-1]
        edge[begin] = True
        edge[end] = True
        edge[m] = False
        starts = np.flatnonzero(edge)
        owner = np.searchsorted(begin, starts, "right") - 1
        inside = (owner >= 0) & (starts < end[np.maximum(owner, 0)])
        stops = np.append(starts[1:], m)
        starts, stops, owner = starts[inside], stops[inside], owner[inside]
        stops = np.minimum(stops, end[owner])
        with np.errstate(over="ignore"):
            content = _stir((total[stops + window - 1] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))
        doc = docs[owner]
        found.append((grams[place[starts]].view(np.int64), content.view(np.int64), doc, starts + lo - at[doc], stops - starts))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _firsts(h, c, key, start):
    """Order by (h, c, key, start), and which rows there begin a new (h, c)."""
    order = np.lexsort((start, key, c, h))
    hs, cs = h[order], c[order]
    new = np.ones(len(order), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])
    return order, new


ROW = "kind int, h long, c long, key long, place long"  # place: start << 20 | windows
NAMES = ["kind", "h", "c", "key", "place"]
FOUND, SEGMENT, SPLIT = 1, 0, 2


def _batch(kind: int, h, c, key, place) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in (h, c, key, place))], NAMES)


def repeated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, place) of the runs of repeated windows; ``docs`` is (key, text), key unique and in the documents' order."""
    spark, shard = docs.sparkSession, SHARD
    root = new_folder(spark, "suffixes")

    def scan(batches):
        serve("segments")
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, at = utf8(batch.column(1))
            first = 0
            while first < batch.num_rows:
                # A few megabytes of text at a time keep a worker's arrays small.
                last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE, "right")) - 1)
                h, c, doc, start, count = segments(data, at[first : last + 1], window)
                key = keys[first + doc]
                first = last
                if not len(h):
                    continue
                order, new = _firsts(h, c, key, start)
                h, c, key, place = h[order], c[order], key[order], (start << 20 | count)[order]
                yield _batch(SEGMENT, h[new], c[new], key[new], place[new])
                if not new.all():
                    # What is settled here travels along under a key that spreads it evenly.
                    yield _batch(FOUND, _stir((key[~new] ^ place[~new]).view(np.uint64)).view(np.int64), c[~new], key[~new], place[~new])

    def settle(batches):
        """Of minimizer groups, ordered by (h, c, key, place): copies are found, different segments go on.

        Firsts are held until they are more than a shard; from then on the group is split.
        """
        before = last = None
        held, size, split = [], 0, False

        def close():
            if not split and sum(len(x[0]) for x in held) > 1:
                yield _batch(SEGMENT, *(np.concatenate(x) for x in zip(*held, strict=True)))

        for batch in batches:
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            known, part = part[0] == FOUND, part[1:]
            if known.any():
                yield _batch(FOUND, *(x[known] for x in part))
                part = [x[~known] for x in part]
            h, c = part[:2]
            if not len(h):
                continue
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            new[0] = before != (h[0], c[0])
            before = (h[-1], c[-1])
            if not new.all():
                yield _batch(FOUND, *(x[~new] for x in part))
            part = [x[new] for x in part]
            h = part[0]
            if not len(h):
                continue
            edges = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            stops = np.append(edges[1:], len(h))
            if h[0] != last:
                yield from close()
                held, size, split = [], 0, False
            bytes_ = (part[3] & ((1 << 20) - 1)) + window - 1
            # Groups that lie inside the batch and fit go on at once.
            whole = np.zeros(len(h), bool)
            if len(edges) > 2:
                sizes = np.add.reduceat(bytes_, edges)
                inner = (stops - edges > 1) & (sizes <= shard)
                inner[[0, -1]] = False
                whole = np.repeat(inner, stops - edges)
                if whole.any():
                    yield _batch(SEGMENT, *(x[whole] for x in part))
            for i in range(len(edges)):
                lo, hi = edges[i], stops[i]
                if 0 < i < len(edges) - 1 and (whole[lo] or hi - lo == 1):
                    continue
                if i and h[lo] != last:
                    yield from close()
                    held, size, split = [], 0, False
                last = h[lo]
                held.append([x[lo:hi] for x in part])
                size += int(bytes_[lo:hi].sum())
                split = split or size > shard
                if split:
                    for x in held:
                        yield _batch(SPLIT, *x)
                    held = []
        yield from close()

    def split_windows(batches):
        """(SEGMENT, h, c, key, place) of the single windows of segments; c is the window's content."""
        for batch in batches:
            h, key, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            data, at = utf8(batch.column(3).cast(pa.binary()).view(pa.string()))
            for a in range(0, len(h), 5_000):
                b = min(len(h), a + 5_000)
                cells = data[at[a] : at[b]]
                n = len(cells)
                with np.errstate(over="ignore"):
                    up, down = _tables(n)
                    total = np.zeros(n + 1, np.uint64)
                    np.cumsum((cells.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
                    count = place[a:b] & ((1 << 20) - 1)
                    owner = np.repeat(np.arange(b - a), count)
                    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                    start = at[a:b][owner] - at[a] + inside
                    c = _stir((total[start + window] - total[start]) * down[start]).view(np.int64)
                yield _batch(SEGMENT, h[a:b][owner], c, key[a:b][owner], ((place[a:b] >> 20)[owner] + inside) << 20 | 1)

    def later_windows(batches):
        """Of windows ordered by (h, c, key, place), all but the first of each (h, c)."""
        before = None
        for batch in batches:
            part = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)]
            h, c = part[:2]
            if len(h):
                again = np.zeros(len(h), bool)
                again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
                again[0] = before == (h[0], c[0])
                before = (h[-1], c[-1])
                yield _batch(FOUND, *(x[again] for x in part))

    def cut_out(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            wanted = batch.column(2)
            flat = wanted.flatten()
            h, place = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            owner = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            begin = at[owner] + (place >> 20)
            stop = begin + (place & ((1 << 20) - 1)) + window - 1
            raw = data.tobytes()
            for a in range(0, len(h), 50_000):
                cells = [raw[x:y] for x, y in zip(begin[a : a + 50_000].tolist(), stop[a : a + 50_000].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 50_000]), pa.array(keys[owner[a : a + 50_000]]), pa.array(place[a : a + 50_000]), pa.array(cells, pa.binary())], ["h", "key", "place", "cell"])

    def sort_shards(batches):
        folder = spill_folder(root)
        held: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if h[a] != last and size >= shard:
                    yield from _sorted(held, folder)
                    held, size = [], 0
                last = h[a]
                part = batch.slice(a, b - a)
                held.append(part)
                size += int(part.column(3).nbytes)
        yield from _sorted(held, folder)

    def _sorted(held, folder):
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        key, place = (table.column(i).to_numpy() for i in (1, 2))
        cells = table.column(3).combine_chunks()
        cells = cells if isinstance(cells, pa.Array) else cells.chunk(0)
        data, at = utf8(cells.cast(pa.binary()).view(pa.string()))
        data, at = data[at[0] : at[-1]], at - at[0]
        inside = np.arange(len(data)) - np.repeat(at[:-1], np.diff(at))
        start = np.repeat(place >> 20, np.diff(at)) + inside
        # Segments in document order; a byte's rank is its segment's rank, then its place.
        order = np.lexsort((place, key))
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(np.append([0], (key[order][1:] != key[order][:-1])))
        rank = np.repeat(of, np.diff(at)) << 40 | start
        hits = np.sort(repeated_windows(data, at, rank, window, folder))
        if not len(hits):
            return
        owner = np.searchsorted(at, hits, "right") - 1
        new = np.ones(len(hits), bool)
        new[1:] = (hits[1:] != hits[:-1] + 1) | (owner[1:] != owner[:-1])
        begins = np.flatnonzero(new)
        count = np.diff(np.append(begins, len(hits)))
        runs = start[hits[begins]] << 20 | count
        zero = np.zeros(len(runs), np.int64)
        yield _batch(FOUND, zero, zero, key[owner[begins]], runs)

    n = shuffle_width(spark)
    segments_ = docs.select("key", "text").mapInArrow(scan, ROW)
    settled = materialize(segments_.repartition(n, "h").sortWithinPartitions("h", "c", "key", "place").mapInArrow(settle, ROW), "settled")

    def bytes_of(kind, then=None, schema="h long, key long, place long, cell binary"):
        wanted = settled.where(f"kind = {kind}").groupBy("key").agg(F.collect_list(F.struct("h", "place")).alias("wanted"))
        cells = docs.select("key", "text").join(wanted, "key").select("key", "text", "wanted")
        # One step in Python, as a stage with two would hold two workers a core.
        return cells.mapInArrow((lambda batches: then(cut_out(batches))) if then else cut_out, schema)

    borders = bytes_of(SEGMENT).repartition(n, "h").sortWithinPartitions("h").mapInArrow(sort_shards, ROW)
    if not settled.where(f"kind = {SPLIT}").isEmpty():
        singles = bytes_of(SPLIT, split_windows, ROW).repartition(n, "h", "c")
        borders = borders.unionAll(singles.sortWithinPartitions("h", "c", "key", "place").mapInArrow(later_windows, ROW))
    return settled.where(f"kind = {FOUND}").unionAll(borders).select("key", "place")


def remove_repeats(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, *carry) of every row.

    kept is the remaining text; characters that a cut has left incomplete are
    not in it, while the digest covers all remaining bytes.
    """
    table = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carry), "key")
    runs = materialize(repeated(table, window), "runs")
    runs = runs.groupBy("key").agg(F.collect_list("place").alias("runs"))
    joined = table.join(runs, "key", "left").select("doc_id", "text", "runs", *carry)

    def cut(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            raw = data.tobytes()
            rows = []
            for i, places in enumerate(batch.column(2)):
                text = raw[at[i] : at[i + 1]]
                spans, kept = [], text
                if places.is_valid:
                    place = np.sort(places.values.to_numpy(zero_copy_only=False))
                    begin, stop = place >> 20, (place >> 20) + (place & ((1 << 20) - 1)) + window - 1
                    reach = np.maximum.accumulate(stop)
                    new = np.ones(len(begin), bool)
                    new[1:] = begin[1:] > reach[:-1]
                    heads = np.flatnonzero(new)
                    spans = list(zip(begin[heads].tolist(), reach[np.append(heads[1:], len(begin)) - 1].tolist(), strict=True))
                    edges = [0, *(x for s in spans for x in s), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            mine = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays([*mine, *batch.columns[3:]], [*names, *carry])

    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    names = schema.names
    return joined.mapInArrow(cut, T.StructType([*schema.fields, *(joined.schema[c] for c in carry)]))
