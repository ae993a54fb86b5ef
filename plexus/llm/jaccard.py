"""Near copies by SimHash links, each checked by exact Jaccard similarity, and the links that no fingerprint shows.

Two texts are near copies if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more. Two fingerprints of such texts differ in about ten of
64 bits at that similarity, and a tree searched that far would visit nearly all
of itself. So the vantage-point forest (``simhash``) finds the links at 4 bits,
which are most of the work where copies abound, every link is verified on the
whole sets, and a prefix filter then finds the pairs that are left, losing none:

1. In any fixed order of shingles, two near sets share one of the first
   ``n - ceil(0.8 n) + 1`` of each. The order is that of the hashes, so it needs
   no count of the corpus.
2. A shingle that more than HOT texts have in their prefix, such as one of a
   passage that documents share, says little. Texts that have such a one go on to
   a next prefix, in the order with those shingles last. Both sets are kept as
   bitmaps of fixed size, since any superset of either will do. Two near texts
   share a rare shingle of a prefix, or both go on; after ROUNDS prefixes the last
   one has no limit.
3. Each text of a bucket meets the bucket's smallest key. Then the others that
   are still in different components meet each other, large buckets being dealt
   out as pairs of chunks. A candidate has to pass a bound first: the symmetric
   difference, at most (a + b) / 9 for near sets, is never less than the
   differing bits of their parity sketches.

Counting sees each shingle's rows in a stream, and what a task has met often
leaves it as one mark, so no group has to fit in memory.

Defined results: shingles are told by 64-bit hashes and equal word sequences by
128 bits; a text below five words is one shingle, and texts without words (null
and empty ones too) are equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, discard, materialize, serve, shuffle_width, utf8

SHINGLE = 5
SKETCH = 1024
#: A shingle in more prefixes than this is put last; one in this many of a task's block is known to be such.
HOT, HOT_HERE = 16, 17
ROUNDS = 3
BITMAP_BITS = 26
#: Rows of a bucket that are compared with each other in one task, and of buckets that are compared side by side.
CHUNK, SMALL = 4096, 64
BLOCK = 1 << 18
ENTRY, MARK, MET = 0, 1, 2


def shingles(data: bytes) -> np.ndarray:
    """Distinct hashes, in order, of a UTF-8 text's runs of five words; no words are one empty run."""
    found = np.unique(simhash.shingle_hashes(data, SHINGLE))
    return found if len(found) else np.zeros(1, np.uint64)


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of 0.8 or more."""
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return 9 * shared >= 4 * (len(a) + len(b))


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def sketch(x: np.ndarray) -> bytes:
    """Parity of the members in each of SKETCH cells."""
    odd = np.bincount((x % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def may_be_near(n, m, bits, others) -> np.ndarray:
    """The bounds by size and sketch, for arrays of sets."""
    n, m = np.asarray(n, np.int64), np.asarray(m, np.int64)
    differing = np.bitwise_count(bits ^ others).sum(axis=1, dtype=np.int64)
    return (9 * differing <= n + m) & (5 * n >= 4 * m) & (5 * m >= 4 * n)


def _texts(batch: pa.RecordBatch, column: int):
    data, at = utf8(batch.column(column))
    for i in range(batch.num_rows):
        yield data[at[i] : at[i + 1]].tobytes()


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def prints(docs: DataFrame) -> DataFrame:
    """(key, line, fp, n, sketch, prefix): a text's word sequence as a hash, its SimHash and what its set of shingles gives.

    The prefix is twice as long as the first round needs, so that most later
    rounds need no text.
    """

    def run(batches):
        serve("prints")
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), _texts(batch, 1), strict=True):
                hashes = simhash.shingle_hashes(text, SHINGLE)
                found = np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)
                line = hashlib.md5(b" ".join(text.lower().split())).digest()
                fp = np.array([simhash.majority(hashes)], np.uint64).view(np.int64)[0]
                rows.append((key, line, int(fp), len(found), sketch(found), found[: 2 * prefix_length(len(found))].tobytes()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "line", "fp", "n", "sketch", "prefix"])

    return docs.select("key", "text").mapInArrow(run, "key long, line binary, fp long, n int, sketch binary, prefix binary")


ROWS = "kind int, h long, key long"


def _rows(kind, h: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
    kinds = kind if isinstance(kind, np.ndarray) else np.full(len(h), kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.ascontiguousarray(h)), pa.array(np.ascontiguousarray(key))], ["kind", "h", "key"])


def shared_prefixes(one: DataFrame) -> DataFrame:
    """(kind, h, key): ENTRY for each text of a shingle that 2 to HOT prefixes share, MET for a text of a commoner one, MARK for that shingle.

    ``one`` is (key, n, prefix), of which the part that a set of n needs counts.
    """

    def deal(batches):
        held, keys, n = [], [], 0

        def flush():
            h, key = np.concatenate(held).view(np.int64), np.repeat(np.array(keys, np.int64), [len(x) for x in held])
            values, place, count = np.unique(h, return_inverse=True, return_counts=True)
            hot = count >= HOT_HERE
            if hot.any():
                often = hot[place]
                yield _rows(MARK, values[hot], values[hot])
                met = np.unique(key[often])
                yield _rows(MET, met, met)
                h, key = h[~often], key[~often]
            for a in range(0, len(h), 50_000):
                yield _rows(ENTRY, h[a : a + 50_000], key[a : a + 50_000])

        for batch in batches:
            for key, size, prefix in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held.append(np.frombuffer(prefix.as_buffer(), np.uint64)[: prefix_length(size)])
                keys.append(key)
                n += len(held[-1])
                if n >= BLOCK:
                    yield from flush()
                    held, keys, n = [], [], 0
        if held:
            yield from flush()

    def settle(batches):
        """Runs of a shingle, its MARK first; the last run of a batch waits for the next batch, at most HOT rows of it."""
        rest = tuple(np.zeros(0, t) for t in (np.int32, np.int64, np.int64))

        def closed(kind, h, key):
            if not len(h):
                return
            starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            size = np.diff(np.append(starts, len(h)))
            marked = (kind[starts] == MARK) | (size > HOT)
            if marked.any():
                yield _rows(MARK, h[starts[marked]], h[starts[marked]])
                often = np.repeat(marked, size) & (kind == ENTRY)
                yield _rows(MET, key[often], key[often])
            few = np.repeat(~marked & (size > 1), size)
            yield _rows(ENTRY, h[few], key[few])

        for batch in batches:
            new = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            met = new[0] == MET
            if met.any():
                yield _rows(MET, new[1][met], new[2][met])
                new = tuple(x[~met] for x in new)
            kind, h, key = (np.concatenate(x) for x in zip(rest, new, strict=True))
            if not len(h):
                continue
            last = int(np.searchsorted(h, h[-1], "left"))
            yield from closed(kind[:last], h[:last], key[:last])
            rest = kind[last:], h[last:], key[last:]
            if len(rest[1]) > HOT or rest[0][0] == MARK:
                yield from closed(*rest)
                rest = np.full(1, MARK, np.int32), rest[1][:1], rest[1][:1]
        if len(rest[1]) > 1 or len(rest[1]) and rest[0][0] == MARK:
            yield from closed(*rest)

    dealt = one.select("key", "n", "prefix").mapInArrow(deal, ROWS)
    dealt = dealt.repartition(shuffle_width(one.sparkSession), "h").sortWithinPartitions("h", F.desc("kind"))
    return dealt.mapInArrow(settle, ROWS)


def _bitmap(values: DataFrame, hashed) -> np.ndarray:
    """Bit per value of the first BITMAP_BITS bits of ``hashed``; 8 MB at most come to the driver."""
    v = F.shiftrightunsigned(hashed, 64 - BITMAP_BITS) + 1  # the built-in places count from 1
    parts = values.select(v.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    for r in parts.toLocalIterator():
        size = len(r.bits)
        out[(r.at - 1) * size : r.at * size] = np.frombuffer(r.bits, np.uint8)
    return out


def _in(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _key_hash(key: np.ndarray) -> np.ndarray:
    """The same multiplicative hash as in ``_keys``."""
    with np.errstate(over="ignore"):
        return key.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _keys(df: DataFrame) -> np.ndarray:
    """Bitmap of the column ``key``."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_key_hash(batch.column(0).to_numpy(zero_copy_only=False)).view(np.int64)))], ["h"])

    return _bitmap(df.select("key").mapInArrow(run, "h long"), F.col("h"))


def next_prefixes(one: DataFrame, docs: DataFrame, again: np.ndarray, often: np.ndarray) -> DataFrame:
    """(key, n, prefix) of the texts in the bitmap ``again``, in the order with the shingles of ``often`` last.

    ``one`` has the sets' first shingles by hash. Where too few of those are not
    in the bitmap, the set is taken from its text once more.
    """
    table = one.sparkSession.sparkContext.broadcast((again, often))

    def ordered(x: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, int]:
        late = _in(often, x)
        return np.concatenate([x[~late], x[late]]), len(x) - int(late.sum())

    def stored(batches):
        again, often = table.value
        for batch in batches:
            batch = batch.filter(pa.array(_in(again, _key_hash(batch.column(0).to_numpy(zero_copy_only=False)))))
            prefixes = []
            for n, prefix in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(prefix.as_buffer(), np.uint64)
                first, rare = ordered(x, often)
                known = rare >= prefix_length(n) or len(x) == n
                prefixes.append(first[: prefix_length(n)].tobytes() if known else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prefixes, pa.binary())], ["key", "n", "prefix"])

    def read(batches):
        _, often = table.value
        for batch in batches:
            prefixes = []
            for text in _texts(batch, 2):
                x = shingles(text)
                prefixes.append(ordered(x, often)[0][: prefix_length(len(x))].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prefixes, pa.binary())], ["key", "n", "prefix"])

    schema = "key long, n int, prefix binary"
    found = materialize(one.select("key", "n", "prefix").mapInArrow(stored, schema), "prefixes")
    rest = found.where("prefix is null").select("key", "n")
    if rest.isEmpty():
        return found
    # Written, as a stage with two Python steps would hold two workers a core.
    rest = materialize(of_keys(docs, rest), "candidates").join(rest, "key").select("key", "n", "text")
    return found.where("prefix is not null").unionAll(materialize(rest.mapInArrow(read, schema), "prefixes"))


def of_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows (key, text) whose key is in ``keys``, and few others: what a bitmap rules out is not shuffled with them."""
    table = docs.sparkSession.sparkContext.broadcast(_keys(keys))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_in(table.value, _key_hash(batch.column(0).to_numpy(zero_copy_only=False)))))

    return docs.select("key", "text").mapInArrow(run, "key long, text string")


def _all_rows(one: DataFrame) -> DataFrame:
    """(h, key) of every shingle of the prefixes (key, n, prefix)."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                held = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x in held]))], ["h", "key"])

    return one.select("key", "prefix").mapInArrow(run, "h long, key long")


def prefix_rows(one: DataFrame, docs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(h, key) rows of buckets, two near texts of ``one`` (key, n, prefix) sharing one of them, and the tables they are read from."""
    rows, tables, often, now = [], [], np.zeros(1 << (BITMAP_BITS - 3), np.uint8), one
    for k in range(ROUNDS):
        found = materialize(shared_prefixes(now), "shared")
        tables.append(found)
        # Buckets of one order are told from those of another.
        rows.append(found.where(f"kind = {ENTRY}").select(F.col("h").bitwiseXOR(F.lit(k).cast("long")).alias("h"), "key"))
        again = found.where(f"kind = {MET}").select("key")
        if again.isEmpty():
            break
        often |= _bitmap(found.where(f"kind = {MARK}").select("h"), F.col("h"))
        # Texts that the bitmap lets through beside those that have to go on do no harm.
        now = next_prefixes(one, docs, _keys(again), often)
        tables.append(now)
    else:
        rows.append(_all_rows(now).select(F.col("h").bitwiseXOR(F.lit(ROUNDS).cast("long")).alias("h"), "key"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out, tables


def _plausible(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """The pairs (a, b) that pass the bounds; ``facts`` is (key, n, sketch)."""

    def run(batches):
        for batch in batches:
            n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            ok = may_be_near(n, m, _sketches(batch.column(4)), _sketches(batch.column(5))) if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(ok)) for i in (0, 1)], ["a", "b"])

    left = facts.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = facts.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are near; texts of other rows are not shuffled with them."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ok = [near(shingles(x), shingles(y)) for x, y in zip(_texts(batch, 2), _texts(batch, 3), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, t in zip(a, ok, strict=True) if t], pa.int64()), pa.array([x for x, t in zip(b, ok, strict=True) if t], pa.int64())], ["a", "b"])

    texts = materialize(of_keys(docs, pairs.select(F.explode(F.array("a", "b")).alias("key"))), "candidates")
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _across_roots(entries: DataFrame, facts: DataFrame) -> DataFrame:
    """Plausible pairs of a bucket whose roots differ; ``entries`` is (h, key, root), ``facts`` (key, n, sketch)."""

    def run(batches):
        held, last = [], None
        for batch in batches:
            h, lo, hi = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
            stops = np.append(cuts[1:], len(h))
            if not len(h):
                continue
            if held and (h[0], lo[0], hi[0]) != last:
                yield from one_by_one(pa.Table.from_batches(held))
                held = []
            # Small buckets that lie inside the batch are compared side by side.
            inner = np.ones(len(cuts), bool)
            inner[[0, -1]] = False
            small = inner & (stops - cuts <= SMALL)
            if small.any():
                which = np.repeat(small, stops - cuts)
                yield from side_by_side(batch.filter(pa.array(which)), np.repeat(np.arange(len(cuts)), stops - cuts)[which])
            for i in np.flatnonzero(~small).tolist():
                if held and i:
                    yield from one_by_one(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(cuts[i], stops[i] - cuts[i]))
            last = h[-1], lo[-1], hi[-1]
        if held:
            yield from one_by_one(pa.Table.from_batches(held))

    def emitted(a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def side_by_side(batch, group):
        key, root, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "root", "n"))
        bits = _sketches(batch.column("sketch"))
        for step in range(1, SMALL):
            i = np.flatnonzero(group[step:] == group[:-step]) if step < len(group) else np.zeros(0, np.int64)
            if not len(i):
                break
            j = i + step
            ok = (root[i] != root[j]) & (5 * n[i] >= 4 * n[j]) & (5 * n[j] >= 4 * n[i])
            for a in range(0, int(ok.sum()), 50_000):
                x, y = i[ok][a : a + 50_000], j[ok][a : a + 50_000]
                near_ = may_be_near(n[x], n[y], bits[x], bits[y])
                if near_.any():
                    yield emitted(key[x[near_]], key[y[near_]])

    def one_by_one(table):
        key, root, n = (table.column(c).to_numpy() for c in ("key", "root", "n"))
        roots, place, count = np.unique(root, return_inverse=True, return_counts=True)
        if len(roots) < 2:
            return
        bits = _sketches(table.column("sketch"))
        # Of two rows with different roots, one at least is not of the commonest root.
        for i in np.flatnonzero(place != np.argmax(count)).tolist():
            ok = may_be_near(n[i], n, bits[i][None], bits) & (root != root[i])
            if ok.any():
                yield emitted(key[ok], np.full(int(ok.sum()), key[i]))

    sizes = entries.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("m"))
    sizes = materialize(sizes.where("low <> high").select("h", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks")), "buckets")
    dealt = entries.join(sizes, "h").join(facts, "key").withColumn("own", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("h", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "key", "root", "n", "sketch")
    dealt = dealt.repartition(shuffle_width(entries.sparkSession), "h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def later_copies(docs: DataFrame) -> DataFrame:
    """(key) of the rows that aren't the smallest of their component; ``docs`` is (key, text), key unique."""
    docs = docs.select(F.col("key").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    every = materialize(prints(docs), "prints")
    # Equal word sequences are one text from here on.
    first = materialize(every.groupBy("line").agg(F.min("key").alias("key")).select("key"), "firsts")
    copies = materialize(every.select("key").join(first, "key", "left_anti"), "copies")
    one = materialize(every.join(first, "key", "left_semi").select("key", "fp", "n", "sketch", "prefix"), "texts")
    discard(every, first)
    facts = one.select("key", "n", "sketch")

    # Links of fingerprints, through one text of each.
    classes = materialize(one.groupBy("fp").agg(F.min("key").alias("of")), "classes")
    ends = lambda c, k: classes.select(F.col("fp").alias(c), F.col("of").alias(k))
    links = simhash.links(classes, classes.count()).toDF("fa", "fb").join(ends("fa", "a"), "fa").join(ends("fb", "b"), "fb").select("a", "b")
    links = links.unionAll(one.join(classes, "fp").where("key <> of").select(F.col("of").alias("a"), F.col("key").alias("b")))

    # Buckets of shared prefix shingles.
    rows, tables = prefix_rows(one.select("key", "n", "prefix"), docs)
    every_entry = materialize(rows, "entries")
    discard(*tables)
    lowest = every_entry.groupBy("h").agg(F.min("key").alias("a"), F.count(F.lit(1)).alias("m")).where("m > 1")
    entries = materialize(every_entry.join(materialize(lowest, "lowest"), "h").where("key <> a"), "entries")
    discard(every_entry)
    stars = entries.select("a", F.col("key").alias("b"))

    pairs = links.unionAll(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(_plausible(materialize(pairs, "pairs"), facts), "plausible")
    edges = materialize(_verified(pairs, docs), "near")

    # The lowest of each bucket has met all others; of two texts or one there is no other pair.
    roots = connected_components(edges).select(F.col("node").alias("key"), "root")
    rooted = entries.where("m > 2").select("h", "key").join(roots, "key", "left").select("h", "key", F.coalesce("root", "key").alias("root"))
    more = materialize(_across_roots(materialize(rooted, "rooted"), facts), "plausible")
    more = more if more.isEmpty() else materialize(_verified(more, docs), "near")
    if not more.isEmpty():
        roots = connected_components(edges.unionAll(more)).select(F.col("node").alias("key"))
    out = materialize(copies.unionAll(roots.select("key")), "later")
    discard(one, classes, entries, pairs)
    return out
