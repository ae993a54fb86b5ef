"""Full-text and exact vector search, and their fusion, as expression plans.

Full-text scoring is built-in functions only, so it stays in generated code and
a label, type or property filter reaches the scan; a written table of words by
their beginnings lets a search read the matching rows only. Vector scores use an unrolled
dot product of literals for one query; a batch of queries runs as one pass over
the vectors in Arrow batches, with a bounded matrix of queries per pass; a frame of
queries is dealt over tasks that each read the vectors through, block by block.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import Value, strict_predicate
from ..model import GraphData, Scan, subscript
from ..sources.paths import filesystem
from .traversal import cut, distinct_neighbors, adjacency

MODES = ("all", "any", "phrase", "prefix")
TOKENIZERS = ("unicode61", "trigram")
METRICS = ("cosine", "dot", "euclidean")
CHAR = r"[\p{IsAlphabetic}\p{N}_]"
WORD = rf"({CHAR}+)"
SPACE = r"(?U)\s+"
QUERY_BLOCK = 1024
TOKEN_BUCKETS = 64


# Text


def normalize(c: Column) -> Column:
    """Lower case, runs of Unicode white space collapsed to one space."""
    return F.trim(F.regexp_replace(F.lower(c), SPACE, " "))


def normalize_python(text: str) -> str:
    """``normalize`` of a query. White space is Unicode's, to which \\x1c to \\x1f don't belong."""
    return " ".join(x for x in re.split(r"[^\S\x1c-\x1f]+", text.lower()) if x)


def word_tokens(text: str) -> list[str]:
    """Maximal runs of alphanumeric characters or underscores."""
    import regex

    return regex.findall(r"[\p{Alphabetic}\p{N}_]+", text)


def check_search(index: dict, query: str, mode: str, labels, edge_type, limit: int) -> list[str]:
    """Validate a search and return its units."""
    if mode not in MODES:
        raise ValueError("full-text mode must be 'all', 'any', 'phrase', or 'prefix'")
    if limit == 0:
        raise ValueError("limit must be greater than zero")
    check_target(index, labels, edge_type, "full-text")
    text = normalize_python(query)
    if not text:
        raise ValueError("full-text query cannot be empty")
    if mode == "prefix" and index["tokenizer"] != "unicode61":
        raise ValueError("prefix mode is only supported by the unicode61 tokenizer")
    if index["tokenizer"] == "trigram":
        units = [text] if mode == "phrase" else text.split(" ")
        if any(len(u) < 3 for u in units):
            raise ValueError("trigram query fragments must contain at least 3 characters")
        return units
    if mode == "phrase":
        return [text]
    units = word_tokens(text)
    if not units:
        raise ValueError("full-text query cannot be empty")
    return list(dict.fromkeys(units))


def check_target(index: dict, labels, edge_type, what: str) -> None:
    if index["target"] == "node" and edge_type is not None:
        raise ValueError(f"edge_type cannot be used with a node {what} index")
    if index["target"] == "edge" and labels:
        raise ValueError(f"labels cannot be used with an edge {what} index")


def target_scan(data: GraphData, index: dict, labels, edge_type, properties: dict[str, Any] | None, keys=()) -> tuple[Scan, DataFrame]:
    """The indexed kind's rows under a search's filters."""
    wanted = {*keys, *(properties or {})}
    s = data.node_scan(tuple(labels or ()), wanted) if index["target"] == "node" else data.edge_scan(edge_type, wanted)
    df = s.df
    for k, v in (properties or {}).items():
        df = df.where(strict_predicate(subscript(s, k), "eq", v))
    return s, df


def _unit_hits(v: Value, units: list[str], index: dict, mode: str) -> list[Column]:
    """Whether a property holds each unit: as a substring, as a whole word or as a word's beginning.

    A word is a maximal run of word characters, so a unit is one where no such
    character stands before it and, unless a beginning will do, none after it.
    """
    if mode == "phrase" or index["tokenizer"] == "trigram":
        text = normalize(v.of("string"))
        return [F.coalesce(F.contains(text, F.lit(u)), F.lit(False)) for u in units]
    text = F.lower(v.of("string"))
    after = "" if mode == "prefix" else f"(?!{CHAR})"
    return [F.coalesce(F.contains(text, F.lit(u)) & text.rlike(f"(?<!{CHAR}){u}{after}"), F.lit(False)) for u in units]


def _shown(v: Value, index: dict, mode: str) -> Column:
    return normalize(v.of("string")) if mode == "phrase" or index["tokenizer"] == "trigram" else F.lower(v.of("string"))


def _any(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _ranked(df: DataFrame, limit: int | None, offset: int) -> DataFrame:
    out = df.orderBy(F.desc("score"), "id")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def _score(n_units: Column, units: list[str], n_fields: Column, fields: list[str]) -> Column:
    return (0.8 * n_units / len(units) + 0.2 * n_fields / len(fields)).cast("double")


def search_text(data: GraphData, index: dict, query: str, mode: str = "all", labels=None, edge_type=None, properties=None, limit: int | None = 20, offset: int = 0, tokens: DataFrame | None = None) -> DataFrame:
    """(id, score, matched_fields) by falling score, then id; limit None returns all matches.

    With ``tokens``, the index's current ``token_table``, words are looked up there and no text is read.
    """
    units = check_search(index, query, mode, labels, edge_type, 1 if limit is None else limit)
    fields = index["properties"]
    if tokens is not None and mode != "phrase" and index["tokenizer"] == "unicode61" and len(units) <= 62 and len(fields) <= 62:
        out = _from_tokens(tokens, units, fields, mode)
        if labels or edge_type is not None or properties:
            out = out.join(target_scan(data, index, labels, edge_type, properties)[1].select("id"), "id", "left_semi")
        return _ranked(out, limit, offset)
    s, df = target_scan(data, index, labels, edge_type, properties, fields)
    hits = {f: _unit_hits(subscript(s, f), units, index, mode) for f in fields}
    # A row that lacks a unit as a plain substring of every property is out before any pattern is run.
    holds = [_any(F.coalesce(F.contains(_shown(subscript(s, f), index, mode), F.lit(u)), F.lit(False)) for f in fields) for u in units]
    df = df.where(_any(holds) if mode == "any" else _all(holds))
    # One column for each field: which units it has.
    df = df.select("id", *[F.array(*h).alias(f"h{i}") for i, h in enumerate(hits.values())])
    unit = [F.lit(False) for _ in units]
    for i in range(len(fields)):
        unit = [u | F.col(f"h{i}")[k] for k, u in enumerate(unit)]
    n_units = sum((u.cast("int") for u in unit[1:]), unit[0].cast("int"))
    met = [F.array_contains(f"h{i}", True) for i in range(len(fields))]
    n_fields = sum((m.cast("int") for m in met[1:]), met[0].cast("int"))
    enough = n_units == len(units) if mode != "any" else n_units > 0
    names = F.array_compact(F.array(*[F.when(m, F.lit(f)) for m, f in zip(met, fields, strict=True)]))
    return _ranked(df.where(enough).select("id", _score(n_units, units, n_fields, fields).alias("score"), names.alias("matched_fields")), limit, offset)


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(F.substring(token, 1, 2)), F.lit(TOKEN_BUCKETS)).cast("int")


def token_table(data: GraphData, index: dict, path: str) -> DataFrame:
    """Write the index's words as (bucket, token, id, field) and read them back; ``field`` is a property's place.

    Files are by bucket of the first two characters and sorted by token, so a
    lookup, also of a word's beginning, reads few of them. A common word's rows are
    spread over tasks by their ids.
    """
    s, df = target_scan(data, index, None, None, None, index["properties"])
    parts = []
    for i, f in enumerate(index["properties"]):
        words = F.array_distinct(F.regexp_extract_all(F.lower(subscript(s, f).of("string")), F.lit(WORD), 1))
        parts.append(df.select(F.explode(words).alias("token"), "id", F.lit(i).alias("field")))
    rows = reduce(lambda a, b: a.unionAll(b), parts).withColumn("bucket", _bucket(F.col("token")))
    rows = rows.repartitionByRange("bucket", "token", "id").sortWithinPartitions("bucket", "token", "id")
    rows.write.partitionBy("bucket").parquet(path)
    return data.spark.read.schema("token string, id long, field int, bucket int").parquet(path)


def _from_tokens(tokens: DataFrame, units: list[str], fields: list[str], mode: str) -> DataFrame:
    """(id, score, matched_fields) of the entities that have the units."""
    token = F.col("token")
    # The beginning of one character doesn't tell the bucket.
    places = F.lit(True) if mode == "prefix" and min(map(len, units)) < 2 else _any(F.col("bucket") == _bucket(F.lit(u)) for u in units)
    match = (lambda u: F.startswith(token, F.lit(u))) if mode == "prefix" else (lambda u: token == u)
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(match(u), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, u in enumerate(units)])
    found = tokens.where(places).where(_any(match(u) for u in units)).select("id", bits.alias("units"), F.expr("shiftleft(1L, field)").alias("fields"))
    found = found.groupBy("id").agg(F.bit_or("units").alias("units"), F.bit_or("fields").alias("fields"))
    n_units, n_fields = F.bit_count("units"), F.bit_count("fields")
    enough = n_units == len(units) if mode != "any" else n_units > 0
    names = F.array_compact(F.array(*[F.when(F.col("fields").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(f)) for i, f in enumerate(fields)]))
    return found.where(enough).select("id", _score(n_units, units, n_fields, fields).alias("score"), names.alias("matched_fields"))


# Vectors


def check_vector(index: dict, vector: list[float], what: str = "vector") -> list[float]:
    """A vector as float32 values, or an error."""
    if len(vector) != index["dimensions"]:
        raise ValueError(f"{what} dimensions must be {index['dimensions']}, not {len(vector)}")
    out = np.asarray(vector, np.float64).astype(np.float32)
    if not np.isfinite(out).all():
        raise ValueError(f"{what} values must be finite")
    if index["metric"] == "cosine" and not out.any():
        raise ValueError(f"{what} cannot be zero for cosine")
    return out.tolist()


def similarity(vector: Column, query: list[float], metric: str) -> Column:
    """Score of a float32 vector column against a literal query, in double precision.

    Sums are unrolled into a balanced tree of plain arithmetic: it is compiled
    with the stage, which a higher-order function isn't.
    """

    def total(terms: list[Column]) -> Column:
        while len(terms) > 1:
            terms = [terms[i] + terms[i + 1] if i + 1 < len(terms) else terms[i] for i in range(0, len(terms), 2)]
        return terms[0]

    x = [vector[i].cast("double") for i in range(len(query))]
    if metric == "euclidean":
        return 1.0 / (1.0 + F.sqrt(total([(a - b) * (a - b) for a, b in zip(x, query, strict=True)])))
    dot = total([a * b for a, b in zip(x, query, strict=True)])
    if metric == "dot":
        return dot
    norm = math.sqrt(sum(b * b for b in query))
    return dot / (F.sqrt(total([a * a for a in x])) * norm)


def _vectors(data: GraphData, index: dict, labels, edge_type, properties) -> DataFrame:
    check_target(index, labels, edge_type, "vector")
    v = data.table("vectors").where(F.col("index_name") == index["name"]).select(F.col("entity_id").alias("id"), "vector")
    if labels or edge_type is not None or properties:
        _, allowed = target_scan(data, index, labels, edge_type, properties)
        v = v.join(allowed.select("id"), "id", "left_semi")
    return v


def _check_min(min_score: float | None, limit: int | None) -> None:
    if limit == 0:
        raise ValueError("limit must be greater than zero")
    if min_score is not None and not math.isfinite(min_score):
        raise ValueError("min_score must be finite")


def search_vector(data: GraphData, index: dict, query: list[float], labels=None, edge_type=None, properties=None, min_score: float | None = None, limit: int | None = 20, offset: int = 0) -> DataFrame:
    """(id, score) by falling score, then id; all of them if ``limit`` is None."""
    _check_min(min_score, limit)
    q = check_vector(index, query, "query vector")
    v = _vectors(data, index, labels, edge_type, properties)
    if index["dimensions"] <= 256:
        out = v.select("id", similarity(F.col("vector"), q, index["metric"]).alias("score"))
    else:
        out = scored(v, [q], index["metric"]).select("id", "score")
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    out = out.orderBy(F.desc("score"), "id")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Scores of the rows of ``x`` for each row of ``q``, in double precision."""
    if metric == "euclidean":
        d = (x * x).sum(1)[None] + (q * q).sum(1)[:, None] - 2 * (q @ x.T)
        close = d < 1e-6 * (x * x).sum(1)[None]
        if close.any():  # cancellation: take these differences directly
            a, b = np.nonzero(close)
            d[a, b] = ((q[a] - x[b]) ** 2).sum(1)
        return 1.0 / (1.0 + np.sqrt(np.maximum(d, 0)))
    dot = q @ x.T
    return dot if metric == "dot" else dot / (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None])


def _keep_best(held, ids: np.ndarray, scores: np.ndarray, keep: int | None):
    """(ids, scores) of the best ``keep`` a query among those held and new; ties go to the smaller id."""
    ids = np.broadcast_to(ids, scores.shape)
    if held is not None:
        ids, scores = np.concatenate([held[0], ids], axis=1), np.concatenate([held[1], scores], axis=1)
    if keep is None or scores.shape[1] <= keep:
        return ids, scores
    n = len(scores)
    out_ids, out_scores = np.empty((n, keep), np.int64), np.empty((n, keep))
    for i in range(n):
        edge = np.partition(scores[i], -keep)[-keep]
        near = np.flatnonzero(scores[i] >= edge)
        best = near[np.lexsort((ids[i][near], -scores[i][near]))[:keep]]
        out_ids[i], out_scores[i] = ids[i][best], scores[i][best]
    return out_ids, out_scores


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1).astype(np.float64)


def scored(vectors: DataFrame, queries: list[list[float]], metric: str, keep: int | None = None, min_score: float | None = None) -> DataFrame:
    """(query, id, score) of all vectors; with ``keep``, each task sends its best ``keep`` a query.

    Ties at the cut go to the smaller id, so merging the tasks' bests is exact.
    """
    if len(queries) > QUERY_BLOCK:
        out = scored(vectors, queries[:QUERY_BLOCK], metric, keep, min_score)
        rest = scored(vectors, queries[QUERY_BLOCK:], metric, keep, min_score)
        return out.unionAll(rest.withColumn("query", F.col("query") + QUERY_BLOCK))
    q = np.asarray(queries, np.float32).astype(np.float64)

    def emit(ids, scores):
        which = np.repeat(np.arange(len(q)), scores.shape[1])
        ids, flat = ids.ravel(), scores.ravel()
        if min_score is not None:
            ok = flat >= min_score
            which, ids, flat = which[ok], ids[ok], flat[ok]
        return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(np.ascontiguousarray(ids)), pa.array(flat)], ["query", "id", "score"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            ids, found = b.column(0).to_numpy(zero_copy_only=False), _scores(q, _matrix(b.column(1), b.num_rows), metric)
            if keep is None:
                yield emit(*_keep_best(None, ids, found, None))
            else:
                held = _keep_best(held, ids, found, keep)
        if held is not None:
            yield emit(*held)

    return vectors.select("id", "vector").mapInArrow(run, "query int, id long, score double")


def search_each(data: GraphData, index: dict, queries: DataFrame, labels=None, edge_type=None, properties=None, min_score: float | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """(query, position, id, score) for a frame of queries (query: long, vector: array<float>) of any size.

    The vectors become a written table. A task takes QUERY_BLOCK of its queries at
    a time and reads the vectors through once for them, keeping the best of each;
    so queries and results never pass the driver, nothing is broadcast or shuffled
    but the queries, and memory holds a block of either side.
    """
    _check_min(min_score, limit)
    metric, keep, wide = index["metric"], limit + offset, index["dimensions"]
    folder = cut(_vectors(data, index, labels, edge_type, properties)).inputFiles()
    folder = folder[0].rsplit("/", 1)[0] if folder else None

    def run(batches):
        from pyarrow import dataset

        for b in batches:
            for a in range(0, b.num_rows, QUERY_BLOCK):
                part = b.slice(a, QUERY_BLOCK)
                sizes = part.column(1).value_lengths().to_pylist()
                if any(n != wide for n in sizes):
                    raise ValueError(f"query vector dimensions must be {wide}, not {next(n for n in sizes if n != wide)}")
                keys, q = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), part.num_rows)
                if not np.isfinite(q).all():
                    raise ValueError("query vector values must be finite")
                if metric == "cosine" and not q.any(axis=1).all():
                    raise ValueError("query vector cannot be zero for cosine")
                system, path = filesystem(folder)
                held = None
                for x in dataset.dataset(path, filesystem=system, format="parquet").to_batches(columns=["id", "vector"], batch_size=8192):
                    if x.num_rows:
                        held = _keep_best(held, x.column(0).to_numpy(zero_copy_only=False), _scores(q, _matrix(x.column(1), x.num_rows), metric), keep)
                if held is None:
                    continue
                order = np.lexsort((held[0], -held[1]), axis=1)[:, offset:]
                ids, found = np.take_along_axis(held[0], order, 1), np.take_along_axis(held[1], order, 1)
                n = ids.shape[1]
                ok = np.ones(ids.size, bool) if min_score is None else found.ravel() >= min_score
                columns = (np.repeat(keys, n), np.tile(np.arange(n, dtype=np.int32), len(keys)), ids.ravel(), found.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(c[ok]) for c in columns], ["query", "position", "id", "score"])

    schema = "query long, position int, id long, score double"
    if folder is None:
        return data.spark.createDataFrame([], schema)
    asked = queries.select(F.col("query").cast("long").alias("query"), F.col("vector").cast("array<float>").alias("vector"))
    return asked.mapInArrow(run, schema)


def search_vectors(data: GraphData, index: dict, queries: list[list[float]], labels=None, edge_type=None, properties=None, min_score: float | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """(query, position, id, score) of each query, in one pass over the vectors."""
    _check_min(min_score, limit)
    checked = [check_vector(index, q, f"query vector at index {i}") for i, q in enumerate(queries)]
    v = _vectors(data, index, labels, edge_type, properties)
    if not checked:
        return data.spark.createDataFrame([], "query int, position int, id long, score double")
    best = scored(v, checked, index["metric"], limit + offset, min_score)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    # The bound on the row number is pushed below the shuffle.
    ranked = best.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit + offset)
    return ranked.where(F.col("n") > offset).select("query", (F.col("n") - 1 - offset).alias("position"), "id", "score")


# Hybrid retrieval


def retrieve_context(
    data: GraphData,
    *,
    text_query: str | None = None,
    text_index: dict | None = None,
    vector_query: list[float] | None = None,
    vector_index: dict | None = None,
    labels=None,
    edge_type=None,
    properties=None,
    radius: int = 1,
    direction: str = "both",
    limit: int = 20,
    text_weight: float = 1.0,
    vector_weight: float = 1.0,
    graph_weight: float = 0.1,
) -> DataFrame:
    """(kind, id, score, distance, text_score, vector_score) best first.

    Each candidate of a search adds its weighted score and the graph weight;
    each node within ``radius`` of a candidate (of both ends, for an edge) adds
    the same with half the graph weight, once per candidate and seed.
    """
    spark = data.spark
    if radius < 0:
        raise ValueError("radius must be non-negative")
    if limit <= 0:
        raise ValueError("limit must be greater than zero")
    for name, q, index in (("text", text_query, text_index), ("vector", vector_query, vector_index)):
        if (q is None) != (index is None):
            raise ValueError(f"{name}_query and {name}_index must be provided together")
    empty = spark.createDataFrame([], "kind string, id long, score double, distance int, text_score double, vector_score double")
    many, parts = max(limit * 4, 20), []
    for name, q, index, weight in (("text", text_query, text_index, text_weight), ("vector", vector_query, vector_index, vector_weight)):
        if q is None:
            continue
        # Filters go to both searches as they are; one of the wrong kind is an error there.
        kind = index["target"]
        found = search_text(data, index, q, "all", labels, edge_type, properties, many) if name == "text" else search_vector(data, index, q, labels, edge_type, properties, None, many)
        parts.append(found.select(F.lit(name).alias("source"), F.lit(kind).alias("kind"), "id", "score", F.lit(float(weight)).alias("weight")))
    if not parts:
        return empty
    cand = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    # At most 2 * max(4 * limit, 20) candidates, so they and their seeds may be broadcast.
    cand = cut(cand.withColumn("c", F.monotonically_increasing_id()))
    own = cand.select("kind", "id", (F.col("score") * F.col("weight") + graph_weight).alias("add"), F.lit(0).alias("distance"), "source", "score")
    # A seed is one end of a candidate; a loop seeds its node twice.
    ends = data.edge_scan(None).df.select(F.col("id").alias("e"), F.posexplode(F.array("src", "dst")).alias("end", "seed"))
    from_edges = F.broadcast(cand.where("kind = 'edge'")).join(ends, F.col("id") == F.col("e")).select((F.col("c") * 2 + F.col("end")).alias("c"), "seed", "source", "score", "weight")
    from_nodes = cand.where("kind = 'node'").select((F.col("c") * 2).alias("c"), F.col("id").alias("seed"), "source", "score", "weight")
    seeds = cut(from_nodes.unionAll(from_edges))
    level = reach = seeds.select("c", F.col("seed").alias("node"))
    adj = adjacency(data, direction, None)
    for _ in range(radius):
        near = distinct_neighbors(adj.join(level.select("node").distinct(), "node", "left_semi"))
        met = near.join(level, "node").select("c", F.col("nbr").alias("node")).distinct()
        level = cut(met.join(reach, ["c", "node"], "left_anti"))
        if level.isEmpty():
            break
        reach = reach.unionAll(level)
    hits = reach.join(seeds, "c").where("node <> seed")
    expanded = hits.select(F.lit("node").alias("kind"), F.col("node").alias("id"), (F.col("score") * F.col("weight") + graph_weight / 2).alias("add"), F.lit(1).alias("distance"), "source", "score")
    every = own.unionAll(expanded)
    by = lambda s: F.max(F.when(F.col("source") == s, F.col("score"))).alias(f"{s}_score")
    out = every.groupBy("kind", "id").agg(F.sum("add").alias("score"), F.min("distance").alias("distance"), by("text"), by("vector"))
    return out.orderBy(F.desc("score"), "distance", "kind", "id").limit(limit)
