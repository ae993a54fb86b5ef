"""Helpers shared by the training-data operators.

Conventions that hold for every operator of this subpackage:

* only the columns an operator needs are selected, so extra columns, also ones
  whose names clash with an output column, are ignored;
* a null text counts as the empty text; a null key stays a row of its own;
* intermediate results that are read more than once become a written table in
  the folder that ``spark.checkpoint.dir`` names, which all executors share.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors; set only where the session names none, and then for a local master only."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="plexus-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, which cuts its lineage."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of materialized tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keyed(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a unique long key ``name`` that follows the documents' order.

    The key is doc_id, or, where that is null or repeats, a row's place by doc_id
    (nulls first), the text's hash and the row's place in the table. Many rows of
    one id, or of no id, are dealt over partitions like any other; the second form
    is a written table.
    """
    if not df.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).count():
        return df.withColumn(name, F.col("doc_id").cast("long"))
    # The ids of range-sorted partitions rise with the order, which is all that a key must do.
    placed = df.withColumns({"__text": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    order = ["doc_id", "__text", "__row"]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("__text", "__row")
    return materialize(ordered.withColumn(name, F.monotonically_increasing_id()), "keyed")


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``key``: the same rule at any size.

    A threshold on the hash, from the table's count, comes before the ranking,
    so what all tasks together send is about ``rows`` rows too.
    """
    n, top = df.count(), 1 << 30
    place = F.pmod(F.xxhash64(key), F.lit(top))
    near = df if n <= rows else df.where(place < int(top * min(1.0, 1.25 * rows / n)))
    return near.orderBy(place, key).limit(rows)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def filesystem(path: str):
    """(pyarrow filesystem, path in it) of a folder; works on drivers and executors."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> None:
    """Write a small file, from the driver."""
    system, name = filesystem(path)
    system.create_dir(os.path.dirname(name), recursive=True)
    with system.open_output_stream(name) as out:
        out.write(data)


def each(column: pa.Array):
    """Python values one at a time, so that a batch's texts are never all Python strings at once."""
    return (x.as_py() for x in column)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.zeros(1, np.int64)
    if n:
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


_serving: dict = {"name": None, "drop": None}


def serve(name: str, drop=None) -> None:
    """Tell this worker which operator it serves: what another one has cached is dropped."""
    if _serving["name"] != name:
        if _serving["drop"]:
            _serving["drop"]()
        _serving.update(name=name, drop=drop)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long) that isn't its component's smallest.

    Alternating large-star and small-star rounds: each is a minimum by node,
    pre-aggregated before its shuffle and written, and an equi-join of written
    tables, which adaptive execution can split where a hub is large. So the plan
    does not grow and a lost executor costs a step of a round at most.
    """
    star = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star = materialize(star, "edges")
    before = None
    for _ in range(max_rounds):
        # Minima are written tables: a join of two plain tables can be split where a hub is large.
        both = star.unionAll(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        after = materialize(small, "edges")
        discard(star, low, large, least)
        star = after
        now = star.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(now) == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(now)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
