"""Append a stream of edges to a native edge table, and keep rolling counts of it.

Micro-batches are written as Parquet under a batch number, so a batch that is
run again after a failure replaces its own output and nothing is doubled. The
folder reads as a native edge source of a graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import Source


def append_edges(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write a stream of (id, src, dst, properties...) into ``folder``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def edge_source(spark, folder: str, edge_type: str, kinds: dict[str, str]) -> Source:
    """What ``append_edges`` has written so far, as edges of one type."""
    df = spark.read.parquet(folder).select("id", "src", "dst", *kinds)
    return Source(df, (edge_type,), dict(kinds))


def rolling_degree(stream: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """(window, src, degree): edges leaving a node in each window, late rows dropped after ``late``."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), "src").agg(F.count(F.lit(1)).alias("degree"))
