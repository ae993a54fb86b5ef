"""Token counts by a map-side two-tier lookup, without any pre-token shuffle.

Tier one is a broadcast hash table from the corpus's most frequent pre-tokens to
their token counts. Which they are is measured over all texts with mergeable
frequent-items sketches of fixed size: tasks send sketches, never pre-tokens.
Their counts come from the tokenizer. The table has at most ``FREQUENT`` entries
of at most ``LONGEST`` characters, whatever the corpus. Tier two are bounded
caches that each worker fills by encoding what the table lacks. The tiers decide
speed only; every count is the library's.

Defined results: null and empty texts have 0 bytes and 0 tokens; every row gives
one row, repeated rows included; an empty table gives no row.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each, serve
from .tokens import LONGEST, TokenCounter, library, public_path

FREQUENT = 8192
#: Items that a sketch keeps track of, and groups in which sketches are merged before the last.
TRACKED = 16384
MERGES = 32


def frequent(docs: DataFrame, most: int = FREQUENT) -> list[str]:
    """The most frequent pre-tokens, by estimated count over all texts."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(TokenCounter.PIECES.pattern), F.lit(0))).alias("w")).where(F.length("w") <= LONGEST)
    part = F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("part")
    sketches = words.groupBy(part).agg(F.expr(f"approx_top_k_accumulate(w, {TRACKED})").alias("s"))
    # Grouped by a constant, as an empty table has no sketch to combine.
    top = sketches.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {TRACKED}), {most})").alias("top")).first()
    return [r[0] for r in top.top] if top else []


def frequent_lengths(pretokens: list[str], path: str) -> dict[str, int]:
    """Pre-token -> token count for those that the tokenizer cuts out whole."""
    tokenizer = library(path)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    whole = [p for p in pretokens if TokenCounter.PIECES.fullmatch(p) and not any(s in p for s in special)]
    return dict(zip(whole, (len(e.ids) for e in tokenizer.encode_batch(whole, add_special_tokens=False)), strict=True))


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    path = public_path(tokenizer)
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(frequent(docs), path))
    made = uuid.uuid4().hex

    def run(batches):
        serve("counts", _counters.clear)
        counter = _counters.get(made)
        if counter is None:
            _counters.clear()
            counter = _counters[made] = TokenCounter(path, table.value)
        for batch in batches:
            n = [counter.count(t) if t else 0 for t in each(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
