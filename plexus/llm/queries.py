"""The ten operators and the pipeline as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, decontaminate, packing, quality_rules, sharding, simhash, suffixdedup, tokencount, tokenfile


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.write_tokens(_table(spark, sf_dir, "documents")).read(spark)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    done = chat.format_chat(turns.unionByName(extra))
    back = done.select("conv_id", "formatted", "loss_mask", chat.parse_chat(F.col("formatted")).alias("turns"))
    loss = chat.loss_text(F.col("formatted"), F.col("loss_mask"))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(shown.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ledger", "policy")


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of op 5's policy refuses, refuses alone, and what would be kept without it."""
    return quality_rules.ablations(quality_rules.ledger(_table(spark, sf_dir, "documents")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_vptree,
        op2_token_files,
        op3_decontamination,
        op4_chat_format,
        op5_quality_rules,
        op6_quality_classifier,
        op7_suffix_dedup,
        op8_token_counts,
        op9_packing,
        op10_kd_sharding,
        quality_rule_ablations,
    )
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LEDGER = rf"""
with w as (
  select doc_id, coalesce(text, '') as text, {_WORDS} as ws from documents
), m as (
  select doc_id, text, ws, len(ws) as n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from w
), g as (
  select doc_id, unnest(list_transform(generate_series(1, n_words - 2), lambda i: struct_pack(i := i, g := [ws[i], ws[i + 1], ws[i + 2]]))) as s
  from m where n_words >= 3
), r as (
  select doc_id, s.i as i, count(*) over (partition by doc_id, s.g) as n from g
), c as (
  select doc_id, i - coalesce(lag(i) over (partition by doc_id order by i), -2) as gap from r where n > 1
), t as (
  select doc_id, sum(least(3, gap)) as n_repeat_words from c group by doc_id
), f as (
  select m.doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, len(ls) as n_lines
  from m left join t on t.doc_id = m.doc_id
), l as (
  select *, cast(
    case when n_words < 50 then 1 else 0 end
    + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
    + case when 100 * n_symbols > 30 * n_words then 4 else 0 end
    + case when 100 * n_dup_lines > 50 * n_lines then 8 else 0 end
    + case when word_chars < 2 * n_words then 16 else 0 end
    + case when word_chars > 20 * n_words then 32 else 0 end as bigint) as ledger
  from f
)
"""

ORACLE_SQL = {
    "op5_quality_rules": _LEDGER
    + "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (ledger & 3) <> 0 as base_failed, ledger = 0 as kept, ledger, 'v1' as policy from l",
    "quality_rule_ablations": _LEDGER
    + "select rule, count(*) filter (ledger & bit <> 0) as failed, count(*) filter (ledger = bit) as failed_alone, count(*) filter (ledger = 0 or ledger = bit) as kept_without from l, (values "
    + ", ".join(f"('{rule}', {1 << k})" for k, rule in enumerate(quality_rules.RULES))
    + ") r(rule, bit) group by rule",
}
