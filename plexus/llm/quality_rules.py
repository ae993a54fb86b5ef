"""Quality rules as a bitmask ledger, in DataFrame operations only.

Every rule is evaluated once over the whole text. A ledger row keeps the failure
bits beside the measurements they came from, so a policy, which is a version
name and the set of rule bits it enforces, is applied by one bitwise test, and
ablations are bitwise aggregates over the ledger: no text is read again.

Repeated three-word windows are found per text without leaving the row: each
window's hash, with the window's place in its low bits, is sorted, equal
neighbours are confirmed word by word, and the union of their places is
measured. The work is n log n in a text's words.

Defined results: null and empty texts have no words and fail the base rules;
rows are judged one by one, so repeated rows give equal results, and null and
repeated ids stay as they are; an empty table gives no row, in ablations neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Rule name -> SQL condition under which it fails, over the measurements. The position is the rule's bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Policy version -> rules that it enforces.
POLICIES = {"v1": tuple(RULES), "v1-base": BASE}

#: Bound names: ws the words, b the bits that a place takes.
_REPEATS = r"""
aggregate(
  sort_array(element_at(transform(array(sort_array(transform(
      sequence(0, size(ws) - 3),
      i -> (xxhash64(ws[i], ws[i + 1], ws[i + 2]) & shiftleft(-1L, b)) | i))),
    p -> transform(
      filter(p, (x, j) ->
        (shiftright(get(p, j - 1), b) <=> shiftright(x, b) AND {same_before}) OR
        (shiftright(get(p, j + 1), b) <=> shiftright(x, b) AND {same_after})),
      x -> cast(x & ~shiftleft(-1L, b) AS int))), 1)),
  named_struct('last', -3, 'n', 0L),
  (s, x) -> named_struct('last', x, 'n', s.n + least(3, x - s.last)),
  s -> s.n)
"""


def _same(other: str) -> str:
    place = "cast({} & ~shiftleft(-1L, b) AS int)"
    a, c = place.format("x"), place.format(other)
    return " AND ".join(f"ws[{a} + {k}] = ws[{c} + {k}]" for k in range(3))


def measurements() -> Column:
    """Struct of n_words, word_chars, n_lines, n_dup_lines and n_repeat_words of ``text``."""
    repeats = _REPEATS.format(same_before=_same("get(p, j - 1)"), same_after=_same("get(p, j + 1)"))
    words = r"split(trim(BOTH ' \u0009\u000A\u000B\u000C\u000D' FROM text), '[\\x20\\x09-\\x0D]+')"
    return F.expr(
        f"""
        element_at(transform(array(filter({words}, w -> w <> '')), ws -> named_struct(
          'n_words', cast(size(ws) AS long),
          'word_chars', cast(length(array_join(ws, '')) AS long),
          'n_repeat_words', if(size(ws) < 3, 0L, element_at(transform(array(length(bin(size(ws)))), b -> {repeats}), 1)))), 1)
        """
    )


def ledger(docs: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, measurements, ledger) of every row; bit k of ledger is set where rule k fails."""
    rules = rules or RULES
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"
    measured = slim.select(
        "doc_id",
        measurements().alias("m"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.expr(f"element_at(transform(array({lines}), ls -> named_struct('n', size(ls), 'd', size(ls) - size(array_distinct(ls)))), 1)").alias("l"),
    )
    flat = measured.select(
        "doc_id", "m.n_words", "m.word_chars", "n_symbols", F.col("l.n").cast("long").alias("n_lines"), F.col("l.d").cast("long").alias("n_dup_lines"), "m.n_repeat_words"
    )
    bits = F.lit(0).cast("long")
    for k, condition in enumerate(rules.values()):
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return flat.withColumn("ledger", bits)


def policy_mask(policy: str | tuple, rules: dict[str, str] | None = None) -> int:
    names = list(rules or RULES)
    return sum(1 << names.index(r) for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def apply_policy(rows: DataFrame, policy: str | tuple = "v1", base: tuple = BASE) -> DataFrame:
    """Ledger rows with base_failed, kept and the policy that decided it: a version's name, or its rules."""
    failed = (F.col("ledger").bitwiseAND(F.lit(policy_mask(base)).cast("long"))) != 0
    refused = (F.col("ledger").bitwiseAND(F.lit(policy_mask(policy)).cast("long"))) != 0
    name = policy if isinstance(policy, str) else "+".join(policy)
    return rows.withColumns({"base_failed": failed, "kept": ~failed & ~refused, "policy": F.lit(name)})


def ablations(rows: DataFrame, policy: str | tuple = "v1", rules: dict[str, str] | None = None) -> DataFrame:
    """(rule, failed, failed_alone, kept_without) under a policy, from the ledger alone.

    failed_alone counts rows that this rule alone refuses; kept_without is what
    the policy would keep without the rule. One aggregate by distinct ledger
    value comes first, so at most 2 ** rules rows are looked at.
    """
    rules = rules or RULES
    names = [r for r in (POLICIES[policy] if isinstance(policy, str) else policy)]
    mask = policy_mask(policy, rules)
    by_bits = rows.groupBy("ledger").agg(F.count(F.lit(1)).alias("n")).withColumn("seen", F.col("ledger").bitwiseAND(F.lit(mask).cast("long")))
    bits = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(policy_mask((r,), rules)).cast("long").alias("bit")) for r in names])
    each = by_bits.select("n", "seen", F.explode(bits).alias("r")).select("n", "seen", "r.rule", "r.bit")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        count(F.col("seen").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        count(F.col("seen") == F.col("bit")).alias("failed_alone"),
        count((F.col("seen") == 0) | (F.col("seen") == F.col("bit"))).alias("kept_without"),
    )
