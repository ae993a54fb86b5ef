"""Chat formatting from typed content parts, in DataFrame operations only.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Its content is an array of typed
parts, which a visitor flattens in order: a text part becomes its escaped text,
an image, audio or document part becomes a numbered placeholder and an entry of
``attachments`` with its reference and the number of tokens it expands to. A
plain ``text`` column is an array of one text part, and goes the same way.

Escaping is reversible: a backslash is doubled and ``<|`` becomes ``<\\|``, so a
control string can't come from a text. A placeholder names one of ``KINDS``, any
other type being shown as the last of them, so none can come from a type either;
``attachments`` keeps the type as given. The loss mask lists, in code points, the
spans of assistant content in the formatted string.

A conversation becomes one string, so its turns meet in one row; offsets are a
running sum over the same partitioning and order, which costs no second shuffle.

Defined results: turns are ordered by turn (null first), ties by role and parts;
null roles and texts count as empty, a null type as text; rows whose conv_id is
null are one conversation; a conversation without assistant turns has an empty
loss text; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that attachments expand to: image patches of 14 x 14 pixels, 25 audio frames a second, 512 a page.
PATCH, FRAMES, PAGE = 14, 25, 512
KINDS = ("image", "audio", "document", "other")
PLACEHOLDER = r"<\|(?:" + "|".join(KINDS) + r"):\d+:\d+\|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def is_text(p: Column) -> Column:
    return F.coalesce(p["type"], F.lit("text")) == "text"


def kind(p: Column) -> Column:
    return F.when(p["type"].isin(*KINDS), p["type"]).otherwise(KINDS[-1])


def part_tokens(p: Column) -> Column:
    """Expanded tokens of an attachment part."""
    image = F.ceil(F.coalesce(p["width"], F.lit(PATCH)) / PATCH) * F.ceil(F.coalesce(p["height"], F.lit(PATCH)) / PATCH)
    audio = F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * FRAMES)
    return F.when(p["type"] == "image", image).when(p["type"] == "audio", audio).otherwise(F.coalesce(p["pages"], F.lit(1)) * PAGE).cast("long")


def visit(parts: Column, first: Column) -> Column:
    """Flattened content; ``first`` is the number of the turn's first attachment."""
    before = lambda i: F.size(F.filter(F.slice(parts, 1, i), lambda q: ~is_text(q)))
    shown = lambda p, i: F.concat(F.lit("<|"), kind(p), F.lit(":"), (first + before(i)).cast("string"), F.lit(":"), part_tokens(p).cast("string"), F.lit("|>"))
    return F.array_join(F.transform(parts, lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(shown(p, i))), "")


def content_parts(turns: DataFrame) -> Column:
    """The parts of a turn: its ``parts``, or its ``text`` as one text part."""
    if "parts" in turns.columns and isinstance(turns.schema["parts"].dataType, T.ArrayType):
        return F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(f"p {PART}")["p"].dataType.fields[2:]]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *rest))


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_mask, attachments), a row for each conversation.

    ``turns`` has conv_id, turn, role and either text or parts (array of PART).
    """
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), content_parts(turns).alias("parts"))
    base = base.withColumn("files", F.filter("parts", lambda p: ~is_text(p)))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "parts")
    base = base.withColumn("first", F.coalesce(F.sum(F.size("files")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    content = visit(F.col("parts"), F.col("first"))
    listed = F.transform("files", lambda p, i: F.struct((F.col("first") + i).cast("long").alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens")))
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("<\\n"))
    laid = base.select("conv_id", "role", content.alias("content"), listed.alias("listed"), F.concat(F.lit(START), role, F.lit("\n")).alias("head"), F.row_number().over(w).alias("at"), "parts", "turn")
    length = F.length("head") + F.length("content") + len(END)
    laid = laid.withColumn("before", F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    row = F.struct(
        "at",
        F.concat("head", "content", F.lit(END)).alias("piece"),
        F.struct((F.col("before") + F.length("head")).cast("long").alias("start"), F.length("content").cast("long").alias("length")).alias("span"),
        (F.col("role") == loss_role).alias("loss"),
        "listed",
    )
    whole = laid.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(row)).alias("t"))
    return whole.select(
        "conv_id",
        "n_turns",
        F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["loss"]), lambda x: x["span"]).alias("loss_mask"),
        F.flatten(F.col("t.listed")).alias("attachments"),
    )


def _turns(formatted: Column) -> Column:
    """Array of (role, content) of a formatted string, content still flattened."""
    cut = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: F.startswith(x, F.lit(START)))
    head = lambda x: F.substring_index(F.substr(x, F.lit(len(START) + 1)), "\n", 1)
    return F.transform(
        cut,
        lambda x: F.struct(
            unescape(F.replace(head(x), F.lit("<\\n"), F.lit("\n"))).alias("role"),
            F.substr(x, F.length(head(x)) + len(START) + 2).alias("content"),
        ),
    )


def parse_chat(formatted: Column) -> Column:
    """Array of (role, text) read back; text leaves placeholders out."""
    return F.transform(_turns(formatted), lambda t: F.struct(t["role"].alias("role"), unescape(F.regexp_replace(t["content"], PLACEHOLDER, "")).alias("text")))


def parse_parts(formatted: Column, attachments: Column) -> Column:
    """Array of (role, parts) read back, parts being (type, text, ref, tokens) in order.

    Text parts that stood side by side come back as one, empty ones not at all.
    """

    def parts(content):
        texts, marks = F.split(content, PLACEHOLDER), F.regexp_extract_all(content, F.lit(f"({PLACEHOLDER})"), 1)
        text = lambda x: F.struct(F.lit("text").alias("type"), unescape(x).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))
        number = lambda m: F.element_at(F.split(m, ":"), 2).cast("int")
        found = lambda m: F.get(attachments, number(m))
        file = lambda m: F.struct(found(m)["type"].alias("type"), F.lit(None).cast("string").alias("text"), found(m)["ref"].alias("ref"), found(m)["tokens"].alias("tokens"))
        both = F.transform(texts, lambda x, i: F.when(i < F.size(marks), F.array(text(x), file(F.get(marks, i)))).otherwise(F.array(text(x))))
        return F.filter(F.flatten(both), lambda p: F.coalesce(p["text"] != "", F.lit(True)))

    return F.transform(_turns(formatted), lambda t: F.struct(t["role"].alias("role"), parts(t["content"]).alias("parts")))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
