"""CSV and JSONL import and export, a text chunker, and line-format loaders."""

from __future__ import annotations

import json
import re
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PROPS, GraphData


def guarded(root: str, kind: str, path: str) -> str:
    """A relative path kept inside ``root``/imports or ``root``/exports."""
    if kind not in ("imports", "exports"):
        raise ValueError("kind must be imports or exports")
    p = PurePosixPath(path)
    if p.is_absolute() or ".." in p.parts or not p.parts:
        raise ValueError(f"path must be relative and stay inside {kind}")
    return f"{root.rstrip('/')}/{kind}/{p}"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


# Import: files become rows of the property tables without passing the driver

def _pv(v: str) -> str:
    """SQL of a variant as a tagged value; null unless it is a boolean, a 64-bit integer, a number or a string."""
    t = f"schema_of_variant({v})"
    is_int, is_float = f"{t} = 'BIGINT'", f"({t} = 'DOUBLE' OR {t} LIKE 'DECIMAL%' AND NOT {t} RLIKE '^DECIMAL\\\\((19|[23][0-9]),0')"
    kind = f"CASE WHEN {t} = 'BOOLEAN' THEN 'bool' WHEN {is_int} THEN 'int' WHEN {is_float} THEN 'float' WHEN {t} = 'STRING' THEN 'string' END"
    part = lambda test, sql: f"CASE WHEN {test} THEN try_variant_get({v}, '$', '{sql}') END"
    is_bool, is_text = f"{t} = 'BOOLEAN'", f"{t} = 'STRING'"
    return f"named_struct('t', {kind}, 'b', {part(is_bool, 'boolean')}, 'i', {part(is_int, 'bigint')}, 'f', {part(is_float, 'double')}, 's', {part(is_text, 'string')})"


def _json_props(c: str) -> Column:
    """A variant object as a property map; values that are no property have a null tag."""
    return F.expr(f"coalesce(transform_values(try_variant_get({c}, '$', 'map<string,variant>'), (k, v) -> {_pv('v')}), map())").cast(PROPS)


def _cell(c: str) -> Column:
    """A CSV cell: a JSON scalar if it is one, else its text."""
    v = _pv(f"try_parse_json(`{c}`)")
    text = f"named_struct('t', 'string', 'b', cast(null AS boolean), 'i', cast(null AS bigint), 'f', cast(null AS double), 's', `{c}`)"
    return F.expr(f"CASE WHEN {v}.t IS NULL THEN {text} ELSE {v} END")


def _csv_props(df: DataFrame, known: set[str]) -> Column:
    """The JSON object of ``properties``, overlaid with the extra columns that are not empty."""
    out = F.create_map().cast(PROPS)
    if "properties" in df.columns:
        out = _json_props("parsed")
    extra = [c for c in df.columns if c not in known]
    if not extra:
        return out
    entries = F.array(*[F.struct(F.lit(c).alias("key"), _cell(c).alias("value"), (F.coalesce(F.col(f"`{c}`"), F.lit("")) != "").alias("there")) for c in extra])
    given = F.map_from_entries(F.transform(F.filter(entries, lambda e: e["there"]), lambda e: F.struct(e["key"], e["value"])))
    return F.map_concat(F.map_filter(out, lambda k, _: ~F.map_contains_key(given, k)), given).cast(PROPS)


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _parsed(df: DataFrame) -> DataFrame:
    """Add ``parsed``, the JSON of ``properties``; a cell that is no JSON is an error."""
    if "properties" not in df.columns:
        return df
    return df.withColumn("parsed", F.parse_json(F.when(F.col("properties") != "", F.col("properties"))))


def node_rows_csv(spark: SparkSession, path: str) -> DataFrame:
    """(external_id, labels, props) of a CSV file: labels split on ``|``, properties from a JSON column and from extra columns."""
    df = _parsed(_csv(spark, path))
    props = _csv_props(df, {"external_id", "labels", "properties", "parsed"})
    external = _column(df, "external_id")
    labels = F.filter(F.split(F.coalesce(_column(df, "labels"), F.lit("")), r"\|"), lambda x: x != "")
    return df.select(F.when(external != "", external).alias("external_id"), F.array_distinct(labels).alias("labels"), props.alias("props"))


def edge_rows_csv(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, edge_type, props) of a CSV file, ends as texts."""
    df = _parsed(_csv(spark, path))
    props = _csv_props(df, {"source", "target", "edge_type", "type", "properties", "parsed"})
    kind = lambda c: F.when(_column(df, c) != "", _column(df, c))
    return df.select("source", "target", F.coalesce(kind("edge_type"), kind("type")).alias("edge_type"), props.alias("props"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.parse_json("value").alias("v"))


def _field(name: str, kind: str = "string") -> Column:
    return F.expr(f"try_variant_get(v, '$.{name}', '{kind}')")


def node_rows_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(external_id, labels, props) of a JSONL file, an object a line; other fields are left out."""
    labels = F.coalesce(_field("labels", "array<string>"), F.array().cast("array<string>"))
    df = _lines(spark, path).select(_field("external_id").alias("external_id"), F.array_distinct(labels).alias("labels"), F.expr("try_variant_get(v, '$.properties', 'variant')").alias("p"))
    return df.select("external_id", "labels", _json_props("p").alias("props"))


def edge_rows_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, edge_type, props) of a JSONL file, ends as texts."""
    kind = F.coalesce(F.nullif(_field("edge_type"), F.lit("")), F.nullif(_field("type"), F.lit("")))
    df = _lines(spark, path).select(_field("source").alias("source"), _field("target").alias("target"), kind.alias("edge_type"), F.expr("try_variant_get(v, '$.properties', 'variant')").alias("p"))
    return df.select("source", "target", "edge_type", _json_props("p").alias("props"))


def resolved(data: GraphData, rows: DataFrame) -> DataFrame:
    """Edge rows with ``src`` and ``dst``: an end is a node's id if there is one, else its external id; null if neither is."""
    nodes = data.node_scan().df.select("id", "external_id")
    for end, to in (("source", "src"), ("target", "dst")):
        number = F.when(F.col(end).rlike("^[0-9]+$"), F.col(end).try_cast("long"))
        by_id = nodes.select(F.col("id").alias("__number"), F.col("id").alias("__by_id"))
        by_name = nodes.select(F.col("external_id").alias(end), F.col("id").alias("__by_name"))
        rows = rows.withColumn("__number", number).join(by_id, "__number", "left").join(by_name, end, "left")
        rows = rows.withColumn(to, F.coalesce("__by_id", "__by_name")).drop("__number", "__by_id", "__by_name")
    return rows


def _sorted_json(columns: list[tuple[str, Any]]):
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(columns)]), {"ignoreNullFields": "false"})


def _plain_props():
    """The property map as one JSON object of plain scalars with sorted keys."""
    value = lambda v: F.when(v["t"] == "string", F.to_json(F.array(v["s"]))).when(v["t"] == "bool", F.to_json(F.array(v["b"]))).when(v["t"] == "int", F.to_json(F.array(v["i"]))).otherwise(F.to_json(F.array(v["f"])))
    bare = lambda j: F.substr(j, F.lit(2), F.length(j) - 2)
    entries = F.transform(F.array_sort(F.map_keys("props")), lambda k: F.concat(bare(F.to_json(F.array(k))), F.lit(":"), bare(value(F.col("props")[k]))))
    return F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))


def _text(c):
    j = F.to_json(F.array(c))
    return F.substr(j, F.lit(2), F.length(j) - 2)


def _write_lines(df: DataFrame, order: str, line, path: str) -> None:
    df.orderBy(order).select(line.alias("value")).write.mode("overwrite").text(path)


def export_nodes(data: GraphData, path: str, nodes: list[int] | None = None) -> None:
    """One JSON object a line with sorted keys, in id order, as a folder of text files."""
    df = data.node_table()
    df = df if nodes is None else df.where(F.col("id").isin(*nodes)) if nodes else df.limit(0)
    line = F.concat(F.lit('{"external_id":'), _text(F.col("external_id")), F.lit(',"id":'), F.col("id").cast("string"), F.lit(',"labels":'), F.to_json("labels"), F.lit(',"properties":'), _plain_props(), F.lit("}"))
    _write_lines(df, "id", line, path)


def export_edges(data: GraphData, path: str, edges: list[int] | None = None) -> None:
    df = data.edge_table()
    df = df if edges is None else df.where(F.col("id").isin(*edges)) if edges else df.limit(0)
    number = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit('{"edge_type":'), _text(F.col("edge_type")), F.lit(',"id":'), number("id"), F.lit(',"properties":'), _plain_props(), F.lit(',"source":'), number("src"), F.lit(',"target":'), number("dst"), F.lit("}"))
    _write_lines(df, "id", line, path)


def export_rows(spark: SparkSession, path: str, rows: DataFrame | list[dict[str, Any]]) -> None:
    if isinstance(rows, DataFrame):
        rows.select(_sorted_json([(c, F.col(c)) for c in rows.columns]).alias("value")).write.mode("overwrite").text(path)
        return
    lines = [(i, json.dumps(r, sort_keys=True, ensure_ascii=False, default=str)) for i, r in enumerate(rows)]
    spark.createDataFrame(lines, "i int, value string").orderBy("i").select("value").write.mode("overwrite").text(path)


# Example sources


def split_text(text: str, max_chars: int = 900) -> list[str]:
    """Chunks of whole sentences, at most ``max_chars`` long unless a sentence alone is longer."""
    text = " ".join((text or "").split())
    out: list[str] = []
    for sentence in re.split(r"(?<=[.!?])\s+", text) if text else []:
        if out and len(out[-1]) + 1 + len(sentence) <= max_chars:
            out[-1] += " " + sentence
        else:
            out.append(sentence)
    return out


def chunks(df: DataFrame, key: str, text: str, max_chars: int = 900) -> DataFrame:
    """(key, chunk, text): greedy sentence packing, in built-in functions."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    sentences = F.filter(F.split(clean, r"(?<=[.!?])\s+"), lambda s: s != "")

    def add(acc, s):
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(last) + 1 + F.length(s) <= max_chars)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), s)))).otherwise(F.concat(acc, F.array(s)))

    # element_at of an empty array is null under try; sizes are small, as a text has few chunks.
    packed = F.aggregate(sentences, F.array().cast("array<string>"), lambda acc, s: F.when(F.size(acc) == 0, F.array(s)).otherwise(add(acc, s)))
    return df.select(F.col(key).alias("key"), F.posexplode(packed).alias("chunk", "text"))


def wikidata(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a JSONL dump (gzip too), records of one id merged."""
    raw = spark.read.schema("qid string, label string, description string, aliases array<string>, enwiki_title string, wiki_text string, claims array<struct<property:string,target:string>>").json(path)
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    return raw.where("qid is not null").groupBy("qid").agg(first("label"), first("description"), F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("aliases"), first("enwiki_title"), first("wiki_text"), F.array_distinct(F.flatten(F.collect_list("claims"))).alias("claims"))


def pokec(spark: SparkSession, path: str, max_nodes: int | None = None, max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(users, friendships) of a file of CREATE and MATCH statements.

    ``max_nodes`` keeps the first users, ``max_edges`` the first friendships between
    users that were kept, both in the file's order.
    """
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    users = lines.where(F.col("value").startswith("CREATE")).select(
        "at",
        *[F.regexp_extract("value", rf"\b{k}:\s*(-?\d+)", 1).try_cast("long").alias(k) for k in ("id", "completion_percentage", "age")],
        F.regexp_extract("value", r'gender:\s*"([^"]*)"', 1).alias("gender"),
    )
    users = users.orderBy("at").limit(max_nodes) if max_nodes is not None else users
    ids = F.regexp_extract_all("value", F.lit(r"\bid:\s*(\d+)"), 1)
    friends = lines.where(F.col("value").startswith("MATCH")).select("at", ids.alias("i")).where("size(i) >= 2").select("at", F.col("i")[0].cast("long").alias("source_id"), F.col("i")[1].cast("long").alias("target_id"))
    for end in ("source_id", "target_id"):
        friends = friends.join(users.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    friends = friends.orderBy("at").limit(max_edges) if max_edges is not None else friends
    return users.drop("at"), friends.select("source_id", "target_id")
