"""Property values as columns, and the two predicate families over them.

A value is a column with a kind. A native column has a fixed kind (bool, int,
float or string), so that a comparison is a plain column predicate, which reaches
the Parquet scan; a value from a property map has the kind ``any`` and is the
tagged struct PV. The structured query language compares type-strictly, Cypher
lets integers and floats meet; both are two-valued. As a conjunct of a filter a
null is as good as false and stays bare, so that scans can take the comparison;
where a predicate is negated it is made false first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

PV = "struct<t:string,b:boolean,i:bigint,f:double,s:string>"
FIELDS = {"bool": "b", "int": "i", "float": "f", "string": "s"}
SQL_TYPES = {"bool": "boolean", "int": "bigint", "float": "double", "string": "string"}
NUMERIC = ("int", "float")
EXACT = 1 << 53


def kind_of(value: Any) -> str:
    """Kind of a Python scalar; booleans are told from integers first."""
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise ValueError("integer property is outside the 64-bit range")
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, str):
        return "string"
    raise TypeError(f"property values must be bool, int, float or str, not {type(value).__name__}")


def check_properties(properties: dict[str, Any] | None) -> dict[str, Any]:
    out = dict(properties or {})
    for key, value in out.items():
        if not isinstance(key, str) or not key:
            raise ValueError("property key cannot be empty")
        if kind_of(value) == "float" and not math.isfinite(value):
            raise ValueError(f'property "{key}" must be finite')
    return out


def pv_tuple(value: Any) -> tuple:
    """A Python scalar as a PV row."""
    kind = kind_of(value)
    return (kind, *(value if k == kind else None for k in FIELDS))


def pv_python(row) -> Any:
    return None if row is None else row[FIELDS[row["t"]]]


def pv_column(kind: str, column: Column) -> Column:
    """A native column as PV; null where it is null."""
    if kind == "any":
        return column
    parts = [F.lit(kind).alias("t")]
    parts += [(column if k == kind else F.lit(None)).cast(SQL_TYPES[k]).alias(f) for k, f in FIELDS.items()]
    return F.when(column.isNotNull(), F.struct(*parts))


@dataclass
class Value:
    """kind: a key of FIELDS, ``any``, ``null``, ``node``, ``edge``, ``list`` or ``map``."""

    kind: str
    column: Column | None = None
    items: Any = None  # elements of a list, entries of a map

    @staticmethod
    def literal(value: Any) -> Value:
        if value is None:
            return Value("null", F.lit(None))
        if isinstance(value, (list, tuple)):
            return Value("list", None, [Value.literal(v) for v in value])
        if isinstance(value, dict):
            return Value("map", None, {k: Value.literal(v) for k, v in value.items()})
        kind = kind_of(value)
        return Value(kind, F.lit(value).cast(SQL_TYPES[kind]))

    def number(self) -> Column:
        """As a double; null unless an integer or a float."""
        if self.kind in NUMERIC:
            return self.column.cast("double")
        if self.kind == "any":
            c = self.column
            return F.when(c["t"] == "int", c["i"].cast("double")).when(c["t"] == "float", c["f"])
        return F.lit(None).cast("double")

    def of(self, kind: str) -> Column:
        """As one kind; null where it is of another."""
        if self.kind == kind:
            return self.column
        if self.kind == "any":
            return F.when(self.column["t"] == kind, self.column[FIELDS[kind]])
        return F.lit(None).cast(SQL_TYPES[kind])

    def present(self) -> Column:
        return F.lit(False) if self.kind == "null" else F.lit(True) if self.column is None else self.column.isNotNull()


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _same(c: Column) -> Column:
    return c


def strict_equal(v: Value, value: Any) -> Column:
    """Type-strict equality with a scalar; false or null where the property is missing."""
    kind = kind_of(value)
    if v.kind not in (kind, "any"):
        return F.lit(False)
    lit = F.lit(value).cast(SQL_TYPES[kind])
    if v.kind == kind:
        return v.column == lit
    return (v.column["t"] == kind) & (v.column[FIELDS[kind]] == lit)


_ORDER = {"lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}


def strict_predicate(v: Value, op: str, value: Any) -> Column:
    """One filter of the structured query language, for use as a conjunct of a filter.

    It may be null where it is to be false, which a filter treats alike: wrapped
    comparisons would not be pushed into a scan.
    """
    if op == "eq":
        return strict_equal(v, value)
    if op == "ne":
        if v.kind == kind_of(value):
            return v.column != F.lit(value).cast(SQL_TYPES[v.kind])
        return v.present() & ~_sure(strict_equal(v, value))
    if op == "in":
        test = F.lit(False)
        for x in value:
            test = test | strict_equal(v, x)
        return test
    if op == "contains":
        return F.contains(v.of("string"), F.lit(value))
    if op not in _ORDER:
        raise ValueError(f"unsupported query filter operator '{op}'")
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return F.lit(False)
    if v.kind == "float" or v.kind == "int" and abs(value) <= EXACT and value == int(value):
        return _ORDER[op](v.column, F.lit(int(value) if v.kind == "int" else float(value)))
    return _ORDER[op](v.number(), F.lit(float(value)))


def equal(a: Value, b: Value, sure: bool = True) -> Column:
    """Cypher equality: integers and floats meet, null never equals, lists and maps neither.

    Without ``sure`` it may be null where it is false, for use as a conjunct of a filter.
    """
    wrap = _sure if sure else _same
    kinds = {a.kind, b.kind}
    if kinds & {"null", "list", "map"}:
        return F.lit(False)
    if kinds & {"node", "edge"}:
        return wrap(a.column["id"] == b.column["id"]) if len(kinds) == 1 else F.lit(False)
    if "any" not in kinds:
        if a.kind == b.kind or kinds <= set(NUMERIC):
            return wrap(a.column == b.column)
        return F.lit(False)
    test = F.lit(False)
    for kind in ("string", "bool", "int"):
        if kinds <= {kind, "any"}:
            test = test | _sure(a.of(kind) == b.of(kind))
    # Two integers were compared exactly above; here at least one side is a float.
    mixed = a.of("float").isNotNull() | b.of("float").isNotNull()
    return test | _sure(mixed & (a.number() == b.number()))


def unequal(a: Value, b: Value) -> Column:
    """The negation of equality: a null differs from anything."""
    kinds = {a.kind, b.kind}
    if kinds <= set(FIELDS) and (len(kinds) == 1 or kinds <= set(NUMERIC)):
        return (a.column != b.column) | a.column.isNull() | b.column.isNull()
    return ~equal(a, b)


_CYPHER = {"<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}


def ordered(a: Value, op: str, b: Value) -> Column:
    """Cypher order as a conjunct of a filter: numbers with numbers, strings with strings, all else false."""
    test, kinds = _ORDER[_CYPHER[op]], {a.kind, b.kind}
    if kinds & {"null", "list", "map", "node", "edge", "bool"}:
        return F.lit(False)
    if "any" not in kinds:
        return test(a.column, b.column) if a.kind == b.kind or kinds <= set(NUMERIC) else F.lit(False)
    out = F.lit(False)
    if kinds <= {"string", "any"}:
        out = out | _sure(test(a.of("string"), b.of("string")))
    if kinds <= {"int", "any"}:
        out = out | _sure(test(a.of("int"), b.of("int")))
    mixed = a.of("float").isNotNull() | b.of("float").isNotNull()
    return out | _sure(mixed & test(a.number(), b.number()))


def contains(a: Value, b: Value) -> Column:
    if {a.kind, b.kind} <= {"string", "any"}:
        return F.contains(a.of("string"), b.of("string"))
    return F.lit(False)


def is_in(a: Value, b: Value) -> Column:
    if b.kind != "list":
        return F.lit(False)
    test = F.lit(False)
    for x in b.items or []:
        test = test | equal(a, x, sure=False)
    return test


def sort_keys(v: Value, descending: bool) -> list[Column]:
    """Nulls last going up, first going down; values of different kinds go by kind.

    The reference order lets incomparable values tie, which no total order can;
    numbers, strings, booleans is the rule here.
    """
    if v.kind == "null":
        return []
    if v.kind in FIELDS:
        return [v.column.desc_nulls_first() if descending else v.column.asc_nulls_last()]
    if v.kind in ("node", "edge"):
        return [v.column["id"].isNull().desc() if descending else v.column["id"].isNull().asc()]
    if v.kind != "any":
        return []
    t = v.column["t"]
    rank = F.when(t.isin("int", "float"), 0).when(t == "string", 1).when(t == "bool", 2)
    keys = [rank, v.number(), v.of("int"), v.of("string"), v.of("bool")]
    return [k.desc_nulls_first() if descending else k.asc_nulls_last() for k in keys]
