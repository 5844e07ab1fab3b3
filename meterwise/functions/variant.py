"""Truthiness and integer coercion on VARIANT values.

The metered system reads JSON with ``a or b or 0`` chains and ``int(x)``:
null, JSON null, 0, 0.0, "", false, [] and {} count as missing; strings of
digits (with sign, blanks or ``_`` separators) convert; floats truncate;
true is 1; anything else makes the conversion fail.

Scalars are tested on their compact JSON text (``to_json``), which keeps
the generated code small enough for whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed patterns: JSON texts that are falsy, JSON numbers, int()-able strings.
FALSY_JSON = r'^(null|false|""|\[\]|\{\}|-?0+(\.0*)?([eE][+-]?[0-9]+)?)$'
JSON_NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
INT_TEXT = r'^"\s*[+-]?[0-9]+(_[0-9]+)*\s*"$'


def field(v: Column, path: str) -> Column:
    """Sub-value at ``path`` as VARIANT; null when absent or not reachable."""
    return F.try_variant_get(v, path, "variant")


def json_text(v: Column) -> Column:
    return F.to_json(v)


def is_object(v: Column) -> Column:
    """True for a JSON object (a struct cast that any object satisfies)."""
    return F.try_variant_get(v, "$", "struct<__probe:variant>").isNotNull()


def as_object(v: Column) -> Column:
    """``v`` when it is a JSON object, else null."""
    return F.when(is_object(v), v)


def as_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def truthy_text(j: Column) -> Column:
    """Truthiness of a value given as its JSON text (null = absent)."""
    return j.isNotNull() & ~j.rlike(FALSY_JSON)


def truthy(v: Column) -> Column:
    return F.coalesce(truthy_text(json_text(v)), F.lit(False))


def first_truthy(*vs: Column) -> Column:
    """``a or b or ...``: the first truthy value, else null."""
    expr = None
    for v in vs:
        expr = F.when(truthy(v), v) if expr is None else expr.when(truthy(v), v)
    return expr


def first_truthy_text(*js: Column) -> Column:
    expr = None
    for j in js:
        expr = F.when(truthy_text(j), j) if expr is None else expr.when(truthy_text(j), j)
    return expr


def int_from_text(j: Column) -> Column:
    """``int(x)`` of a value given as JSON text; null when it would fail."""
    return (F.when(j.rlike(JSON_NUMBER), j.try_cast("decimal(38,6)").try_cast("bigint"))
             .when(j.rlike(INT_TEXT), F.regexp_replace(j, r'[\s"_]', "").try_cast("bigint"))
             .when(j == "true", F.lit(1).cast("bigint")))


def to_int(v: Column) -> Column:
    return int_from_text(json_text(v))


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def text(v: Column) -> Column:
    """String form of a scalar value (numbers are rendered)."""
    return F.try_variant_get(v, "$", "string")
