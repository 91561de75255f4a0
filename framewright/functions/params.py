"""Typed parameters and run-name helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unquote(value: Column) -> Column:
    return F.regexp_replace(value, r"^['\"]+|['\"]+$", "")


def infer_param(value: Column) -> Column:
    """struct(kind, text, int_value, double_value, bool_value, items) of a setting's text.

    Quotes go first; then none, true, false in any case; a number with `.` or `e` is a float, another an int; then
    lists and tuples (items as text) and dicts (kept as text); all else is a string.
    """
    text = unquote(value)
    lower = F.lower(text)
    pointed = text.contains(".") | lower.contains("e")
    as_double = F.when(pointed & text.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(text).try_cast("double"))
    as_int = F.when(~pointed & text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long"))
    listed = F.trim(text).rlike(r"^(\[.*\]|\(.*,.*\))$")
    body = F.regexp_replace(F.trim(text), r"^[\[(]|[\])]$", "")
    items = F.filter(F.transform(F.split(body, ","), lambda v: unquote(F.trim(v))), lambda v: v != "")
    kind = (
        F.when(lower == "none", "none")
        .when(lower.isin("true", "false"), "bool")
        .when(as_double.isNotNull(), "float")
        .when(as_int.isNotNull(), "int")
        .when(listed, "list")
        .when(F.trim(text).rlike(r"^\{.*\}$"), "dict")
        .otherwise("string")
    )
    return F.struct(
        kind.alias("kind"),
        text.alias("text"),
        F.when(kind == "int", as_int).alias("int_value"),
        F.when(kind == "float", as_double).alias("double_value"),
        F.when(kind == "bool", lower == "true").alias("bool_value"),
        F.when(kind == "list", items).alias("items"),
    )
