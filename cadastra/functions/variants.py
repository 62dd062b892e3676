"""Values of VARIANT columns: kinds, members and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTAINERS = ("object", "array")


# How schemas begin, and the kinds they stand for. Shorter numbers with a point come as decimals too.
SCHEMA = r"^(OBJECT|ARRAY|STRING|BOOLEAN|VOID|BIGINT|DECIMAL(?=\((?:19|2\d|3\d),0\)))"
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "integer", "DECIMAL": "integer", "": "number"}


def kind_of(value: Column) -> Column:
    """object, array, string, boolean, integer, number or null. The schema, which goes through all of a value, is made once."""
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return F.try_element_at(kinds, F.regexp_extract(F.schema_of_variant(value), SCHEMA, 1))


def as_object(value: Column) -> Column:
    """The members of an object; null for anything else."""
    return value.try_cast("map<string,variant>")


def as_list(value: Column) -> Column:
    """The members of a list; null for anything else."""
    return value.try_cast("array<variant>")


def text_of(value: Column) -> Column:
    """A scalar as text: texts as they are, all else as JSON; null for null, objects and lists."""
    kind = kind_of(value)
    return F.when(kind == "string", value.try_cast("string")).when(~kind.isin(*CONTAINERS, "null"), F.to_json(value))


def quoted(text: Column) -> Column:
    """A text as JSON."""
    inside = F.to_json(F.array(text))
    return F.substring(inside, F.lit(2), F.length(inside) - 2)


def step(value: Column, part: str) -> Column:
    """A member of a value: an object's of that key, or a list's of that number. Which of both, the value's kind says."""
    named = F.try_element_at(as_object(value), F.lit(part))
    return F.coalesce(named, F.try_element_at(as_list(value), F.lit(int(part) + 1))) if part.isdigit() and len(part) < 10 else named
