"""Record identity and content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadastra.functions.variants import CONTAINERS, kind_of, step, text_of

MAX_ID = 200
MAX_AS_OF = 100
# Where an identity is looked for when no contract names one.
GUESSED_ID_FIELDS = ("source_record_id", "record_id", "innovationid", "requirementid", "resource_id", "id", "code")


def _at(payload: Column | str, path: str) -> tuple[Column, Column]:
    """(the value at a dotted path as text, the kind of value: STRING, ARRAY, ...; null where the payload is no JSON)."""
    payload = F.col(payload) if isinstance(payload, str) else payload
    steps = "$" + "".join(f"['{p}']" for p in path.split("."))
    return F.get_json_object(payload, steps), F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), steps, "variant"))


def field(payload: Column | str, path: str) -> Column:
    """The scalar at a dotted path of JSON text, as text; null if a step is missing, empty, or an object or array."""
    value, kind = _at(payload, path)
    nested = F.coalesce(kind.rlike("^(ARRAY|OBJECT)"), value.rlike(r"^\s*[\[{]"))
    return F.when((value != "") & ~nested, value)


def field_json(payload: Column | str, path: str) -> Column:
    """The same scalar as JSON: texts are quoted, numbers and booleans are not."""
    return F.when(_at(payload, path)[1] == "STRING", json_of(field(payload, path))).otherwise(field(payload, path))


def json_of(value: Column) -> Column:
    """A scalar column as JSON."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def pointer(payload: Column | str, path: str) -> Column:
    """The value at a JSON pointer, scalars as text: ~1 is a slash, ~0 a tilde. A whole number is a key of an object and a place in a list;
    the empty pointer, a slash and $ are the whole document. Null where a step is missing, or the payload is no JSON."""
    if path not in ("", "/", "$") and not path.startswith("/"):
        raise ValueError(f"no JSON pointer: {path}")
    value = F.try_parse_json(F.col(payload) if isinstance(payload, str) else payload)
    for part in path.split("/")[1:] if path not in ("", "/", "$") else []:
        value = step(value, part.replace("~1", "/").replace("~0", "~"))
    return F.when(kind_of(value).isin(*CONTAINERS), F.to_json(value)).otherwise(text_of(value))


def canonical(payload: Column | str) -> Column:
    """JSON text with sorted keys and no white space; numbers in their shortest form."""
    return F.to_json(F.try_parse_json(F.col(payload) if isinstance(payload, str) else payload))


def payload_hash(payload: Column | str) -> Column:
    return F.sha2(canonical(payload), 256)


def stable_hash(*parts: Column, sep: str = "|") -> Column:
    """SHA-256 of the parts' texts; a null part is the text None."""
    return F.sha2(F.concat_ws(sep, *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts)), 256)


def composite_id(*parts: Column) -> Column:
    """The hash of the parts as a JSON array: numbers stay numbers."""
    return _composite(*(json_of(p) for p in parts))


def _composite(*parts: Column) -> Column:
    return F.concat(F.lit("composite:"), F.sha2(F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]")), 256))


def contract_id(payload: Column | str, options: Sequence[Sequence[str]], fallback: Column) -> Column:
    """The first option all of whose fields are there: one field is readable, several are hashed together.

    The option ["$payload_hash"] always applies. Null if none does, or if a readable id has over 200 characters;
    identity_problem() says which, and gates.unidentified() finds such rows.
    """
    chosen = _first_option(payload, options, fallback)
    return F.when(F.length(chosen) <= MAX_ID, chosen)


def identity_problem(payload: Column | str, options: Sequence[Sequence[str]], fallback: Column) -> Column:
    """Why a record has no id: none of the options is there, or the id is too long; null if it has one."""
    chosen = _first_option(payload, options, fallback)
    return F.when(chosen.isNull(), "no identity").when(F.length(chosen) > MAX_ID, "identity too long")


def _first_option(payload: Column | str, options: Sequence[Sequence[str]], fallback: Column) -> Column:
    found = []
    for option in options:
        if list(option) == ["$payload_hash"]:
            found.append(fallback)
            continue
        values = [field(payload, path) for path in option]
        whole = values[0].isNotNull()
        for value in values[1:]:
            whole = whole & value.isNotNull()
        found.append(F.when(whole, values[0] if len(values) == 1 else _composite(*(field_json(payload, path) for path in option))))
    return F.coalesce(*found)


def contract_as_of(payload: Column | str, fields: Sequence[str]) -> Column:
    """The first field that is there, as text of up to 100 characters; it is never read as a date."""
    value = F.coalesce(*(field(payload, f) for f in fields))
    return F.when(F.length(value) <= MAX_AS_OF, value)


def guessed_id(payload: Column | str, fallback: Column) -> Column:
    return F.coalesce(*(F.substring(field(payload, f), 1, MAX_ID) for f in GUESSED_ID_FIELDS), fallback)


def snapshot_id(dataset: Column, payload: Column | str, identity: Sequence[str], times: Sequence[str], digest: Column) -> Column:
    """dataset, every identity field that is there, and the first time field, joined by colons; else dataset and digest."""
    parts = [field(payload, f) for f in identity]
    time = F.coalesce(*(field(payload, f) for f in times)) if times else F.lit(None).cast("string")
    anything = F.coalesce(*parts, time) if parts else time
    return F.substring(F.concat_ws(":", dataset, *parts, time, F.when(anything.isNull(), digest)), 1, MAX_ID)


def group_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-256 of the parts joined by the unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 16)
