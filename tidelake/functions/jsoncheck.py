"""Checks and repair of JSON text against a schema, as Columns: a walk over VARIANT values that the schema directs.

The schema is the subset that ``jsontext.validate`` knows: type, required,
properties, items, enum. Everything stays in the JVM; no row passes through Python.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsontext import CONFIDENCE, DIRECTIONS, to_boolean, to_enum, to_integer, to_number
from .values import once

_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
_TAGS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "integer": ("BIGINT",), "number": _NUMBERS}


def _tag(v: Column) -> Column:
    return F.substring_index(F.substring_index(F.schema_of_variant(v), "<", 1), "(", 1)


def _typed(v: Column, f: Callable[[Column, Callable[[str], Column]], Column]) -> Column:
    """f of a value and of the test of its kind; the value is parsed or looked up once, and its kind found once."""
    return once(v, lambda own: once(_tag(own), lambda tag: f(own, lambda kind: F.coalesce(tag.isin(*_TAGS[kind]), F.lit(False)))))


def _child(v: Column, key: str) -> Column:
    return F.try_variant_get(v, "$['" + key.replace("'", "\\'") + "']", "variant")


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _none() -> Column:
    return F.array().cast("array<string>")


def _below(at: Column, found: Column) -> Column:
    """Faults with the place that they were found at."""
    return F.transform(found, lambda f: F.concat(at, F.lit(": "), f))


def faults(text: Column, schema: dict) -> Column:
    """The faults of a JSON text, as an array; of what is no JSON "not JSON". Whole numbers beyond 64 bits are numbers, not integers."""
    return once(F.try_parse_json(text), lambda v: F.when(v.isNull(), F.array(F.lit("not JSON"))).otherwise(_faults(v, schema)))


def _faults(v: Column, schema: dict) -> Column:
    return _typed(v, lambda own, is_: _found(own, is_, schema))


def _found(v: Column, is_: Callable[[str], Column], schema: dict) -> Column:
    kind, needed = schema.get("type"), schema.get("required", [])
    parts = []
    if "enum" in schema:
        shown = F.when(is_("string"), F.concat(F.lit("'"), _text(v), F.lit("'"))).otherwise(F.to_json(v))
        allowed = F.to_json(v).isin(*(json.dumps(x, ensure_ascii=False) for x in schema["enum"]))
        parts.append(F.when(~allowed, F.array(F.concat(shown, F.lit(" is not allowed")))).otherwise(_none()))
    if kind == "object":
        parts += [F.when(_child(v, k).isNull(), F.array(F.lit(f"lacks {k}"))).otherwise(_none()) for k in needed]
        for k, s in schema.get("properties", {}).items():
            parts.append(once(_child(v, k), _part_faults(k, s, k in needed)))
    elif kind == "array" and "items" in schema:
        parts.append(F.flatten(F.transform(_items(v), lambda x, i: _below(i.cast("string"), _faults(x, schema["items"])))))
    found = F.concat(*parts) if parts else _none()
    return F.when(~is_(kind), F.array(F.lit(f"not of type {kind}"))).otherwise(found) if kind else found


def _part_faults(key: str, schema: dict, needed: bool) -> Callable[[Column], Column]:
    def run(child: Column) -> Column:
        there = child.isNotNull() if needed else child.isNotNull() & ~F.is_variant_null(child)
        return F.when(there, _below(F.lit(key), _faults(child, schema))).otherwise(_none())

    return run


def repaired(text: Column, schema: dict) -> Column:
    """The value with the slips of models mended, as a column of the schema's type; null where nothing can be made of it.

    Page numbers, amounts and truth values written as text are read, allowed texts
    are found by case and synonym, numbers serve as texts. Array items that lack a
    required part or hold a text that is not allowed are dropped.
    """
    return _repaired(F.try_parse_json(text), schema)


def _repaired(v: Column, schema: dict) -> Column:
    return _typed(v, lambda own, is_: _mended(own, is_, schema))


def _mended(v: Column, is_: Callable[[str], Column], schema: dict) -> Column:
    kind, enum = schema.get("type"), schema.get("enum")
    if kind == "object":
        made = F.struct(*(_repaired(_child(v, k), s).alias(k) for k, s in schema.get("properties", {}).items()))
        return F.when(is_("object"), made)
    if kind == "array":
        items = schema.get("items", {"type": "string"})
        return F.when(is_("array"), F.filter(F.transform(_items(v), lambda x: _repaired(x, items)), lambda x: _sound(x, items)))
    if kind == "integer":
        whole = once(F.try_variant_get(v, "$", "double"), lambda n: F.when(n == F.floor(n), n.cast("long")))
        return F.when(is_("integer"), F.try_variant_get(v, "$", "long")).when(is_("number"), whole).when(is_("string"), to_integer(_text(v)))
    if kind == "number":
        return F.when(is_("number"), F.try_variant_get(v, "$", "double")).when(is_("string"), to_number(_text(v)))
    if kind == "boolean":
        return F.when(is_("boolean"), F.try_variant_get(v, "$", "boolean")).when(is_("string"), to_boolean(_text(v)))
    own = F.when(is_("string") | is_("number"), _text(v))
    known = {a: others for table in (DIRECTIONS, CONFIDENCE) for a, others in table.items() if a in (enum or ())}
    return to_enum(own, tuple(enum), known) if enum else own


def _sound(c: Column, schema: dict) -> Column:
    """Whether a repaired value has its required parts, and only allowed texts."""
    ok = c.isNotNull()
    if "enum" in schema:
        ok = ok & F.coalesce(c.isin(*schema["enum"]), F.lit(False))
    for k, s in schema.get("properties", {}).items():
        part = c[k]
        ok = ok & (_sound(part, s) if k in schema.get("required", []) else part.isNull() | _sound(part, s))
    return ok
