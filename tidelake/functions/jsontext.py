"""JSON in model answers: extraction, checks and repair."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_THINK = re.compile(r"<think(?:ing)?>.*?</think(?:ing)?>", re.S | re.I)
_FENCE = re.compile(r"```[a-zA-Z]*")
# Synonyms that models use for the allowed texts.
DIRECTIONS = {"▲": ("up", "↑", "+", "increase", "rise", "상승", "증가", "확대"), "▼": ("down", "↓", "decrease", "fall", "하락", "감소", "축소"), "–": ("-", "—", "−", "~", "→", "flat", "neutral", "보합", "유지", "중립")}
CONFIDENCE = {"med": ("medium", "mid", "m", "moderate")}


def first_object(text: str | None) -> str | None:
    """The first balanced {...} that parses, thoughts and code fences aside."""
    if text is None:
        return None
    text = _FENCE.sub("", _THINK.sub("", text))
    decoder = json.JSONDecoder()
    at = text.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(text, at)
            return json.dumps(value, ensure_ascii=False)
        except ValueError:
            at = text.find("{", at + 1)
    return None


@F.pandas_udf(StringType())
def extract_json(text: pd.Series) -> pd.Series:
    """first_object of every text; nested braces are beyond regular expressions."""
    return text.map(first_object)


@dataclass(frozen=True)
class Repair:
    """How a text stands for a value of some type: group 1 of the pattern, separators aside, is what is read."""

    pattern: str
    kind: str
    read: Callable[[str], object]

    def column(self, c: Column) -> Column:
        found = F.regexp_replace(F.regexp_extract(c, self.pattern, 1), ",", "")
        return F.when(c.rlike(self.pattern), found.try_cast(self.kind))

    def value(self, text: str):
        found = re.match(self.pattern, text)
        return text if found is None else self.read(found[1].replace(",", ""))


# How models write page numbers, amounts and truth values.
REPAIRS = {
    "integer": Repair(r"(?i)^\s*(?:p\.?\s*)?([+-]?[0-9]+)(?:\.0+)?\s*(?:페이지)?\s*$", "long", int),
    "number": Repair(r"^\s*\$?([+-]?(?:[0-9][0-9,]*\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*%?\s*$", "double", float),
    "boolean": Repair(r"(?i)^\s*(true|false)\s*$", "boolean", lambda t: t.lower() == "true"),
}


def to_integer(c: Column) -> Column:
    """ "p. 12페이지" as 12."""
    return REPAIRS["integer"].column(c)


def to_number(c: Column) -> Column:
    """ "$1,234%" as 1234.0."""
    return REPAIRS["number"].column(c)


def to_boolean(c: Column) -> Column:
    return REPAIRS["boolean"].column(c)


def to_enum(c: Column, allowed: tuple[str, ...], synonyms: dict[str, tuple[str, ...]] | None = None) -> Column:
    """An allowed text whatever its case, or the one it is a synonym of; else as it is."""
    folded, out = F.lower(F.trim(c)), c
    for a in allowed:
        out = F.when(folded == a.lower(), a).otherwise(out)
    for a, others in (synonyms or {}).items():
        out = F.when(folded.isin(*others), a).otherwise(out)
    return out


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float)}


def _is(data, kind: str) -> bool:
    return isinstance(data, _KINDS[kind]) and (kind == "boolean" or not isinstance(data, bool))


def validate(data, schema: dict) -> list[str]:
    """Faults of a value against a subset of JSON Schema: type, required, properties, items, enum. A null stands for a lack of what is not required."""
    kind, needed = schema.get("type"), schema.get("required", [])
    if kind and not _is(data, kind):
        return [f"not of type {kind}"]
    faults = [f"{data!r} is not allowed"] if "enum" in schema and data not in schema["enum"] else []
    inner = []
    if kind == "object":
        faults += [f"lacks {k}" for k in needed if k not in data]
        inner = [(k, data[k], s) for k, s in schema.get("properties", {}).items() if k in data and (k in needed or data[k] is not None)]
    elif kind == "array" and "items" in schema:
        inner = [(i, x, schema["items"]) for i, x in enumerate(data)]
    return faults + [f"{at}: {f}" for at, x, s in inner for f in validate(x, s)]


def _allowed(text: str, enum: list) -> str:
    """The allowed text that is meant: a known synonym's, or the one that differs by case only; else the text."""
    folded = text.strip().casefold()
    meant = {o: a for table in (DIRECTIONS, CONFIDENCE) for a, others in table.items() if a in enum for o in others}
    return meant.get(folded) or {str(a).casefold(): a for a in enum}.get(folded, text)


def mended(data, schema: dict):
    """A value with common slips of models mended by the table of repairs; array items that stay invalid are dropped."""
    kind, enum = schema.get("type"), schema.get("enum")
    inner = {"object": schema.get("properties", {}), "array": schema.get("items")}.get(kind)
    if inner is not None and _is(data, kind):
        if kind == "object":
            return {k: mended(v, inner.get(k, {})) for k, v in data.items()}
        return [x for x in (mended(x, inner) for x in data) if not validate(x, inner)]
    if isinstance(data, str):
        return REPAIRS[kind].value(data) if kind in REPAIRS else _allowed(data, enum) if kind == "string" and enum else data
    if kind == "integer" and isinstance(data, float) and data == data // 1:
        return int(data)
    return str(data) if kind == "string" and _is(data, "number") else data
