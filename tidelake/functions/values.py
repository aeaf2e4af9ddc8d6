"""Numbers out of messy text, as pure Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for no value.
BLANKS = ("", "-", "–", "—", "n.a.", "na", "n/a", "null", "nan", "none")
# White space in the Unicode sense.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_WIDE, _PLAIN = "０１２３４５６７８９", "0123456789"
_NUMBER = r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$|^[+-]?(?i:inf|infinity)$"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that f refers to many times: it is computed once, and the generated code stays small."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at the ends, in the Unicode sense."""
    return F.btrim(c, F.lit(SPACES))


def _float(c: Column) -> Column:
    """A number as Python's float() reads it, else null; Java's type suffixes do not count."""

    def read(c: Column) -> Column:
        plain = F.translate(c, "_", "")
        endless = F.regexp_replace(plain, "(?i)^([+-]?)inf(inity)?$", "$1Infinity")
        return F.when(c.rlike(_NUMBER), F.when(F.lower(plain).contains("i"), endless).otherwise(plain).try_cast("double"))

    return once(F.translate(c, _WIDE, _PLAIN), read)


def normalize_value(raw: Column) -> Column:
    """struct(value, unit, status) of a text: status is ok, blank or non_numeric.

    ``( )`` negates; ``%`` is kept as the unit and not divided; commas and white
    space inside are dropped; a negative zero becomes zero.
    """
    return once(strip(raw), _parsed)


def _parsed(text: Column) -> Column:
    """Each step is computed once: what is inside the brackets, less the percent sign, and its number."""
    negative = text.startswith("(") & text.endswith(")")
    return once(F.when(negative, strip(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text), lambda inner: _unsigned(text, negative, inner))


def _unsigned(text: Column, negative: Column, inner: Column) -> Column:
    percent = inner.endswith("%")
    bare = F.translate(F.when(percent, F.substring(inner, F.lit(1), F.length(inner) - 1)).otherwise(inner), "," + SPACES, "")

    def judged(x: Column) -> Column:
        number = x["number"]
        blank = text.isNull() | F.lower(text).isin(*BLANKS) | (x["bare"] == "") | F.lower(x["bare"]).isin("nan", "+nan", "-nan")
        value = F.when(negative, -number).otherwise(number) + F.lit(0.0)
        return once(blank, lambda blank: F.struct(
            F.when(~blank, value).alias("value"),
            F.when(~blank & number.isNotNull() & percent, F.lit("%")).alias("unit"),
            F.when(blank, "blank").when(number.isNull(), "non_numeric").otherwise("ok").alias("status"),
        ))

    return once(bare, lambda bare: once(F.struct(bare.alias("bare"), _float(bare).alias("number")), judged))


def normalize_typed(raw: Column, kind: str) -> Column:
    """normalize_value for a source column of any type: numbers pass, NaN is blank, truth values are non_numeric."""
    if kind == "boolean":
        return F.struct(F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.when(raw.isNull(), "blank").otherwise("non_numeric").alias("status"))
    if kind == "string":
        return normalize_value(raw)
    number = raw.cast("double")
    blank = raw.isNull() | F.isnan(number)
    return F.struct(F.when(~blank, number + F.lit(0.0)).alias("value"), F.lit(None).cast("string").alias("unit"), F.when(blank, "blank").otherwise("ok").alias("status"))


def clean_text(raw: Column, kind: str = "string") -> Column:
    """A dimension's text: null is empty, whole numbers have no decimals, text is stripped."""
    if kind in ("double", "float"):
        whole = (raw == F.floor(raw)) & (F.abs(raw) < 1e18)
        return F.coalesce(F.when(whole, raw.cast("decimal(38,0)").cast("string")).otherwise(raw.cast("string")), F.lit(""))
    return F.coalesce(strip(raw.cast("string")), F.lit(""))


def normalize_number(text: Column) -> Column:
    return F.coalesce(F.regexp_replace(text, r"(?U)[,%$\s]", ""), F.lit(""))


def relative_change(old: Column, new: Column) -> Column:
    return F.when(old == 0, F.abs(new)).otherwise(F.abs(new - old) / F.abs(old))


def percent_change(old: Column, new: Column) -> Column:
    """In percent of the old value; null where that is missing or zero."""
    return F.when(old.isNotNull() & (old != 0), (new - old) / F.abs(old) * 100)


def num_text(value: Column) -> Column:
    """Whole numbers without decimals, others with two less trailing zeros."""
    return F.when(value == F.floor(value), F.format_string("%.0f", value)).otherwise(strip_zeros(F.format_string("%.2f", value)))


def signed_num_text(value: Column) -> Column:
    return F.concat(F.when(value < 0, "-").otherwise("+"), num_text(F.abs(value)))


def strip_zeros(text: Column) -> Column:
    """1.50 to 1.5 and 2.00 to 2."""
    out = F.regexp_replace(text, r"\.?0*$", "")
    return F.when(text.contains("."), F.when(out == "", "0").otherwise(out)).otherwise(text)


def display(value: float) -> str:
    """num_text on the driver."""
    return str(int(value)) if value == int(value) else f"{value:.2f}".rstrip("0").rstrip(".")


def signed(value: float) -> str:
    return ("-" if value < 0 else "+") + display(abs(value))
