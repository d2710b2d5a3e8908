"""Numbers, ranges and yields as Column functions. Nothing throws: what is no number is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import decimal_point, let, sub

_WHOLE = r"\d+"
RATIO = rf"{_WHOLE}\s*/\s*{_WHOLE}"
MIXED = rf"{_WHOLE}\s+{RATIO}"
#: A mixed number, a ratio, or a decimal.
NUMBER = rf"(?:{MIXED}|{RATIO}|{_WHOLE}(?:\.{_WHOLE})?)"

# Words of a yield, in the order in which they are tried, and what they are stored as.
YIELD_UNITS = (("portionen", "portionen"), ("portion", "portion"), ("servings", "servings"), ("serves", "serves"), ("personen", "person"), ("person", "person"))


def number(token: Column) -> Column:
    """A number token as double: mixed, fraction, decimal or whole; a zero denominator is null."""

    def one(t: Column) -> Column:
        top, low = F.regexp_extract(t, r"(\d+)\s*/\s*(\d+)$", 1).try_cast("double"), F.regexp_extract(t, r"(\d+)\s*/\s*(\d+)$", 2).try_cast("double")
        mixed = F.regexp_extract(t, r"^(\d+)\s+\d+\s*/\s*\d+$", 1).try_cast("double")
        return F.when(t.contains("/"), F.when(t.rlike(r"^(?:\d+\s+)?\d+\s*/\s*\d+$"), F.coalesce(mixed, F.lit(0.0)) + F.try_divide(top, low))).when(t.rlike(r"^\d+(?:\.\d+)?$"), t.try_cast("double"))

    return let(F.trim(token), one)


def first_number(text: Column) -> Column:
    """The first number of a text, with point or comma."""
    return decimal_point(F.nullif(F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)", 1), F.lit(""))).try_cast("double")


def _first(text: Column) -> Column:
    """struct(value, rest): the number that a text starts with, and what stands behind it."""
    found = let(F.regexp_extract(text, rf"^\s*{NUMBER}(?=\s|-|$)", 0), lambda t: F.struct(number(t).alias("value"), F.char_length(t).alias("n")))
    return let(F.struct(text.alias("text"), found.alias("f")), lambda x: F.struct(x["f"]["value"].alias("value"), F.ltrim(F.substr(x["text"], x["f"]["n"] + 1, F.char_length(x["text"]))).alias("rest")))


def quantity_range(text: Column) -> Column:
    """struct(low, high, rest) of a leading quantity; high is null for a single one, all null without one."""

    def second(x: Column) -> Column:
        other = _first(F.when(x["rest"].startswith("-"), F.substr(x["rest"], F.lit(2), F.char_length(x["rest"]))))
        return F.struct(x["value"].alias("low"), x["rest"].alias("rest"), x["text"].alias("text"), other.alias("other"))

    def whole(x: Column) -> Column:
        ranged = x["other"]["value"].isNotNull() & ~x["other"]["rest"].startswith("-")
        single = x["low"].isNotNull() & x["text"].rlike(rf"^\s*{NUMBER}(?=\s|$)")
        made = lambda high, rest: F.struct(x["low"].alias("low"), high.alias("high"), rest.alias("rest"))
        nothing = F.struct(*[F.lit(None).cast(kind).alias(name) for name, kind in (("low", "double"), ("high", "double"), ("rest", "string"))])
        return F.when(x["low"].isNotNull() & ranged, made(x["other"]["value"], x["other"]["rest"])).when(single, made(F.lit(None).cast("double"), x["rest"])).otherwise(nothing)

    first = let(text, lambda t: let(_first(t), lambda f: F.struct(f["value"].alias("value"), f["rest"].alias("rest"), t.alias("text"))))
    return let(let(first, second), whole)


def bare_number(text: Column) -> Column:
    """Whether a text is nothing but a number or range."""
    return text.rlike(rf"^\s*{NUMBER}(?:\s*[-–]\s*{NUMBER})?\s*$")


def yield_count(text: Column) -> Column:
    return first_number(F.trim(text))


def yield_unit(text: Column) -> Column:
    made = F.lit(None).cast("string")
    for word, stored in reversed(YIELD_UNITS):
        made = F.when(F.lower(text).contains(word), stored).otherwise(made)
    return made


def qty_text(low: Column, high: Column) -> Column:
    """The stored form: "low-high" or a number without trailing zeros, empty without one."""
    plain = lambda c: sub(F.format_string("%.3f", c), r"\.?0+$", "")
    return F.when(low.isNull(), "").when(high.isNull(), plain(low)).otherwise(F.concat(plain(low), F.lit("-"), plain(high)))


def float_equals(a: Column, b: Column, within: float = 0.0005) -> Column:
    """Null-safe comparison within a tolerance."""
    return (a.isNull() & b.isNull()) | F.coalesce(F.abs(a - b) <= within, F.lit(False))


def split_entries(line: Column) -> Column:
    """The entries of a line that holds several: split at ; and bullets or wide gaps, without bare numbers."""
    parts = F.transform(F.split(line, r"\s*[;•·]\s*|\s{2,}"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (p != "") & ~bare_number(p))
