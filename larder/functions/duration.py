"""Durations: free text to ISO 8601, sums with carry, and a default for the total."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import FRACTIONS, decimal_point, let, plain_fractions, sub

# Words for the parts of a duration, by the letter of ISO 8601.
WORDS = {"H": ("stunden", "stunde", "std", "hours", "hour", "h"), "M": ("minuten", "minutes", "minute", "mins", "min", "m"), "S": ("sekunden", "sekunde", "seconds", "sec", "s")}

_COUNT = r"\d+\s+\d+\s*/\s*\d+|\d+\s*/\s*\d+|\d+(?:[.,]\d+)?"
_UNIT = f"({_COUNT})\\s*({'|'.join(sorted((w for ws in WORDS.values() for w in ws), key=lambda w: (-len(w), w)))})"


def _value(token: Column) -> Column:
    t = decimal_point(token)
    number = lambda pattern: F.regexp_extract(t, pattern, 1).try_cast("double")
    whole = F.coalesce(number(r"^(\d+)\s+\d+\s*/"), F.lit(0.0))
    return F.coalesce(t.try_cast("double"), whole + F.try_divide(number(r"(\d+)\s*/"), number(r"/\s*(\d+)$")), F.lit(0.0))


def _iso(h: Column, m: Column, s: Column) -> Column:
    part = lambda c, mark: F.when(c > 0, F.concat(c.cast("string"), F.lit(mark))).otherwise("")
    return F.concat(F.lit("PT"), part(h, "H"), part(m, "M"), part(s, "S"))


def parse_duration(text: Column) -> Column:
    """ISO duration of a text; parts are rounded, not carried; a bare number is minutes; null if there is none."""
    # A fraction stands apart from the whole number before it and from the unit after it.
    apart = sub(text, f"(?<=\\d)(?=[{''.join(FRACTIONS)}])|(?<=[{''.join(FRACTIONS)}])(?=\\p{{L}})", " ")
    text = F.when(text.rlike(f"[{''.join(FRACTIONS)}]"), plain_fractions(apart)).otherwise(text)
    low = F.lower(F.trim(text))
    pairs = F.arrays_zip(F.regexp_extract_all(low, F.lit(_UNIT), F.lit(1)).alias("v"), F.regexp_extract_all(low, F.lit(_UNIT), F.lit(2)).alias("u"))
    return let(F.struct(F.trim(text).alias("t"), pairs.alias("pairs")), lambda x: _written(x["t"], x["pairs"]))


def _written(t: Column, pairs: Column) -> Column:
    low = F.lower(t)
    total = lambda kind: F.aggregate(F.filter(pairs, lambda p: p["u"].rlike(kind)), F.lit(0.0), lambda acc, p: acc + _value(p["v"]))
    clock_h, clock_m = F.regexp_extract(t, r"^(\d+)\s*:\s*(\d{1,2})$", 1).try_cast("double"), F.regexp_extract(t, r"^(\d+)\s*:\s*(\d{1,2})$", 2).try_cast("double")
    bare = decimal_point(F.regexp_extract(low, r"(\d+(?:[.,]\d+)?)", 1)).try_cast("double")
    some = F.size(pairs) > 0
    hours = F.when(some, total("^(h|st)")).otherwise(F.coalesce(clock_h, F.lit(0.0)))
    minutes = F.when(some, total("^m")).otherwise(F.coalesce(clock_m, F.when(clock_h.isNull(), bare), F.lit(0.0)))
    seconds = F.when(some, total("^s(?!t)")).otherwise(F.lit(0.0))
    parts = F.struct(hours.alias("h"), minutes.alias("m"), seconds.alias("s"))
    made = let(parts, lambda p: F.when((p["h"] != 0) | (p["m"] != 0) | (p["s"] != 0), _iso(*[F.round(p[k]).cast("long") for k in "hms"])))
    return F.when(t == "", None).when(t.rlike("^PT"), t).otherwise(made)


def seconds_of(iso: Column) -> Column:
    """Seconds of an ISO duration of hours, minutes and seconds; 0 for null."""
    part = lambda mark: F.coalesce(F.regexp_extract(iso, rf"PT(?:\d+[HM])*?(\d+){mark}", 1).try_cast("long"), F.lit(0))
    return part("H") * 3600 + part("M") * 60 + part("S")


def sum_durations(a: Column, b: Column) -> Column:
    """The sum with carry; null if both are null."""
    made = let(seconds_of(a) + seconds_of(b), lambda t: _iso(F.floor(t / 3600), F.floor(t % 3600 / 60), t % 60))
    return F.when(a.isNotNull() | b.isNotNull(), made)


def total_time(total: Column, prep: Column, cook: Column) -> Column:
    """The total as given, else preparation and cooking together."""
    return F.coalesce(total, sum_durations(prep, cook))
