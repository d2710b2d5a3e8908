"""Text normalisation as Column functions; each takes and returns a string Column, null stays null."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache, reduce
from string import ascii_lowercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.lexicon import TOLERANCES

# Phrases that make the tail after the last comma a note.
NOTE_HINTS = ("optional", "nach geschmack", "zum abschmecken", "falls vorhanden", "nach belieben", "oder", "bzw.", "alternativ", "ggf.", "wenn möglich", "bei bedarf")

# Vulgar fractions and their plain form.
FRACTIONS = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅐": "1/7", "⅑": "1/9", "⅒": "1/10", "⅓": "1/3", "⅔": "2/3", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8"}

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def having(df: DataFrame, test: Callable[[Column], Column], *columns: Column | str) -> DataFrame:
    """Columns of the rows that pass a test on them. A ``where`` goes below the stages that made the columns, with all of their expressions written out, as often as one names another; a generator stays."""
    return df.select(F.explode(F.filter(F.array(F.struct(*columns)), test)).alias("_row")).select("_row.*")


def sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, pattern, to)


def squeeze(text: Column) -> Column:
    """White space, no-break spaces included, collapsed and trimmed."""
    return F.trim(sub(text, r"(?U)\s+", " "))


def plain_spaces(text: Column) -> Column:
    """No-break, narrow and thin spaces become spaces, runs collapse."""
    return sub(F.translate(text, "   ", "   "), r" {2,}", " ")


def unify_dashes(text: Column, to: str = "–") -> Column:
    """All dashes become one."""
    return F.translate(text, "-‐‑‒–—―−", to * 8)


def decimal_point(text: Column) -> Column:
    """A comma between digits becomes a point."""
    return sub(text, r"(?<=\d),(?=\d)", ".")


def spaced_dashes(text: Column) -> Column:
    return sub(text, r"\s*[-–—]\s*", " - ")


def decode_u00(text: Column) -> Column:
    """Leftovers of escapes, with or without a backslash, as the Latin-1 characters that they name."""
    text = F.regexp_replace(text, r"\\u00([0-9a-fA-F]{2})", "u00$1")
    pairs = [(f"u00{code:02x}", chr(code)) for code in range(0xA0, 0x100)] + [(f"u00{code:02X}", chr(code)) for code in range(0xA0, 0x100) if f"{code:02X}" != f"{code:02x}"]
    table = F.expr("array(" + ",".join(f"named_struct('a', '{a}', 'b', '{b}')" for a, b in pairs) + ")")
    return let(text, lambda t: F.when(t.rlike("u00[0-9a-fA-F]{2}"), F.aggregate(table, t, lambda acc, p: F.replace(acc, p["a"], p["b"]))).otherwise(t))


def drop_leading_and(text: Column) -> Column:
    """A leading ampersand or "und" before a word goes."""
    return sub(text, r"(?iU)^\s*(?:&|und)\s+(?=\p{L})", "")


def tail_to_note(text: Column) -> Column:
    """The part after the last comma goes into brackets where a part holds a note hint."""
    hints = "|".join(h.replace(".", r"\.") for h in NOTE_HINTS)
    bracketed = r"^(.*[^)\s])\s*, ((?!\(.*\)$)[^,]*)$"

    def one(t: Column) -> Column:
        tidy = F.array_join(F.transform(F.split(t, ","), lambda p: F.trim(p)), ", ")
        return F.when(t.contains(",") & F.lower(t).rlike(hints), sub(tidy, bracketed, "$1 ($2)")).otherwise(t)

    return let(text, one)


def normalize_line(text: Column) -> Column:
    """The line normaliser; it never makes a line empty."""
    made = squeeze(sub(text, "[​-‍﻿]+", ""))
    for step in (decode_u00, drop_leading_and, tail_to_note, spaced_dashes, squeeze):
        made = step(made)
    return F.coalesce(F.nullif(made, F.lit("")), text)


def prenormalize(text: Column) -> Column:
    """What the line parser does first: spaces, fraction slash, decimal comma, dashes, and a gap between digits and letters."""
    made = decimal_point(F.replace(plain_spaces(text), F.lit("⁄"), F.lit("/")))
    return squeeze(sub(spaced_dashes(made), r"(?<=\d)(?=[A-Za-zÄÖÜäöüµ%])", " "))


def plain_fractions(text: Column) -> Column:
    """Vulgar fractions outside of words in plain form."""

    def spelled(text: Column) -> Column:
        return reduce(lambda t, p: sub(t, f"(?<![{_LETTER}]){p[0]}(?![{_LETTER}])", p[1]), FRACTIONS.items(), text)

    return let(text, lambda t: F.when(t.rlike("[" + "".join(FRACTIONS) + "]"), spelled(t)).otherwise(t))


def normalize_quantity(text: Column) -> Column:
    """A line whose numbers have one form: plain fractions and decimal points, multipliers apart, without words of tolerance (whole words only)."""
    tolerance = "(?:" + "|".join(TOLERANCES) + r")(?!\p{L})\.?|~"
    digit = r"(?<=\d)"
    made = F.translate(plain_spaces(plain_fractions(text)), "–—×", "--x")
    steps = ((rf"{digit}(?=\d/\d)", " "), (rf"{digit},(?=\d)", "."), (rf"{digit}\s*[xX]\s*(?=\d)", " x "), (rf"(?iu)(?<!\S)(?:{tolerance})", " "), (r"^\s*\.\s*(?=\d)", ""))
    return squeeze(reduce(lambda t, step: sub(t, *step), steps, made))


def strip_tags(text: Column) -> Column:
    return sub(text, r"<[^>]*>", "")


@cache
def _accents() -> tuple[str, str]:
    """Every Latin letter that is one of a-z with marks, and what it is without them."""
    bases = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))}
    marked = [c for c, base in bases.items() if base in ascii_lowercase]
    return "".join(marked), "".join(bases[c] for c in marked)


def canon_key(text: Column) -> Column:
    """Comparison key: without tags, accents and case, white space collapsed."""
    return F.translate(squeeze(F.lower(strip_tags(text))), *_accents())


def slug(text: Column) -> Column:
    """Folded text of a-z, 0-9 and single spaces; umlauts in two letters."""
    made = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")), F.lower(text))
    return squeeze(sub(F.translate(made, "àáâãåçèéêëìíîïñòóôõùúûýÿ", "aaaaaceeeeiiiinoooouuuyy"), r"[^a-z0-9]+", " "))


def absolute_url(url: Column, base: Column) -> Column:
    """A URL against the page's: absolute ones stay, rooted ones get the origin, others the folder."""
    return let(F.struct(F.trim(F.coalesce(url, F.lit(""))).alias("u"), base.alias("b")), lambda x: _absolute(x["u"], x["b"]))


def _absolute(u: Column, base: Column) -> Column:
    origin = F.regexp_extract(base, r"(?i)^(https?://[^/]+)(/.*)?$", 1)
    path = F.regexp_extract(base, r"(?i)^(https?://[^/]+)(/.*)?$", 2)
    folder = sub(F.when(path == "", "/").otherwise(path), r"/[^/]*$", "/")
    return F.when((u == "") | u.rlike("(?i)^https?://") | base.isNull() | (origin == ""), u).when(u.startswith("/"), F.concat(origin, u)).otherwise(F.concat(origin, folder, u))


def split_list(text: Column) -> Column:
    """Distinct positive numbers of a comma-separated list, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p).try_cast("long")), lambda n: n > 0))
