"""Casing of German ingredient lines that were written in lower case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import let

# Words that stay in lower case, stems of adjectives and the endings they take, and words that tell German.
KEPT = ("und", "oder", "mit", "ohne", "in", "im", "am", "vom", "von", "zum", "zur", "zu", "auf", "an", "aus", "für", "fuer", "bei", "als", "der", "die", "das", "den", "dem", "des", "ein", "eine", "einer", "einem", "eines")
STEMS = ("gemahlen", "gehackt", "gerieben", "gepresst", "gequetscht", "geschält", "geschaelt", "getrocknet", "frisch", "weich", "hart", "grob", "fein", "klein", "groß", "gross", "mittelgroß", "mittelgross", "kalt", "warm", "heiß", "heiss", "lauwarm", "zart", "reif", "ungesalzen", "gesalzen", "gewürfelt", "gewuerfelt", "in", "halbiert", "geviertelt", "entkernt", "ohne", "mit")
ENDINGS = ("e", "en", "em", "er", "es", "n", "s")
GERMAN = ("und", "oder", "mit", "ohne", "für", "fuer", "zum", "zur", "der", "die", "das", "den", "dem", "des")

_LOWERED = rf"(?iu)^(?:{'|'.join(KEPT)}|(?:{'|'.join(STEMS)})(?:{'|'.join(ENDINGS)})?)$"
_IS_GERMAN = rf"[äöüß]|(?iu)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(GERMAN)})(?![\p{{L}}\p{{N}}_])"


def german_casing(line: Column) -> Column:
    """A line with its likely nouns capitalised: words and parts of hyphenated ones, but for adjectives and small words.

    What has a capital already stays as it is, and so does a line in which nothing tells German. Null stays null.
    """

    def cased(part: Column) -> Column:
        first = r"^(\P{Ll}*)(\p{Ll})(?s)(.*)$"
        raised = F.concat(F.regexp_extract(part, first, 1), F.upper(F.regexp_extract(part, first, 2)), F.regexp_extract(part, first, 3))
        return F.when(part.rlike(_LOWERED), F.lower(part)).when(part.rlike(r"\p{Lu}|\p{Lt}") | ~part.rlike(r"\p{Ll}"), part).otherwise(raised)

    parts = F.regexp_extract_all(line, F.lit(r"(?U)[^\s-]+|[\s-]+"), F.lit(0))
    return F.when(~line.rlike(_IS_GERMAN), line).otherwise(let(parts, lambda ps: F.array_join(F.transform(ps, cased), "")))
