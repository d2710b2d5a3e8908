"""Tokens of an ingredient line: kinds, values and places, and what is consumed from its start.

A line is taken apart once; quantity and unit are then read off the tokens, and what is left is cut by place. Nothing is
matched twice, and a hyphen inside a word is part of the word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.lexicon import TOLERANCES
from larder.functions.quantity import MIXED, RATIO, number
from larder.functions.text import FRACTIONS, decode_u00, drop_leading_and, let, plain_spaces, squeeze, sub, tail_to_note
from larder.functions.units import CANONICAL, SIMPLE_UNITS, canonical_unit, folded_unit

#: Characters of a line among which its quantity and unit are looked for; the rest of a line is never taken apart.
HEAD = 160
GLYPHS = "".join(FRACTIONS)
_LEX = {
    "number": rf"{MIXED}|{RATIO}|\d*\s?[{GLYPHS}]|\d+(?:[.,]\d+)?|[.,]\d+",
    "word": r"\p{L}(?:[\p{L}\p{M}\p{N}'’]|-(?=\p{L}))*-?\.?",
    "dash": r"[-‐‑‒–—―−]",
    "space": r"\s+",
    "mark": r".",
}
_ANY = "(?sU)" + "|".join(f"(?:{p})" for p in _LEX.values())
#: Words between the ends of a range, and those of half a piece.
BETWEEN = ("bis", "to")
ARTICLES = tuple(f"ein{end}" for end in ("", "e", "er", "em", "en", "es"))
HALVES = tuple(f"halb{end}" for end in ("", "e", "er", "em", "en", "es"))
#: Unit words beyond those with a canonical name.
_NAMED = {u.lower().rstrip(".") for u in (*SIMPLE_UNITS, "Stücke", "Scheiben", "Pakete", "Knollen", "Packung", "Packungen")} - CANONICAL.keys()
#: Fold of a list is bounded, as is the head of a line.
_TOKEN = "struct<kind:string,text:string,start:int,end:int>"


def tidy(raw: Column) -> Column:
    """A line as the tokenizer takes it: one kind of space and fraction stroke, tails with hints in brackets, multipliers apart, a zero before a leading point."""
    made = squeeze(sub(plain_spaces(raw), "[​-‍﻿]+", ""))
    for step in (decode_u00, drop_leading_and, tail_to_note):
        made = step(made)
    made = sub(F.translate(made, "⁄×", "/x"), r"(?<=\d)\s*[xX]\s*(?=\d)", " x ")
    return squeeze(sub(made, r"(?<![\d.,])\.(?=\d)", "0."))


def tokens(text: Column) -> Column:
    """array<struct<kind, text, start, end>> of a text, white space left out; places are code points from 0, end exclusive."""
    parts = F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))
    kind = lambda t: F.when(t.rlike(r"^\p{L}"), "word").when(t.rlike(rf"^[.,]?\d|[{GLYPHS}]"), "number").when(t.rlike(r"^(?U)\s"), "space").when(t.rlike(f"^{_LEX['dash']}$"), "dash").otherwise("mark")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_TOKEN}>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        end = acc["at"] + F.char_length(t)
        token = F.struct(kind(t).alias("kind"), t.alias("text"), acc["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], token).alias("out"))

    return F.filter(F.aggregate(parts, zero, step, lambda acc: acc["out"]), lambda t: t["kind"] != "space")


def value(token: Column) -> Column:
    """The number that a token stands for, vulgar fractions included; null for other tokens."""
    glyphs = F.create_map(*[F.lit(x) for glyph, plain in FRACTIONS.items() for x in (glyph, int(plain.split("/")[0]) / int(plain.split("/")[1]))])

    def one(t: Column) -> Column:
        glyph = F.regexp_extract(t, f"([{GLYPHS}])", 1)
        whole = F.coalesce(F.regexp_extract(t, r"^(\d+)", 1).try_cast("double"), F.lit(0.0))
        return F.when(glyph != "", whole + F.element_at(glyphs, glyph)).otherwise(number(F.replace(t, F.lit(","), F.lit("."))))

    return F.when(token["kind"] == "number", let(F.trim(token["text"]), one))


def _word(token: Column) -> Column:
    return F.when(token["kind"] == "word", F.lower(F.rtrim(token["text"], F.lit("."))))


def leading_quantity(toks: Column) -> Column:
    """struct(low, high, used, zero): quantity or range, in order, at the start of the tokens, how many of them it takes, and whether it divides by zero."""
    none = F.lit(None).cast("double")

    def after_tolerance(x: Column) -> Column:
        ts, skip = x["ts"], x["skip"]
        at = lambda k: F.get(ts, skip + k)
        half = F.when(_word(at(0)).isin(*HALVES), 1).when(_word(at(0)).isin(*ARTICLES) & _word(at(1)).isin(*HALVES), 2)

        def read(v: Column) -> Column:
            low, high = v["low"], v["high"]
            zero = (at(0)["kind"] == "number") & low.isNull()
            single = F.struct(low.alias("low"), none.alias("high"), (skip + 1).alias("used"), F.coalesce(zero, F.lit(False)).alias("zero"))
            both = F.struct(F.least(low, high).alias("low"), F.when(low != high, F.greatest(low, high)).alias("high"), (skip + 3).alias("used"), F.lit(False).alias("zero"))
            halved = F.struct(F.lit(0.5).alias("low"), none.alias("high"), (skip + half).alias("used"), F.lit(False).alias("zero"))
            nothing = F.struct(none.alias("low"), none.alias("high"), F.lit(0).alias("used"), F.coalesce(zero, F.lit(False)).alias("zero"))
            return F.when(half.isNotNull(), halved).when(low.isNotNull() & high.isNotNull(), both).when(low.isNotNull(), single).otherwise(nothing)

        ranged = (at(1)["kind"] == "dash") | _word(at(1)).isin(*BETWEEN)
        return let(F.struct(value(at(0)).alias("low"), F.when(ranged, value(at(2))).alias("high")), read)

    tolerance = _word(F.get(toks, 0)).isin(*TOLERANCES) | (F.get(toks, 0)["text"] == "~")
    return let(F.struct(toks.alias("ts"), F.when(tolerance, 1).otherwise(0).alias("skip")), after_tolerance)


def unit_of(token: Column) -> Column:
    """The canonical unit that a word names, by the alias table, then by that of folded spellings; other unit words as they are; else null."""
    bare = F.when(token["kind"] == "word", F.rtrim(token["text"], F.lit(".")))
    return let(bare, lambda w: F.coalesce(canonical_unit(w), folded_unit(w), F.when(F.lower(w).isin(*sorted(_NAMED)), w)))


def parsed_head(line: Column) -> Column:
    """struct(low, high, zero, unit, rest) of a tidy line; a unit is only looked for behind a quantity, and the rest begins behind what is consumed."""

    def with_unit(x: Column) -> Column:
        following = F.when(x["q"]["low"].isNotNull(), F.get(x["ts"], x["q"]["used"]))
        return F.struct(x["line"].alias("line"), x["ts"].alias("ts"), x["q"].alias("q"), unit_of(following).alias("unit"))

    def cut(x: Column) -> Column:
        used = x["q"]["used"] + F.when(x["unit"].isNotNull(), 1).otherwise(0)
        at = F.when(used > 0, F.get(x["ts"], used - 1)["end"]).otherwise(0)
        rest = F.trim(F.substr(x["line"], at + 1, F.char_length(x["line"])))
        return F.struct(x["q"]["low"].alias("low"), x["q"]["high"].alias("high"), x["q"]["zero"].alias("zero"), x["unit"].alias("unit"), rest.alias("rest"))

    first = let(line, lambda t: F.struct(t.alias("line"), tokens(F.substr(t, F.lit(1), F.lit(HEAD))).alias("ts")))
    quantified = let(first, lambda x: F.struct(x["line"].alias("line"), x["ts"].alias("ts"), leading_quantity(x["ts"]).alias("q")))
    return let(let(quantified, with_unit), cut)
