"""What follows a quantity: unit, item and notes, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.quantity import NUMBER
from larder.functions.text import decimal_point, let, plain_fractions, plain_spaces, squeeze, sub, unify_dashes
from larder.functions.units import canonical_unit

# What a piece behind a hyphen is noted as, beside a unit of weight.
PIECES = {"stück": "Stück", "stk": "Stück", "stueck": "Stück", "scheibe": "Scheibe", "scheiben": "Scheiben", "würfel": "Würfel", "wuerfel": "Würfel", "streifen": "Streifen"}
WEIGHT_UNITS = ("g", "kg")

_BRACKETS = r"^(.*)\(([^)]*)\)\s*$"
_HYPHEN = r"^(\p{L}[\p{L}-]*)\s*-\s*(\p{L}+)$"


def trailing_notes(text: Column) -> Column:
    """struct(item, note): brackets at the end, then what follows the first comma, become the note, each part once."""

    def one(t: Column) -> Column:
        left = F.when(t.rlike(_BRACKETS), F.trim(F.regexp_extract(t, _BRACKETS, 1))).otherwise(t)
        notes = F.array(squeeze(F.regexp_extract(t, _BRACKETS, 2)), squeeze(F.regexp_extract(left, "^[^,]*,(.*)$", 1)))
        item = F.trim(F.regexp_extract(left, "^([^,]*)", 1))
        return F.struct(item.alias("item"), F.nullif(F.array_join(F.array_distinct(F.filter(notes, lambda n: n != "")), ", "), F.lit("")).alias("note"))

    return let(F.trim(text), one)


def hyphen_note(item: Column, unit: Column) -> Column:
    """struct(item, note): of "Ingwer-Stück" by weight the last part is a note."""
    pieces = F.create_map(*[F.lit(x) for pair in PIECES.items() for x in pair])

    def one(x: Column) -> Column:
        note = F.when(x["unit"].isin(*WEIGHT_UNITS), F.element_at(pieces, F.lower(F.regexp_extract(x["item"], _HYPHEN, 2))))
        return F.struct(F.when(note.isNotNull(), F.regexp_extract(x["item"], _HYPHEN, 1)).otherwise(x["item"]).alias("item"), note.alias("note"))

    return let(F.struct(F.trim(item).alias("item"), unit.alias("unit")), one)


def remainder(text: Column) -> Column:
    """struct(unit, item, note) of what follows a quantity: a leading TK, trailing parts and hyphened pieces are notes."""
    frozen = let(F.trim(text), lambda t: F.struct(F.when(t.rlike(r"^TK\b"), "TK").alias("tk"), F.trim(sub(t, r"^TK\b", "")).alias("rest")))

    def with_unit(x: Column) -> Column:
        word = F.regexp_extract(x["rest"], r"^(\p{L}+)", 1)
        unit = canonical_unit(word)
        rest = F.when(unit.isNotNull(), F.trim(F.substr(x["rest"], F.char_length(word) + 1))).otherwise(x["rest"])
        return F.struct(x["tk"].alias("tk"), unit.alias("unit"), trailing_notes(rest).alias("t"))

    def with_piece(x: Column) -> Column:
        return F.struct(x["tk"].alias("tk"), x["unit"].alias("unit"), x["t"]["note"].alias("note"), hyphen_note(x["t"]["item"], x["unit"]).alias("h"))

    def whole(x: Column) -> Column:
        note = F.nullif(F.concat_ws("; ", x["tk"], x["note"], x["h"]["note"]), F.lit(""))
        return F.struct(x["unit"].alias("unit"), x["h"]["item"].alias("item"), note.alias("note"))

    return let(let(let(frozen, with_unit), with_piece), whole)


def quantity_token(text: Column) -> Column:
    """A quantity with plain fractions, decimal points, a zero before a leading point, and a hyphen for "bis" and all dashes."""
    made = decimal_point(sub(plain_spaces(text), r"(^|[^0-9])\.(?=\d)", "$1 0."))
    made = sub(plain_fractions(made), r"(?<=\d)(?=\d/\d)", " ")
    return squeeze(sub(unify_dashes(made, "-"), r"(?i)\s+bis\s+", "-"))


def number_tokens(text: Column) -> Column:
    """The numbers of a text in order, two with a hyphen between as one range."""
    found = F.regexp_extract_all(quantity_token(text), F.lit(rf"({NUMBER}(?:\s*-\s*{NUMBER})?)"), F.lit(1))
    return F.transform(found, lambda t: sub(t, r"\s*-\s*", "-"))


def without_quantity(text: Column, units: tuple[str, ...]) -> Column:
    """A text without a leading number and, after it, one of the units."""
    words = "|".join(u.replace(".", r"\.") for u in sorted(units, key=len, reverse=True))
    return F.trim(sub(sub(F.trim(text), r"^\d+(?:[.,]\d+)?\s*", ""), rf"(?iu)^(?:{words})(?:\.?s)?\b\s*", ""))


def step_text(step: Column) -> Column:
    """A step without the number that it starts with."""
    return F.trim(sub(F.trim(step), r"^\d+[).:-]\s+", ""))


def shows_original(raw: Column, servings: Column) -> Column:
    """Whether a yield is shown as written too: where its number is another than the servings, or it has none."""
    number = F.replace(F.nullif(F.regexp_extract(raw, r"(\d+(?:[.,]\d+)?)", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    return F.coalesce((raw != "") & (number.isNull() | ~number.eqNullSafe(servings.cast("double"))), F.lit(False))
