"""Display strings of quantities, units and lines, and scaling to servings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import let, sub
from larder.functions.units import german_unit


def german_number(value: Column, snap: bool = True) -> Column:
    """Two decimals with a comma and without trailing zeros; within .01 of a whole number that number."""
    near = (lambda x: F.when(F.abs(x - F.round(x)) < 0.01, F.round(x)).otherwise(x)) if snap else (lambda x: x)
    text = F.replace(F.format_string("%.2f", F.round(let(value, near), 2)), F.lit("."), F.lit(","))
    return F.when(value.isNotNull(), sub(sub(text, ",00$", ""), "(,[0-9])0$", "$1"))


def quantity_display(low: Column, high: Column) -> Column:
    """A quantity or range for display, empty without one."""
    return F.when(low.isNull(), "").when(high.isNull(), german_number(low)).otherwise(F.concat(german_number(low), F.lit("–"), german_number(high)))


def capitalised(text: Column) -> Column:
    """The first letter in upper case where the text is all lower case."""
    return F.when(text == F.lower(text), F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))).otherwise(text)


def positive_or(value: Column, default: int = 2) -> Column:
    """A number of servings; what is no positive number is the default."""
    v = value.try_cast("double")
    return F.when(v > 0, v).otherwise(F.lit(float(default)))


def scaled(value: Column, servings: Column, base: Column) -> Column:
    return value * F.try_divide(servings, base)


def shopping_line(low: Column, high: Column, unit: Column, item: Column, note: Column) -> Column:
    """One line of a shopping list."""
    parts = F.array(quantity_display(low, high), german_unit(unit), capitalised(item), F.when(note.isNotNull() & (note != ""), F.concat(F.lit("("), note, F.lit(")"))))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def stored_name(item: Column, note: Column) -> Column:
    """The stored name: item, and the note in brackets."""
    return F.when(note.isNotNull() & (note != ""), F.concat(item, F.lit(" ("), note, F.lit(")"))).otherwise(item)
