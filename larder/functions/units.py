"""Units: leading unit of a text, canonical names, German labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.text import let, slug

# Unit words that the simple parser knows, as typed.
SIMPLE_UNITS = ("g", "kg", "mg", "l", "ml", "Liter", "EL", "TL", "Prise", "Stk", "Stück", "Stueck", "Bund", "Dose", "Tasse", "Becher", "Pck", "Pck.", "Paket", "Scheibe", "Zehe", "Knolle", "Paar")
#: Of these, what the active parser recognises: its list holds a damaged form of "Stück", which never matches.
ACTIVE_UNITS = tuple(u for u in SIMPLE_UNITS if u != "Stück")

# Canonical unit by alias.
CANONICAL = {
    "g": "g", "gram": "g", "grams": "g", "gramm": "g", "gr": "g", "kg": "kg",
    "ml": "ml", "milliliter": "ml", "millilitre": "ml", "l": "l", "liter": "l", "litre": "l",
    "tl": "tsp", "teeloeffel": "tsp", "teelöffel": "tsp", "tsp": "tsp", "teaspoon": "tsp", "teaspoons": "tsp",
    "el": "tbsp", "essloeffel": "tbsp", "esslöffel": "tbsp", "tbsp": "tbsp", "tablespoon": "tbsp", "tablespoons": "tbsp",
    "tasse": "cup", "tassen": "cup", "cup": "cup", "cups": "cup", "prise": "pinch", "prisen": "pinch", "pinch": "pinch",
    "stk": "piece", "stück": "piece", "stueck": "piece", "piece": "piece", "pieces": "piece",
    "dose": "can", "dosen": "can", "can": "can", "bund": "bunch", "bündel": "bunch", "bunch": "bunch",
    "zehe": "clove", "zehen": "clove", "clove": "clove", "cloves": "clove",
}

# Canonical unit by alias without umlauts and marks, for spellings that the table above lacks.
FOLDED = {"essl": "tbsp", "essloffel": "tbsp", "teel": "tsp", "teeloffel": "tsp", "bunde": "bunch", "buendel": "bunch", "bundel": "bunch", "stuck": "piece", "stucke": "piece", "stuecke": "piece"}

# German label by unit.
GERMAN = {
    "tsp": "TL", "teaspoon": "TL", "teaspoons": "TL", "tl": "TL", "tbsp": "EL", "tablespoon": "EL", "tablespoons": "EL", "el": "EL",
    "cup": "Tasse", "cups": "Tasse", "tasse": "Tasse", "piece": "Stück", "pieces": "Stück", "stueck": "Stück", "stück": "Stück",
    "pinch": "Prise", "prisen": "Prise", "prise": "Prise", "can": "Dose", "dose": "Dose", "bunch": "Bund", "bund": "Bund",
    "g": "g", "gram": "g", "grams": "g", "gramm": "g", "kg": "kg", "ml": "ml", "milliliter": "ml", "millilitre": "ml",
    "l": "l", "liter": "l", "litre": "l", "oz": "oz", "ounce": "oz", "ounces": "oz", "lb": "lb", "pound": "lb", "pounds": "lb",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def canonical_unit(unit: Column) -> Column:
    """Canonical name, null if there is none."""
    return _lookup(CANONICAL, F.lower(F.trim(unit)))


def folded_unit(unit: Column) -> Column:
    """Canonical name by the unit's letters a-z, umlauts in two letters, then in one; null if there is none."""
    table = {**{k: v for k, v in CANONICAL.items() if k.isascii()}, **FOLDED}
    two = F.regexp_replace(slug(unit), "[^a-z]", "")
    one = F.regexp_replace(F.translate(F.lower(unit), "äöüß", "aous"), "[^a-z]", "")
    return F.coalesce(_lookup(table, two), _lookup(table, one))


def german_unit(unit: Column) -> Column:
    """German label; an unknown unit stays, an empty or null one is empty."""
    return F.coalesce(_lookup(GERMAN, F.lower(F.trim(unit))), unit, F.lit(""))


def leading_unit(text: Column, units: tuple[str, ...] = ACTIVE_UNITS) -> Column:
    """struct(unit as typed or null, rest) of a text."""
    pattern = r"(?iu)^(" + "|".join(u.replace(".", r"\.") for u in units) + r")\b\s*(.*)$"
    return let(F.struct(text.alias("text"), F.regexp_extract(text, pattern, 1).alias("unit")), lambda x: _split_unit(x["text"], x["unit"], pattern))


def _split_unit(text: Column, unit: Column, pattern: str) -> Column:
    return F.struct(F.when(unit != "", unit).alias("unit"), F.when(unit != "", F.trim(F.regexp_extract(text, pattern, 2))).otherwise(text).alias("rest"))
