"""Stored recipe documents: tolerant reading, parsing their lines anew, what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.display import german_number
from larder.functions.quantity import number
from larder.functions.text import canon_key, decode_u00, let
from larder.functions.units import german_unit
from larder.operators.lines import parse_lines
from larder.operators.recipe import first_wins
from larder.sources.serialized import unserialized

_NO_TEXTS = "array<string>"


def listed(meta: Column) -> Column:
    """array<variant> of stored metadata: a list, or an object as its only entry, in JSON or serialized; anything else is empty."""
    return entries(F.coalesce(F.try_parse_json(meta), unserialized(F.when(F.try_parse_json(meta).isNull(), meta))))


def entries(value: Column) -> Column:
    """array<variant> of a variant: the items of a list, or an object as the only one; anything else has none."""
    none = F.array().cast("array<variant>")
    return let(value, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v)), none))


def _entries(schema: Column, key: str) -> Column:
    """The entries of a list of a document, or the one that stands there."""
    many, one = F.try_variant_get(schema, f"$.{key}", "array<variant>"), F.try_variant_get(schema, f"$.{key}", "variant")
    return F.coalesce(many, F.array_compact(F.array(one)))


def _text(v: Column) -> Column:
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def raw_lines(schema: Column) -> Column:
    """The raw lines of a document (variant), each once and where it comes first."""
    every = F.concat(_entries(schema, "recipeIngredient"), _entries(schema, "ingredientsParsed"))
    raw = F.transform(every, lambda v: F.trim(F.coalesce(_text(v), F.try_variant_get(v, "$.raw", "string"))))
    return F.array_distinct(F.filter(raw, lambda t: t != ""))


def reparsed(docs: DataFrame, key: str, schema: str = "schema", engine: str = "simple") -> DataFrame:
    """(key, lines): the raw lines of each document's JSON parsed anew; documents without any are left out."""
    raw = docs.select(key, F.posexplode(raw_lines(F.try_parse_json(F.col(schema)))).alias("pos", "raw"))
    line = F.struct("pos", "raw", "qty_low", "qty_high", "unit", "item", "note")
    return parse_lines(raw, "raw", engine).groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("lines"))


def materialized(schema: Column) -> Column:
    """array<struct<qty, unit, name>> as shown, of a document (variant): its parsed entries, else its ingredients."""
    get = lambda v, path: F.try_variant_get(v, path, "string")

    def amount(v: Column) -> Column:
        single = number(F.replace(get(v, "$.qty"), F.lit(","), F.lit(".")))
        ends = F.struct(F.coalesce(F.try_variant_get(v, "$.qty.low", "double"), single).alias("low"), F.try_variant_get(v, "$.qty.high", "double").alias("high"))
        shown = lambda x: F.concat_ws("–", german_number(x["low"]), F.when(~x["high"].eqNullSafe(x["low"]), german_number(x["high"])))
        return let(ends, shown)

    def entry(v: Column) -> Column:
        name = decode_u00(F.coalesce(F.trim(_text(v)), get(v, "$.item"), get(v, "$.name"), get(v, "$.raw"), F.lit("")))
        return F.struct(amount(v).alias("qty"), german_unit(get(v, "$.unit")).alias("unit"), name.alias("name"))

    parsed = _entries(schema, "ingredientsParsed")
    return F.transform(F.when(F.size(parsed) > 0, parsed).otherwise(_entries(schema, "recipeIngredient")), entry)


def summary(schema: Column) -> Column:
    """struct(name, ingredients, first_ingredients, steps, first_steps): counts, and the first five and three."""
    said = lambda v: F.coalesce(_text(v), F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$['@type']", "string"))
    lines, steps = F.transform(_entries(schema, "recipeIngredient"), said), F.transform(_entries(schema, "recipeInstructions"), said)
    return F.struct(F.try_variant_get(schema, "$.name", "string").alias("name"), F.size(lines).alias("ingredients"), F.slice(lines, 1, 5).alias("first_ingredients"), F.size(steps).alias("steps"), F.slice(steps, 1, 3).alias("first_steps"))


def source_url(schema: Column, canonical: Column, stored: Column) -> Column:
    """The address in the document (variant), else the canonical one of the stored address, else that; empty without any."""
    own, at = F.try_variant_get(schema, "$.url", "string"), F.nullif(F.trim(stored), F.lit(""))
    return F.coalesce(F.when(own.rlike(r"(?i)^[a-z][a-z0-9+.-]*://[^\s/]+"), own), F.when(at.isNotNull(), F.nullif(canonical, F.lit(""))), at, F.lit(""))


def first_filled(*lists: Column) -> Column:
    """The first list that has entries: groups, stored lines, lines of the document, lines made again; empty without any."""
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast(_NO_TEXTS))


def shown_once(lines: DataFrame, group: list[str], order: str, low: str = "qty_low", unit: str = "unit", name: str = "name") -> DataFrame:
    """``lines`` without those whose lower quantity, unit and folded name an earlier one of the group has."""
    qty = F.coalesce(F.format_string("%.3f", F.col(low)), F.lit(""))
    key = F.concat(F.when(F.col(low).isNull(), "").otherwise(qty), F.lit("|"), F.lower(F.trim(F.coalesce(unit, F.lit("")))), F.lit("|"), canon_key(F.coalesce(name, F.lit(""))), F.lit("."))
    return first_wins(lines, group, order, key)


def card(title: Column, link: Column, *images: Column) -> Column:
    """struct(link, title, image) of a related post: the first image that there is."""
    image = F.coalesce(*[F.nullif(i, F.lit("")) for i in images], F.lit(""))
    return F.struct(link.alias("link"), title.alias("title"), image.alias("image"))
