"""Recipe level: merging sources, instructions, duplicates, flags and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.display import stored_name
from larder.functions.quantity import qty_text
from larder.functions.text import absolute_url, canon_key

#: Fields of a merged document, in storage order.
FIELDS = ("name", "alternateName", "description", "image", "author", "prepTime", "cookTime", "totalTime", "recipeYield", "recipeIngredient", "recipeInstructions", "nutrition", "aggregateRating", "ingredientGroups")
#: Fields that rank a candidate.
CORE = ("name", "recipeIngredient", "recipeInstructions", "image", "recipeYield", "prepTime", "cookTime", "totalTime")

# How far a field of each source is trusted.
WEIGHTS = {"jsonld": 0.95, "microdata": 0.85, "dom": 0.70}
LOW_CONFIDENCE = 0.7


def _filled(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def field_score(fields: list[str] | tuple[str, ...] = CORE) -> Column:
    """How many of the fields are filled."""
    total = F.lit(0)
    for f in fields:
        total = total + F.when(_filled(F.col(f)), 1).otherwise(0)
    return total


def rank_candidates(df: DataFrame, group: str, order: str, fields: tuple[str, ...] = CORE) -> DataFrame:
    """``df`` with score and rank of each candidate of a group: more filled fields first, then the given order."""
    scored = df.withColumn("score", field_score(fields))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), order)))


def merge_sources(df: DataFrame, fields: tuple[str, ...], sources: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """For columns ``<source>_<field>``: the first filled one by source, and ``<field>_source``."""
    out = []
    for f in fields:
        value, source = F.lit(None).cast("string"), F.lit(None).cast("string")
        for s in reversed(sources):
            column = F.col(f"{s}_{f}")
            value, source = F.when(_filled(column), column).otherwise(value), F.when(_filled(column), s).otherwise(source)
        out += [value.alias(f), source.alias(f"{f}_source")]
    return df.select(*[c for c in df.columns if not any(c == f"{s}_{f}" for s in sources for f in fields)], *out)


def provenance(fields: tuple[str, ...]) -> Column:
    """Map from field to the list of its one source, for fields that have one."""
    entries = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.array(F.col(f"{f}_source")).alias("value")) for f in fields]), lambda e: F.get(e["value"], 0).isNotNull())
    return F.map_from_entries(entries)


def source_weight(source: Column) -> Column:
    made = F.lit(None).cast("double")
    for s, w in WEIGHTS.items():
        made = F.when(source == s, w).otherwise(made)
    return made


def confidence(sources: list[Column]) -> Column:
    """Mean weight of the parts that have a source, added in order; 0 without any."""
    weights = F.filter(F.array(*[source_weight(s) for s in sources]), lambda w: w.isNotNull())
    return F.when(F.size(weights) == 0, 0.0).otherwise(F.aggregate(weights, F.lit(0.0), lambda a, w: a + w) / F.size(weights))


def flags(ingredients: Column, instructions: Column, score: Column) -> Column:
    """struct(isPartial, lowConfidence)."""
    partial = (F.coalesce(ingredients, F.lit(0)) == 0) | (F.coalesce(instructions, F.lit(0)) == 0)
    return F.struct(partial.alias("isPartial"), (score < LOW_CONFIDENCE).alias("lowConfidence"))


def warnings(score: Column, partial: Column) -> Column:
    return F.array_compact(F.array(F.when(score < LOW_CONFIDENCE, "low confidence"), F.when(partial, "partial")))


def line_key(low: Column, high: Column, unit: Column, item: Column) -> Column:
    """Key of equal lines: quantity to three places, unit, folded item."""
    qty = F.when(low.isNull(), "").when(high.isNull(), F.format_string("%.3f", low)).otherwise(F.format_string("%.3f-%.3f", low, high))
    return F.concat_ws("|", qty, F.lower(F.trim(F.coalesce(unit, F.lit("")))), canon_key(F.coalesce(item, F.lit(""))))


def stored_key(low: Column, high: Column, unit: Column, item: Column, note: Column) -> Column:
    """Key of equal stored lines: the folded text of quantity, unit and name."""
    parts = F.transform(F.array(qty_text(low, high), unit, stored_name(item, note)), lambda p: F.nullif(F.trim(p), F.lit("")))
    return canon_key(F.array_join(F.array_compact(parts), " "))


def first_wins(df: DataFrame, group: list[str], order: str, key: Column) -> DataFrame:
    """Of the rows of a group with one key only the first by order; rows with an empty key go."""
    w = Window.partitionBy(*group, "_key").orderBy(order)
    # The test of the key stands behind the window: pushed below it, the key would be computed twice.
    place = F.when(~F.col("_key").isin("||", ""), F.row_number().over(w))
    return df.withColumn("_key", key).withColumn("_n", place).where("_n = 1").drop("_key", "_n")


def instruction_steps(text: Column) -> Column:
    """Steps of a plain text: split at line breaks and before a capital after a full stop."""
    parts = F.split(text, r"\r?\n|\.\s+(?=[A-ZÄÖÜ])")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")


def section_steps(steps: Column) -> Column:
    """Steps of array<struct<type, name, text, items array<string>>>: sections give their items with the section's name."""

    def one(s: Column) -> Column:
        section = (F.lower(F.coalesce(s["type"], F.lit(""))) == "howtosection") & (F.size(F.coalesce(s["items"], F.array().cast("array<string>"))) > 0)
        plain = F.array(F.struct(F.trim(F.coalesce(s["text"], s["name"], F.lit(""))).alias("text"), F.lit(None).cast("string").alias("section")))
        return F.when(section, F.transform(s["items"], lambda i: F.struct(F.trim(i).alias("text"), F.nullif(F.trim(s["name"]), F.lit("")).alias("section")))).otherwise(plain)

    return F.filter(F.flatten(F.transform(steps, one)), lambda s: s["text"] != "")


def images(urls: Column, og_image: Column, base: Column) -> Column:
    """Absolute image addresses, the page's own last, distinct and filled."""
    every = F.concat(F.coalesce(urls, F.array().cast("array<string>")), F.array(og_image))
    return F.array_distinct(F.filter(F.transform(every, lambda u: absolute_url(u, base)), lambda u: u != ""))


def authors(names: Column) -> Column:
    """Persons of a list of names or addresses; an address is named by its last part."""
    named = F.transform(names, lambda n: F.when(n.rlike("^https?://"), F.regexp_extract(n, r"([^/]+)/*$", 1)).otherwise(F.trim(n)))
    return F.transform(F.filter(named, lambda n: n.isNotNull() & (n != "")), lambda n: F.struct(n.alias("name")))
