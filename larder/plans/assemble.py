"""Pages to recipe documents: extraction, merging by priority, normalisation, lines, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import duration, quantity
from larder.functions.text import let
from larder.functions.units import canonical_unit
from larder.operators import recipe
from larder.operators.lines import parse_lines
from larder.plans.session import spread
from larder.sources import pages as P

SCALARS = ("name", "description", "recipeYield", "prepTime", "cookTime", "totalTime")
LISTS = ("image", "ingredients", "instructions")


def _plain(v: Column) -> Column:
    """The text of a variant that is one, null for lists and objects."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _each(node: Column | str, path: str) -> Column:
    """The variants of a list at a path, or the one that stands there."""
    many = F.try_variant_get(node, path, "array<variant>")
    return F.coalesce(many, F.array_compact(F.array(F.try_variant_get(node, path, "variant"))))


def _ingredients(node: str) -> Column:
    """array<struct<raw, given>> of a node's ingredients; ``given`` holds the quantity, unit, item and note of one that has them as fields."""
    get = lambda v, *keys: F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in keys])
    end = lambda v, k: F.try_variant_get(v, f"$.qty.{k}", "double")
    has = lambda v: F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in ("qty", "unit", "item", "name", "note")]).isNotNull()

    def fields(v: Column) -> Column:
        unit, item = get(v, "unit"), F.coalesce(get(v, "item", "name"), F.lit(""))
        single = quantity.number(F.replace(get(v, "qty"), F.lit(","), F.lit(".")))
        low, high = F.coalesce(end(v, "low"), single), end(v, "high")
        amount = F.nullif(quantity.qty_text(low, high), F.lit(""))
        given = F.struct(low.alias("low"), high.alias("high"), F.coalesce(canonical_unit(unit), F.nullif(unit, F.lit(""))).alias("unit"), item.alias("item"), F.nullif(get(v, "note"), F.lit("")).alias("note"))
        return F.struct(F.coalesce(get(v, "raw"), F.trim(F.concat_ws(" ", amount, given["unit"], item))).alias("raw"), given.alias("given"))

    def one(v: Column) -> Column:
        plain = F.coalesce(_plain(v), get(v, "raw", "text"))
        none = F.lit(None).cast("struct<low double, high double, unit string, item string, note string>")
        return F.when(_plain(v).isNull() & has(v), fields(v)).otherwise(F.struct(plain.alias("raw"), none.alias("given")))

    listed = F.transform(_each(node, "$.recipeIngredient"), one)
    split = F.transform(recipe.instruction_steps(_plain(F.try_variant_get(node, "$.recipeIngredient", "variant"))), lambda t: F.struct(t.alias("raw"), F.lit(None).cast("struct<low double, high double, unit string, item string, note string>").alias("given")))
    return F.coalesce(split, F.filter(listed, lambda x: x["raw"].isNotNull()))


def _images(node: str) -> Column:
    """Addresses of the images of a node: texts, or objects by url, contentUrl or @id."""
    get = lambda v, k: F.try_variant_get(v, f"$['{k}']", "string")
    return F.filter(F.transform(_each(node, "$.image"), lambda v: F.coalesce(_plain(v), get(v, "url"), get(v, "contentUrl"), get(v, "@id"))), lambda u: u.isNotNull() & (u != ""))


def _steps(node: str) -> Column:
    """array<struct<text, section>> of a node's instructions: steps, sections with their steps, and plain text split into steps."""
    get = lambda v, k: F.try_variant_get(v, f"$['{k}']", "string")
    said = lambda v: F.coalesce(_plain(v), get(v, "text"), get(v, "name"))
    listed = F.transform(_each(node, "$.recipeInstructions"), lambda v: F.struct(get(v, "@type").alias("type"), get(v, "name").alias("name"), F.coalesce(_plain(v), get(v, "text")).alias("text"), F.filter(F.transform(_each(v, "$.itemListElement"), said), lambda t: t.isNotNull()).alias("items")))
    one = F.try_variant_get(node, "$.recipeInstructions", "variant")
    split = F.transform(recipe.instruction_steps(_plain(one)), lambda t: F.struct(t.alias("text"), F.lit(None).cast("string").alias("section")))
    return F.coalesce(split, recipe.section_steps(listed))


def _names(node: Column) -> Column:
    """Names of the authors of a node: texts, or objects by name, else the last part of their @id."""
    get = lambda v, k: F.try_variant_get(v, f"$['{k}']", "string")
    return F.filter(F.transform(_each(node, "$.author"), lambda v: F.coalesce(_plain(v), get(v, "name"), get(v, "@id"))), lambda n: n.isNotNull() & (n != ""))


def _facts(node: Column) -> Column:
    """array<struct<key, value>> of the texts and numbers of a node's nutrition."""
    held = F.try_variant_get(node, "$.nutrition", "map<string,variant>")
    texts = F.map_filter(F.transform_values(held, lambda _, v: F.try_variant_get(v, "$", "string")), lambda k, v: v.isNotNull() & (v != "") & ~k.startswith("@"))
    return F.coalesce(F.map_entries(texts), F.array().cast("array<struct<key:string,value:string>>"))


def _rating(node: Column) -> Column:
    """struct(value, best, count) of a node's aggregate rating; null without a value."""
    get = lambda k: F.replace(F.try_variant_get(node, f"$.aggregateRating.{k}", "string"), F.lit(","), F.lit(".")).try_cast("double")
    made = F.struct(get("ratingValue").alias("value"), get("bestRating").alias("best"), F.coalesce(get("ratingCount"), get("reviewCount")).cast("long").alias("count"))
    return F.when(get("ratingValue").isNotNull(), made)


def _candidate(node: Column, place: Column) -> Column:
    """struct of a recipe node's fields, with how many of the core ones are filled."""
    texts = {f: F.nullif(F.try_variant_get(node, f"$.{f}", "string"), F.lit("")) for f in (*SCALARS, "alternateName")}

    def whole(x: Column) -> Column:
        filled = [x[f].isNotNull() for f in SCALARS if f != "description"] + [F.size(x[f]) > 0 for f in ("images", "entries", "steps")]
        score = F.lit(0)
        for test in filled:
            score = score + test.cast("int")
        return F.struct((-score).alias("order"), place.alias("place"), x.alias("fields"))

    nested = {"images": _images(node), "entries": _ingredients(node), "steps": _steps(node), "authors": _names(node), "facts": _facts(node), "rating": _rating(node)}
    return let(F.struct(*[c.alias(n) for n, c in {**texts, **nested}.items()]), whole)


def _best(found: Column, field: str, filled) -> Column:  # noqa: ANN001
    """A field of the first candidate that has it."""
    return F.get(F.filter(F.transform(found, lambda c: c["fields"][field]), filled), 0)


def _sources(candidates: str) -> dict[str, dict[str, Column]]:
    """For each field its value by source, best candidate first, null or empty where it lacks one."""
    ld, micro, dom = F.col(candidates), lambda f: F.col(f"m.microdata.{f}"), lambda f: F.col(f"m.{f}")
    some = lambda x: F.size(x) > 0
    text = lambda f: _best(ld, f, lambda v: v.isNotNull())
    single = lambda c: F.array_compact(F.array(F.nullif(c, F.lit(""))))
    marked = {"name": "title", "description": "description", "recipeYield": "servings"}
    found = {f: {"jsonld": text(f), "microdata": F.nullif(micro(f), F.lit("")), **({"dom": F.nullif(dom(marked[f]), F.lit(""))} if f in marked else {})} for f in SCALARS}
    found["alternateName"] = {"jsonld": text("alternateName")}
    found["image"] = {"jsonld": _best(ld, "images", some), "microdata": micro("images"), "dom": single(dom("og_image"))}
    found["ingredients"] = {"jsonld": F.transform(_best(ld, "entries", some), lambda x: x["raw"]), "microdata": micro("ingredients"), "dom": dom("ingredients")}
    found["instructions"] = {"jsonld": F.transform(_best(ld, "steps", some), lambda x: x["text"]), "microdata": micro("instructions"), "dom": dom("instructions")}
    found["author"] = {"jsonld": _best(ld, "authors", some), "microdata": micro("authors")}
    return found


def _merged(found: dict[str, dict[str, Column]]) -> list[Column]:
    """The first filled value of each field by source, and ``<field>_source``."""
    out = []
    for f, by_source in found.items():
        filled = {s: (F.coalesce(F.size(c), F.lit(0)) > 0 if f in (*LISTS, "author") else c.isNotNull()) for s, c in by_source.items()}
        value, source = F.lit(None), F.lit(None).cast("string")
        for s in reversed(by_source):
            value, source = F.when(filled[s], by_source[s]).otherwise(value), F.when(filled[s], s).otherwise(source)
        out += [value.alias(f), source.alias(f"{f}_source")]
    return out


def facts_by_source(jsonld: Column, microdata: Column) -> tuple[Column, Column]:
    """Two maps of a nested object whose keys are merged one by one, the first source's before the second's: key to value, and key to source."""
    none = F.create_map().cast("map<string,string>")
    first, second = F.coalesce(jsonld, none), F.coalesce(microdata, none)
    added = F.map_filter(second, lambda k, _: ~F.map_contains_key(first, k))
    source = F.map_concat(F.transform_values(first, lambda _, __: F.lit("jsonld")), F.transform_values(added, lambda _, __: F.lit("microdata")))
    return F.map_concat(first, added), source


def _once(lines: DataFrame) -> DataFrame:
    """Lines without those that an earlier one of the page equals, by its parts or as it is stored. The input is dealt by page, so neither window shuffles."""
    lines = recipe.first_wins(lines, ["page_id"], "pos", F.when(F.col("pos").isNull(), F.lit("-")).otherwise(recipe.line_key(F.col("qty_low"), F.col("qty_high"), F.col("unit"), F.col("item"))))
    return recipe.first_wins(lines, ["page_id"], "pos", F.when(F.col("pos").isNull(), F.lit("-")).otherwise(recipe.stored_key(F.col("qty_low"), F.col("qty_high"), F.col("unit"), F.col("item"), F.col("note"))))


def assemble(pages: DataFrame, engine: str = "simple", li_override: bool = True) -> DataFrame:
    """One recipe document for each page (page_id, which is unique, url, html); a page without any recipe has empty lists.

    Pages are read once, and go through one Arrow step that walks markup and JSON-LD; all else is expressions over
    a page's own row, dealt by page once. Ingredients are exploded to be parsed, the page's other fields beside the first one only, and
    gathered in the same partition.
    """
    step = P.markup(F.col("html"), "title", "description", "og_image", "servings", "ingredients", "instructions", "groups", "recipes", "microdata", li_override=li_override)
    rows = pages.select("page_id", "url", P.canonical_url(F.col("html"), F.col("url")).alias("canonical"), step.alias("m"))
    # Dealt once, behind the Python step, whose rows have no known place, so that the windows and the gathering below shuffle nothing.
    rows = spread(rows, "page_id")
    nodes = F.transform(F.col("m.recipes"), lambda text, i: _candidate(F.try_parse_json(text), i))
    rows = rows.withColumn("found", F.array_sort(nodes)).select("*", *_merged(_sources("found")))
    # Entries that come with fields keep them; only what is text is parsed.
    some = lambda x: F.size(x) > 0
    facts, fact_sources = facts_by_source(F.map_from_entries(_best(F.col("found"), "facts", some)), F.col("m.microdata.nutrition"))
    from_ld = lambda f, get: F.when(F.col(f"{f}_source") == "jsonld", get)
    rows = rows.select(
        "*", facts.alias("nutrition"), fact_sources.alias("nutritionSources"), _best(F.col("found"), "rating", lambda r: r.isNotNull()).alias("aggregateRating"),
        from_ld("ingredients", F.transform(_best(F.col("found"), "entries", some), lambda x: x["given"])).alias("given"),
        from_ld("instructions", F.filter(_best(F.col("found"), "steps", some), lambda s: s["section"].isNotNull())).alias("sectionSteps"),
        F.when(F.col("ingredients_source") == "dom", F.col("m.groups")).otherwise(F.expr("array()").cast("array<struct<name:string,items:array<string>>>")).alias("ingredientGroups"), F.col("m.og_image").alias("og_image"),
    ).drop("m", "found")
    kept = [c for c in rows.columns if c not in ("page_id", "ingredients", "given")]
    entries = F.zip_with("ingredients", F.coalesce("given", F.array().cast(rows.schema["given"].dataType)), lambda raw, given: F.struct(raw.alias("raw"), given.alias("given")))
    document = F.struct(*kept)
    lines = rows.select("page_id", document.alias("document"), F.posexplode_outer(entries).alias("pos", "entry"))
    lines = lines.select("page_id", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("document")).alias("document"), "pos", F.col("entry.raw").alias("raw"), F.col("entry.given").alias("given"))
    parsed = parse_lines(lines, "raw", engine)
    fielded = lambda c, f: F.when(F.col("given").isNotNull(), F.col(f"given.{f}")).otherwise(F.col(c)).alias(c)
    parsed = parsed.select("page_id", "document", "pos", "raw", fielded("qty_low", "low"), fielded("qty_high", "high"), F.when(F.col("given").isNotNull(), F.col("given.high").isNotNull()).otherwise(F.col("is_range")).alias("is_range"), *[fielded(c, c) for c in ("unit", "item", "note")])
    # The page's row has to outlive its first line, which may be empty.
    line = F.struct("pos", "raw", "qty_low", "qty_high", "is_range", "unit", "item", "note")
    fields = ("pos", "raw", "qty_low", "qty_high", "is_range", "unit", "item", "note")
    nothing = lambda c: F.lit(None).cast(parsed.schema[c].dataType).alias(c)
    two = F.array(F.struct(nothing("document"), *fields), F.struct("document", *map(nothing, fields)))
    every = parsed.select("page_id", F.explode(two).alias("x")).select("page_id", "x.*").where("document is not null or pos is not null")
    full = _once(every).groupBy("page_id").agg(F.first("document", ignorenulls=True).alias("d"), F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), line))).alias("lines"))
    full = full.select("page_id", "d.*", "lines")
    score = recipe.confidence([F.col(f"{p}_source") for p in ("name", "image", "ingredients", "instructions")] + [F.coalesce("prepTime_source", "cookTime_source", "totalTime_source"), F.col("recipeYield_source")])
    full = full.withColumn("confidence", score).withColumn("iso", F.transform(F.array("prepTime", "cookTime", "totalTime"), duration.parse_duration))
    full = full.withColumns({c: F.get("iso", F.lit(i)) for i, c in enumerate(("prepTime", "cookTime", "totalTime"))})
    flags = recipe.flags(F.size("lines"), F.size("instructions"), F.col("confidence"))
    return full.select(
        "page_id", "url", "canonical", "name", "alternateName", "description", recipe.images(F.col("image"), F.coalesce("og_image", F.lit("")), F.col("url")).alias("image"), recipe.authors(F.coalesce("author", F.array().cast("array<string>"))).alias("author"),
        "prepTime", "cookTime", duration.total_time(F.col("totalTime"), F.col("prepTime"), F.col("cookTime")).alias("totalTime"),
        F.struct(F.col("recipeYield").alias("raw"), quantity.yield_count(F.col("recipeYield")).alias("count"), quantity.yield_unit(F.col("recipeYield")).alias("unit")).alias("yield"),
        F.col("lines").alias("recipeIngredient"), F.coalesce("instructions", F.array().cast("array<string>")).alias("recipeInstructions"), "sectionSteps", "ingredientGroups", "nutrition", "nutritionSources", "aggregateRating",
        recipe.provenance((*SCALARS, "alternateName", *LISTS, "author")).alias("sources"), "confidence", flags.alias("flags"), recipe.warnings(F.col("confidence"), flags["isPartial"]).alias("warnings"),
    )
