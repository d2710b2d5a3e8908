"""The registered queries of the reference operators, and DuckDB SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.functions import casing, display, duration, notes, quantity, text, tokens, units
from larder.operators import evaluate, grouping, posts, publish, recipe, store, stored
from larder.operators.lines import ambiguous, free_text_half, normalized, parse_auto, parse_lines, parse_modular, parse_simple
from larder.plans import inputs as I
from larder.plans.assemble import assemble
from larder.plans.inputs import derived
from larder.sources import encodings
from larder.sources import pages as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_FRACTIONS = "raw"
for _glyph, _plain in text.FRACTIONS.items():
    _FRACTIONS = f"replace({_FRACTIONS}, '{_glyph}', '{_plain}')"
_UNITS = "|".join(u.replace(".", "\\.") for u in units.ACTIVE_UNITS)

#: The simple parse in another dialect: no look-around, capture groups and repeated passes instead.
_PARSED = rf"""
lines AS ({I.LINES}),
n1 AS (SELECT *, CASE WHEN raw LIKE '%, optional' THEN regexp_replace(raw, '^(.*), ([^,]*)$', '\1 (\2)') ELSE raw END AS r FROM lines),
n2 AS (SELECT * EXCLUDE (r), regexp_replace({_FRACTIONS.replace("raw", "r")}, '\s*[-–—]\s*', ' - ', 'g') AS r FROM n1),
n3 AS (SELECT * EXCLUDE (r), regexp_replace(regexp_replace(r, '(\d),(\d)', '\1.\2', 'g'), '(\d)([A-Za-zÄÖÜäöüµ%])', '\1 \2', 'g') AS r FROM n2),
n4 AS (SELECT * EXCLUDE (r), regexp_replace(regexp_replace(r, '(\d)(\d/\d)', '\1 \2', 'g'), '(\d)\s*[xX]\s*(\d)', '\1 x \2', 'g') AS r FROM n3),
norm AS (SELECT * EXCLUDE (r), trim(regexp_replace(regexp_replace(r, '(^|\s)(?i:ca|circa|etwa|approx|~)\.?(\s)', '\1\2', 'g'), '\s+', ' ', 'g')) AS line FROM n4),
cut AS (SELECT *, regexp_extract(line, '^(?i:ein(?:e|er|em|en)?\s+)?(?i:halb(?:e|en|er|es|em)?)\s+(.*)$', 1) AS half,
  regexp_extract(line, '^((?:\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?)) - ((?:\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?))(?:\s(.*))?$', ['lo', 'hi', 'rest']) AS rng,
  regexp_extract(line, '^((?:\d+\s+\d+/\d+|\d+/\d+|\d+(?:\.\d+)?))(?:\s(.*))?$', ['lo', 'rest']) AS one FROM norm),
num AS (SELECT *, CASE WHEN half <> '' THEN '' WHEN rng.lo <> '' THEN rng.lo ELSE one.lo END AS lo, CASE WHEN half <> '' THEN '' ELSE rng.hi END AS hi,
  CASE WHEN half <> '' THEN half WHEN rng.lo <> '' THEN rng.rest WHEN one.lo <> '' THEN one.rest END AS rest FROM cut),
val AS (SELECT *, CASE WHEN half <> '' THEN 0.5 WHEN lo LIKE '% %/%' THEN split_part(lo, ' ', 1)::DOUBLE + split_part(split_part(lo, ' ', 2), '/', 1)::DOUBLE / split_part(lo, '/', 2)::DOUBLE
  WHEN lo LIKE '%/%' THEN split_part(lo, '/', 1)::DOUBLE / split_part(lo, '/', 2)::DOUBLE WHEN lo <> '' THEN lo::DOUBLE END AS qty_low, CASE WHEN hi <> '' THEN hi::DOUBLE END AS qty_high FROM num),
unt AS (SELECT *, CASE WHEN rest IS NOT NULL THEN nullif(regexp_extract(rest, '^((?i:{_UNITS}))\b\s*(.*)$', 1), '') END AS unit FROM val),
itm AS (SELECT *, CASE WHEN unit IS NOT NULL THEN regexp_extract(rest, '^((?i:{_UNITS}))\b\s*(.*)$', 2) ELSE coalesce(rest, line) END AS body FROM unt),
parsed AS (SELECT line_id, recipe_id, pos, raw, qty_low, qty_high, qty_high IS NOT NULL AS is_range, unit, CASE WHEN body LIKE '%)' THEN trim(regexp_extract(body, '^(.*?)\s*\(([^()]+)\)$', 1)) ELSE body END AS item,
  CASE WHEN body LIKE '%)' THEN regexp_extract(body, '^(.*?)\s*\(([^()]+)\)$', 2) END AS note FROM itm)
"""


def _mapped(table: dict[str, str], column: str, otherwise: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE lower(trim({column})) {whens} ELSE {otherwise} END"


_SHOW = "replace(CASE WHEN printf('%.2f', {v}) LIKE '%.00' THEN left(printf('%.2f', {v}), length(printf('%.2f', {v})) - 3) ELSE rtrim(printf('%.2f', {v}), '0') END, '.', ',')"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_simple(derived(spark, sf_dir, I.LINES))


@query(f"WITH {_PARSED} SELECT coalesce(unit, '-') AS unit, count(*) AS n_lines, sum(qty_low) AS sum_low, count(*) FILTER (WHERE is_range) AS n_ranges FROM parsed GROUP BY 1")
def line_parse_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy(F.coalesce("unit", F.lit("-")).alias("unit")).agg(F.count("*").alias("n_lines"), F.sum("qty_low").alias("sum_low"), F.count_if("is_range").alias("n_ranges"))


@query(f"WITH {_PARSED} SELECT * FROM parsed")
def line_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


@query(f"WITH {_PARSED} SELECT line_id, line FROM norm")
def qty_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, I.LINES).select("line_id", normalized(F.col("raw")).alias("line"))


#: Of the adjectives, those that the names of parts begin with.
_ADJECTIVES = r"'^((?:(?:fresh|small|medium|large|green|red|yellow)\s+)+)\S'"


@query(rf"""WITH {_PARSED}, a AS (SELECT *, trim(regexp_extract(item, {_ADJECTIVES}, 1)) AS lead FROM parsed)
SELECT * EXCLUDE (lead) REPLACE (coalesce({_mapped(units.CANONICAL, 'unit', 'unit')}, unit, CASE WHEN qty_low IS NOT NULL AND item NOT LIKE 'x %' THEN 'piece' END) AS unit,
  replace(trim(substr(item, length(lead) + 1)), 'Cajun - ', 'Cajun-') AS item, nullif(concat_ws(', ', nullif(lead, ''), note), '') AS note) FROM a""")
def line_parse_modular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_modular(derived(spark, sf_dir, I.LINES))


_AUTO = f"""SELECT id, CASE WHEN k = 6 THEN p_size::DOUBLE END AS qty_low, CASE k WHEN 1 THEN 'pinch' WHEN 6 THEN 'g' END AS unit, CASE k WHEN 4 THEN raw WHEN 5 THEN '' WHEN 8 THEN NULL ELSE p_name END AS item,
  CASE k WHEN 0 THEN p_type WHEN 2 THEN concat('TK; ', p_brand) WHEN 7 THEN p_type END AS note, CASE WHEN k IN (6, 7, 8) THEN 'first' ELSE 'legacy' END AS engine, CASE WHEN k = 4 THEN 'zero_denominator' WHEN k < 6 THEN 'nothing_found' END AS diagnosis
FROM (SELECT *, id % 9 AS k FROM ({I.POOR_LINES}))"""


@query(_AUTO)
def line_parse_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the first engine fails on are parsed by the second, with what was wrong."""
    return parse_auto(derived(spark, sf_dir, I.POOR_LINES).select("id", "raw")).select("id", "qty_low", "unit", "item", "note", "engine", "diagnosis")


@query(f"SELECT coalesce(diagnosis, 'none') AS diagnosis, engine, count(*) AS n, count(*) FILTER (WHERE unit IS NOT NULL) AS with_unit, count(*) FILTER (WHERE note IS NOT NULL) AS with_note FROM ({_AUTO}) GROUP BY ALL")
def fallback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_auto(derived(spark, sf_dir, I.POOR_LINES).select("id", "raw"))
    return parsed.groupBy(F.coalesce("diagnosis", F.lit("none")).alias("diagnosis"), "engine").agg(F.count("*").alias("n"), F.count("unit").alias("with_unit"), F.count("note").alias("with_note"))


_TOKEN_LINES = "SELECT p_partkey AS id, concat(p_size, '-', p_size + 1, ' EL ', p_name, '-Mix, ', p_size, '½ (x)') AS raw FROM part"


@query("SELECT p_partkey AS id, concat('number:', p_size, ' dash:- number:', p_size + 1, ' word:EL ', CASE WHEN p_name LIKE '% %' THEN concat('word:', split_part(p_name, ' ', 1), ' word:', split_part(p_name, ' ', 2)) ELSE concat('word:', p_name) END, '-Mix mark:, number:', p_size, '½ mark:( word:x mark:)') AS tokens, (2 * length(CAST(p_size AS VARCHAR)) + length(CAST(p_size + 1 AS VARCHAR)) + length(p_name) + 16)::BIGINT AS n_chars FROM part")
def line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of lines by kind, and where the last one ends."""
    rows = derived(spark, sf_dir, _TOKEN_LINES).select("id", tokens.tokens(F.col("raw")).alias("t"))
    return rows.select("id", F.array_join(F.transform("t", lambda t: F.concat(t["kind"], F.lit(":"), t["text"])), " ").alias("tokens"), F.element_at("t", -1)["end"].cast("long").alias("n_chars"))


_SPLIT = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat(p_size, '-', p_size + 2, ' Stück ', p_name) WHEN 1 THEN concat(p_size, ',5 kg ', p_name, ' (', p_type, ')') WHEN 2 THEN p_name ELSE concat('½ ', p_name) END AS raw FROM part"


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size + 0.5::DOUBLE WHEN 3 THEN 0.5::DOUBLE END AS qty, CASE p_partkey % 4 WHEN 0 THEN 'Stück' WHEN 1 THEN 'kg' END AS unit, CASE WHEN p_partkey % 4 = 1 THEN concat(p_name, ' (', p_type, ')') ELSE p_name END AS item FROM part")
def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest split: a range keeps its lower end, and the name its notes."""
    return parse_lines(derived(spark, sf_dir, _SPLIT), "raw", "split").select("id", F.col("qty_low").alias("qty"), "unit", "item")


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'piece' WHEN 1 THEN 'kg' END AS unit, CASE WHEN p_partkey % 4 = 0 THEN (p_size + 2)::DOUBLE END AS high, p_name AS item, CASE WHEN p_partkey % 4 = 1 THEN p_type END AS note, p_partkey % 4 = 2 AS ambiguous FROM part")
def line_parse_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second engine, and whether a line tells no quantity at all."""
    rows = parse_lines(derived(spark, sf_dir, _SPLIT), "raw", "legacy")
    return rows.select("id", "unit", F.col("qty_high").alias("high"), "item", "note", ambiguous(F.col("raw")).alias("ambiguous"))


@query(f"WITH {_PARSED} SELECT line_id, unit, {_mapped(units.CANONICAL, 'unit', 'NULL')} AS canonical FROM parsed WHERE unit IS NOT NULL")
def unit_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.having(_lines(spark, sf_dir), lambda r: r["unit"].isNotNull(), "line_id", "unit").select("*", units.canonical_unit(F.col("unit")).alias("canonical"))


@query(f"WITH {_PARSED} SELECT line_id, {_mapped(units.GERMAN, 'unit', 'coalesce(unit, ' + chr(39) * 2 + ')')} AS label FROM parsed")
def unit_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("line_id", units.german_unit(F.col("unit")).alias("label"))


@query(f"WITH {_PARSED} SELECT line_id, CASE WHEN qty_low IS NULL THEN '' WHEN qty_high IS NULL THEN {_SHOW.format(v='qty_low')} ELSE concat({_SHOW.format(v='qty_low')}, '–', {_SHOW.format(v='qty_high')}) END AS shown FROM parsed")
def qty_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("line_id", display.quantity_display(F.col("qty_low"), F.col("qty_high")).alias("shown"))


@query(f"WITH {_PARSED}, s AS (SELECT line_id, round(qty_low * 6 / 4, 6) AS low, round(qty_high * 6 / 4, 6) AS high FROM parsed WHERE qty_low IS NOT NULL) SELECT line_id, low, high FROM s")
def scale_servings(spark: SparkSession, sf_dir: str) -> DataFrame:
    six, four = F.lit(6.0), F.lit(4.0)
    df = text.having(_lines(spark, sf_dir), lambda r: r["qty_low"].isNotNull(), "line_id", "qty_low", "qty_high")
    return df.select("line_id", F.round(display.scaled(F.col("qty_low"), six, four), 6).alias("low"), F.round(display.scaled(F.col("qty_high"), six, four), 6).alias("high"))


@query(f"WITH {_PARSED} SELECT line_id, CASE WHEN item = lower(item) THEN concat(upper(left(item, 1)), substr(item, 2)) ELSE item END AS label, CASE WHEN note IS NULL THEN item ELSE concat(item, ' (', note, ')') END AS stored FROM parsed")
def stored_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("line_id", display.capitalised(F.col("item")).alias("label"), display.stored_name(F.col("item"), F.col("note")).alias("stored"))


_KEY = "concat_ws('|', CASE WHEN qty_low IS NULL THEN '' WHEN qty_high IS NULL THEN printf('%.3f', qty_low) ELSE printf('%.3f-%.3f', qty_low, qty_high) END, lower(coalesce(unit, '')), strip_accents(lower(item)))"


@query(f"WITH {_PARSED}, k AS (SELECT recipe_id, pos, {_KEY} AS key FROM parsed), twice AS (SELECT * FROM k UNION ALL SELECT recipe_id, pos + 10000000, key FROM k) SELECT recipe_id, pos, key FROM twice QUALIFY row_number() OVER (PARTITION BY recipe_id, key ORDER BY pos) = 1")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines, each of which a recipe repeats at its end."""
    df = _lines(spark, sf_dir).withColumn("key", recipe.line_key(F.col("qty_low"), F.col("qty_high"), F.col("unit"), F.col("item"))).select("recipe_id", "pos", "key")
    return recipe.first_wins(df.union(df.withColumn("pos", F.col("pos") + 10_000_000)), ["recipe_id"], "pos", F.col("key")).select("recipe_id", "pos", "key")


@query("SELECT doc_id, strip_accents(trim(regexp_replace(lower(regexp_replace(text, '<[^>]*>', '', 'g')), '\\s+', ' ', 'g'))) AS key FROM documents")
def canon_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text.canon_key(F.col("text")).alias("key"))


_ISO = "concat('PT', CASE WHEN h > 0 THEN concat(h, 'H') ELSE '' END, CASE WHEN m > 0 THEN concat(m, 'M') ELSE '' END, CASE WHEN s > 0 THEN concat(s, 'S') ELSE '' END)"


@query(rf"""WITH d AS ({I.DURATIONS}), v AS (SELECT id, txt, lower(txt) AS t FROM d), x AS (SELECT id, txt,
  CASE WHEN t LIKE '%:%' THEN split_part(t, ':', 1)::BIGINT ELSE coalesce(nullif(regexp_extract(t, '(\d+) *(?:h|st)', 1), '')::BIGINT, 0) END AS h,
  CASE WHEN t LIKE '%:%' THEN split_part(t, ':', 2)::BIGINT WHEN regexp_full_match(t, '\d+') THEN t::BIGINT ELSE coalesce(nullif(regexp_extract(t, '(\d+) *m', 1), '')::BIGINT, 0) END AS m,
  coalesce(nullif(regexp_extract(t, '(\d+) *se', 1), '')::BIGINT, 0) AS s FROM v)
SELECT id, CASE WHEN txt LIKE 'PT%' THEN txt WHEN h + m + s = 0 THEN NULL ELSE {_ISO} END AS iso FROM x""")
def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, I.DURATIONS).select("id", duration.parse_duration(F.col("txt")).alias("iso"))


def _seconds(c: str) -> str:
    part = lambda mark: f"coalesce(nullif(regexp_extract({c}, '(\\d+){mark}', 1), '')::BIGINT, 0)"
    return f"({part('H')} * 3600 + {part('M')} * 60 + {part('S')})"


_SUM = f"SELECT id, total, prep, cook, t // 3600 AS h, t % 3600 // 60 AS m, t % 60 AS s FROM (SELECT *, {_seconds('prep')} + {_seconds('cook')} AS t FROM ({I.DURATIONS}))"


@query(f"SELECT id, CASE WHEN prep IS NULL AND cook IS NULL THEN NULL ELSE {_ISO} END AS iso FROM ({_SUM})")
def duration_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, I.DURATIONS).select("id", duration.sum_durations(F.col("prep"), F.col("cook")).alias("iso"))


@query(f"SELECT id, coalesce(total, CASE WHEN prep IS NULL AND cook IS NULL THEN NULL ELSE {_ISO} END) AS iso FROM ({_SUM})")
def total_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, I.DURATIONS).select("id", duration.total_time(F.col("total"), F.col("prep"), F.col("cook")).alias("iso"))


_YIELD = r"replace(nullif(regexp_extract(txt, '(\d+(?:[.,]\d+)?)', 1), ''), ',', '.')::DOUBLE AS count, CASE WHEN lower(txt) LIKE '%portionen%' THEN 'portionen' WHEN lower(txt) LIKE '%portion%' THEN 'portion' WHEN lower(txt) LIKE '%servings%' THEN 'servings' WHEN lower(txt) LIKE '%serves%' THEN 'serves' WHEN lower(txt) LIKE '%person%' THEN 'person' END AS unit"


@query(f"SELECT id, {_YIELD} FROM ({I.YIELDS})")
def yield_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, I.YIELDS).select("id", quantity.yield_count(F.col("txt")).alias("count"), quantity.yield_unit(F.col("txt")).alias("unit"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")


_UNESCAPE = "replace(replace(replace(replace({t}, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
_NO_SCRIPT = "regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g')"


@query(f"SELECT page_id, nullif(trim(regexp_replace({_UNESCAPE.format(t='regexp_extract(' + _NO_SCRIPT + chr(44) + chr(39) + '(?is)<h1[^>]*>(.*?)</h1>' + chr(39) + ', 1)')}, '\\s+', ' ', 'g')), '') AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", P.markup(F.col("html"), "title").getField("title").alias("title"))


@query(rf"""WITH b AS (SELECT page_id, unnest(string_split({_NO_SCRIPT}, '<p>')[2:]) AS t FROM pages),
c AS (SELECT page_id, trim(regexp_replace({_UNESCAPE.format(t="regexp_replace(regexp_extract(t, '(?is)^(.*?)(?:</p>|</article>|$)', 1), '<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g')) AS t FROM b)
SELECT page_id, count(*) AS n_paragraphs, sum(length(t))::BIGINT AS n_chars FROM c WHERE t <> '' GROUP BY 1""")
def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _pages(spark, sf_dir).select("page_id", F.explode(P.markup(F.col("html"), "paragraphs").getField("paragraphs")).alias("t"))
    return each.groupBy("page_id").agg(F.count("*").alias("n_paragraphs"), F.sum(F.char_length("t")).alias("n_chars"))


@query(f"SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace({_NO_SCRIPT}, '(?is)<(nav|aside|form|footer)[^>]*>.*?</(nav|aside|form|footer)>', '', 'g'), '(?is)<(ul|ol) class=\"(share|sidebar|comments|newsletter)[^>]*>.*?</(ul|ol)>', '', 'g'), '(?is)<li[^>]*>(.*?)</li>', 1).len()::BIGINT AS n_items FROM pages")
def page_list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items of a page's scope, without those of furniture."""
    return _pages(spark, sf_dir).select("page_id", F.size(P.markup(F.col("html"), "list_items").getField("list_items")).cast("long").alias("n_items"))


@query(f"SELECT page_id, n::BIGINT AS n_items FROM ({I.NOISE_PAGES})")
def page_noise_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items that are left when furniture of every kind is removed: as many as the page's own list was made with."""
    return derived(spark, sf_dir, I.NOISE_PAGES).select("page_id", F.size(P.markup(F.col("html"), "list_items").getField("list_items")).cast("long").alias("n_items"))


@query("""SELECT page_id, concat(name, ' & Körner') AS name, brand AS alternate, concat('https://www.example.com/a.jpg|https://cdn.example.com/', page_id, '.png|https://www.example.com/og.jpg') AS images, 1::BIGINT AS n_lines, concat('Mix|Bake|Serve ', kind) AS steps, brand AS section,
  concat(brand, '|Z. ', kind) AS authors, concat('calories=', size, ' kcal|fatContent=', size, '|proteinContent=', size % 9, ' g') AS nutrition, 'jsonld|jsonld|microdata' AS nutrition_sources, 4.5::DOUBLE AS rating, size::BIGINT AS reviews
FROM (SELECT p_partkey AS page_id, p_name AS name, p_type AS kind, p_brand AS brand, p_size AS size FROM part)""")
def assembled_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes of pages that nest them in other nodes, with image lists, repeated ingredients, sections of steps, authors, a rating, and nutrition from two sources."""
    whole = assemble(derived(spark, sf_dir, I.NESTED_PAGES))
    joined = lambda c: F.array_join(c, "|")
    facts = F.array_sort(F.map_entries("nutrition"))
    return whole.select(
        "page_id", "name", F.col("alternateName").alias("alternate"), joined("image").alias("images"), F.size("recipeIngredient").cast("long").alias("n_lines"), joined("recipeInstructions").alias("steps"), joined(F.array_distinct(F.transform("sectionSteps", lambda s: s["section"]))).alias("section"),
        joined(F.transform("author", lambda a: a["name"])).alias("authors"), joined(F.transform(facts, lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("nutrition"), joined(F.transform(facts, lambda e: F.try_element_at("nutritionSources", e["key"]))).alias("nutrition_sources"),
        F.col("aggregateRating.value").alias("rating"), F.col("aggregateRating.count").alias("reviews"),
    )


@query("""SELECT p_partkey AS page_id, concat(CASE WHEN p_partkey % 3 = 1 THEN 'MARINADE' ELSE 'Teig' END, ':', p_size, ' g ', p_type, ',1 EL ', p_brand, '|Guss:2 ml ', p_name) AS groups, CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 3 END::BIGINT AS n_ingredients,
  concat(CASE WHEN p_partkey % 2 = 0 THEN concat(p_name, '|') ELSE '' END, p_type, '|', p_brand, '|', p_name) AS items FROM part""")
def ingredient_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of ingredients under headings, kept in the assembled document beside the parsed lines of all of them."""
    whole = assemble(derived(spark, sf_dir, I.GROUP_PAGES))
    groups = F.transform("ingredientGroups", lambda g: F.concat_ws(":", g["name"], F.array_join(g["items"], ",")))
    return whole.select("page_id", F.array_join(groups, "|").alias("groups"), F.size("recipeIngredient").cast("long").alias("n_ingredients"), F.array_join(F.transform("recipeIngredient", lambda x: x["item"]), "|").alias("items"))


_SPOILT = "SELECT p_partkey AS id, concat('Käse – „', p_name, '“ für ', p_size, ' €, naïve Größe ½') AS txt FROM part"


@query(_SPOILT)
def text_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were decoded wrongly up to three times, with entities and tags, put right."""
    wrong = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    as_western = F.translate(wrong(F.col("txt")), "\x80\x82\x93\x96\x9c\x9e\x9f", "€‚“–œžŸ")
    spoilt = F.when(F.col("id") % 4 == 0, as_western).when(F.col("id") % 4 == 1, wrong(wrong(F.col("txt")))).when(F.col("id") % 4 == 2, wrong(wrong(wrong(F.col("txt"))))).otherwise(F.concat(F.lit("<p> "), F.replace(F.col("txt"), F.lit("€"), F.lit("&euro;")), F.lit("</p>")))
    return derived(spark, sf_dir, _SPOILT).select("id", encodings.sanitized(spoilt).alias("txt"))


_CHARSETS = "SELECT p_partkey AS id, concat('<html><head>', CASE p_partkey % 5 WHEN 3 THEN '<meta charset=\"iso-8859-15\">' ELSE '' END, '</head>Öl à la ', p_name, ' 3 €</html>') AS txt FROM part"


@query(_CHARSETS)
def charset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes of five character sets, told by mark, validity, name or their zeros."""
    western = lambda euro: F.encode(F.translate("txt", "€", euro), "ISO-8859-1")
    kinds = (F.encode("txt", "UTF-8"), F.encode("txt", "UTF-16"), western("\x80"), western("¤"), F.encode("txt", "UTF-16LE"))
    content = F.get(F.array(*kinds), F.col("id") % 5)
    return derived(spark, sf_dir, _CHARSETS).select("id", encodings.decode(content).alias("txt"))


_FILES = "SELECT p_partkey AS id, p_partkey % 50 AS folder, concat(CASE WHEN p_partkey % 2 = 0 THEN 'Page ' ELSE 'page ' END, p_size, '-', p_partkey % 1000, '.html') AS name, p_size, p_partkey % 1000 AS rest FROM part"


@query(f"SELECT id, row_number() OVER (PARTITION BY folder ORDER BY p_size, rest, name, id)::INT AS place FROM ({_FILES})")
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder in the order in which people count."""
    place = F.row_number().over(Window.partitionBy("folder").orderBy(encodings.natural_key(F.col("name")), "id"))
    return derived(spark, sf_dir, _FILES).select("id", place.alias("place"))


_NODE = "SELECT page_id, url, html, json_extract(regexp_replace(regexp_extract(html, '(?is)<script type=\"application/ld\\+json\">(.*?)</script>', 1), '(?s)/\\*.*?\\*/', ''), '$.\"@graph\"[1]') AS node FROM (" + I.LD_PAGES + ")"


@query(f"SELECT page_id, node->>'$.name' AS name, node->>'$.recipeYield' AS recipe_yield, node->>'$.prepTime' AS prep_time FROM ({_NODE})")
def jsonld_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    get = lambda k: F.try_variant_get("node", f"$.{k}", "string")
    return P.json_ld_recipes(derived(spark, sf_dir, I.LD_PAGES)).select("page_id", get("name").alias("name"), get("recipeYield").alias("recipe_yield"), get("prepTime").alias("prep_time"))


@query(f"SELECT bucket, page_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, page_id)::INT AS rank FROM (SELECT page_id % 20 AS bucket, page_id, ((node->>'$.name') IS NOT NULL)::INT + ((node->>'$.recipeYield') IS NOT NULL)::INT + ((node->>'$.prepTime') IS NOT NULL)::INT + ((node->>'$.image') IS NOT NULL)::INT AS score FROM ({_NODE}))) WHERE rank <= 3")
def field_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("name", "recipeYield", "prepTime", "image")
    nodes = P.json_ld_recipes(derived(spark, sf_dir, I.LD_PAGES)).select((F.col("page_id") % 20).alias("bucket"), "page_id", *[F.try_variant_get("node", f"$.{f}", "string").alias(f) for f in fields])
    return recipe.rank_candidates(nodes, "bucket", "page_id", fields).where("rank <= 3").select("bucket", "page_id", "score", "rank")


_SOURCES = """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS jsonld_name, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS microdata_name, p_type AS dom_name,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE NULL END AS jsonld_image, CASE WHEN p_partkey % 7 = 0 THEN p_brand END AS microdata_image, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS dom_image,
  CASE WHEN p_partkey % 11 = 0 THEN p_name END AS jsonld_yield, CAST(NULL AS VARCHAR(5)) AS microdata_yield, CASE WHEN p_partkey % 3 = 1 THEN p_type END AS dom_yield FROM part"""
_FIELDS = ("name", "image", "yield")
_MERGED = "SELECT id, " + ", ".join(f"coalesce(nullif(jsonld_{f}, ''), nullif(microdata_{f}, ''), nullif(dom_{f}, '')) AS {f}, CASE WHEN jsonld_{f} <> '' THEN 'jsonld' WHEN microdata_{f} <> '' THEN 'microdata' WHEN dom_{f} <> '' THEN 'dom' END AS {f}_source" for f in _FIELDS) + f" FROM ({_SOURCES})"


@query(_MERGED)
def priority_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipe.merge_sources(derived(spark, sf_dir, _SOURCES), _FIELDS)


_W = [f"CASE {f}_source WHEN 'jsonld' THEN 0.95::DOUBLE WHEN 'microdata' THEN 0.85::DOUBLE WHEN 'dom' THEN 0.7::DOUBLE END" for f in _FIELDS]


@query(f"SELECT id, confidence, confidence < 0.7::DOUBLE AS low_confidence, is_partial FROM (SELECT id, coalesce(({' + '.join(f'coalesce({w}, 0::DOUBLE)' for w in _W)}) / nullif({' + '.join(f'({f}_source IS NOT NULL)::INT' for f in _FIELDS)}, 0), 0::DOUBLE) AS confidence, image IS NULL OR yield IS NULL AS is_partial FROM ({_MERGED}))")
def confidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = priority_merge(spark, sf_dir).withColumn("confidence", recipe.confidence([F.col(f"{f}_source") for f in _FIELDS]))
    n = lambda c: F.col(c).isNotNull().cast("int")
    return merged.withColumn("f", recipe.flags(n("image"), n("yield"), F.col("confidence"))).select("id", "confidence", F.col("f.lowConfidence").alias("low_confidence"), F.col("f.isPartial").alias("is_partial"))


_URLS = "SELECT page_id, url AS base, CASE page_id % 4 WHEN 0 THEN '/img/a.jpg' WHEN 1 THEN 'b.png' WHEN 2 THEN 'https://cdn.example.com/c.gif' ELSE '' END AS link FROM pages"


@query(rf"SELECT page_id, CASE WHEN link = '' OR link LIKE 'http%' THEN link WHEN link LIKE '/%' THEN concat(regexp_extract(base, '^(https?://[^/]+)', 1), link) ELSE concat(regexp_extract(base, '^(https?://[^/]+)', 1), regexp_replace(regexp_replace(base, '^https?://[^/]+', ''), '[^/]*$', ''), link) END AS absolute FROM ({_URLS})")
def absolute_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _URLS).select("page_id", text.absolute_url(F.col("link"), F.col("base")).alias("absolute"))


@query(f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN concat('https://www.example.com/r/', page_id) WHEN 1 THEN concat('https://example.org/p/', page_id) ELSE url END AS canonical FROM ({I.LD_PAGES})")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, I.LD_PAGES).select("page_id", P.canonical_url(F.col("html"), F.col("url")).alias("canonical"))


_CAPITAL = "[A-ZÄÖÜ]"


@query(rf"""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\.\s+({_CAPITAL})', chr(1) || '\1', 'g'), '\r?\n', chr(1), 'g') AS t FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS steps FROM d)
SELECT doc_id, len(steps)::BIGINT AS n_steps, steps[1] AS first_step, steps[-1] AS last_step FROM s WHERE len(steps) > 0""")
def instruction_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", recipe.instruction_steps(F.col("text")).alias("steps"))
    return docs.where(F.size("steps") > 0).select("doc_id", F.size("steps").cast("long").alias("n_steps"), F.element_at("steps", 1).alias("first_step"), F.element_at("steps", -1).alias("last_step"))


_DIFF_FIELDS = ("title", "note", "yield")
_DIFF = " UNION ALL ".join(f"SELECT coalesce(o.post_id, n.post_id) AS post_id, '{f}' AS field, o.{f} AS old, n.{f} AS new, {'coalesce(o.title_locked, false)' if f == 'title' else 'false'} AS locked FROM o FULL JOIN n ON o.post_id = n.post_id WHERE o.{f} IS DISTINCT FROM n.{f}" for f in _DIFF_FIELDS)


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = derived(spark, sf_dir, I.VERSIONS).withColumn("locks", F.when(F.col("title_locked"), F.array(F.lit("title"))).otherwise(F.array().cast("array<string>")))
    return old, derived(spark, sf_dir, I.NEW_VERSIONS)


@query(f"WITH o AS ({I.VERSIONS}), n AS ({I.NEW_VERSIONS}) {_DIFF}")
def refresh_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.changes(*_versions(spark, sf_dir), "post_id", list(_DIFF_FIELDS), "locks")


@query(f"WITH o AS ({I.VERSIONS}), n AS ({I.NEW_VERSIONS}) SELECT coalesce(o.post_id, n.post_id) AS post_id, CASE WHEN n.post_id IS NULL OR coalesce(o.title_locked, false) THEN o.title ELSE n.title END AS title, CASE WHEN n.post_id IS NULL THEN o.note ELSE n.note END AS note, CASE WHEN n.post_id IS NULL THEN o.yield ELSE n.yield END AS yield FROM o FULL JOIN n ON o.post_id = n.post_id")
def selective_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(*_versions(spark, sf_dir), "post_id", list(_DIFF_FIELDS), "locks")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 10")
def capped_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "ts")
    return store.capped_history(log, "user_id", [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query(f"""WITH p AS ({I.POSTS}), r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5(post_id::VARCHAR), post_id) AS k FROM p)
SELECT a.post_id, b.post_id AS related_id, row_number() OVER (PARTITION BY a.post_id ORDER BY b.k)::INT AS place FROM p a JOIN r b ON a.category = b.category AND a.post_id <> b.post_id AND b.k <= 7 QUALIFY place <= 6""")
def related_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts.related(derived(spark, sf_dir, I.POSTS))


@query(f"SELECT post_id, category FROM ({I.POSTS}) ORDER BY date DESC, post_id DESC LIMIT 6 OFFSET 12")
def post_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts.page(derived(spark, sf_dir, I.POSTS), offset=12).select("post_id", "category")


@query(rf"""WITH l AS ({I.GROUP_LINES}), h AS (SELECT *, NOT regexp_matches(raw, '^\s*\d') AND NOT regexp_matches(raw, '(?i)\b(g|kg|ml|l|tl|el|tsp|tbsp|cup|prise|pinch|dose|bund|oz|lb|can|bunch)\b') AND (raw LIKE '%:' OR raw = 'MARINADE' OR upper(raw) LIKE '%SAUCE%') AS is_header FROM l)
SELECT recipe_id, pos, is_header, (count(*) FILTER (WHERE is_header) OVER w)::BIGINT AS group_no, last_value(CASE WHEN is_header THEN rtrim(raw, ': ') END IGNORE NULLS) OVER w AS group_name FROM h WINDOW w AS (PARTITION BY recipe_id ORDER BY pos)""")
def group_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping.grouped(derived(spark, sf_dir, I.GROUP_LINES), "recipe_id", "pos").select("recipe_id", "pos", "is_header", "group_no", "group_name")


@query(rf"""WITH {_PARSED}, e AS (SELECT p.*, l.low, l.high, l.unit AS label, l.note AS label_note FROM parsed p JOIN ({I.LABELS}) l ON p.line_id = l.line_id)
SELECT 'all' AS file, 'qty_parse_rate' AS metric, count(*) FILTER (WHERE qty_low IS NOT NULL) AS ok, count(*) AS total FROM e WHERE low IS NOT NULL
UNION ALL SELECT 'all', 'range_detect_rate', count(*) FILTER (WHERE qty_low = low AND qty_high = high), count(*) FROM e WHERE high IS NOT NULL
UNION ALL SELECT 'all', 'decimal_comma_clean', count(*) FILTER (WHERE qty_low IS NOT DISTINCT FROM low AND qty_high IS NOT DISTINCT FROM high), count(*) FROM e WHERE regexp_matches(raw, '\d,\d')
UNION ALL SELECT 'all', 'unit_attach_clean', count(*) FILTER (WHERE unit IS NOT DISTINCT FROM label), count(*) FROM e WHERE label IS NOT NULL
UNION ALL SELECT 'all', 'note_separation_ok', count(*) FILTER (WHERE coalesce(note, '') = coalesce(label_note, '')), count(*) FROM e""")
def golden_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the derived lines against labels from the columns that the lines are made of, which no parser has seen."""
    actual = _lines(spark, sf_dir).select(F.lit("all").alias("file"), F.col("line_id").alias("idx"), "raw", "qty_low", "qty_high", "unit", "note")
    labels = derived(spark, sf_dir, I.LABELS).join(derived(spark, sf_dir, I.LINES).select("line_id", F.col("raw").alias("line")), "line_id")
    expected = labels.select(F.lit("all").alias("file"), F.col("line_id").alias("idx"), "line", "low", "high", "unit", "note")
    return evaluate.metrics(evaluate.judged(evaluate.aligned(expected, actual.drop("raw"))))


@query(f"WITH {_PARSED} SELECT status, count(*) AS n FROM (SELECT recipe_id, CASE WHEN count(*) FILTER (WHERE qty_low IS NOT NULL) = 0 THEN 'fail' WHEN count(*) FILTER (WHERE unit IS NULL) > 0 THEN 'warn' ELSE 'ok' END AS status FROM parsed GROUP BY 1) GROUP BY 1")
def fixture_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _lines(spark, sf_dir).groupBy("recipe_id").agg(F.count_if(F.col("qty_low").isNotNull()).alias("lines"), F.count_if(F.col("unit").isNull()).alias("warned"))
    return each.select(evaluate.fixture_status(F.lit(0), F.col("lines"), F.col("warned")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


_LABEL = _mapped(units.GERMAN, "unit", "coalesce(unit, '')")
_SHOWN = f"CASE WHEN qty_low IS NULL THEN '' WHEN qty_high IS NULL THEN {_SHOW.format(v='qty_low')} ELSE concat({_SHOW.format(v='qty_low')}, '–', {_SHOW.format(v='qty_high')}) END"


@query(f"WITH {_PARSED} SELECT line_id, concat_ws(' ', nullif({_SHOWN}, ''), nullif({_LABEL}, ''), nullif(CASE WHEN item = lower(item) THEN concat(upper(left(item, 1)), substr(item, 2)) ELSE item END, ''), CASE WHEN note <> '' THEN concat('(', note, ')') END) AS line FROM parsed")
def shopping_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("line_id", display.shopping_line(F.col("qty_low"), F.col("qty_high"), F.col("unit"), F.col("item"), F.col("note")).alias("line"))


_PLAIN = "regexp_replace(printf('%.3f', {v}), '\\.?0+$', '')"


@query(f"WITH {_PARSED} SELECT line_id, CASE WHEN qty_low IS NULL THEN '' WHEN qty_high IS NULL THEN {_PLAIN.format(v='qty_low')} ELSE concat({_PLAIN.format(v='qty_low')}, '-', {_PLAIN.format(v='qty_high')}) END AS qty FROM parsed")
def qty_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("line_id", quantity.qty_text(F.col("qty_low"), F.col("qty_high")).alias("qty"))


@query("SELECT post_id, name, value FROM (" + " UNION ALL ".join(f"SELECT post_id, '{f}_bak_20250101' AS name, {f} AS value FROM ({I.VERSIONS})" for f in _DIFF_FIELDS) + ") WHERE value IS NOT NULL")
def field_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.backup(derived(spark, sf_dir, I.VERSIONS), "post_id", list(_DIFF_FIELDS), "20250101")


_PARSED_BY = "SELECT o_orderkey AS post_id, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '2' ELSE '1' END AS parser FROM orders"


@query(f"SELECT post_id, parser FROM ({_PARSED_BY}) WHERE parser IS DISTINCT FROM '2'")
def stale_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that another version of the parser has written, or none."""
    return store.stale(derived(spark, sf_dir, _PARSED_BY), "parser", "2")


_CATEGORIES = "SELECT CASE WHEN p_partkey % 9 = 0 THEN ' ' WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS name FROM part"
_KNOWN = "SELECT DISTINCT p_brand AS name FROM part WHERE p_size < 3"


@query(f"SELECT name FROM ({_KNOWN}) UNION SELECT name FROM ({_CATEGORIES}) WHERE trim(name) <> ''")
def category_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.with_categories(derived(spark, sf_dir, _CATEGORIES), derived(spark, sf_dir, _KNOWN))


@query(f"SELECT id, coalesce(nullif(jsonld_image, ''), nullif(microdata_image, ''), '/default.jpg') AS image FROM ({_SOURCES})")
def lead_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _SOURCES).select("id", store.lead_image(F.col("jsonld_image"), F.col("microdata_image"), "/default.jpg").alias("image"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 200")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 200 lines of a log: the feature is the limit."""
    return store.log_tail(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type"), "event_id", 200)


@query(f"SELECT recipe_id, pos, raw FROM ({I.GROUP_LINES}) QUALIFY row_number() OVER (PARTITION BY recipe_id, split_part(raw, ' ', 1) ORDER BY pos) = 1")
def group_assigned_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line, here by its first word, in the group where it comes first."""
    return grouping.assigned_once(derived(spark, sf_dir, I.GROUP_LINES), "recipe_id", "pos", F.split_part("raw", F.lit(" "), F.lit(1)))


_META = "SELECT o_orderkey AS post_id, CASE o_orderkey % 3 WHEN 0 THEN 'ingredients_struct' WHEN 1 THEN 'schema_recipe_json' ELSE 'other' END AS key, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '[]' WHEN 2 THEN NULL WHEN 3 THEN '{}' ELSE o_orderpriority END AS value FROM orders"


@query(f"SELECT DISTINCT post_id FROM ({_META}) WHERE key <> 'other' AND value NOT IN ('', '[]', '{{}}')")
def recipe_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts.seeds(derived(spark, sf_dir, _META))


_SERVINGS = "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'viele' WHEN 1 THEN '-3' WHEN 2 THEN NULL WHEN 3 THEN concat(p_size, '.5') ELSE CAST(p_size AS VARCHAR(5)) END AS txt FROM part"


@query(f"SELECT id, coalesce(CASE WHEN try_cast(txt AS DOUBLE) > 0 THEN try_cast(txt AS DOUBLE) END, 2) AS servings FROM ({_SERVINGS})")
def servings_or_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _SERVINGS).select("id", display.positive_or(F.col("txt")).alias("servings"))


_ENTRIES = "SELECT p_partkey AS id, concat(p_name, ' ; ', p_size, CASE WHEN p_partkey % 2 = 0 THEN concat('-', p_size + 2) ELSE '' END, ' • ', p_type, '   ', p_brand) AS line FROM part"


@query("SELECT id, concat(p_name, '|', p_type, '|', p_brand) AS entries FROM (SELECT p_partkey AS id, p_name, p_type, p_brand FROM part)")
def line_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold several entries, without bare numbers and ranges."""
    return derived(spark, sf_dir, _ENTRIES).select("id", F.array_join(quantity.split_entries(F.col("line")), "|").alias("entries"))


_SCORES = "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS a, CASE WHEN p_partkey % 6 IN (0, 1) THEN p_name END AS b, p_size AS a_score, p_size % 7 + p_partkey % 40 AS b_score FROM part"


@query(f"SELECT id, CASE WHEN a IS NOT DISTINCT FROM b THEN 'identical' WHEN b_score > a_score THEN 'improved' ELSE 'different' END AS verdict FROM ({_SCORES})")
def engine_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _SCORES).select("id", evaluate.engine_difference(F.col("a"), F.col("b"), F.col("a_score"), F.col("b_score")).alias("verdict"))


_NAMES = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('https://example.com/author/', lower(split_part(p_name, ' ', 1)), '/') WHEN 1 THEN concat(' ', p_name, ' ') ELSE '' END AS name FROM part"


@query("SELECT id, CASE id % 3 WHEN 0 THEN lower(split_part(p_name, ' ', 1)) WHEN 1 THEN p_name ELSE '' END AS author FROM (SELECT p_partkey AS id, p_name FROM part)")
def recipe_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors by name; an address is named by its last part."""
    return derived(spark, sf_dir, _NAMES).select("id", F.array_join(F.transform(recipe.authors(F.array("name")), lambda a: a["name"]), "|").alias("author"))


@query("SELECT o_orderkey AS post_id, CASE WHEN o_orderkey = 7 THEN 'trash' ELSE o_orderstatus END AS status FROM orders")
def post_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One post goes to the trash where its token fits."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("post_id"), F.lit("t").alias("token"), F.col("o_orderstatus").alias("status"))
    return store.soft_delete(store.soft_delete(rows, 7, "t"), 8, "wrong").drop("token")


_HALVES = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat('Saft einer halben ', p_name) WHEN 1 THEN concat('Schale von einer halben ', p_name) ELSE p_name END AS line FROM part"


@query("SELECT id, CASE WHEN id % 3 < 2 THEN 0.5::DOUBLE END AS qty, CASE WHEN id % 3 < 2 THEN p_name END AS item, CASE id % 3 WHEN 0 THEN 'Saft' WHEN 1 THEN 'Schale' END AS note FROM (SELECT p_partkey AS id, p_name FROM part)")
def halves_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = free_text_half(F.col("line"))
    return derived(spark, sf_dir, _HALVES).select("id", found.alias("f")).select("id", "f.qty", "f.item", "f.note")


@query(f"SELECT id, CASE id % 4 WHEN 0 THEN 'g' WHEN 1 THEN 'tbsp' WHEN 2 THEN 'kg' END AS unit, CASE WHEN id % 4 = 2 THEN 'Ingwer' ELSE p_name END AS item, CASE id % 4 WHEN 0 THEN concat('TK; ', p_type) WHEN 1 THEN p_brand WHEN 2 THEN concat(p_type, '; Stück') END AS note FROM (SELECT p_partkey AS id, p_name, p_type, p_brand FROM part)")
def line_remainders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit, item and notes of what follows a quantity."""
    return derived(spark, sf_dir, I.REMAINDERS).select("id", notes.remainder(F.col("rest")).alias("r")).select("id", "r.unit", "r.item", "r.note")


_NUMBERS = "SELECT p_partkey AS id, concat('von ', p_size, '½ bis ', p_size + 2, ' oder ', p_size, ',5 – ', p_size + 1, ' und .25') AS line FROM part"


@query("SELECT p_partkey AS id, concat(p_size, ' 1/2-', p_size + 2, '|', p_size, '.5-', p_size + 1, '|0.25') AS tokens FROM part")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and ranges of a line, wherever they stand."""
    return derived(spark, sf_dir, _NUMBERS).select("id", F.array_join(notes.number_tokens(F.col("line")), "|").alias("tokens"))


_MEASURED = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat(p_size, ',5 EL ', p_name) WHEN 1 THEN concat(p_size, ' ', p_name) ELSE concat('EL ', p_name) END AS line FROM part"


@query("SELECT p_partkey AS id, p_name AS item FROM part")
def line_without_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _MEASURED).select("id", notes.without_quantity(F.col("line"), units.SIMPLE_UNITS).alias("item"))


_STEPS = "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN concat(' ', p_size, '. ', p_name, ' ') WHEN 1 THEN concat(p_size, ') ', p_name) ELSE concat(p_size, ' ', p_name) END AS step FROM part"


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN p_name ELSE concat(p_size, ' ', p_name) END AS step FROM part")
def step_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _STEPS).select("id", notes.step_text(F.col("step")).alias("step"))


_WRITTEN = "SELECT p_partkey AS id, p_size % 5 AS servings, CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ' Portionen') WHEN 1 THEN 'viele' WHEN 2 THEN '' ELSE concat('für ', p_size, ',0 Personen') END AS written FROM part"


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 1 THEN true WHEN 2 THEN false ELSE p_size <> p_size % 5 END AS shown FROM part")
def original_yield_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, _WRITTEN).select("id", notes.shows_original(F.col("written"), F.col("servings")).alias("shown"))


@query("SELECT p_partkey AS post_id, 2::BIGINT AS n_lines, concat(p_name, '|', p_type) AS items, 'g|EL' AS units FROM part")
def reparsed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw lines of stored documents, parsed anew."""
    again = stored.reparsed(derived(spark, sf_dir, I.SCHEMAS), "post_id", "json")
    each = lambda f: F.array_join(F.transform("lines", lambda x: x[f]), "|")
    return again.select("post_id", F.size("lines").cast("long").alias("n_lines"), each("item").alias("items"), each("unit").alias("units"))


@query("SELECT p_partkey AS post_id, CASE WHEN p_partkey % 2 = 0 THEN concat('1,5,EL,', p_name, '|2–3,Stück,', p_brand) ELSE concat(',,', p_size, ' g ', p_name, '|,,', p_size, ' g ', p_name, '|,,2 EL ', p_type) END AS shown FROM part")
def materialized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of stored documents: parsed entries, else their ingredients as they are."""
    rows = stored.materialized(F.try_parse_json("json"))
    return derived(spark, sf_dir, I.SCHEMAS).select("post_id", F.array_join(F.transform(rows, lambda r: F.concat_ws(",", r["qty"], r["unit"], r["name"])), "|").alias("shown"))


@query("SELECT p_partkey AS post_id, p_name AS name, 3::BIGINT AS n_ingredients, 4::BIGINT AS n_steps, concat('Mix|Bake ', p_brand, '|HowToStep') AS first_steps FROM part")
def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived(spark, sf_dir, I.SCHEMAS).select("post_id", stored.summary(F.try_parse_json("json")).alias("s"))
    return docs.select("post_id", "s.name", F.col("s.ingredients").cast("long").alias("n_ingredients"), F.col("s.steps").cast("long").alias("n_steps"), F.array_join("s.first_steps", "|").alias("first_steps"))


@query("SELECT p_partkey AS post_id, CASE WHEN p_partkey % 3 = 0 THEN concat('https://example.com/own/', p_partkey) WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN 'https://example.com/canonical' ELSE 'https://example.com/stored' END AS source FROM part")
def source_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address that a document names, else the canonical one of where it came from, else that."""
    docs = derived(spark, sf_dir, I.SCHEMAS)
    at = F.when(F.col("post_id") % 5 == 0, " ").otherwise("https://example.com/stored")
    canonical = F.when(F.col("post_id") % 5 == 1, "https://example.com/canonical").otherwise("")
    return docs.select("post_id", stored.source_url(F.try_parse_json("json"), canonical, at).alias("source"))


_META_VALUES = """SELECT p_partkey AS post_id, CASE p_partkey % 9 WHEN 0 THEN concat('["', p_name, '","', p_type, '"]') WHEN 1 THEN '{"a":1}' WHEN 2 THEN 'a:0:{broken' WHEN 3 THEN '"text"'
  WHEN 4 THEN concat('a:2:{i:0;s:', length(p_name), ':"', p_name, '";i:1;a:1:{s:6:"größ";d:', p_size, '.5;}}') WHEN 5 THEN concat('a:2:{s:4:"item";s:', length(p_type) + 2, ':"', p_type, '";";s:2:"ok";b:1;}')
  WHEN 6 THEN concat('a:1:{i:0;s:', length(p_name) + 1, ':"', p_name, '";}') WHEN 7 THEN 'a:0:{}' END AS value FROM part"""


@query(r"""SELECT p_partkey AS post_id, CASE p_partkey % 9 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 4 THEN 2 WHEN 5 THEN 1 ELSE 0 END::BIGINT AS n_entries,
  CASE p_partkey % 9 WHEN 0 THEN concat('["', p_name, '","', p_type, '"]') WHEN 1 THEN '[{"a":1}]' WHEN 4 THEN concat('["', p_name, '",{"größ":', p_size, '.5}]') WHEN 5 THEN concat('[{"item":"', p_type, '\";","ok":true}]') ELSE '[]' END AS entries FROM part""")
def metadata_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of stored metadata in JSON or serialized, whatever its form; what is broken, or no list or object, has none."""
    entries = stored.listed(F.col("value"))
    return derived(spark, sf_dir, _META_VALUES).select("post_id", entries.alias("e")).select("post_id", F.size("e").cast("long").alias("n_entries"), F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: F.to_json(x)), ","), F.lit("]")).alias("entries"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 5 = 0 THEN p_type ELSE '' END AS lines FROM part")
def lines_to_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped lines before stored ones before those of the document."""
    some = lambda c, n: F.when(F.col("p_partkey") % n == 0, F.array(c)).otherwise(F.array().cast("array<string>"))
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").alias("id"), F.array_join(stored.first_filled(some("p_name", 2), some("p_brand", 3), some("p_type", 5)), "|").alias("lines"))


_SHOWN_KEY = "concat_ws('|', CASE WHEN qty_low IS NULL THEN '' ELSE printf('%.3f', qty_low) END, lower(coalesce(unit, '')), strip_accents(lower(item)))"


@query(f"WITH {_PARSED} SELECT recipe_id, pos FROM parsed QUALIFY row_number() OVER (PARTITION BY recipe_id, {_SHOWN_KEY} ORDER BY pos) = 1")
def lines_shown_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored.shown_once(_lines(spark, sf_dir), ["recipe_id"], "pos", name="item").select("recipe_id", "pos")


@query(f"SELECT id, CASE WHEN jsonld_image <> '' THEN jsonld_image WHEN microdata_image <> '' THEN microdata_image ELSE coalesce(dom_image, '') END AS image, dom_name AS title FROM ({_SOURCES})")
def related_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = stored.card(F.col("dom_name"), F.lit("/"), F.col("jsonld_image"), F.col("microdata_image"), F.col("dom_image"))
    return derived(spark, sf_dir, _SOURCES).select("id", c.alias("c")).select("id", "c.image", "c.title")


_LOWER_LINES = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN concat('frische ', p_name, '-mix mit öl, gemahlener ', lower(p_type)) WHEN 1 THEN concat(p_name, ' FÜR ', p_type, ' Grobes salz') WHEN 2 THEN p_name
  WHEN 3 THEN concat(' geschälte  ', lower(p_brand), ' ohne kleines ', p_name) ELSE concat('(', p_name, ') und 2x', lower(p_type), '-') END AS line FROM part"""


@query(rf"""WITH l AS (SELECT id, line, regexp_extract_all(line, '[^\s-]+|[\s-]+') AS parts FROM ({_LOWER_LINES}))
SELECT id, CASE WHEN line NOT LIKE '%ä%' AND line NOT LIKE '%ö%' AND line NOT LIKE '%ü%' AND line NOT LIKE '%ß%' AND len(list_intersect(regexp_split_to_array(lower(line), '[^a-zü]+'), {list(casing.GERMAN)})) = 0 THEN line
  ELSE array_to_string(list_transform(parts, lambda x: CASE WHEN list_contains({list(casing.KEPT)}, lower(x)) OR len(list_filter({list(casing.STEMS)}, lambda s: starts_with(lower(x), s) AND list_contains({["", *casing.ENDINGS]}, substr(lower(x), length(s) + 1)))) > 0 THEN lower(x)
    WHEN lower(x) <> x OR upper(x) = x THEN x ELSE concat(regexp_extract(x, '^[^a-zäöüß]*'), upper(substr(x, length(regexp_extract(x, '^[^a-zäöüß]*')) + 1, 1)), substr(x, length(regexp_extract(x, '^[^a-zäöüß]*')) + 2)) END), '') END AS shown FROM l""")
def ingredient_casing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in lower case with their likely nouns capitalised, where they are German."""
    return derived(spark, sf_dir, _LOWER_LINES).select("id", casing.german_casing(F.col("line")).alias("shown"))


_DAMAGED = f"SELECT post_id, CASE post_id % 7 WHEN 0 THEN '' WHEN 1 THEN '[1]' WHEN 2 THEN concat('{{{{\"name\":\"', post_id, '\",\"recipeIngredient\":[\" \",{{{{}}}}]}}}}') WHEN 3 THEN NULL ELSE json END AS json FROM ({I.SCHEMAS})".replace("{{", "{").replace("}}", "}")
_LEAD = f"coalesce(trim(regexp_extract(p_name, {_ADJECTIVES}, 1)), '')"


@query(f"""SELECT p_partkey AS post_id, pos, CASE pos WHEN 2 THEN concat('2 EL ', p_type) ELSE concat(p_size, ' g ', p_name) END AS raw,
  CASE pos WHEN 2 THEN concat('2 tbsp ', p_type) ELSE concat(p_size, ' g ', trim(substr(p_name, length({_LEAD}) + 1)), CASE WHEN {_LEAD} <> '' THEN concat(' (', {_LEAD}, ')') ELSE '' END) END AS shown
FROM part, (SELECT unnest([0, 1, 2])::INT AS pos) WHERE p_partkey % 7 > 3""")
def repair_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the lines of stored documents would read if they were parsed anew."""
    return publish.preview(derived(spark, sf_dir, _DAMAGED), "post_id", "json")


@query(f"""SELECT p_partkey AS post_id, CASE p_partkey % 7 WHEN 0 THEN 'no_schema' WHEN 1 THEN 'no_object' WHEN 2 THEN 'no_lines' WHEN 3 THEN 'no_schema' ELSE 'repaired' END AS status,
  CASE WHEN p_partkey % 7 > 3 THEN 3 ELSE 0 END::BIGINT AS n_lines, CASE WHEN p_partkey % 7 > 3 THEN p_name WHEN p_partkey % 7 = 2 THEN CAST(p_partkey AS VARCHAR) END AS name,
  CASE WHEN p_partkey % 7 > 3 THEN trim(substr(p_name, length({_LEAD}) + 1)) END AS first_item, CASE WHEN p_partkey % 7 > 3 THEN concat('2 EL ', p_type) END AS last_raw, CASE WHEN p_partkey % 7 > 3 THEN p_size::DOUBLE END AS qty FROM part""")
def repaired_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents with their lines parsed anew in place, the rest of them kept; those that can't be repaired as they are."""
    got = publish.repaired(derived(spark, sf_dir, _DAMAGED), "post_id", "json").withColumn("v", F.try_parse_json("new"))
    read = lambda path, kind: F.try_variant_get("v", path, kind)
    return got.select("post_id", "status", F.col("n_lines").cast("long").alias("n_lines"), read("$.name", "string").alias("name"), read("$.recipeIngredient[0].item", "string").alias("first_item"), read("$.ingredientsParsed[2].raw", "string").alias("last_raw"), read("$.recipeIngredient[1].qty", "double").alias("qty"))


_REQUESTS = "SELECT event_id AS request_id, user_id % 300 AS visit, ts AS at, user_id % 40 AS post_id, CAST(event_id % 5 AS INT) AS n FROM events"


@query(f"""WITH p AS ({I.POSTS}), q AS (SELECT *, greatest(n, 1) AS m, sum(greatest(n, 1)) OVER (PARTITION BY visit, post_id ORDER BY r.at, request_id) AS upto FROM ({_REQUESTS}) r),
others AS (SELECT a.post_id, b.post_id AS related_id, row_number() OVER (PARTITION BY a.post_id ORDER BY md5(CAST(b.post_id AS VARCHAR)), b.post_id) AS place FROM p a JOIN p b ON a.category = b.category AND a.post_id <> b.post_id WHERE a.post_id IN (SELECT post_id FROM q))
SELECT q.request_id, q.visit, q.post_id, o.related_id, o.place::BIGINT AS place FROM q JOIN others o ON q.post_id = o.post_id AND o.place > q.upto - q.m AND o.place <= q.upto""")
def related_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for more related posts, none of which a visit is shown twice."""
    return posts.served(posts.claims(derived(spark, sf_dir, _REQUESTS)), posts.ranked(derived(spark, sf_dir, I.POSTS)))
