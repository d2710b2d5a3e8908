"""Recipe-shaped inputs derived from the driver's tables by SQL text that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.plans.session import tasks

LINES = """
SELECT p_partkey AS line_id, p_partkey % 50 AS recipe_id, p_partkey AS pos,
  CASE p_partkey % 12
    WHEN 0 THEN concat(p_size, ' g ', p_name) WHEN 1 THEN concat(p_size, ',5 EL ', p_name)
    WHEN 2 THEN concat(p_size, '-', p_size + 2, ' ml ', p_name) WHEN 3 THEN concat('½ TL ', p_name, ' (fein gehackt)')
    WHEN 4 THEN concat('ca. 0,75 l ', p_name) WHEN 5 THEN concat(p_size, ' 1/2 TL ', p_name)
    WHEN 6 THEN CASE WHEN p_partkey % 24 = 6 THEN p_name ELSE concat(p_size, ' EL Cajun-', p_name) END WHEN 7 THEN concat('eine halbe ', p_name)
    WHEN 8 THEN concat(p_size, '–', p_size + 1, ' Bund ', p_name) WHEN 9 THEN concat(p_name, ', optional')
    WHEN 10 THEN concat(p_size, '½ Prise ', p_name) ELSE concat(p_size, 'x', p_size + 1, ' kg ', p_name) END AS raw
FROM part"""

#: What each of the lines says, from the columns that it is made of.
LABELS = """
SELECT p_partkey AS line_id,
  CAST(CASE WHEN p_partkey % 12 IN (0, 2, 8, 11) OR p_partkey % 24 = 18 THEN p_size WHEN p_partkey % 12 IN (1, 5, 10) THEN p_size + 0.5 WHEN p_partkey % 12 IN (3, 7) THEN 0.5 WHEN p_partkey % 12 = 4 THEN 0.75 END AS DOUBLE) AS low,
  CAST(CASE p_partkey % 12 WHEN 2 THEN p_size + 2 WHEN 8 THEN p_size + 1 END AS DOUBLE) AS high,
  CASE WHEN p_partkey % 24 = 18 THEN 'EL' ELSE CASE p_partkey % 12 WHEN 0 THEN 'g' WHEN 1 THEN 'EL' WHEN 2 THEN 'ml' WHEN 3 THEN 'TL' WHEN 4 THEN 'l' WHEN 5 THEN 'TL' WHEN 8 THEN 'Bund' WHEN 10 THEN 'Prise' WHEN 11 THEN 'kg' END END AS unit,
  CASE p_partkey % 12 WHEN 3 THEN 'fein gehackt' WHEN 9 THEN 'optional' END AS note
FROM part"""

#: Lines of which the simple engine takes every third; the others are names only, in four shapes, and one that divides by zero.
POOR_LINES = """
SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN concat(p_name, ', ', p_type) WHEN 1 THEN concat('Prise ', p_name) WHEN 2 THEN concat('TK ', p_name, ', ', p_brand) WHEN 3 THEN p_name WHEN 4 THEN concat('1/0 ', p_name)
    WHEN 5 THEN '' WHEN 6 THEN concat(p_size, ' g ', p_name) WHEN 7 THEN concat(p_name, ' (', p_type, ')') END AS raw, p_name, p_type, p_brand, p_size
FROM part"""

#: Pages with as many list items in their recipe as p_size says, and two in a piece of furniture of ten kinds.
NOISE_PAGES = """
SELECT p_partkey AS page_id, p_size % 7 AS n,
  concat('<html><body>', CASE p_partkey % 10 WHEN 0 THEN '<nav>' WHEN 1 THEN '<footer>' WHEN 2 THEN '<aside>' WHEN 3 THEN '<form>' WHEN 4 THEN '<div class="comments">' WHEN 5 THEN '<div class="x sidebar">'
      WHEN 6 THEN '<div class="share y">' WHEN 7 THEN '<div class="newsletter">' WHEN 8 THEN '<script>' ELSE '<style>' END, '<ul><li>no</li><li>no</li></ul>',
    CASE p_partkey % 10 WHEN 0 THEN '</nav>' WHEN 1 THEN '</footer>' WHEN 2 THEN '</aside>' WHEN 3 THEN '</form>' WHEN 8 THEN '</script>' WHEN 9 THEN '</style>' ELSE '</div>' END,
    '<div><ul>', repeat('<li>yes</li>', p_size % 7), '</ul></div></body></html>') AS html
FROM part"""

#: Pages whose JSON-LD nests the recipe, lists images as texts and objects, and has sections with steps.
NESTED_PAGES = """
SELECT p_partkey AS page_id, concat('https://www.example.com/r/', p_partkey) AS url,
  concat('<html><head><meta property="og:image" content="/og.jpg"><script type="application/ld+json">', CASE p_partkey % 3 WHEN 0 THEN '{"@type":"WebPage","mainEntity":' WHEN 1 THEN '[{"@graph":[{"@type":"Person","name":"x"},' ELSE '{"@type":"ItemList","itemListElement":[{"@type":"ListItem","item":' END,
    '{"@type":"Recipe","name":"', p_name, ' &amp; KÃ¶rner","alternateName":"', p_brand, '","author":[{"@type":"Person","name":"<b>', p_brand, '</b>"},"Z. ', p_type, '"],"nutrition":{"@type":"NutritionInformation","calories":"', p_size, ' kcal","fatContent":', p_size, '},"aggregateRating":{"ratingValue":"4,5","reviewCount":', p_size, '},"image":["/a.jpg",{"url":"https://cdn.example.com/', p_partkey, '.png"}],"recipeIngredient":["', p_size, ' g ', p_name, '","', p_size, ' g ', p_name, '"],"recipeInstructions":[{"@type":"HowToSection","name":"', p_brand, '","itemListElement":[{"@type":"HowToStep","text":"Mix"},{"@type":"HowToStep","text":"Bake"}]},{"@type":"HowToStep","text":"Serve ', p_type, '"}]}',
    CASE p_partkey % 3 WHEN 0 THEN '}' WHEN 1 THEN ']}]' ELSE '}]}' END, '</script></head><body><div itemscope itemtype="https://schema.org/Recipe"><span itemprop="name">other</span><div itemprop="nutrition" itemscope><b itemprop="calories">1</b><b itemprop="proteinContent">', p_size % 9, ' g</b></div></div></body></html>') AS html
FROM part"""

#: Pages whose ingredients stand in groups under headings of three kinds, without lists.
GROUP_PAGES = """
SELECT p_partkey AS page_id, concat('https://www.example.com/g/', p_partkey) AS url,
  concat('<html><body><div class="recipe"><h1>', p_name, '</h1><p class="ingredient-label ingredient">Zutaten:</p>', CASE WHEN p_partkey % 2 = 0 THEN concat('<p class="ingredient">', p_size, ' g ', p_name, '</p>') ELSE '' END,
    CASE p_partkey % 3 WHEN 0 THEN '<h3 class="ingredient-group">' WHEN 1 THEN '<p class="ingredient-group">' ELSE '<div class="ingredients"><span class="ingredient-group">' END, CASE WHEN p_partkey % 3 = 1 THEN 'MARINADE' ELSE 'Teig:' END, CASE p_partkey % 3 WHEN 0 THEN '</h3>' WHEN 1 THEN '</p>' ELSE '</span></div>' END,
    '<p class="ingredient">', p_size, ' g ', p_type, '</p><p class="ingredient">1 EL ', p_brand, '</p><h4 class="ingredients">Leer</h4><h4 class="ingredients">Guss</h4><p class="ingredient">2 ml ', p_name, '</p></div></body></html>') AS html
FROM part"""

#: What follows a quantity, with notes of every kind.
REMAINDERS = """
SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('TK g ', p_name, ' (', p_type, ')') WHEN 1 THEN concat('EL ', p_name, ', ', p_brand) WHEN 2 THEN concat('kg Ingwer-Stück, ', p_type) ELSE p_name END AS rest
FROM part"""

#: Stored documents: repeated raw lines, parsed entries of three kinds, steps of four.
SCHEMAS = """
SELECT p_partkey AS post_id, concat('{"name":"', p_name, '","recipeIngredient":["', p_size, ' g ', p_name, '","', p_size, ' g ', p_name, '",{"raw":"2 EL ', p_type, '"}],',
  '"recipeInstructions":["Mix",{"text":"Bake ', p_brand, '"},{"@type":"HowToStep"},"Serve"]', CASE WHEN p_partkey % 3 = 0 THEN concat(',"url":"https://example.com/own/', p_partkey, '"') WHEN p_partkey % 3 = 1 THEN ',"url":"no address"' ELSE '' END,
  CASE WHEN p_partkey % 2 = 0 THEN concat(',"ingredientsParsed":[{"raw":"', p_size, ' g ', p_name, '","qty":1.5,"unit":"tbsp","item":"', p_name, '"},{"qty":{"low":2,"high":3},"unit":"piece","name":"', p_brand, '"}]') ELSE '' END, '}') AS json
FROM part"""

DURATIONS = """
SELECT p_partkey AS id,
  CASE p_partkey % 7 WHEN 0 THEN concat(p_size, ' min') WHEN 1 THEN concat('1 h ', p_size, ' m') WHEN 2 THEN concat('PT', p_size, 'M')
    WHEN 3 THEN concat('1:', lpad(CAST(p_size AS VARCHAR(5)), 2, '0')) WHEN 4 THEN concat(p_size, ' Minuten') WHEN 5 THEN concat(p_size % 9 + 1, ' Stunden ', p_size, ' Sekunden') ELSE CAST(p_size AS VARCHAR(5)) END AS txt,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE concat('PT', p_size % 4 + 1, 'H', p_size, 'M') END AS prep,
  CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE concat('PT', p_size + 15, 'M', p_size, 'S') END AS cook,
  CASE WHEN p_partkey % 5 = 0 THEN concat('PT', p_size, 'H') END AS total
FROM part"""

YIELDS = """
SELECT p_partkey AS id,
  CASE p_partkey % 6 WHEN 0 THEN concat(p_size, ' Portionen') WHEN 1 THEN concat('serves ', p_size) WHEN 2 THEN concat(p_size, '-', p_size + 2, ' Personen')
    WHEN 3 THEN concat(p_size, ',5 servings') WHEN 4 THEN 'einige' ELSE concat('für ', p_size, ' Person') END AS txt
FROM part"""

LD_PAGES = """
SELECT p_partkey AS page_id, concat('https://www.example.com/recipes/', p_partkey, '/index.html') AS url,
  concat('<html><head>', CASE WHEN p_partkey % 3 = 0 THEN concat('<link rel="canonical" href="/r/', p_partkey, '">') WHEN p_partkey % 3 = 1 THEN concat('<meta property="og:url" content="https://example.org/p/', p_partkey, '">') ELSE '' END,
    '<script type="application/ld+json">', CASE WHEN p_partkey % 4 = 3 THEN '/* generated */ ' ELSE '' END, '{"@graph":[{"@type":"WebPage","name":"page"},{"@type":"Recipe","name":"', p_name, '","recipeYield":"', p_size, ' Portionen"',
    CASE WHEN p_partkey % 2 = 0 THEN concat(',"prepTime":"PT', p_size, 'M"') ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN ',"image":"/img.jpg"' ELSE '' END, '}]}</script></head><body></body></html>') AS html
FROM part"""

POSTS = "SELECT o_orderkey AS post_id, o_custkey % 200 AS category, o_orderdate AS date, o_orderstatus AS status FROM orders"

VERSIONS = """
SELECT o_orderkey AS post_id, CASE WHEN o_orderkey % 4 = 0 THEN concat('title ', o_custkey) ELSE concat('old ', o_orderkey) END AS title,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS note, CAST(o_custkey % 7 AS VARCHAR(5)) AS yield, o_orderkey % 6 = 0 AS title_locked
FROM orders WHERE o_orderkey % 10 <> 9"""

NEW_VERSIONS = """
SELECT o_orderkey AS post_id, concat('title ', o_custkey) AS title, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS note, CAST(o_custkey % 5 AS VARCHAR(5)) AS yield
FROM orders WHERE o_orderkey % 10 <> 8"""

GROUP_LINES = """
SELECT p_partkey % 40 AS recipe_id, p_partkey AS pos,
  CASE WHEN p_partkey % 400 < 40 THEN concat('Für ', p_name, ':') WHEN p_partkey % 400 BETWEEN 120 AND 159 THEN 'MARINADE' WHEN p_partkey % 400 BETWEEN 240 AND 250 THEN concat('Sauce ', p_name) WHEN p_partkey % 2 = 0 THEN concat(p_size, ' g ', p_name) ELSE concat('etwas ', p_name) END AS raw
FROM part"""


#: Tables whose rows are parsed one by one, and the key that they are dealt by before that; the others are only joined and grouped.
_PARSED = {"part": "p_partkey", "pages": "page_id"}


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts above, over the tables below ``sf_dir``; those of part and pages are spread over all cores as they are read."""
    for name in ("part", "orders", "events", "pages"):
        if f"FROM {name}" in sql:
            path = f"parquet.`{sf_dir}/{name}.parquet`"
            source = f"(SELECT /*+ REPARTITION({tasks(spark)}, {_PARSED[name]}) */ * FROM {path})" if name in _PARSED else path
            sql = sql.replace(f"FROM {name}", f"FROM {source}")
    return spark.sql(sql)
