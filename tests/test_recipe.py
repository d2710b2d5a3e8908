from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from larder.functions import display, duration, quantity, text, units
from larder.operators import evaluate, grouping, posts, recipe, store
from larder.sources import pages, sinks
from larder.streaming.ingest import ingest


def one(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_durations(spark):
    given = ["90 min", "1.5 h", "1 h 40 m", "1:40", "45", "PT30M", "", None, "kurz", "2 Stunden 5 Sekunden", "1 std 15 min"]
    assert one(spark, given, duration.parse_duration) == ["PT90M", "PT2H", "PT1H40M", "PT1H40M", "PT45M", "PT30M", None, None, None, "PT2H5S", "PT1H15M"]
    df = spark.createDataFrame([("PT45M", "PT30M"), (None, "PT5S"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(duration.sum_durations(F.col("a"), F.col("b"))).collect()] == ["PT1H15M", "PT5S", None]


def test_numbers_and_display(spark):
    assert one(spark, [10.0, 100.0, 1.5, 0.0, 2.999, 0.333, None], display.german_number, "double") == ["10", "100", "1,5", "0", "3", "0,33", None]
    assert one(spark, ["1 1/2", "3/4", "2.5", "7", "x", "1/0", None], quantity.number) == [1.5, 0.75, 2.5, 7.0, None, None, None]
    assert one(spark, ["4 Portionen", "serves 3", "für 2,5 Personen", "viele", None], quantity.yield_unit) == ["portionen", "serves", "person", None, None]
    assert one(spark, ["TL", " Gramm ", "Becher", None], units.canonical_unit) == ["tsp", "g", None, None]
    assert one(spark, ["tsp", "Becher", None], units.german_unit) == ["TL", "Becher", ""]
    assert one(spark, ["salz", "Salz"], display.capitalised) == ["Salz", "Salz"]


def test_text_functions(spark):
    assert one(spark, ["Gru00fcn", "w\\u00f6rter", None], text.decode_u00) == ["Grün", "wörter", None]
    assert one(spark, ["& Pfeffer", "und Salz", "Salz & Pfeffer"], text.drop_leading_and) == ["Pfeffer", "Salz", "Salz & Pfeffer"]
    assert one(spark, ["a, b, nach Belieben", "a, b", "a (x), optional", "a, (optional)"], text.tail_to_note) == ["a, b (nach Belieben)", "a, b", "a (x), optional", "a, (optional)"]
    assert one(spark, ["<b>Crème</b>  Brûlée "], text.canon_key) == ["creme brulee"]
    assert one(spark, ["Grüne Weißwurst!"], text.slug) == ["gruene weisswurst"]
    assert one(spark, ["3, x, 3, -1, 5"], text.split_list) == [[3, 5]]


def test_merge_score_and_flags(spark):
    df = spark.createDataFrame([(1, "a", "b", None, None, "", "c"), (2, None, None, None, None, None, None)], "id int, jsonld_name string, dom_name string, microdata_name string, jsonld_image string, microdata_image string, dom_image string")
    got = recipe.merge_sources(df, ("name", "image")).withColumn("c", recipe.confidence([F.col("name_source"), F.col("image_source")])).orderBy("id").collect()
    assert (got[0]["name"], got[0]["name_source"], got[0]["image"], got[0]["image_source"]) == ("a", "jsonld", "c", "dom")
    assert got[0]["c"] == (0.95 + 0.7) / 2
    assert got[1]["c"] == 0.0
    three = spark.range(1).select(recipe.confidence([F.lit("dom")] * 3).alias("c")).first()["c"]
    assert three == 0.6999999999999998


def test_extraction(spark):
    page = """<html><head><link rel="canonical" href="/r/1"><script type="application/ld+json"><!-- {"@graph":[{"@type":"WebPage"},{"@type":["Recipe"],"name":"Cake","recipeIngredient":["1 g a"]}]} --></script></head>
    <body><div class="recipe"><h1>Cake &amp; more</h1><p>Good<p>cake</p><ul><li class="ingredient">1 g a</li><li>2 g b</li></ul><ol><li>Mix</li></ol></div>
    <div itemscope itemtype="https://schema.org/Recipe"><span itemprop="name">Micro</span><meta itemprop="prepTime" content="PT5M"></div></body></html>"""
    df = spark.createDataFrame([(1, "https://x.example/a/b", page), (2, "https://x.example/", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in df.select("page_id", pages.markup(F.col("html")).alias("m"), pages.canonical_url(F.col("html"), F.col("url")).alias("c")).collect()}
    m = got[1]["m"]
    assert (m["title"], m["description"], m["list_items"], m["instructions"]) == ("Cake & more", "Good", ["1 g a", "2 g b", "Mix"], ["Mix"])
    assert (m["microdata"]["name"], m["microdata"]["prepTime"]) == ("Micro", "PT5M")
    assert got[1]["c"] == "https://x.example/r/1"
    assert got[2]["m"]["title"] is None
    node = pages.json_ld_recipes(df).select("page_id", F.try_variant_get("node", "$.name", "string").alias("n")).collect()
    assert [(r["page_id"], r["n"]) for r in node] == [(1, "Cake")]


def test_tolerant_json(spark):
    got = one(spark, ['{"a":1}', '/* x */ {"a":1}', '{"a":"b\nc"}', "nonsense{"], lambda c: pages.tolerant_json(c).isNotNull())
    assert got == [True, True, True, False]


def test_instructions(spark):
    assert one(spark, ["Mix. Then bake.\nServe. now"], recipe.instruction_steps) == [["Mix", "Then bake", "Serve. now"]]


def test_store(spark):
    old = spark.createDataFrame([(1, "a", "x", ["t"]), (2, "b", None, [])], "id int, t string, n string, locks array<string>")
    new = spark.createDataFrame([(1, "c", "y"), (3, "d", None)], "id int, t string, n string")
    diff = {(r["id"], r["field"], r["locked"]) for r in store.changes(old, new, "id", ["t", "n"], "locks").collect()}
    assert diff == {(1, "t", True), (1, "n", False), (2, "t", False), (3, "t", False)}
    assert {tuple(r) for r in store.upsert(old, new, "id", ["t", "n"], "locks").collect()} == {(1, "a", "y"), (2, "b", None), (3, "d", None)}
    assert {tuple(r) for r in store.upsert(old, new, "id", ["t", "n"], "locks", force=True).collect()} == {(1, "c", "y"), (2, "b", None), (3, "d", None)}
    assert {r["name"] for r in store.backup(old, "id", ["t", "n"], "s").collect()} == {"t_bak_s", "n_bak_s"}


def test_posts_and_groups(spark):
    df = spark.createDataFrame([(i, i % 2, i) for i in range(20)], "post_id long, category int, date int")
    got = posts.related(df, most=3).collect()
    assert len(got) == 60
    assert all(r["post_id"] % 2 == r["related_id"] % 2 and r["post_id"] != r["related_id"] for r in got)
    assert [r["post_id"] for r in posts.page(df, 6).collect()] == [13, 12, 11, 10, 9, 8]
    lines = spark.createDataFrame([(1, 0, "Für den Teig:"), (1, 1, "2 EL Öl"), (1, 2, "SAUCE"), (1, 3, "Salz"), (2, 0, "Salz")], "recipe int, pos int, raw string")
    assert [(r["group_no"], r["group_name"]) for r in grouping.grouped(lines, "recipe", "pos").orderBy("recipe", "pos").collect()] == [(1, "Für den Teig"), (1, "Für den Teig"), (2, "SAUCE"), (2, "SAUCE"), (0, None)]


def test_golden_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2 EL Öl\n\n 1-2 g Salz \n")
    (tmp_path / "a.expected.json").write_text('{"cases":[{"line":"2 EL Öl","qty":2,"unit":"tbsp","item":"Öl","note":null},{"line":"1-2 g Salz","min_qty":1,"max_qty":2,"unit":"g"}]}')
    from larder.operators.lines import parse_simple

    lines = pages.line_files(spark, str(tmp_path)).withColumn("file", F.lit("a"))
    cases = pages.labelled_cases(spark, str(tmp_path)).withColumn("file", F.lit("a"))
    parsed = parse_simple(lines, "line").drop("line", "is_range")
    got = {r["metric"]: (r["ok"], r["total"]) for r in evaluate.metrics(evaluate.judged(evaluate.aligned(cases, parsed))).collect()}
    assert got == {"qty_parse_rate": (2, 2), "range_detect_rate": (1, 1), "unit_attach_clean": (2, 2), "note_separation_ok": (2, 2)}
    assert '"line":"2 EL Öl"' in sinks.skeleton(lines).first()["value"]


def test_incremental_ingest(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for batch in ([(1, "a"), (1, "a"), (2, "b")], [(3, "c")]):
        spark.createDataFrame(batch, "page_id long, html string").coalesce(1).write.mode("append").parquet(src)
        ingest(spark, src, "page_id long, html string", out, mark, lambda df: df).awaitTermination()
    assert sorted(r["page_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


@pytest.mark.parametrize("name", ["line_parse_by_unit", "refresh_diff", "jsonld_recipe"])
def test_registered_queries_match_sql(spark, name):
    import duckdb

    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("part", "orders", "pages", "documents", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, folder)
    want = db.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(map(repr, [tuple(r) for r in got.select(*columns).collect()])) == sorted(map(repr, want.select(*[f'"{c}"' for c in columns]).fetchall()))


def test_assembled_recipe(spark):
    from larder.plans.assemble import assemble

    page = """<html><head><script type="application/ld+json">{"@type":"Recipe","name":"Cake","recipeYield":"4 Portionen","prepTime":"20 min","recipeIngredient":["200 g Mehl","200 g  Mehl","1-2 EL Öl (mild)"],"recipeInstructions":[{"@type":"HowToStep","text":"Mix"},"Bake"]}</script></head>
    <body><div itemscope itemtype="http://schema.org/Recipe"><span itemprop="name">Other</span><meta itemprop="cookTime" content="PT40M"></div><div class="recipe"><h1>Title</h1><p>Text</p></div></body></html>"""
    df = spark.createDataFrame([(1, "https://x.example/a", page), (2, "https://x.example/b", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in assemble(df).collect()}
    one = got[1]
    assert (one["name"], one["description"], one["totalTime"]) == ("Cake", "Text", "PT1H")
    assert [(i["qty_low"], i["qty_high"], i["unit"], i["item"], i["note"]) for i in one["recipeIngredient"]] == [(200.0, None, "g", "Mehl", None), (1.0, 2.0, "EL", "Öl", "mild")]
    assert one["recipeInstructions"] == ["Mix", "Bake"]
    assert (one["yield"]["count"], one["yield"]["unit"]) == (4.0, "portionen")
    assert one["sources"]["name"] == ["jsonld"]
    assert one["sources"]["cookTime"] == ["microdata"]
    assert not one["flags"]["isPartial"]
    assert got[2]["flags"]["isPartial"]
    assert got[2]["recipeIngredient"] == []


def assembled(spark, ld, head=""):
    from larder.plans.assemble import assemble

    page = f'<html><head>{head}<script type="application/ld+json">{ld}</script></head><body></body></html>'
    return assemble(spark.createDataFrame([(1, "https://x.e/p/q", page)], "page_id long, url string, html string")).first()


@pytest.mark.parametrize("wrap", ['{"@type":"WebPage","mainEntity":%s}', '[{"@graph":[%s]}]', '[[%s]]', '{"@graph":[{"@type":"WebPage","mainEntity":[%s]}]}', '{"@type":"ItemList","itemListElement":[{"@type":"ListItem","item":%s}]}'])
def test_recipes_nested_in_other_nodes(spark, wrap):
    assert assembled(spark, wrap % '{"@type":"Recipe","name":"Cake"}')["name"] == "Cake"


@pytest.mark.parametrize(("image", "want"), [('["/a.jpg","/b.jpg"]', ["https://x.e/a.jpg", "https://x.e/b.jpg", "https://x.e/og.png"]), ('{"@type":"ImageObject","url":"c.jpg"}', ["https://x.e/p/c.jpg", "https://x.e/og.png"]), ('[{"@id":"/d.jpg"},{"x":1}]', ["https://x.e/d.jpg", "https://x.e/og.png"]), ("null", ["https://x.e/og.png"])])
def test_image_lists_and_objects(spark, image, want):
    assert assembled(spark, f'{{"@type":"Recipe","name":"Cake","image":{image}}}', '<meta property="og:image" content="/og.png">')["image"] == want


def test_sections_give_their_steps(spark):
    got = assembled(spark, '{"@type":"Recipe","recipeInstructions":[{"@type":"HowToSection","name":"Teig","itemListElement":[{"@type":"HowToStep","text":"Mix"},{"@type":"HowToStep","text":"Rest"}]},{"@type":"HowToStep","text":"Bake"}]}')
    assert got["recipeInstructions"] == ["Mix", "Rest", "Bake"]
    assert [(s["text"], s["section"]) for s in got["sectionSteps"]] == [("Mix", "Teig"), ("Rest", "Teig")]


def test_durations_with_fractions(spark):
    assert one(spark, ["1½ h", "½ Stunde", "1 1/2 h 5 min", "3/4 h", "1,5 Stunden", "no time", None], duration.parse_duration) == ["PT2H", "PT1H", "PT2H5M", "PT1H", "PT2H", None, None]


def test_keys_without_any_accent(spark):
    assert one(spark, ["Dvořák  <b>ŐŠž</b> ậ ß"], text.canon_key) == ["dvorak osz a ß"]


def test_ingredients_with_fields_keep_them(spark):
    entries = """[{"qty":"1,5","unit":"Esslöffel","item":"Öl","note":"mild"}, {"qty":{"low":2,"high":3},"name":"Eier"}, {"raw":"200 g Mehl"}, "1,5 EL Öl (mild)", {"qty":1,"unit":"Becher","item":"Sahne","raw":"ein Becher"}, {"note":"nur so"}]"""
    page = f"""<script type="application/ld+json">{{"@type":"Recipe","name":"x","recipeIngredient":{entries}}}</script>"""
    from larder.plans.assemble import assemble

    lines = assemble(spark.createDataFrame([(1, "https://x.example/", page)], "page_id long, url string, html string")).first()["recipeIngredient"]
    got = [(x["raw"], x["qty_low"], x["qty_high"], x["is_range"], x["unit"], x["item"], x["note"]) for x in lines]
    assert got == [
        ("1.5 tbsp Öl", 1.5, None, False, "tbsp", "Öl", "mild"),
        ("2-3 Eier", 2.0, 3.0, True, None, "Eier", None),
        ("200 g Mehl", 200.0, None, False, "g", "Mehl", None),
        ("1,5 EL Öl (mild)", 1.5, None, False, "EL", "Öl", "mild"),
        ("ein Becher", 1.0, None, False, "Becher", "Sahne", None),
    ]
