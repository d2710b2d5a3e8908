"""Bytes, spoilt text, serialized values, file order, groups and nested items of pages, nested objects of documents."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from larder.sources import encodings, pages, serialized, sinks


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (b"\xef\xbb\xbf\xc3\xb6", "ö"), ("ö€".encode("utf-16"), "ö€"), ("<p>ö</p>".encode("utf-16-be"), "<p>ö</p>"), ("Grüße".encode(), "Grüße"), ("Grüße €".encode("cp1252"), "Grüße €"), (b'<meta charset="iso-8859-15">\xa4', '<meta charset="iso-8859-15">€'),
        (b'<meta http-equiv=x content="text/html; charset=koi8-r">\xc1', '<meta http-equiv=x content="text/html; charset=koi8-r">а'), (b"<meta charset=latin1>\x80", "<meta charset=latin1>€"), (b"<meta charset=nonsense>\xe4", "<meta charset=nonsense>ä"), (b"<meta charset=utf-8>\xe4", "<meta charset=utf-8>ä"),
        (b"\x81\xe4", "\x81ä"), (b"", ""), (None, None),
    ],
)
def test_character_sets(data, want):
    assert encodings.decoded(data) == want


def test_spoilt_text_is_put_right():
    good = "Käse – „Öl“ für 5 €, naïve Größe ½ 漢字"
    bad = good
    for _ in range(3):
        bad = "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in bad.encode())
        assert encodings.repaired(bad) == good
    for text in (good, "Ã", "São Ångström Â", "¡Olé!", "Â£ is £", "", "ÃÃÃ"):
        fixed = encodings.repaired(text)
        assert fixed == ("£ is £" if text == "Â£ is £" else text)
    assert encodings.sanitize("<b>Stück</b> &amp;  a &lt; b\n<!-- x -->1 < 2") == "Stück & a < b 1 < 2"


def test_references_end_with_a_semicolon():
    for text, want in (("a&amp", "a&amp"), ("&lt;b&gt; &copy=1 &#38; &#x26 &nosuch; &notit;", "<b> ©=1 & & &nosuch; &notit;".replace("©", "&copy")), ("&amp;amp;", "&amp;"), ("", "")):
        assert encodings.unescape(text) == want
    assert pages.page_record("<h1>x&amp;&amp; and&amp</h1>", wanted=("title",))["title"] == "x&& and&amp"
    assert pages.page_record('<link rel="canonical" href="/a?b=1&copy=2&amp;c">', wanted=("canonical",))["canonical"] == "/a?b=1&copy=2&c"


def test_serialized_values(spark):
    read = lambda t: json.loads(serialized.to_json(t)) if serialized.to_json(t) is not None else "broken"
    assert read('a:2:{i:0;s:6:"größ";i:1;a:1:{s:1:"k";N;}}') == ["größ", {"k": None}]
    assert read('s:5:"a";b"";') == 'a";b"' and read('s:6:"a";b"";') == "broken" and read('s:4:"a";b";') == 'a";b'
    assert read("a:2:{i:1;b:1;i:0;d:-1.5E+2;}") == {"1": True, "0": -150.0} and read("i:-3;") == -3 and read("N;") is None and read("d:NAN;") is None
    for bad in ("a:2:{i:0;i:1;}", "a:0:{", 'O:3:"abc":0:{}', "a:1:{i:0;R:1;}", "i:1;i:2;", "", None, "a:999999999:{}", "a:1:{i:0;" * 500 + "N;" + "}" * 500, 's:-1:"";', "d:..;"):
        assert read(bad) == "broken", bad
    rows = spark.createDataFrame([('a:1:{i:0;i:7;}',), ("[1]",), (None,)], "v string").select(F.to_json(serialized.unserialized(F.col("v"))).alias("j")).collect()
    assert [r["j"] for r in rows] == ["[7]", None, None]


def test_files_in_any_set_and_order(spark, tmp_path):
    for name, data in (("page 10.html", "Grüße".encode("cp1252")), ("Page 9.html", b"nine"), ("page 010.html", b"x"), ("b.txt", "2 EL Öl\r\n\n a<b ".encode("utf-16")), ("c.jsonld", b'{"@type":"Recipe"}'), ("d.json", b"{}")):
        (tmp_path / name).write_bytes(data)
    rows = pages.fixture_pages(spark, str(tmp_path)).orderBy("place").collect()
    assert [r["file"] for r in rows] == ["b.txt", "c.jsonld", "Page 9.html", "page 010.html", "page 10.html"]
    assert rows[0]["html"] == "<html><body><ul><li>2 EL Öl</li><li>a&lt;b</li></ul></body></html>" and rows[-1]["html"] == "Grüße" and "ld+json" in rows[1]["html"]


def test_absent_and_null_keys_are_told_apart(spark, tmp_path):
    (tmp_path / "x.expected.json").write_text('{"cases":[{"line":"a","unit":null},{"line":"b"}]}')
    rows = pages.labelled_cases(spark, str(tmp_path)).orderBy("idx").collect()
    assert [sorted(r["asserts"]) for r in rows] == [["line", "unit"], ["line"]] and rows[0]["unit"] is None


def test_groups_of_ingredients():
    page = '<div class="recipe"><p class="ingredient">Zutaten:</p><p class="ingredient">1 g a</p><h3 class="ingredient">Teig</h3><p class="ingredient">2 g b</p><span class="ingredient">FÜR DEN GUSS</span><p class="ingredient">3 g c</p><p class="ingredient">Leer:</p></div>'
    got = pages.page_record(page)
    assert got["ingredients"] == ["1 g a", "2 g b", "3 g c"] and got["groups"] == [{"name": "Teig", "items": ["2 g b"]}, {"name": "FÜR DEN GUSS", "items": ["3 g c"]}]
    listed = page.replace("</div>", "<ul><li>x</li></ul></div>")
    assert pages.page_record(listed)["groups"] == [] and pages.page_record(listed)["ingredients"] == ["x"]
    assert len(pages.page_record(listed, li_override=False)["groups"]) == 2
    assert set(pages.page_record(page, wanted=("canonical",))) == {"canonical"}


def test_nested_items():
    page = """<div itemscope itemtype="http://schema.org/Recipe"><b itemprop="name">Cake</b><div itemprop="image" itemscope><link itemprop="url" content="/a.jpg"><meta itemprop="contentUrl" content="/b.jpg"></div>
    <div itemprop="author" itemscope><span itemprop="name">Ann</span><img itemprop="image" src="no.jpg"></div><div itemprop="nutrition" itemscope><i itemprop="calories">5 kcal</i></div><i itemprop="fatContent">2 g</i></div>"""
    got = pages.page_record(page)["microdata"]
    assert (got["name"], got["images"], got["authors"], dict(got["nutrition"])) == ("Cake", ["/a.jpg", "/b.jpg"], ["Ann"], {"calories": "5 kcal", "fatContent": "2 g"})


def test_deep_pages_take_linear_time():
    page = '<div class="recipe">' * 3000 + "serves 4 <p>text</p>" + "</div>" * 3000
    assert pages.page_record(page)["servings"] == "4"
    assert len(pages.recipe_nodes(pages.tree('<script type="application/ld+json">' + '{"mainEntity":' * 200 + '{"@type":["Recipe"],"name":"a<b>c</b>"}' + "}" * 200 + "</script>"))) == 1


def test_nested_objects_by_source(spark):
    from larder.plans.assemble import assemble

    ld = '[{"@type":"Recipe","name":"A","nutrition":{"calories":"1 kcal"},"author":"Ann"},{"@type":"Recipe","alternateName":"B","name":"A2","image":"/x.jpg","author":{"@id":"https://x.e/people/bob/"},"nutrition":{"calories":"9","fatContent":"3 g"},"aggregateRating":{"ratingValue":4,"ratingCount":"7"}}]'
    page = f'<script type="application/ld+json">{ld}</script><div itemscope itemtype="https://schema.org/Recipe"><i itemprop="proteinContent">8 g</i><i itemprop="author">Cy</i></div>'
    rows = {r["page_id"]: r for r in assemble(spark.createDataFrame([(1, "https://x.e/", page), (2, "https://x.e/", page.split("</script>")[1]), (3, None, None)], "page_id long, url string, html string")).collect()}
    one = rows[1]
    # The second candidate has more fields, so it comes first.
    assert (one["name"], one["alternateName"], [a["name"] for a in one["author"]]) == ("A2", "B", ["bob"])
    assert one["nutrition"] == {"calories": "9", "fatContent": "3 g", "proteinContent": "8 g"} and one["nutritionSources"]["proteinContent"] == "microdata" and one["nutritionSources"]["calories"] == "jsonld"
    assert (one["aggregateRating"]["value"], one["aggregateRating"]["count"], one["sources"]["author"]) == (4.0, 7, ["jsonld"])
    assert [a["name"] for a in rows[2]["author"]] == ["Cy"] and rows[2]["aggregateRating"] is None and rows[3]["nutrition"] == {} and rows[3]["recipeIngredient"] == []


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "id long, x string, y string")
    assert sorted(map(tuple, sinks.long_metadata(df, "id", {"x": F.col("x"), "y": F.col("y")}).collect())) == [(1, "x", "a"), (2, "x", "b"), (2, "y", "c")]
    sinks.write_records(df, str(tmp_path / "r"), partition_by=["x"])
    sinks.write_records(df, str(tmp_path / "r"), partition_by=["x"])
    assert spark.read.parquet(str(tmp_path / "r")).count() == 4
    sinks.write_report(df, str(tmp_path / "j"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "j")).collect()) == ['{"id":1,"x":"a"}', '{"id":2,"x":"b","y":"c"}']
    shown = spark.range(1).select(sinks.render(F.lit("Cake"), F.array(F.lit("1 g a")), F.array(F.lit("Mix"), F.lit("Bake")))).first()[0]
    assert shown == "Cake\n- 1 g a\n1. Mix\n2. Bake"
