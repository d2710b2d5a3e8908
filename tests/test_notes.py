from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from larder.functions import notes
from larder.functions.lexicon import LEXICONS, any_of, lexicon, merged
from larder.operators import stored
from larder.operators.lines import parse_modular


def one(spark, column, value):
    return spark.range(1).select(F.lit(value).cast("string").alias("v")).select(column(F.col("v")).alias("x")).first()["x"]


def test_lexicon_merges_in_order_and_once():
    de = lexicon("de_AT", {"adjectives": ("mild", "rot(e|er|es)?"), "own": ("x",)})
    assert de["adjectives"] == LEXICONS["de"]["adjectives"] + LEXICONS["en"]["adjectives"] + ("mild",)
    assert de["own"] == ("x",) and de["unit_aliases"] == ()
    assert lexicon("fr") == lexicon("en")
    assert merged({"a": ("1", "2")}, {"a": ("2", "3")}) == {"a": ("1", "2", "3")}


def test_patterns_match_umlauts_either_way():
    pattern = re.compile(any_of(LEXICONS["de"]["adjectives"]) + "$")
    assert all(pattern.match(w) for w in ("grüne", "gruener", "weiß", "weisse", "gewürfelt", "fein  gehackt")) and not pattern.match("Grün-kohl")


@pytest.mark.parametrize(
    ("raw", "unit", "item", "note"),
    [
        ("200 g TK Erbsen", "g", "Erbsen", "TK"),
        ("30 g Ingwer-Stück", "g", "Ingwer", "Stück"),
        ("2 EL Butter zum Braten", "tbsp", "Butter", "zum Braten"),
        ("3 kleine rote Zwiebeln, fein gehackt", "piece", "Zwiebeln", "klein, rot, fein gehackt"),
        ("2 EL Petersilie gehackt (glatt)", "tbsp", "Petersilie", "gehackt, glatt"),
        ("1 kg Rotkohl", "kg", "Rotkohl", None),
        ("1 rote", "piece", "rote", None),
        (None, None, None, None),
    ],
)
def test_modular_notes(spark, raw, unit, item, note):
    r = parse_modular(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (r["unit"], r["item"], r["note"]) == (unit, item, note)


def test_overlay_adds_adjectives(spark):
    lines = spark.createDataFrame([("2 EL milde Soße",)], "raw string")
    assert parse_modular(lines).first()["item"] == "milde Soße"
    r = parse_modular(lines, overlay={"adjectives": ("milde?",)}).first()
    assert (r["item"], r["note"]) == ("Soße", "milde")


@pytest.mark.parametrize(("text", "item", "note"), [("Reis (gekocht), warm", "Reis (gekocht)", "warm"), ("Reis, warm (heiß)", "Reis", "heiß, warm"), ("Reis, warm (warm)", "Reis", "warm"), ("", "", None), (None, None, None)])
def test_trailing_notes(spark, text, item, note):
    r = one(spark, notes.trailing_notes, text)
    assert (r["item"], r["note"]) == (item, note)


def test_number_tokens(spark):
    assert one(spark, notes.number_tokens, "1½ bis 2 Tassen, 3 – 4 und 1/2, .5") == ["1 1/2-2", "3-4", "1/2", "0.5"]
    assert one(spark, notes.number_tokens, "keine") == [] and one(spark, notes.number_tokens, None) is None


def test_stored_documents_of_any_form(spark):
    docs = spark.createDataFrame([(1, '{"recipeIngredient":"2 EL Salz"}'), (2, "broken"), (3, None), (4, "[]"), (5, '{"recipeIngredient":[" ",{"item":"x"}]}')], "post_id int, schema string")
    assert [(r["post_id"], [x["item"] for x in r["lines"]]) for r in stored.reparsed(docs, "post_id").collect()] == [(1, ["Salz"])]
    shown = {r["post_id"]: r["m"] for r in docs.select("post_id", stored.materialized(F.try_parse_json("schema")).alias("m")).collect()}
    assert [x["name"] for x in shown[1]] == ["2 EL Salz"] and not shown[4] and [x["name"] for x in shown[5]] == ["", "x"]
    assert docs.select(stored.listed(F.col("schema")).alias("l")).select(F.size("l").alias("n")).where("n > 0").count() == 2
