"""The engines on labelled lines: how many quantities, units, notes and items each gets right."""

from __future__ import annotations

import pytest
from golden_lines import GOLDEN
from pyspark.sql import functions as F

from larder.operators import evaluate
from larder.operators.lines import parse_auto, parse_lines, parse_modular

LABELS = "file string, idx int, line string, low double, high double, unit string, item string, note string"


def scores(spark, engine):
    labels = spark.createDataFrame([(f, i, line, e.get("min_qty", e.get("qty")) and float(e.get("min_qty", e.get("qty"))), e.get("max_qty") and float(e["max_qty"]), e.get("unit"), e.get("item"), e.get("note")) for i, (f, line, e) in enumerate(GOLDEN)], LABELS)
    parsed = parse_lines(labels.select("file", "idx", "line"), "line", engine).drop("line")
    pairs = evaluate.judged(evaluate.aligned(labels, parsed))
    found = {r["metric"]: (r["ok"], r["total"]) for r in evaluate.metrics(pairs.withColumn("all", F.lit("x")), "all").collect()}
    found["item"] = pairs.where(evaluate.same_text(F.col("e_item"), F.col("a_item"))).count()
    return found


@pytest.mark.parametrize(("engine", "unit", "note", "item"), [("simple", 34, 95, 47), ("auto", 34, 95, 47), ("legacy", 77, 98, 94), ("modular", 102, 118, 114)])
def test_engines_on_the_golden_lines(spark, engine, unit, note, item):
    """What the reference's active path is expected to reach, and at least what the others do now."""
    found = scores(spark, engine)
    assert found["range_detect_rate"] == (3, 3) and found["qty_parse_rate"][0] >= 105 and found["qty_parse_rate"][1] == 106
    assert found["unit_attach_clean"] == (unit, 102) and found["note_separation_ok"] == (note, 121) and found["item"] == item


@pytest.mark.parametrize(
    ("raw", "low", "high", "unit", "item", "note"),
    [
        ("500 g Basmati-Reis", 500, None, "g", "Basmati-Reis", None), ("2 mittelgroße weiße Zwiebeln", 2, None, "piece", "weiße Zwiebeln", "mittelgroß"), ("ca. 2 Essl. Öl", 2, None, "tbsp", "Öl", None),
        ("1 Büschel Minze", 1, None, "piece", "Büschel Minze", None), ("3 bis 2 Stk. Eier", 2, 3, "piece", "Eier", None), ("10/4 l Milch", 2.5, None, "l", "Milch", None), ("1/0 g X", None, None, None, "1/0 g X", None),
        ("frisch gehackt", None, None, None, "gehackt", "frisch"), ("eine halbe Zitrone", 0.5, None, "piece", "Zitrone", None), ("2 EL Cajun-Gewürz", 2, None, "tbsp", "Cajun-Gewürz", None), ("200 g Cashewkerne, grob gehackt", 200, None, "g", "Cashewkerne", "grob gehackt"),
        ("15 g Ingwer-Stück", 15, None, "g", "Ingwer", "Stück"), ("Optional: kleine Röstzwiebeln", None, None, None, "Röstzwiebeln", "optional, klein"), ("2 Wasser", 2, None, None, "Wasser", None), (".5 TL Salz", 0.5, None, "tsp", "Salz", None), ("", None, None, None, "", None), (None, None, None, None, None, None),
    ],
)
def test_modular_lines(spark, raw, low, high, unit, item, note):
    r = parse_modular(spark.createDataFrame([(raw, 1)], "raw string, item_ int").drop("item_")).first()
    assert [r["qty_low"], r["qty_high"], r["unit"], r["item"], r["note"]] == [low, high, unit, item, note]


def test_tolerance_words_end(spark):
    r = parse_lines(spark.createDataFrame([("2 EL Cajun-Gewürz",), ("100 g Cashewkerne",), ("3 Carotten",), ("ca 3 EL Öl",), ("~5 g Salz",)], "raw string")).collect()
    assert [x["item"] for x in r] == ["Cajun - Gewürz", "Cashewkerne", "Carotten", "Öl", "Salz"]


def test_auto_says_what_it_fell_back_on(spark):
    lines = ["2 EL Mehl", "Paprika, rot", "Prise Salz", "1/0 g Mehl", "1 3/00 Zwiebel", "10/05 l X", "", None, "Salz (grob)"]
    rows = parse_auto(spark.createDataFrame([(x, "e") for x in lines], "raw string, item_ string")).collect()
    assert [(r["engine"], r["diagnosis"]) for r in rows] == [("first", None), *[("legacy", "nothing_found")] * 2, *[("legacy", "zero_denominator")] * 2, ("first", None), ("legacy", "nothing_found"), ("first", None), ("first", None)]
    assert [(r["unit"], r["item"], r["note"]) for r in rows[:3]] == [("EL", "Mehl", None), (None, "Paprika", "rot"), ("pinch", "Salz", None)]


def test_tokens_keep_places(spark):
    from larder.functions.tokens import tokens

    text = "2-3½ EL Chili- und x'y-Pulver."
    got = spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"))).first()[0]
    assert [t["text"] for t in got] == ["2", "-", "3½", "EL", "Chili-", "und", "x'y-Pulver."] and all(text[t["start"] : t["end"]] == t["text"] for t in got)
    assert [t["kind"] for t in got] == ["number", "dash", "number", "word", "word", "word", "word"]


def test_long_lines_are_parsed_whole(spark):
    r = parse_modular(spark.createDataFrame([("3 EL " + "Wort " * 20_000 + "(fein)",)], "raw string")).first()
    assert r["qty_low"] == 3 and r["unit"] == "tbsp" and r["note"] == "fein" and r["item"] == ("Wort " * 20_000).strip()
