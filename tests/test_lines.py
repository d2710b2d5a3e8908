from __future__ import annotations

import pytest

from larder.operators.lines import parse_lines

VECTORS = [
    ("1½ EL Zucker", 1.5, None, "EL", "Zucker", None),
    ("2–3 TL Salz", 2, 3, "TL", "Salz", None),
    ("ca. 0,75 l Wasser", 0.75, None, "l", "Wasser", None),
    ("2x 200 g Tomaten", 2, None, None, "x 200 g Tomaten", None),
    ("Prise Salz", None, None, None, "Prise Salz", None),
    ("½ Paprika, rot", 0.5, None, None, "Paprika, rot", None),
    ("0,50 Stück Zitrone (Saft)", 0.5, None, None, "Stück Zitrone", "Saft"),
    ("ca. 15 g Ingwer-Stück", 15, None, "g", "Ingwer - Stück", None),
    ("1 /2 TL Kurkuma", 0.5, None, "TL", "Kurkuma", None),
    ("einer halben Zitrone", 0.5, None, None, "Zitrone", None),
    ("Saft einer halben Zitrone", None, None, None, "Saft einer halben Zitrone", None),
    ("1,5 Liter Wasser", 1.5, None, "Liter", "Wasser", None),
    ("10/2 g X", 1, None, "g", "X", None),
    ("2 tbsp Mehl", 2, None, None, "tbsp Mehl", None),
    ("Chili, optional", None, None, None, "Chili", "optional"),
    ("1 Pck. Backpulver", 1, None, "Pck", ". Backpulver", None),
    ("1.000 g Mehl", 1, None, "g", "Mehl", None),
    ("3EL Öl", 3, None, "EL", "Öl", None),
    ("Kartoffeln ca. 500 g", None, None, None, "Kartoffeln 500 g", None),
]


def test_simple_vectors(spark):
    df = spark.createDataFrame([(i, v[0]) for i, v in enumerate(VECTORS)], "i int, raw string")
    got = {r["i"]: r for r in parse_lines(df, "raw", "simple").collect()}
    for i, (raw, *want) in enumerate(VECTORS):
        r = got[i]
        assert [r["qty_low"], r["qty_high"], r["unit"], r["item"], r["note"]] == want, raw


def test_null_empty_and_division_by_zero(spark):
    got = parse_lines(spark.createDataFrame([(None,), ("",), ("1/0 g X",)], "raw string"), "raw").collect()
    assert got[0]["item"] is None and got[0]["qty_low"] is None
    assert got[1]["item"] == "" and got[1]["unit"] is None
    assert got[2]["qty_low"] is None and got[2]["item"] == "1/0 g X"


@pytest.mark.parametrize(("raw", "low", "high", "unit", "item", "note"), [("3-2 Zehen Knoblauch, fein gehackt", 2, 3, "clove", "Knoblauch", "fein gehackt"), ("2 tbsp frische Petersilie", 2, None, "tbsp", "Petersilie", "frisch"), ("2 Knoblauchzehen", 2, None, "clove", "Knoblauch", None)])
def test_modular(spark, raw, low, high, unit, item, note):
    r = parse_lines(spark.createDataFrame([(raw,)], "raw string"), "raw", "modular").first()
    assert [r["qty_low"], r["qty_high"], r["unit"], r["item"], r["note"]] == [low, high, unit, item, note]
