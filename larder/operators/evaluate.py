"""Evaluation of parsed lines against labelled ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.quantity import float_equals
from larder.functions.text import slug
from larder.functions.units import canonical_unit

METRICS = ("qty_parse_rate", "range_detect_rate", "decimal_comma_clean", "unit_attach_clean", "note_separation_ok")


def aligned(expected: DataFrame, actual: DataFrame, file: str = "file", idx: str = "idx") -> DataFrame:
    """Expected and actual rows by place: columns of ``expected`` get e_, of ``actual`` a_, missing sides are null."""
    e = expected.select(file, idx, *[F.col(c).alias(f"e_{c}") for c in expected.columns if c not in (file, idx)])
    a = actual.select(file, idx, *[F.col(c).alias(f"a_{c}") for c in actual.columns if c not in (file, idx)])
    return e.join(a, [file, idx], "full_outer")


def compare_unit(unit: Column) -> Column:
    return F.coalesce(canonical_unit(unit), F.lower(F.trim(unit)))


def same_text(a: Column, b: Column) -> Column:
    """Whether two texts agree in their letters and digits; null is as good as empty."""
    return F.coalesce(slug(a), F.lit("")) == F.coalesce(slug(b), F.lit(""))


def collapsed(low: Column, high: Column) -> Column:
    """struct(low, high) where a range of equal ends is a single quantity."""
    return F.struct(low.alias("low"), F.when(float_equals(low, high), None).otherwise(high).alias("high"))


def judged(pairs: DataFrame) -> DataFrame:
    """``pairs`` with a verdict for each metric, null where it asserts nothing."""
    e, a = collapsed(F.col("e_low"), F.col("e_high")), collapsed(F.col("a_qty_low"), F.col("a_qty_high"))
    same = float_equals(e["low"], a["low"]) & float_equals(e["high"], a["high"])
    return pairs.select(
        "*",
        F.when(e["low"].isNotNull(), a["low"].isNotNull()).alias("qty_parse_rate"),
        F.when(e["high"].isNotNull(), same).alias("range_detect_rate"),
        F.when(F.col("e_line").rlike(r"\d,\d"), same).alias("decimal_comma_clean"),
        F.when(F.col("e_unit").isNotNull(), compare_unit(F.col("e_unit")).eqNullSafe(compare_unit(F.col("a_unit")))).alias("unit_attach_clean"),
        F.when(F.col("e_line").isNotNull(), same_text(F.col("e_note"), F.col("a_note"))).alias("note_separation_ok"),
    )


def metrics(verdicts: DataFrame, by: str = "file") -> DataFrame:
    """(file, metric, ok, total) of the verdicts."""
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("ok")) for m in METRICS])
    each = verdicts.select(by, F.explode(entries).alias("m")).where("m.ok is not null")
    return each.groupBy(by, F.col("m.metric").alias("metric")).agg(F.count_if("m.ok").alias("ok"), F.count("*").alias("total"))


def engine_difference(a: Column, b: Column, a_score: Column, b_score: Column) -> Column:
    """identical, improved or different."""
    return F.when(a.eqNullSafe(b), "identical").when(b_score > a_score, "improved").otherwise("different")


def fixture_status(errors: Column, ingredients: Column, warned: Column) -> Column:
    """fail with an error or no ingredient, warn with warnings, else ok."""
    return F.when((errors > 0) | (ingredients == 0), "fail").when(warned > 0, "warn").otherwise("ok")
