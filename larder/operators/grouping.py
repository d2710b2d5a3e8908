"""Ingredient lines in groups under header lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that make a line without quantity a header, and unit words that make it a line.
HEADERS = ("BEILAGE", "SAUCE", "GARNITUR", "TOPPING", "MARINADE", "DRESSING", "FUELLUNG", "TEIG", "SPICE MIX")
LINE_UNITS = ("g", "kg", "ml", "l", "tl", "el", "tsp", "tbsp", "cup", "prise", "pinch", "dose", "bund", "oz", "lb", "can", "bunch")


def is_header(line: Column) -> Column:
    """A colon at the end, at least three letters all in capitals, or a header word; never with a quantity or unit."""
    t = F.trim(F.regexp_replace(line, r"\s+", " "))
    letters = F.regexp_replace(t, r"[^\p{L}]+", "")
    looks = t.rlike(r"^\s*\p{N}") | t.rlike(r"(?i)\b(" + "|".join(LINE_UNITS) + r")\b")
    named = F.upper(t).rlike("|".join(HEADERS))
    return F.coalesce((t != "") & ~looks & (t.rlike(r":\s*$") | ((F.char_length(letters) >= 3) & (F.upper(letters) == letters)) | named), F.lit(False))


def grouped(lines: DataFrame, by: str, order: str, line: str = "raw") -> DataFrame:
    """``lines`` with is_header, group_no (0 before the first header) and group_name, the header without its colon."""
    w = Window.partitionBy(by).orderBy(order)
    marked = lines.withColumn("is_header", is_header(F.col(line))).withColumn("group_no", F.sum(F.col("is_header").cast("long")).over(w))
    name = F.when(F.col("is_header"), F.regexp_replace(F.trim(line), r"[: ]+$", ""))
    return marked.withColumn("group_name", F.last(name, ignorenulls=True).over(w))


def assigned_once(lines: DataFrame, by: str, order: str, key: Column, group: str = "group_no") -> DataFrame:
    """Lines without later repeats of a key; each stays in the group where it came first."""
    w = Window.partitionBy(by, "_key").orderBy(order)
    return lines.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")
