"""Sinks: stored records as tables, long metadata, reports and labelled-line skeletons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_metadata(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, name, value): one row for each field that has a value."""
    entries = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("string").alias("value")) for n, c in fields.items()])
    return df.select(key, F.explode(F.filter(entries, lambda e: e["value"].isNotNull())).alias("e")).select(key, "e.name", "e.value")


def write_records(df: DataFrame, path: str, mode: str = "append", partition_by: list[str] | None = None) -> None:
    """Write records as Parquet."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Write rows as JSON lines."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def skeleton(lines: DataFrame) -> DataFrame:
    """(file, value): one JSON object of unlabelled cases for each file of (file, idx, line)."""
    case = F.struct("idx", F.struct("line", *[F.lit(None).cast("string").alias(k) for k in ("qty", "unit", "item", "note")]).alias("c"))
    cases = F.transform(F.array_sort(F.collect_list(case)), lambda x: x["c"])
    return lines.groupBy("file").agg(F.to_json(F.struct(cases.alias("cases")), {"ignoreNullFields": "false"}).alias("value"))


def render(title: Column, lines: Column, steps: Column) -> Column:
    """A plain text rendering of a recipe."""
    numbered = F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return F.concat_ws("\n", title, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"), F.array_join(numbered, "\n"))
