"""Repairs of stored documents: seen before they are made, staged, checked, and published by a pointer.

A version is a folder of its own below a target, with the documents and the backups of what they replace. It is read back
and checked before a row that names it is written; readers take the newest version named. So a run that
fails leaves what is published as it was, and one that is repeated writes the same folder again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.display import german_number
from larder.functions.text import let
from larder.operators.lines import parse_lines
from larder.operators.store import backup
from larder.operators.stored import _entries, _text, materialized

#: What became of a document.
STATUSES = ("no_schema", "no_object", "no_lines", "repaired")


def written_lines(schema: Column) -> Column:
    """The lines of a document (variant) as they were written: texts, the raw text of objects, else their quantity, unit and item put together."""
    get = lambda v, key: F.nullif(F.try_variant_get(v, f"$.{key}", "string"), F.lit(""))
    made = lambda v: F.concat_ws(" ", get(v, "qty"), get(v, "unit"), F.coalesce(get(v, "item"), get(v, "name")))
    lines = F.transform(_entries(schema, "recipeIngredient"), lambda v: F.trim(F.coalesce(_text(v), F.try_variant_get(v, "$.raw", "string"), made(v))))
    return F.filter(lines, lambda t: t != "")


def _parsed(docs: DataFrame, key: str, schema: str, engine: str) -> DataFrame:
    raw = docs.select(key, F.posexplode(written_lines(F.try_parse_json(F.col(schema)))).alias("pos", "raw"))
    return parse_lines(raw, "raw", engine)


def preview(docs: DataFrame, key: str, schema: str = "schema", engine: str = "modular") -> DataFrame:
    """(key, pos, raw, shown): how each line would read if its document were parsed anew; nothing is stored."""
    qty = F.concat_ws("–", german_number(F.col("qty_low")), german_number(F.col("qty_high")))
    shown = F.concat_ws(" ", F.nullif(qty, F.lit("")), F.nullif("unit", F.lit("")), "item", F.when(F.col("note") != "", F.concat(F.lit("("), F.col("note"), F.lit(")"))))
    return _parsed(docs, key, schema, engine).select(key, "pos", "raw", shown.alias("shown"))


def repaired(docs: DataFrame, key: str, schema: str = "schema", engine: str = "modular") -> DataFrame:
    """(key, old, new, status, n_lines) of every document: its JSON with the lines parsed anew in place of its ingredients.

    Other fields stay. Documents that can't be repaired keep what they have; ``key`` is taken to be unique.
    """
    low, high = F.col("qty_low"), F.col("qty_high")
    qty = F.when(high.isNotNull(), F.to_variant_object(F.struct(low.alias("low"), high.alias("high")))).otherwise(low.cast("variant"))
    entry = F.struct("pos", "raw", qty.alias("qty"), "unit", "item", "note")
    # Variants have no order, so entries are ordered by their place alone.
    placed = lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)
    lines = _parsed(docs, key, schema, engine).groupBy(key).agg(F.array_sort(F.collect_list(entry), placed).alias("_lines"))
    fields = F.try_variant_get(F.try_parse_json(F.col("old")), "$", "map<string,variant>")
    made = F.to_variant_object(F.transform("_lines", lambda x: F.struct(x["raw"].alias("raw"), x["qty"].alias("qty"), x["unit"].alias("unit"), x["item"].alias("item"), x["note"].alias("note"))))
    names = ("recipeIngredient", "ingredientsParsed")
    new = F.to_json(F.map_concat(F.map_filter(fields, lambda k, _: ~k.isin(*names)), F.create_map(*[x for n in names for x in (F.lit(n), made)])))
    status = F.when(F.coalesce(F.col("old"), F.lit("")) == "", STATUSES[0]).when(fields.isNull(), STATUSES[1]).when(F.col("_lines").isNull(), STATUSES[2]).otherwise(STATUSES[3])
    joined = docs.select(key, F.col(schema).alias("old")).join(lines, key, "left").withColumn("status", status)
    return joined.select(key, "old", F.when(F.col("status") == STATUSES[3], new).otherwise(F.col("old")).alias("new"), "status", F.coalesce(F.size("_lines"), F.lit(0)).alias("n_lines"))


def rebuilt(docs: DataFrame, key: str, schema: str = "schema") -> DataFrame:
    """(key, rows): what is shown of each document, made again from its parsed entries, else from its ingredients; documents without any are left out."""
    rows = docs.select(key, let(F.try_parse_json(F.col(schema)), materialized).alias("rows"))
    return rows.where(F.size("rows") > 0)


def publish(staged: DataFrame, key: str, target: str, stamp: str, name: str = "schema") -> dict[str, int]:
    """Write the documents of ``staged`` (see ``repaired``) and backups of those replaced as version ``stamp``, check them, and make it the one that is read.

    Returns how many documents have which status. Raises ValueError, with nothing published, where keys repeat or are null, or a repaired document can't be read.
    """
    spark, folder = staged.sparkSession, f"{target}/versions/{stamp}"
    staged.write.mode("overwrite").parquet(f"{folder}/staged")
    kept = spark.read.parquet(f"{folder}/staged")
    broken = F.count_if((F.col("status") == STATUSES[3]) & F.try_parse_json("new").isNull())
    again = kept.groupBy(key).agg(F.count("*").alias("n")).agg(F.count_if((F.col("n") > 1) | F.col(key).isNull())).first()[0]
    row = kept.agg(broken.alias("broken"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]).first()
    if again or row["broken"]:
        raise ValueError(f"{folder} is not published: {again} keys are null or repeated, {row['broken']} documents can't be read")
    changed = kept.where((F.col("status") == STATUSES[3]) & ~F.col("old").eqNullSafe(F.col("new")))
    backup(changed.select(key, F.col("old").alias(name)), key, [name], stamp).write.mode("overwrite").parquet(f"{folder}/backups")
    kept.select(key, F.col("new").alias(name)).write.mode("overwrite").parquet(f"{folder}/documents")
    spark.createDataFrame([(stamp,)], "version string").coalesce(1).write.mode("overwrite").parquet(f"{target}/published/at={stamp}")
    return {s: row[s] for s in STATUSES}


def published(spark: SparkSession, target: str, version: str | None = None) -> DataFrame:
    """The documents of the newest version (or an earlier one) that is published."""
    named = spark.read.parquet(f"{target}/published").select("version")
    newest = named.agg(F.max("version")).first()[0] if version is None else version
    if version is not None and named.where(F.col("version") == version).isEmpty():
        raise ValueError(f"version {version} is not published")
    return spark.read.parquet(f"{target}/versions/{newest}/documents")
