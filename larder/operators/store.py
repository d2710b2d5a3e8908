"""Stored versions: change detection with locks, selective upsert, backups, capped history, soft deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, fields: list[str], locks: str | None = None) -> DataFrame:
    """One row for each key and field whose value differs: (key, field, old, new, locked).

    Keys on one side only count as differing in every field that is not null. ``locks`` is an array column of ``old``.
    """
    a = old.select(F.col(key), *[F.col(f).cast("string").alias(f"_o_{f}") for f in fields], (F.col(locks) if locks else F.array().cast("array<string>")).alias("_locks"))
    b = new.select(F.col(key), *[F.col(f).cast("string").alias(f"_n_{f}") for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_o_{f}").alias("old"), F.col(f"_n_{f}").alias("new")) for f in fields])
    both = a.join(b, key, "full_outer").select(key, "_locks", F.explode(F.filter(pairs, lambda p: ~p["old"].eqNullSafe(p["new"]))).alias("p"))
    return both.select(key, "p.field", "p.old", "p.new", F.coalesce(F.array_contains("_locks", F.col("p.field")), F.lit(False)).alias("locked"))


def upsert(old: DataFrame, new: DataFrame, key: str, fields: list[str], locks: str | None = None, dry_run: bool = False, force: bool = False) -> DataFrame:
    """``old`` with the values of ``new``: locked fields keep theirs unless forced, new keys are added; unchanged in a dry run."""
    if dry_run:
        return old.select(key, *fields)
    a = old.select(F.col(key), F.lit(True).alias("_had"), *[F.col(f).alias(f"_o_{f}") for f in fields], (F.col(locks) if locks and not force else F.array().cast("array<string>")).alias("_locks"))
    both = a.join(new.select(key, F.lit(True).alias("_has"), *fields), key, "full_outer")
    keep = lambda f: F.col("_has").isNull() | (F.col("_had").isNotNull() & (F.coalesce(F.array_contains("_locks", f), F.lit(False))))
    return both.select(key, *[F.when(keep(f), F.col(f"_o_{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def backup(df: DataFrame, key: str, fields: list[str], stamp: str) -> DataFrame:
    """(key, name, value) of the fields under their names with the time of the run, null values left out."""
    entries = F.array(*[F.struct(F.lit(f"{f}_bak_{stamp}").alias("name"), F.col(f).cast("string").alias("value")) for f in fields])
    return df.select(key, F.explode(F.filter(entries, lambda e: e["value"].isNotNull())).alias("e")).select(key, "e.name", "e.value")


def capped_history(log: DataFrame, key: str, newest_by: list[Column], most: int = 10) -> DataFrame:
    """The newest entries of each key, at most ``most``."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*newest_by))).where(F.col("_n") <= most).drop("_n")


def stale(df: DataFrame, version: str, current: str) -> DataFrame:
    """Rows parsed by another version than the current one."""
    return df.where(~F.col(version).eqNullSafe(F.lit(current)))


def with_categories(names: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """``known`` and the names that it lacks, once each."""
    missing = names.select(name).where(F.col(name).isNotNull() & (F.trim(name) != "")).distinct().join(known.select(name), name, "left_anti")
    return known.select(name).unionByName(missing)


def soft_delete(posts: DataFrame, post_id: int, token: str) -> DataFrame:
    """``posts`` (post_id, token, status) with the post in the trash where the token fits."""
    return posts.withColumn("status", F.when((F.col("post_id") == post_id) & (F.col("token") == token), "trash").otherwise(F.col("status")))


def lead_image(own: Column, category: Column, default: str) -> Column:
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(category, F.lit("")), F.lit(default))


def log_tail(log: DataFrame, order: str, lines: int) -> DataFrame:
    """The last lines of a log, oldest first."""
    return log.orderBy(F.desc(order)).limit(lines).orderBy(order)
