"""Queries over posts: related posts, pages of a list, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def related(posts: DataFrame, category: str = "category", most: int = 6, order: Column | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """(post_id, related_id, place): for every post up to ``most`` (1 to 24) others of its category.

    The order is one per candidate (by default a hash of its id, so it is the same in every run), so each category is
    ranked once and a post looks at the first ``most + 1``: the pairs made are at most ``most + 1`` for each post.
    """
    most = min(24, max(1, most))
    rank = F.row_number().over(Window.partitionBy(category).orderBy(order if order is not None else F.md5(F.col("post_id").cast("string")), "post_id"))
    candidates = posts if excluded is None else posts.join(excluded.select("post_id"), "post_id", "left_anti")
    top = candidates.select("post_id", category).withColumn("_n", rank).where(F.col("_n") <= most + 1).select(category, F.col("post_id").alias("related_id"), "_n")
    pairs = posts.select("post_id", category).join(top, category).where("post_id <> related_id")
    place = F.row_number().over(Window.partitionBy("post_id").orderBy("_n"))
    return pairs.withColumn("place", place).where(F.col("place") <= most).select("post_id", "related_id", "place")


#: Digits of the hash by which a category is ranked in parts, and the most posts of one request.
PART_DIGITS, MOST = 3, 24


def ranked(posts: DataFrame, category: str = "category") -> DataFrame:
    """(category, post_id, rank): posts in the order of the hash of their id, from 1 in each category.

    A category is ranked in parts by the first digits of the hash, each behind the posts of those before it, so a very common one is no task's alone.
    """
    hashed = posts.where(F.col(category).isNotNull()).select(category, "post_id", F.md5(F.col("post_id").cast("string")).alias("_hash")).withColumn("_part", F.substring("_hash", 1, PART_DIGITS))
    sizes = hashed.groupBy(category, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(category).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(category, "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(category, "_part").orderBy("_hash", "post_id"))
    return hashed.withColumn("_within", within).join(starts, [category, "_part"]).select(category, "post_id", (F.col("_before") + F.col("_within")).alias("rank"))


def claims(requests: DataFrame) -> DataFrame:
    """(visit, post_id, request_id, first, n): the places that each request (visit, post_id, request_id, at, n) takes behind those of its visit before it.

    A visit's requests for more posts related to a post never show one twice: as the order is fixed, what has been
    shown is how many have been. ``n`` is taken from 1 to ``MOST``; requests without a time are left out.
    """
    asked = requests.where(F.col("at").isNotNull()).select("visit", "post_id", "request_id", "at", F.least(F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)), F.lit(MOST)).cast("long").alias("n"))
    before = F.sum("n").over(Window.partitionBy("visit", "post_id").orderBy("at", "request_id").rowsBetween(Window.unboundedPreceding, -1))
    return asked.select("visit", "post_id", "request_id", F.coalesce(before, F.lit(0)).alias("first"), "n")


def served(claimed: DataFrame, order: DataFrame, category: str = "category") -> DataFrame:
    """(request_id, visit, post_id, related_id, place): the posts of ``order`` (see ``ranked``) at the places claimed, the post itself passed over.

    Every place is one equality, so the rows made are those returned.
    """
    own = order.select("post_id", category, F.col("rank").alias("_own"))
    place = F.explode(F.sequence(F.col("first") + 1, F.col("first") + F.col("n"))).alias("place")
    wanted = claimed.join(own, "post_id").select("request_id", "visit", "post_id", category, "_own", place)
    wanted = wanted.withColumn("rank", F.col("place") + F.when(F.col("place") >= F.col("_own"), 1).otherwise(0))
    return wanted.join(order.select(category, "rank", F.col("post_id").alias("related_id")), [category, "rank"]).select("request_id", "visit", "post_id", "related_id", "place")


def page(posts: DataFrame, offset: int, size: int = 6) -> DataFrame:
    """One page of posts, newest first, ties by the larger id."""
    return posts.orderBy(F.desc("date"), F.desc("post_id")).offset(offset).limit(size)


def seeds(meta: DataFrame) -> DataFrame:
    """Posts that have a recipe: a non-empty ingredients or schema entry in (post_id, key, value)."""
    return meta.where(F.col("key").isin("ingredients_struct", "schema_recipe_json") & F.col("value").isNotNull() & ~F.col("value").isin("", "[]", "{}")).select("post_id").distinct()
