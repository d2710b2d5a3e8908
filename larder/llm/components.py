"""Connected components by alternating large-star and small-star steps.

Each step is a ``groupBy`` with a ``min`` (combined before the shuffle) and an equi-join, so
that a node with very many neighbours is never gathered in one task. A graph of at most
``LOCAL_EDGES`` distinct edges, counted first, is done by union-find in one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import cut

#: Edges of the largest graph that one task takes (16 bytes each).
LOCAL_EDGES = 500_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    stars = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stars.union(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def union_find(edges: Iterator[tuple[int, int]]) -> dict[int, int]:
    """The smallest node of its component for every node of an edge."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.setdefault(top, top)) != top:
            top = y
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(up)}


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = union_find(e for batch in batches for e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an edge; component is the smallest node reachable.

    ``edges`` is undirected; repeated edges and loops are allowed, rows with a null end are
    ignored, and no edges give an empty table. Lineage is cut in every round.
    """
    now = cut(
        edges.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .select(F.greatest(left, right).cast("long").alias("u"), F.least(left, right).cast("long").alias("v"))
        .distinct()
    )
    if now.count() <= LOCAL_EDGES:
        return cut(now.coalesce(1).mapInArrow(_local, "node long, component long"))
    before = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sign == before or not sign["n"]:
            break
        before = sign
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
