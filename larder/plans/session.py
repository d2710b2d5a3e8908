"""Session defaults of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}


def session(master: str | None = None, partitions: int | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """A session with UTC, AQE with skew handling, and Arrow; shuffle partitions are left to AQE unless named."""
    builder = SparkSession.builder.appName("larder").config(map={**DEFAULTS, **({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}), **(extra or {})})
    return (builder.master(master) if master else builder).getOrCreate()


def tasks(spark: SparkSession) -> int:
    """Tasks that rows are spread over: as many as the session shuffles to, one for each core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by their key before work on each of them: narrow tables lie in few row groups, and a row group is read by one task."""
    return df.repartition(tasks(df.sparkSession), key)
