"""Distributed ranks: positions in a total order without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.sources.tables import materialize


def bucketed_rank(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: the 1-based position of each row within ``keys`` by (bucket, order).

    ``bucket`` must be a coarse, order-preserving prefix of the order (a hash prefix): rows are numbered within their bucket and shifted by
    the rows of earlier buckets, which are pre-aggregated counts. No task holds more than one bucket. Null keys form a group of their own.
    """
    df = df.withColumn("__b", bucket)
    counts = df.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__ob"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inner = Window.partitionBy(*keys, "__b").orderBy(*order)
    ranked = df.withColumn("__r", F.row_number().over(inner))
    on = F.col("__b").eqNullSafe(F.col("__ob"))
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return ranked.join(offsets, on).withColumn(out, (F.col("__off") + F.col("__r")).cast("bigint")).select(*[c for c in df.columns if c != "__b"], out)


def range_rank(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: the 1-based position of each row within ``keys`` by ``order`` (columns that tell all rows of a key apart).

    Rows are cut into ranges of (keys, order) of about equal size, whatever the skew of keys, numbered within them and shifted by the counts
    of earlier ranges. The rows are written down before their ranges are drawn from a sample, and with them, so nothing is computed twice.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = materialize(materialize(df).repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id()))
    return bucketed_rank(ranges, keys, F.col("__range"), [F.col(c) for c in order], out).drop("__range")
