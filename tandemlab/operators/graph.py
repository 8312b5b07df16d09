"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlab.sources.tables import drop_materialized, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star: every neighbour of u that is larger (large star) or not larger (small star) is tied to the least of u and its neighbours.

    The least neighbour is a partial aggregate, so a vertex with a third of all edges costs a skewed join at most, which AQE splits.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every vertex of ``edges`` (u bigint, v bigint); the component is its least vertex.

    Nulls and loops in ``edges`` are ignored, repeated edges count once, and an empty input gives an empty result. A round costs two
    aggregations and joins over the edges; their number grows with the logarithm of the longest path. Edges stay on the executors.
    """
    now = materialize(edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).select("u", "v").distinct())
    sign = None
    for _ in range(max_rounds):
        after = materialize(_star(_star(now, True), False))
        drop_materialized(now)
        now = after
        was, sign = sign, now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if was == sign:
            break
    else:
        raise RuntimeError("components did not converge")
    rooted = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return rooted.unionByName(rooted.select(F.col("component").alias("node"), "component").distinct())
