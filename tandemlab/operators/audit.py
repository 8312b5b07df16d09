"""Audits: set differences, strict joins and violations. An audit is sound when its result is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, rows): keys that stand more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("rows")).filter("rows > 1")


def missing_and_unexpected(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """(key, kind): expected and not found, or found and not expected."""
    e, f = expected.select(*key).distinct(), found.select(*key).distinct()
    return e.join(f, key, "left_anti").withColumn("kind", F.lit("missing")).unionByName(f.join(e, key, "left_anti").withColumn("kind", F.lit("unexpected")))


def mismatches(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """(key, fields): rows of both sides that differ, null-safely, with the names of the fields."""
    r = right.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    fields = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns]))
    return left.join(r, key).select(*key, F.array_join(fields, ",").alias("fields")).filter("fields != ''")


def strict_join(records: DataFrame, scores: DataFrame, key: str, provenance: list[str]) -> DataFrame:
    """(key, fault): what keeps records and scores from being joined one to one with equal provenance; empty where nothing does.

    Faults: 'record repeated', 'score repeated', 'no score', 'no record', and 'other <columns>' of a pair whose provenance differs.
    """
    r, s = records.groupBy(key).agg(F.count("*").alias("nr"), *[F.min(c).alias(f"r_{c}") for c in provenance]), scores.groupBy(key).agg(F.count("*").alias("ns"), *[F.min(c).alias(f"s_{c}") for c in provenance])
    other = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"r_{c}").eqNullSafe(F.col(f"s_{c}")), F.lit(c)) for c in provenance])), ",")
    fault = (
        F.when(F.col("ns").isNull(), "no score").when(F.col("nr").isNull(), "no record").when(F.col("nr") > 1, "record repeated").when(F.col("ns") > 1, "score repeated").when(other != "", F.concat(F.lit("other "), other))
    )
    return r.join(s, key, "full").select(key, fault.alias("fault")).filter("fault is not null")


def copies_that_differ(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields): keys whose rows do not agree, null-safely, in all ``fields``, with the names of those that differ; one aggregation."""
    odd = [F.when((F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1)))), F.lit(c)) for c in fields]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.array_compact(F.array(*odd)), ",").alias("fields")).filter("fields != ''")


def republish_difference(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """(.., side): rows of a stored result and its recomputation that the other lacks."""
    cols = sorted(stored.columns)
    a, b = stored.select(*cols), recomputed.select(*cols)
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("recomputed")))


def conflicts(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, kinds): keys with more than one value of ``column``."""
    return df.groupBy(*key).agg(F.countDistinct(column).alias("kinds")).filter("kinds > 1")
