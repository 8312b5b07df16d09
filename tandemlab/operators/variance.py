"""Seeds, variance decomposition and the 2 x 2 decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seed_summary(cells: DataFrame, reference: str) -> DataFrame:
    """(run_id, cond): over seeds, the mean, population deviation and range of the accuracy difference to the reference, and whether its sign agrees."""
    acc = cells.groupBy("run_id", "cond", "seed").agg(F.avg(F.col("y").cast("double")).alias("acc"))
    ref = acc.filter(F.col("cond") == reference).select("run_id", "seed", F.col("acc").alias("ref"))
    d = acc.filter(F.col("cond") != reference).join(ref, ["run_id", "seed"]).withColumn("d", F.col("acc") - F.col("ref"))
    sign = F.when(F.col("d") != 0, F.signum("d"))
    return d.groupBy("run_id", "cond").agg(F.count("*").alias("seeds"), F.round(F.avg("d"), 8).alias("mean"), F.round(F.stddev_pop("d"), 8).alias("sd"), F.round(F.max("d") - F.min("d"), 8).alias("spread"), (F.countDistinct(sign) <= 1).alias("sign_consistent"))


def variance_split(cells: DataFrame, value: str = "y") -> DataFrame:
    """(run_id, cond): law of total variance of an indicator over items of two or more seeds: within, between, and the within share."""
    per = cells.groupBy("run_id", "cond", "item").agg(F.var_pop(F.col(value).cast("double")).alias("v"), F.avg(F.col(value).cast("double")).alias("m"), F.countDistinct("seed").alias("k")).filter("k >= 2")
    agg = per.groupBy("run_id", "cond").agg(F.count("*").alias("items"), F.avg("v").alias("within"), F.var_pop("m").alias("between")).filter("items >= 2")
    return agg.select("run_id", "cond", "items", F.round("within", 8).alias("within"), F.round("between", 8).alias("between"), F.round(F.try_divide(F.col("within"), F.col("within") + F.col("between")), 8).alias("within_share"))


def decomposition(grid: DataFrame, by: list[str]) -> DataFrame:
    """``grid``: (by, unit, r00, r10, r01, r11). Mean answer effect, readout effect and interaction over units with all four cells; null without any."""
    full = grid.filter(F.col("r00").isNotNull() & F.col("r10").isNotNull() & F.col("r01").isNotNull() & F.col("r11").isNotNull())
    c = F.col
    agg = full.groupBy(*by).agg(F.count("*").alias("units"), F.avg(c("r10") - c("r00")).alias("a"), F.avg(c("r01") - c("r00")).alias("b"), F.avg(c("r11") - c("r10") - c("r01") + c("r00")).alias("i"))
    return agg.select(*by, "units", F.round("a", 8).alias("answer_effect"), F.round("b", 8).alias("readout_effect"), F.round("i", 8).alias("interaction"))
