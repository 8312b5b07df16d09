"""Ranking and calibration metrics over confidence atoms: scores are heavily tied, so every metric begins with counts per distinct score.

An atom table has a row per (group, score); the windows below run over atoms, not over observations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.functions.expressions import decimal_round, share
from tandemlab.sources.tables import materialize


def atoms(obs: DataFrame, by: list[str]) -> DataFrame:
    """(by, conf, n, pos): observations and correct ones with a valid confidence at each distinct score."""
    return obs.filter("c").groupBy(*by, "conf").agg(F.count("*").alias("n"), F.count_if("y").alias("pos"))


def auroc(atom: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve, ties counted half; null when one class is missing."""
    below = Window.partitionBy(*by).orderBy("conf").rowsBetween(Window.unboundedPreceding, -1)
    neg = F.col("n") - F.col("pos")
    walked = atom.withColumn("below", F.coalesce(F.sum(neg).over(below), F.lit(0)))
    wins = F.sum(F.col("pos") * F.col("below") + 0.5 * F.col("pos") * neg)
    return walked.groupBy(*by).agg(F.sum("n").alias("n"), F.round(F.try_divide(wins, (F.sum("pos") * F.sum(neg)).cast("double")), 8).alias("auroc"))


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m for whole m >= 0: summed up to 32, beyond by its asymptotic series, which is exact to the last digit there."""
    exact = F.array(*[F.lit(math.fsum(1 / k for k in range(1, n + 1))) for n in range(33)])
    x = F.greatest(m, F.lit(1)).cast("double")
    series = F.ln(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, 4)) - 1 / (252 * F.pow(x, 6))
    return F.when(m <= 32, F.element_at(exact, F.least(m, F.lit(32)).cast("int") + 1)).otherwise(series)


def aurc(atom: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """Area under the risk-coverage curve, averaged within ties: the k-th row of an atom of error rate e has risk (E_above + k e) / (N_above + k).

    The sum over an atom of n rows is n e + (E - N e) (H(N + n) - H(N)) with harmonic numbers H, so an atom costs the same whatever it holds.
    ``totals``: (by, total) counts all observations; the operational area is the normalised one times valid / total.
    """
    above = Window.partitionBy(*by).orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, -1)
    err = F.col("n") - F.col("pos")
    walked = atom.withColumn("n0", F.coalesce(F.sum("n").over(above), F.lit(0))).withColumn("e0", F.coalesce(F.sum(err).over(above), F.lit(0))).withColumn("e", err / F.col("n"))
    inner = F.col("n") * F.col("e") + (F.col("e0") - F.col("n0") * F.col("e")) * (harmonic(F.col("n0") + F.col("n")) - harmonic(F.col("n0")))
    per = walked.groupBy(*by).agg(F.sum(inner).alias("s"), F.sum("n").alias("valid"))
    return per.join(totals, by).select(*by, "valid", F.round(F.col("s") / F.col("valid"), 8).alias("aurc"), F.round(F.col("s") / F.col("total"), 8).alias("operational_aurc"))


def pool(n: Sequence[int], pos: Sequence[int]) -> list[int]:
    """The block of each place after pooling adjacent violators of a rising rate pos / n; whole numbers only, in linear time."""
    blocks: list[list[int]] = []  # n, pos, places
    for a, b in zip(n, pos, strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            x = blocks.pop()
            blocks[-1] = [blocks[-1][i] + x[i] for i in range(3)]
    return [i for i, block in enumerate(blocks) for _ in range(block[2])]


def isotonic(atom: DataFrame, by: list[str]) -> DataFrame:
    """(by, conf, n, pos, fit): the isotonic fit of correctness on score by pooling adjacent violators, ties pooled first.

    Scores are cut into ranges of about equal size, whatever the skew of groups, and pooled within them on many tasks; what is pooled stays
    pooled, so the blocks of all ranges of a group, which are far fewer, are pooled again to the same fit.
    """
    types = {f.name: f.dataType.simpleString() for f in atom.schema}
    keys = ", ".join(f"{k} {types[k]}" for k in by)

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [pdf for pdf in batches if len(pdf)]
        if parts:  # a range: bounded by the ranges' number
            for _, pdf in pd.concat(parts).groupby(by, sort=False, dropna=False):
                yield pdf.sort_values("conf").assign(block=lambda x: pool(x["n"].to_list(), x["pos"].to_list()))

    cut = atom.select(*by, "conf", "n", "pos").repartitionByRange(int(atom.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "conf").withColumn("range", F.spark_partition_id())
    placed = materialize(cut.mapInPandas(within, f"{keys}, conf double, n bigint, pos bigint, range int, block bigint"))
    blocks = placed.groupBy(*by, "range", "block").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["range", "block"])
        last = pool(pdf["n"].to_list(), pdf["pos"].to_list())
        sums = pdf.groupby(last)[["n", "pos"]].transform("sum")
        return pdf[[*by, "range", "block"]].assign(fit=sums["pos"] / sums["n"])

    fits = blocks.groupBy(*by).applyInPandas(across, f"{keys}, range int, block bigint, fit double")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"f.{k}")) for k in [*by, "range", "block"]])
    return placed.alias("a").join(fits.alias("f"), on).select(*[F.col(f"a.{k}") for k in [*by, "conf", "n", "pos"]], "f.fit")


def corp(atom: DataFrame, by: list[str]) -> DataFrame:
    """Brier score with its isotonic decomposition: brier = mcb - dsc + unc, and the ratios to unc (null when unc is 0)."""
    fit = isotonic(atom, by)
    neg = F.col("n") - F.col("pos")
    sq = lambda p: F.col("pos") * F.pow(1 - p, 2) + neg * F.pow(p, 2)
    agg = fit.groupBy(*by).agg(F.sum("n").alias("n"), (F.sum("pos") / F.sum("n")).alias("base"), (F.sum(sq(F.col("conf"))) / F.sum("n")).alias("brier"), (F.sum(sq(F.col("fit"))) / F.sum("n")).alias("recal"))
    unc = F.col("base") * (1 - F.col("base"))
    cols = {"base_rate": F.col("base"), "brier": F.col("brier"), "mcb": F.col("brier") - F.col("recal"), "dsc": unc - F.col("recal"), "unc": unc}
    ratio = {"brier_skill": F.try_divide(unc - F.col("brier"), unc), "dsc_share": F.try_divide(unc - F.col("recal"), unc), "mcb_share": F.try_divide(F.col("brier") - F.col("recal"), unc)}
    return agg.select(*by, "n", *[decimal_round(v).alias(k) for k, v in (cols | ratio).items()])


def quantisation(atom: DataFrame, by: list[str]) -> DataFrame:
    """Distinct scores, entropy in bits and its maximum, the largest atom (the lowest on a tie) and its mass."""
    total = Window.partitionBy(*by)
    p = F.col("n") / F.sum("n").over(total)
    withp = atom.withColumn("p", p)
    return withp.groupBy(*by).agg(
        F.count("*").alias("atoms"), F.round(-F.sum(F.col("p") * F.log2("p")), 8).alias("entropy_bits"), F.round(F.log2(F.count("*").cast("double")), 8).alias("max_entropy_bits"),
        F.max_by("conf", F.struct("n", -F.col("conf"))).alias("largest_atom"), F.round(F.max("p"), 8).alias("largest_mass"),
    )


def coverage_steps(atom: DataFrame, by: list[str]) -> DataFrame:
    """(by, conf, reachable): the share of valid confidences kept at each distinct threshold."""
    down = Window.partitionBy(*by).orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    return atom.select(*by, "conf", F.round(share(F.sum("n").over(down), F.sum("n").over(Window.partitionBy(*by))), 8).alias("reachable"))
