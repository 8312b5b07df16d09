"""Decisions: step-down adjustment, exact bounds, certification, transport of thresholds and classification of contrasts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.functions.expressions import accepts, share


def holm(tests: DataFrame, family: list[str], p: str, name: Column, alpha: float = 0.05) -> DataFrame:
    """``tests`` with adjusted and reject: Holm's step-down within ``family`` (all together when empty), ties by ``name``; p of null stays out.

    A family is a plan's list of contrasts: small, and one window row each.
    """
    keys = family or [F.lit(1)]
    named = tests.filter(F.col(p).isNotNull()).withColumn("__name", name)
    order = Window.partitionBy(*keys).orderBy(p, "__name")
    m = F.count("*").over(Window.partitionBy(*keys))
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    walked = named.withColumn("__s", step)
    adjusted = F.max("__s").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return walked.withColumn("adjusted", F.round(adjusted, 8)).withColumn("reject", F.col("adjusted") <= alpha).drop("__name", "__s")


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 20_000) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction (modified Lentz), for whole batches at once.

    The fraction is taken on the side where it converges in a number of rounds that grows with the root of a and b.
    """
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    front = np.exp(np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b, strict=True)]) + a * np.log(np.maximum(x, tiny)) + b * np.log1p(-x)) / a
    keep = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c, d = np.ones_like(x), 1 / keep(1 - (a + b) * x / (a + 1))
    total = d.copy()
    for m in range(1, rounds):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / keep(1 + even * d), keep(1 + even / c)
        total = total * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / keep(1 + odd * d), keep(1 + odd / c)
        step = d * c
        total = total * step
        if np.all(np.abs(step - 1) < 1e-13):
            break
    return np.where(flip, 1 - front * total, front * total)


def binomial_upper_bounds(errors: np.ndarray, trials: np.ndarray, confidence: float = 0.95, steps: int = 60) -> np.ndarray:
    """One-sided Clopper-Pearson upper bounds of a batch: the p at which a beta distribution of (errors + 1, trials - errors) reaches ``confidence``.

    Found by bisection. 1 when all trials are errors, NaN without trials.
    """
    e, n = errors.astype(float), trials.astype(float)
    out = np.where(n > 0, 1.0, np.nan)
    some = (n > 0) & (e < n)
    if some.any():
        a, b = e[some] + 1, n[some] - e[some]
        low, high = e[some] / n[some], np.ones(int(some.sum()))
        for _ in range(steps):
            mid = (low + high) / 2
            over = incomplete_beta(a, b, mid) >= confidence
            low, high = np.where(over, low, mid), np.where(over, mid, high)
        out[some] = high
    return out


def binomial_upper(errors: int, trials: int, confidence: float = 0.95) -> float | None:
    """The bound of one row; null without trials."""
    got = binomial_upper_bounds(np.array([errors]), np.array([trials]), confidence)[0]
    return None if np.isnan(got) else float(got)


def with_upper_bound(rows: DataFrame, errors: str, trials: str, confidence: float = 0.95) -> DataFrame:
    """``rows`` (one per group) with ``upper``: the exact bound, by Arrow batches; null where either count is."""

    @F.pandas_udf("double")
    def bound(e: pd.Series, n: pd.Series) -> pd.Series:
        known = (e.notna() & n.notna()).to_numpy()
        out = np.full(len(e), np.nan)
        out[known] = binomial_upper_bounds(e[known].to_numpy(dtype=float), n[known].to_numpy(dtype=float), confidence)
        return pd.Series(out)

    got = rows.withColumn("upper", F.round(bound(F.col(errors), F.col(trials)), 6))
    return got.withColumn("upper", F.when(~F.isnan("upper"), F.col("upper")))


def certify(obs: DataFrame, policies: DataFrame, by: list[str], target: float, minimum_coverage: float, confidence: float = 0.95) -> DataFrame:
    """The frozen threshold of each group on certification rows: coverage, risk, exact bound, and certified or infeasible with the reason."""
    joined = obs.join(policies.filter(F.col("threshold").isNotNull()).select(*by, "threshold"), by)
    acc = accepts(F.col("threshold"))
    agg = joined.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(acc).alias("accepted"), F.count_if(acc & ~F.col("y")).alias("errors"))
    bounded = with_upper_bound(agg, "errors", "accepted", confidence)
    coverage = share(F.col("accepted"), F.col("n"))
    thin, loose = coverage < minimum_coverage, F.col("upper").isNull() | (F.col("upper") > target)
    return bounded.select(*by, "n", "accepted", "errors", F.round(coverage, 8).alias("coverage"), F.round(share(F.col("errors"), F.col("accepted")), 8).alias("risk"), "upper",
                          F.when(thin | loose, "infeasible").otherwise("certified").alias("status"), F.when(thin, "coverage").when(loose, "bound").alias("reason"))


def transport(obs: DataFrame, policies: DataFrame, reference: str, target: float) -> DataFrame:
    """(run_id, cond, ...): a frozen numeric threshold applied unchanged to every condition, against the reference and the target coverage."""
    joined = obs.join(policies.filter(F.col("threshold").isNotNull()).select("run_id", "threshold"), "run_id")
    acc = accepts(F.col("threshold"))
    agg = joined.groupBy("run_id", "cond").agg(share(F.count_if(acc), F.count("*")).alias("k"), share(F.count_if(acc & ~F.col("y")), F.count_if(acc)).alias("r"))
    ref = agg.filter(F.col("cond") == reference).select("run_id", F.col("k").alias("k0"), F.col("r").alias("r0"))
    both = agg.filter(F.col("cond") != reference).join(ref, "run_id")
    return both.select("run_id", "cond", F.round("k", 8).alias("coverage"), F.round("r", 8).alias("risk"), F.round(F.col("r") - F.col("r0"), 8).alias("delta_risk"),
                       F.round(F.col("k") - F.col("k0"), 8).alias("delta_coverage"), F.round(F.col("k") - target, 8).alias("delta_from_target"))


def classify(rows: DataFrame, margin: float, low: str = "ci_low", high: str = "ci_high", reject: str = "reject") -> DataFrame:
    """``rows`` with equivalent, classification and overlap: a detected change comes first, then equivalence within the margin (strictly), then not estimable."""
    inside = (F.col(low) > -margin) & (F.col(high) < margin)  # null where the interval is
    hit = F.coalesce(F.col(reject), F.lit(False))
    label = F.when(hit, "change_detected").when(inside, "equivalent_within_margin").when(inside.isNull(), "not_estimable").otherwise("inconclusive")
    return rows.withColumn("equivalent", inside).withColumn("classification", label).withColumn("overlap", hit & F.coalesce(inside, F.lit(False)))


def separation(rows: DataFrame, equivalent: str = "equivalent", realisation: str = "realisation") -> DataFrame:
    """One row: the strongest realisation among equivalent contrasts, the weakest among the others, and whether the first is below the second."""
    eq = F.coalesce(F.col(equivalent), F.lit(False))
    agg = rows.filter(F.col(realisation).isNotNull()).agg(F.max(F.when(eq, F.col(realisation))).alias("max_equivalent"), F.min(F.when(~eq, F.col(realisation))).alias("min_other"), F.count_if(eq).alias("equivalent_contrasts"))
    return agg.withColumn("separated", F.col("max_equivalent") < F.col("min_other"))


def noninferior(rows: DataFrame, margin: float, high: str = "ci_high") -> DataFrame:
    """``rows`` with noninferior: the upper end of the interval is at most the margin."""
    return rows.withColumn("noninferior", F.col(high) <= margin)


def effect_report(draws: DataFrame, by: list[str], values: dict[str, float], levels: tuple[float, float] = (0.95, 0.9)) -> DataFrame:
    """(by, and of each value: replicates, variance, both intervals, equivalent, noninferior): what bootstrap draws say of shifted effects.

    ``values``: column -> margin. An effect is equivalent if its narrower interval lies strictly inside the margin, and noninferior if the upper
    end of that interval is at most the margin; undefined draws count for nothing, and without any all is null but the flags, which are false.
    """
    ends = [(level, side, p) for level in levels for side, p in (("low", (1 - level) / 2), ("high", 1 - (1 - level) / 2))]
    name = lambda v, level, side: f"{v}_{side}_{round(level * 100)}"
    aggs = []
    for v in values:
        aggs += [F.count(v).alias(f"{v}_replicates"), F.round(F.var_samp(v), 10).alias(f"{v}_variance")]
        aggs += [F.round(F.percentile(v, p), 6).alias(name(v, level, side)) for level, side, p in ends]
    out = draws.groupBy(*by).agg(*aggs)
    for v, margin in values.items():
        low, high = F.col(name(v, levels[1], "low")), F.col(name(v, levels[1], "high"))
        out = out.withColumn(f"{v}_equivalent", F.coalesce((low > -margin) & (high < margin), F.lit(False))).withColumn(f"{v}_noninferior", F.coalesce(high <= margin, F.lit(False)))
    return out
