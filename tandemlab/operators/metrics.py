"""Decomposable metrics: sums over observations and a final expression over the sums, for groups, contrasts and bootstraps alike."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemlab.functions.expressions import accepts, share


@dataclass(frozen=True)
class Metric:
    """``sums``: name -> column added up per unit; ``finish``: from a lookup of summed columns to the metric, null where it is undefined."""

    sums: Callable[[float], dict[str, Column]]
    finish: Callable[[Callable[[str], Column]], Column]


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("bigint")


_CONF = lambda: F.when(F.col("c"), F.col("conf")).otherwise(0.0)
METRICS: dict[str, Metric] = {
    "accuracy": Metric(lambda t: {"n": F.lit(1), "y": _flag(F.col("y"))}, lambda s: share(s("y"), s("n"))),
    "coverage": Metric(lambda t: {"n": F.lit(1), "k": _flag(accepts(t))}, lambda s: share(s("k"), s("n"))),
    "risk": Metric(lambda t: {"k": _flag(accepts(t)), "e": _flag(accepts(t) & ~F.col("y"))}, lambda s: share(s("e"), s("k"))),
    "invalid_rate": Metric(lambda t: {"n": F.lit(1), "i": _flag(~F.col("c"))}, lambda s: share(s("i"), s("n"))),
    "mean_confidence": Metric(lambda t: {"v": _flag(F.col("c")), "s": _CONF()}, lambda s: F.try_divide(s("s"), s("v").cast("double"))),
    "brier": Metric(lambda t: {"v": _flag(F.col("c")), "b": F.when(F.col("c"), F.pow(F.col("conf") - F.col("y").cast("double"), 2)).otherwise(0.0)}, lambda s: F.try_divide(s("b"), s("v").cast("double"))),
}


def evaluate(obs: DataFrame, names: list[str], by: list[str], tau: float) -> DataFrame:
    """(by, one column per metric) in one aggregation."""
    sums = {f"{m}_{k}": F.sum(v) for m in names for k, v in METRICS[m].sums(tau).items()}
    agg = obs.groupBy(*by).agg(*[v.alias(k) for k, v in sums.items()])
    return agg.select(*by, *[METRICS[m].finish(lambda k, m=m: F.col(f"{m}_{k}")).alias(m) for m in names])


#: Outcomes of response surfaces: a number per observation, null where the outcome is undefined.
OUTCOMES: dict[str, Callable[[float], Column]] = {
    "correctness": lambda t: F.col("y").cast("double"),
    "coverage": lambda t: accepts(t).cast("double"),
    "invalid": lambda t: (~F.col("c")).cast("double"),
    "selective_error": lambda t: F.when(accepts(t), (~F.col("y")).cast("double")),
}
