"""Threshold selection by one cumulative window over confidence atoms; a policy is a table keyed by its group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.functions.expressions import share


def candidates(obs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, threshold, accepted, errors, coverage, risk): every distinct valid confidence as a threshold; those that accept nothing are left out."""
    total = obs.groupBy(*by).agg(F.count("*").alias("n"))
    atom = obs.filter("c").groupBy(*by, "conf").agg(F.count_if("a").alias("k"), F.count_if(F.col("a") & ~F.col("y")).alias("e"))
    down = Window.partitionBy(*by).orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, 0)
    walked = atom.select(*by, F.col("conf").alias("threshold"), F.sum("k").over(down).alias("accepted"), F.sum("e").over(down).alias("errors"))
    return walked.join(total, by).filter("accepted > 0").withColumn("coverage", share(F.col("accepted"), F.col("n"))).withColumn("risk", share(F.col("errors"), F.col("accepted")))


def empirical_threshold(cand: DataFrame, by: list[str], target_risk: float) -> DataFrame:
    """The candidate of the highest coverage whose risk is within the target; on a tie the lowest threshold. No row where there is none."""
    ok = cand.filter(F.col("risk") <= target_risk)
    best = ok.groupBy(*by).agg(F.max_by(F.struct("threshold", "coverage", "risk", "accepted"), F.struct("coverage", -F.col("threshold"))).alias("x"))
    return best.select(*by, "x.*")


def contract_threshold(cand: DataFrame, groups: DataFrame, by: list[str], target_risk: float, minimum_coverage: float) -> DataFrame:
    """empirical_threshold with a least coverage: status 'candidate' or 'risk-contract infeasible', and the reason, for every group."""
    joined = groups.join(empirical_threshold(cand, by, target_risk), by, "left")
    low = F.col("coverage") < minimum_coverage
    return joined.select(
        *by, F.when(F.col("threshold").isNull() | low, "risk-contract infeasible").otherwise("candidate").alias("status"), "threshold", F.round("coverage", 8).alias("coverage"), F.round("risk", 8).alias("risk"),
        F.when(F.col("threshold").isNull(), "no threshold meets the risk target").when(low, "coverage below the minimum").alias("reason"),
    )


def fixed_coverage_threshold(cand: DataFrame, by: list[str], target: float) -> DataFrame:
    """The least coverage at or above the target, on a tie the highest threshold; else status 'target unattainable' with the best coverage."""
    fit = F.col("coverage") >= target
    agg = cand.groupBy(*by).agg(F.min_by(F.when(fit, F.struct("threshold", "coverage", "risk", "accepted")), F.when(fit, F.struct("coverage", -F.col("threshold")))).alias("x"), F.max("coverage").alias("best"))
    return agg.select(*by, F.when(F.col("x").isNull(), "target unattainable").otherwise("selected").alias("status"), F.col("x.threshold").alias("threshold"), F.coalesce("x.coverage", "best").alias("coverage"), F.col("x.risk").alias("risk"), F.coalesce("x.accepted", F.lit(0)).alias("accepted"))


def frozen_endpoint(obs: DataFrame, by: list[str], target_risk: float, minimum_coverage: float, target_coverage: float) -> DataFrame:
    """The rule that freezes a policy: the risk contract's threshold, else that of fixed coverage, else infeasible."""
    cand = candidates(obs, by)
    groups = obs.select(*by).distinct()
    risk = contract_threshold(cand, groups, by, target_risk, minimum_coverage).filter("status = 'candidate'").select(*by, F.col("threshold").alias("t1"))
    cover = fixed_coverage_threshold(cand, by, target_coverage).select(*by, F.col("threshold").alias("t2"))
    joined = groups.join(risk, by, "left").join(cover, by, "left")
    return joined.select(
        *by, F.coalesce("t1", "t2").alias("threshold"), F.when(F.col("t1").isNotNull(), "attained").otherwise("infeasible").alias("risk_contract"),
        F.when(F.col("t1").isNotNull(), "certified_risk_threshold").when(F.col("t2").isNotNull(), f"fixed_coverage_{target_coverage:.2f}").alias("endpoint"),
        F.when(F.coalesce("t1", "t2").isNull(), "threshold infeasible").otherwise("selected").alias("status"),
    )


def policy_tally(policies: DataFrame) -> DataFrame:
    """(status, risk_contract, endpoint, policies)."""
    return policies.groupBy("status", "risk_contract", F.coalesce("endpoint", F.lit("(none)")).alias("endpoint")).agg(F.count("*").alias("policies"))
