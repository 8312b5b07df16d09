"""Operational endpoints, outcome shares and summaries of observations at a threshold. All are one aggregation over one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemlab.functions.expressions import OUTCOMES, accepts, decimal_round, outcome, share


def endpoint_columns(tau: Column | float) -> list[Column]:
    """Aggregates: n, q (answer failure rate), coverage, risk (null when nothing is accepted), success, accepted, confidence_invalid."""
    acc = accepts(tau)
    n, accepted = F.count(F.lit(1)), F.count_if(acc)
    errors = F.count_if(acc & ~F.col("y"))
    invalid = F.coalesce(share(F.count_if(F.col("a") & ~F.col("c")), F.count_if("a")), F.lit(0.0))
    return [
        n.alias("n"), F.round(share(F.count_if(~F.col("a")), n), 8).alias("answer_failure_rate"), F.round(share(accepted, n), 8).alias("coverage"),
        F.round(share(errors, accepted), 8).alias("risk"), F.round(F.when(accepted > 0, share(accepted - errors, n)), 8).alias("success"),
        accepted.alias("accepted"), F.round(invalid, 8).alias("confidence_invalid_rate"),
    ]


def operational_endpoints(obs: DataFrame, tau: Column | float, by: list[str]) -> DataFrame:
    return obs.groupBy(*by).agg(*endpoint_columns(tau))


def outcome_partition(obs: DataFrame, tau: float, by: list[str]) -> DataFrame:
    """The shares of the five disjoint outcomes, which sum to 1, with coverage and non_acceptance derived from them."""
    kind = outcome(tau)
    n = F.count(F.lit(1))
    counts = {k: F.count_if(kind == k) for k in OUTCOMES}
    out = obs.groupBy(*by).agg(n.alias("n"), *[F.round(share(c, n), 8).alias(k) for k, c in counts.items()], F.round(share(counts["accepted_error"] + counts["accepted_success"], n), 8).alias("coverage"))
    return out.withColumn("non_acceptance", F.round(1 - F.col("coverage"), 8))


def selective_risk(obs: DataFrame, tau: float, by: list[str]) -> DataFrame:
    """Accepted, errors, risk and distinct experimental units of the groups that accept anything."""
    acc = accepts(tau)
    return obs.filter(acc).groupBy(*by).agg(F.count("*").alias("accepted"), F.count_if(~F.col("y")).alias("errors"), F.round(share(F.count_if(~F.col("y")), F.count("*")), 8).alias("risk"), F.countDistinct("item").alias("units"))


def invalid_confidence(obs: DataFrame, by: list[str]) -> DataFrame:
    """Invalid confidences among valid answers: count, base and rate (0 when there is no valid answer)."""
    bad, base = F.count_if(F.col("a") & ~F.col("c")), F.count_if("a")
    return obs.groupBy(*by).agg(base.alias("valid_answers"), bad.alias("invalid_confidences"), F.round(F.coalesce(share(bad, base), F.lit(0.0)), 8).alias("rate"))


def summary(obs: DataFrame, by: list[str]) -> DataFrame:
    """Rows, clusters, sorted seeds, accuracy, valid and invalid counts, mean and median confidence and Brier score of valid confidences."""
    p = F.when(F.col("c"), F.col("conf"))
    return obs.groupBy(*by).agg(
        F.count("*").alias("n"), F.countDistinct("cluster").alias("clusters"), F.concat_ws(",", F.transform(F.sort_array(F.collect_set("seed")), lambda s: s.cast("string"))).alias("seeds"),
        F.round(F.avg(F.col("y").cast("double")), 8).alias("accuracy"), F.count_if("c").alias("valid"), F.count_if(~F.col("c")).alias("invalid"),
        F.round(F.avg(p), 8).alias("mean_confidence"), F.round(F.percentile(p, 0.5), 8).alias("median_confidence"),
        decimal_round(F.avg(F.pow(p - F.col("y").cast("double"), 2))).alias("brier"),
    )


def expected_calibration_error(obs: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Equal-width ECE over valid confidences: bin min(bins - 1, int(c x bins)), weighted |mean c - mean y|."""
    ok = obs.filter("c")
    binned = ok.withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("conf") * bins)))
    per = binned.groupBy(*by, "bin").agg(F.count("*").alias("k"), F.abs(F.avg("conf") - F.avg(F.col("y").cast("double"))).alias("gap"))
    return per.groupBy(*by).agg(F.sum("k").alias("n"), F.round(F.sum(F.col("k") * F.col("gap")) / F.sum("k"), 8).alias("ece"))


def identical(valid: Column, answer: Column, valid0: Column, answer0: Column) -> Column:
    """Whether two answers are the same answer: both valid and equal as parsed. A missing answer equals nothing."""
    return valid & valid0 & F.coalesce(answer == answer0, F.lit(False))


def same_answer(cells: DataFrame, reference: str, shifted: str) -> DataFrame:
    """By run: of paired (item, seed), the share with one and the same answer under both conditions, and what changes among them."""
    pair = cells.filter(F.col("cond").isin(reference, shifted)).groupBy("run_id", "item", "seed").agg(
        *[F.max(F.when(F.col("cond") == c, F.struct("a", "c", "conf", "ans", "y"))).alias(n) for n, c in (("r", reference), ("s", shifted))]
    )
    both = pair.filter(F.col("r").isNotNull() & F.col("s").isNotNull())
    same = identical(F.col("s.a"), F.col("s.ans"), F.col("r.a"), F.col("r.ans"))
    valid = same & F.col("r.c") & F.col("s.c")
    return both.groupBy("run_id").agg(
        F.count("*").alias("pairs"), F.count_if(same).alias("same"), F.round(share(F.count_if(same), F.count("*")), 8).alias("same_rate"),
        F.round(F.avg(F.when(same, F.col("r.y").cast("double"))), 8).alias("accuracy_on_same"),
        F.round(F.avg(F.when(same, F.col("s.y").cast("double"))), 8).alias("shifted_accuracy_on_same"),
        F.count_if(valid).alias("valid_pairs"), F.round(F.avg(F.when(valid, F.col("s.conf") - F.col("r.conf"))), 8).alias("mean_confidence_delta"),
    )


def accuracy_matched(obs: DataFrame, reference: str, tolerance: float) -> DataFrame:
    """By run and shifted condition: the accuracy difference to the reference and whether it is within ``tolerance``."""
    acc = obs.groupBy("run_id", "cond").agg(F.avg(F.col("y").cast("double")).alias("acc"))
    ref = acc.filter(F.col("cond") == reference).select("run_id", F.col("acc").alias("ref"))
    joined = acc.filter(F.col("cond") != reference).join(ref, "run_id")
    delta = F.col("acc") - F.col("ref")
    return joined.select("run_id", "cond", F.round(delta, 8).alias("delta"), (F.abs(delta) <= tolerance).alias("matched"))


def intervention_strength(cells: DataFrame, reference: str) -> DataFrame:
    """By run and shifted condition: how often the answer and the confidence change, the latter also given an identical answer.

    realisation is the larger of the two changes.
    """
    ref = F.col("cond") == reference
    key = ["run_id", "item", "seed"]
    base = cells.filter(ref).select(*key, F.col("ans").alias("ans0"), F.col("a").alias("a0"), F.when(F.col("c"), F.col("conf")).alias("c0"))
    joined = cells.filter(~ref).join(base, key)
    answer = ~identical(F.col("a"), F.col("ans"), F.col("a0"), F.col("ans0"))
    conf = ~F.when(F.col("c"), F.col("conf")).eqNullSafe(F.col("c0"))
    mean = lambda x: F.avg(x.cast("double"))
    out = joined.groupBy("run_id", "cond").agg(F.count("*").alias("pairs"), mean(answer).alias("answer_changed"), mean(conf).alias("confidence_changed"), mean(F.when(~answer, conf)).alias("confidence_changed_same_answer"))
    return out.select("run_id", "cond", "pairs", *[F.round(c, 8).alias(c) for c in ("answer_changed", "confidence_changed", "confidence_changed_same_answer")], F.round(F.greatest("answer_changed", "confidence_changed"), 8).alias("realisation"))


def item_deltas(cells: DataFrame, reference: str, shifted: str, tau: float) -> DataFrame:
    """By run and item in both conditions: the difference of accepted share, answer failures and accepted successes."""
    acc = accepts(tau)
    per = cells.filter(F.col("cond").isin(reference, shifted)).groupBy("run_id", "item", "cond").agg(
        F.avg(acc.cast("double")).alias("k"), F.avg((~F.col("a")).cast("double")).alias("q"), F.avg((acc & F.col("y")).cast("double")).alias("s")
    )
    wide = per.groupBy("run_id", "item").agg(*[F.max(F.when(F.col("cond") == c, F.col(v))).alias(f"{v}{i}") for i, c in enumerate((reference, shifted)) for v in "kqs"])
    return wide.filter(F.col("k0").isNotNull() & F.col("k1").isNotNull()).select("run_id", "item", *[F.round(F.col(f"{v}1") - F.col(f"{v}0"), 8).alias(f"d_{v}") for v in "kqs"])
