"""Resampling of clusters: bootstrap and randomisation over sufficient statistics.

Metrics are functions of a few sums, so observations are first added up to one row per (group, cluster) and arm. Draws come from hashes of
(seed, replicate, position): the same on every run, layout and engine. The draws are the streamed side; the cluster table is hashed by its
position on many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.functions.expressions import accepts, hash_number, share
from tandemlab.operators.ranking import range_rank

SUMS = ("n", "q", "acc", "err", "cf")


def cluster_stats(obs: DataFrame, tau: float, reference: str, shifted: list[str], unit: str = "item") -> DataFrame:
    """(run_id, contrast, unit, idx, n0.., n1..): sums of both arms per unit in both, with its position by name within the contrast.

    n rows, q answer failures, acc accepted, err accepted errors, cf confidence failures. Units of one arm only are left out.
    """
    acc = accepts(tau)
    sums = obs.groupBy("run_id", F.col(unit).alias("unit"), "cond").agg(
        F.count("*").alias("n"), F.count_if(~F.col("a")).alias("q"), F.count_if(acc).alias("acc"), F.count_if(acc & ~F.col("y")).alias("err"), F.count_if(F.col("a") & ~F.col("c")).alias("cf"))
    ref = sums.filter(F.col("cond") == reference).select("run_id", "unit", *[F.col(s).alias(f"{s}0") for s in SUMS])
    other = sums.filter(F.col("cond").isin(shifted)).select("run_id", "unit", F.col("cond").alias("contrast"), *[F.col(s).alias(f"{s}1") for s in SUMS])
    both = other.join(ref, ["run_id", "unit"])
    return range_rank(both, ["run_id", "contrast"], ["unit"], "idx").withColumn("idx", (F.col("idx") - 1).cast("int"))


def endpoint_deltas(sums: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """(by, d_q, d_k, d_r, d_s, d_e): shifted minus reference endpoints of summed statistics; null where an arm accepts nothing."""
    w = weight if weight is not None else F.lit(1)
    agg = sums.groupBy(*by).agg(*[F.sum(F.col(f"{s}{i}") * w).alias(f"{s}{i}") for s in SUMS for i in (0, 1)])
    c = F.col
    risk = [share(c(f"err{i}"), c(f"acc{i}")) for i in (0, 1)]
    success = [F.when(c(f"acc{i}") > 0, share(c(f"acc{i}") - c(f"err{i}"), c(f"n{i}"))) for i in (0, 1)]
    rate = lambda s: share(c(f"{s}1"), c("n1")) - share(c(f"{s}0"), c("n0"))
    return agg.select(*by, rate("q").alias("d_q"), rate("acc").alias("d_k"), (risk[1] - risk[0]).alias("d_r"), (success[1] - success[0]).alias("d_s"), rate("err").alias("d_e"), rate("cf").alias("d_c"))


#: Positions that one row of a plan is spread into at a time.
BLOCK = 65_536


def draw_positions(sizes: DataFrame, by: list[str], replicates: int) -> DataFrame:
    """(by, size, b, j): a row for each draw of each replicate, ``size`` draws each, on many tasks; no row holds more than BLOCK of them."""
    blocks = sizes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / BLOCK))))
    many = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.least(F.col("size"), (F.col("__k") + 1) * BLOCK) - 1
    return blocks.repartition(many, *by, "b", "__k").withColumn("j", F.explode(F.sequence(F.col("__k") * BLOCK, last))).drop("__k")


def at_positions(draws: DataFrame, placed: DataFrame, on: list[str]) -> DataFrame:
    """``draws`` with the rows of ``placed`` at their positions.

    The size of draws is unknown to Spark, which takes them for as small as the plan they are spread from and would collect and broadcast
    them. So the join is fixed: both sides are shuffled, and ``placed``, smaller by the number of replicates, is what tasks hash.
    """
    return draws.join(placed.hint("shuffle_hash"), on)


def bootstrap_draws(stats: DataFrame, replicates: int = 5000, seed: int = 17) -> DataFrame:
    """``stats`` once for each time its unit is drawn, with the replicate b: as many draws with replacement as the contrast has units."""
    sizes = stats.groupBy("run_id", "contrast").agg(F.count("*").alias("size"))
    draws = draw_positions(sizes, ["run_id", "contrast"], replicates)
    picked = draws.select("run_id", "contrast", "b", (hash_number(F.lit(seed), F.col("b"), F.col("j")) % F.col("size")).cast("int").alias("idx"))
    return at_positions(picked, stats, ["run_id", "contrast", "idx"])


def poisson_bootstrap(stats: DataFrame, by: list[str], replicates: int = 5000, seed: int = 17) -> DataFrame:
    """Endpoint deltas of ``replicates`` Poisson bootstraps: every unit gets an independent Poisson(1) weight per replicate from its hash.

    No draw meets a join: each unit's row is weighted where it lies and partial sums are all that is shuffled, which is the form for
    clusters by the billion. The number of units per replicate varies by its square root.
    """
    u = hash_number(F.lit(seed), F.col("b"), F.col("unit")) / F.lit(float(1 << 60))
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712]
    weight = sum((F.when(u >= cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    spread = stats.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", weight).filter("w > 0")
    return endpoint_deltas(spread, [*by, "b"], F.col("w"))


def intervals(draws: DataFrame, by: list[str], value: str, level: float = 0.95, convention: str = "linear", least: int = 1) -> DataFrame:
    """(by, replicates, ci_low, ci_high) of the defined draws of ``value``, null below ``least`` of them.

    Conventions: 'linear' interpolates at (n - 1) p; 'index_n' takes the sorted value at int(p n), at most n - 1; 'index_n_minus_1' at
    int(p (n - 1)).
    """
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    some = draws.filter(F.col(value).isNotNull())
    if convention == "linear":
        out = some.groupBy(*by).agg(F.count("*").alias("replicates"), F.percentile(value, lo).alias("lo"), F.percentile(value, hi).alias("hi"))
    else:
        ranked = some.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1).withColumn("m", F.count("*").over(Window.partitionBy(*by)))
        at = {p: F.least(F.col("m") - 1, F.floor(F.lit(p) * (F.col("m") if convention == "index_n" else F.col("m") - 1))) for p in (lo, hi)}
        out = ranked.groupBy(*by).agg(F.count("*").alias("replicates"), F.max(F.when(F.col("k") == at[lo], F.col(value))).alias("lo"), F.max(F.when(F.col("k") == at[hi], F.col(value))).alias("hi"))
    ok = F.col("replicates") >= least
    return out.select(*by, "replicates", F.when(ok, F.round("lo", 6)).alias("ci_low"), F.when(ok, F.round("hi", 6)).alias("ci_high"))


def randomisation_p(stats: DataFrame, endpoint: str, replicates: int = 9999, seed: int = 29, tolerance: float = 1e-12, count_undefined: bool = True) -> DataFrame:
    """(run_id, contrast, observed, p): two-sided p-value of swapping a unit's arms by the low bit of its hash.

    (extreme + 1) / (replicates + 1), undefined draws counting as not extreme; with ``count_undefined`` false the denominator takes defined
    draws only. Null where the observed difference is undefined.
    """
    by = ["run_id", "contrast"]
    seen = endpoint_deltas(stats, by).select(*by, F.abs(F.col(endpoint)).alias("observed"))
    coin = hash_number(F.lit(seed), F.col("b"), F.col("idx")) % 2 == 0
    swapped = stats.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("coin", coin)
    arms = swapped.select(*by, "b", *[F.when(F.col("coin"), F.col(f"{s}{i}")).otherwise(F.col(f"{s}{1 - i}")).alias(f"{s}{i}") for s in SUMS for i in (0, 1)])
    drawn = endpoint_deltas(arms, [*by, "b"]).select(*by, F.abs(F.col(endpoint)).alias("d"))
    joined = drawn.join(seen, by)
    out = joined.groupBy(*by).agg(F.max("observed").alias("observed"), F.count_if(F.col("d") >= F.col("observed") - tolerance).alias("extreme"), F.count("d").alias("defined"))
    base = F.lit(replicates) if count_undefined else F.col("defined")
    return out.select(*by, F.round("observed", 8).alias("observed"), F.when(F.col("observed").isNotNull(), F.round((F.col("extreme") + 1) / (base + 1), 8)).alias("p"))


def randomisation_tests(stats: DataFrame, endpoint: str, replicates: int = 9999, seed: int = 29, tolerance: float = 1e-12) -> DataFrame:
    """(run_id, contrast, observed, valid, p_change, p_increase): two-sided and one-sided p-values of swapping the arms of units.

    (extreme + 1) / (valid + 1) over the draws in which the endpoint is defined; both are 1 where the observed difference is undefined.
    """
    by = ["run_id", "contrast"]
    seen = endpoint_deltas(stats, by).select(*by, F.col(endpoint).alias("observed"))
    coin = hash_number(F.lit(seed), F.col("b"), F.col("idx")) % 2 == 0
    swapped = stats.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("coin", coin)
    arms = swapped.select(*by, "b", *[F.when(F.col("coin"), F.col(f"{s}{i}")).otherwise(F.col(f"{s}{1 - i}")).alias(f"{s}{i}") for s in SUMS for i in (0, 1)])
    d = endpoint_deltas(arms, [*by, "b"]).select(*by, F.col(endpoint).alias("d")).join(seen, by)
    agg = d.groupBy(*by).agg(
        F.max("observed").alias("observed"), F.count("d").alias("valid"),
        F.count_if(F.abs("d") >= F.abs("observed") - tolerance).alias("two"), F.count_if(F.col("d") >= F.col("observed") - tolerance).alias("one"),
    )
    p = lambda k: F.when(F.col("observed").isNull(), 1.0).otherwise(F.round((F.col(k) + 1) / (F.col("valid") + 1), 8))
    return agg.select(*by, F.round("observed", 8).alias("observed"), F.when(F.col("observed").isNull(), 0).otherwise(F.col("valid")).alias("valid"), p("two").alias("p_change"), p("one").alias("p_increase"))


def resampling_strata(clusters: DataFrame, least: int = 2) -> DataFrame:
    """``clusters``: (by.., cluster, stratum), one row each. (dataset_id, clusters, strata, smallest, used): whether a dataset is resampled within strata.

    Strata are used if every cluster has one and each holds ``least`` clusters or more; else the dataset is resampled as a whole.
    """
    per = clusters.groupBy("dataset_id", "stratum").agg(F.count("*").alias("k"))
    out = per.groupBy("dataset_id").agg(F.sum("k").alias("clusters"), F.count("stratum").alias("strata"), F.min("k").alias("smallest"), F.bool_or(F.col("stratum").isNull()).alias("open"))
    return out.select("dataset_id", "clusters", "strata", "smallest", (~F.col("open") & (F.col("smallest") >= least)).alias("used"))


def stratified_draws(clusters: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(dataset_id, stratum, b, cluster): as many draws with replacement within each stratum as it has clusters; positions by the cluster's name."""
    by = ["dataset_id", "stratum"]
    placed = range_rank(clusters.withColumn("stratum", F.coalesce("stratum", F.lit(""))), by, ["cluster"], "idx").withColumn("idx", (F.col("idx") - 1).cast("bigint"))
    sizes = placed.groupBy(*by).agg(F.count("*").alias("size"))
    picked = draw_positions(sizes, by, replicates).select(*by, "b", (hash_number(F.lit(seed), F.col("stratum"), F.col("b"), F.col("j")) % F.col("size")).alias("idx"))
    return at_positions(picked, placed, [*by, "idx"]).select(*by, "b", "cluster")
