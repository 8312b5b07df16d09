"""Problem 4: per source, the score cutoff that keeps a target fraction, by sketch-bracketed exact selection.

Defined results: a record counts once however often it was ingested; null run_id or record_id rows are left out; NaN scores are missing;
a target of null gives no row; tied scores are kept or cut together; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.sources.tables import materialize


def _around(rank: Column, m: Column, grid: int, accuracy: int, low: str, high: str) -> tuple[Column, Column]:
    """The values of the summary ``q`` around the ``rank``-th of ``m`` eligible scores from above, widened by the guarantee; ``low`` and ``high`` beyond its ends."""
    at = (m - rank + 1) / m  # as a share from below
    slack = 1.0 / accuracy + F.lit(1.0) / m
    lo = F.greatest(F.lit(0), F.floor((at - slack) * grid) - 1).cast("int")
    hi = F.least(F.lit(grid), F.ceil((at + slack) * grid) + 1).cast("int")
    return F.when(lo <= 0, F.col(low)).otherwise(F.get("q", lo)), F.when((hi >= grid) | (rank <= 0), F.col(high)).otherwise(F.get("q", hi))


def select_cutoffs(records: DataFrame, targets: DataFrame, grid: int = 200, accuracy: int = 10_000, most: int = 1_000_000) -> DataFrame:
    """(source, n, kept, cutoff): the highest score at which the kept records are at least target x n.

    ``records``: (source, score, candidate boolean, eligible boolean), one row per record; a score is a possible cutoff where
    ``candidate``, and counted as kept where ``eligible`` (eligible records are candidates). ``targets``: (source, target), one row each.

    1. One aggregation per source gives n, the eligible count m and a Greenwald-Khanna summary read at ``grid`` + 1 ranks, each within
       m / ``accuracy`` ranks of the exact one.
    2. The wanted rank lies between two of those values, widened by the guarantee: the bracket. Records above it are only counted.
       While a bracket holds more than ``most`` records it is summarised again from within, about a hundred times narrower each time,
       until tied scores leave nothing to narrow.
    3. Records inside are compressed to (score, count) and summed from above to find the cutoff. Only these are sorted.
    """
    at = [i / grid for i in range(grid + 1)]
    ok = F.when(F.col("eligible"), F.col("score"))
    summary = F.percentile_approx(ok, at, accuracy)
    stats = records.groupBy("source").agg(F.count("*").alias("n"), F.count(ok).alias("m"), summary.alias("q"), F.min(F.when(F.col("candidate"), F.col("score"))).alias("lo_all"), F.max(F.when(F.col("candidate"), F.col("score"))).alias("hi_all"))
    need = F.col("target") * F.col("n")
    some = stats.join(targets.filter(F.col("target").isNotNull()), "source").filter((F.col("m") > 0) & (F.col("m") >= need)).withColumn("need", need)
    lo, hi = _around(F.ceil("need"), F.col("m"), grid, accuracy, "lo_all", "hi_all")
    bracket = materialize(some.select("source", "n", "need", lo.alias("lo"), hi.alias("hi")))  # one row per source
    scored = records.filter("candidate")
    inside = (F.col("score") >= F.col("lo")) & (F.col("score") <= F.col("hi"))
    for _ in range(12):
        joined = scored.join(bracket, "source")
        within = F.when(inside, ok)
        held = joined.groupBy("source", "n", "need", "lo", "hi").agg(
            F.count_if(F.col("eligible") & (F.col("score") > F.col("hi"))).alias("above"), F.count_if(inside).alias("rows"), F.count(within).alias("m"), F.percentile_approx(within, at, accuracy).alias("q"))
        lo, hi = _around(F.ceil("need") - F.col("above"), F.col("m"), grid, accuracy, "lo", "hi")
        wide = (F.col("rows") > most) & (F.col("m") > 0) & (F.col("lo") < F.col("hi"))
        held = materialize(held.select("source", "n", "need", "above", "lo", "hi", F.when(wide, lo).otherwise(F.col("lo")).alias("lo2"), F.when(wide, hi).otherwise(F.col("hi")).alias("hi2")))
        moved = held.filter("lo2 != lo or hi2 != hi").limit(1).count()
        if not moved:
            break
        bracket = held.select("source", "n", "need", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"))
    bracket = held.select("source", "n", "need", "lo", "hi")  # that of the counts above it
    above = held.select("source", "above")
    atoms = scored.join(bracket, "source").filter(inside).groupBy("source", "score").agg(F.sum(F.col("eligible").cast("int")).alias("c"))
    down = Window.partitionBy("source").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    walked = atoms.withColumn("run", F.sum("c").over(down)).join(above, "source").withColumn("kept", F.col("run") + F.col("above"))
    hit = walked.join(bracket.select("source", "n", "need"), "source").filter(F.col("kept") >= F.col("need"))
    picked = hit.groupBy("source").agg(F.max_by(F.struct("score", "kept", "n"), "score").alias("x"))
    return picked.select("source", F.col("x.n").alias("n"), F.col("x.kept").alias("kept"), F.col("x.score").alias("cutoff"))


def confidence_records(observations: DataFrame, condition: str = "reference", partition: str = "development") -> DataFrame:
    """(source, score, candidate, eligible): the distinct records of a condition and partition, as select_cutoffs takes them."""
    kept = observations.filter((F.col("condition_id") == condition) & (F.col("dataset_partition") == partition) & F.col("run_id").isNotNull() & F.col("record_id").isNotNull())
    has = F.col("confidence").isNotNull() & ~F.isnan("confidence")
    conf_ok = has & (F.col("confidence_parse_status") == "valid")
    both = conf_ok & (F.col("answer_parse_status") == "valid")
    rows = kept.select(F.col("run_id").alias("source"), "record_id", F.col("confidence").alias("score"), F.coalesce(conf_ok, F.lit(False)).alias("candidate"), F.coalesce(both, F.lit(False)).alias("eligible"))
    # copies of a record are alike; if they differ, the one that counts is the highest by (eligible, candidate, score)
    one = rows.groupBy("source", "record_id").agg(F.max(F.struct("eligible", "candidate", "score")).alias("x"))
    return one.select("source", "x.score", "x.candidate", "x.eligible")


def coverage_cutoffs(observations: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(run_id, n, kept, cutoff, coverage, target): the cutoffs of the runs of calibration_thresholds."""
    targets = thresholds.filter(F.col("run_id").isNotNull()).groupBy(F.col("run_id").alias("source")).agg(F.max("fixed_coverage_target").alias("target"))
    records = materialize(confidence_records(observations).join(targets.select("source"), "source", "left_semi"))
    out = select_cutoffs(records, targets).join(targets, "source")
    return out.select(F.col("source").alias("run_id"), "n", "kept", "cutoff", (F.col("kept") / F.col("n")).alias("coverage"), "target")
