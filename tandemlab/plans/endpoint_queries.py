"""Endpoint, ranking and threshold queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemlab.functions.expressions import accepts, decimal_round, logit, outcome, violation
from tandemlab.operators import endpoints as ep
from tandemlab.operators import ranking_metrics as rm
from tandemlab.operators import thresholds as th
from tandemlab.operators.observations import cells, observations, scored
from tandemlab.sources.tables import table

REFERENCE, HOT, NARROW = "reference", "high-temperature", "low-top-p"
TAU = 0.8
BY = ["run_id", "cond"]


def obs(spark: SparkSession, folder: str) -> DataFrame:
    return observations(table(spark, folder, "observations"))


def done(spark: SparkSession, folder: str) -> DataFrame:
    return scored(obs(spark, folder))


def cell(spark: SparkSession, folder: str) -> DataFrame:
    return cells(obs(spark, folder))


def development(spark: SparkSession, folder: str) -> DataFrame:
    return done(spark, folder).filter((F.col("part") == "development") & (F.col("cond") == REFERENCE))


OBS = """obs AS (
  SELECT DISTINCT record_id, run_id, dataset_id, dataset_item_id AS item, coalesce(cluster_id, dataset_item_id) AS cluster, dataset_partition AS part, condition_id AS cond, seed,
         coalesce(answer_parse_status = 'valid', false) AS a, coalesce(confidence_parse_status = 'valid' AND confidence IS NOT NULL, false) AS c, confidence AS conf, parsed_answer AS ans, correct AS y
  FROM observations WHERE record_id IS NOT NULL),
done AS (SELECT *, a AND c AND coalesce(conf >= 0.8, false) AS acc FROM obs WHERE y IS NOT NULL),
cell AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, item, cond, seed ORDER BY record_id) AS k FROM done) WHERE k = 1),
dev AS (SELECT * FROM done WHERE part = 'development' AND cond = 'reference')"""
W = f"WITH {OBS} "
B = "CAST({} AS BIGINT)".format
SUM = lambda c: f"CAST(sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS BIGINT)"
ATOMS = "atom AS (SELECT run_id, cond, conf, count(*) AS n, sum(CASE WHEN y THEN 1 ELSE 0 END) AS pos FROM done WHERE c GROUP BY ALL)"
CAND = """atom AS (SELECT run_id, conf, sum(CASE WHEN a THEN 1 ELSE 0 END) AS k, sum(CASE WHEN a AND NOT y THEN 1 ELSE 0 END) AS e FROM dev WHERE c GROUP BY ALL),
tot AS (SELECT run_id, count(*) AS n FROM dev GROUP BY ALL),
walk AS (SELECT run_id, conf AS threshold, sum(k) OVER w AS accepted, sum(e) OVER w AS errors FROM atom WINDOW w AS (PARTITION BY run_id ORDER BY conf DESC ROWS UNBOUNDED PRECEDING)),
cand AS (SELECT w.*, t.n, w.accepted / t.n AS coverage, w.errors / w.accepted AS risk FROM walk w JOIN tot t ON t.run_id IS NOT DISTINCT FROM w.run_id WHERE w.accepted > 0),
emp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY coverage DESC, threshold) AS r FROM cand WHERE risk <= 0.25) WHERE r = 1),
fix AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY coverage, threshold DESC) AS r FROM cand WHERE coverage >= 0.5) WHERE r = 1),
best AS (SELECT run_id, max(coverage) AS best FROM cand GROUP BY 1)"""
FROZEN = """pol AS (SELECT t.run_id, coalesce(CASE WHEN e.coverage >= 0.1 THEN e.threshold END, f.threshold) AS threshold, CASE WHEN e.coverage >= 0.1 THEN 'attained' ELSE 'infeasible' END AS risk_contract,
  CASE WHEN e.coverage >= 0.1 THEN 'certified_risk_threshold' WHEN f.threshold IS NOT NULL THEN 'fixed_coverage_0.50' END AS endpoint
  FROM tot t LEFT JOIN emp e ON e.run_id = t.run_id LEFT JOIN fix f ON f.run_id = t.run_id)"""

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("b1_b3_predicates", W + f"SELECT cond, count(*) AS n, {SUM('a')} AS valid_answers, {SUM('c')} AS valid_confidences, {SUM('a AND c AND coalesce(conf >= 0.8, false)')} AS accepted FROM obs GROUP BY cond")
def b1(spark, folder):
    return obs(spark, folder).groupBy("cond").agg(F.count("*").alias("n"), F.count_if("a").alias("valid_answers"), F.count_if("c").alias("valid_confidences"), F.count_if(accepts(TAU)).alias("accepted"))


@query("b4_partition_filter", "SELECT dataset_id, partition, count(DISTINCT item_id) AS items FROM items WHERE partition IN ('development', 'test') GROUP BY ALL")
def b4(spark, folder):
    return table(spark, folder, "items").filter(F.col("partition").isin("development", "test")).groupBy("dataset_id", "partition").agg(F.countDistinct("item_id").alias("items"))


@query("b6_anchor_filter", W + "SELECT o.run_id, o.item, count(*) AS n FROM obs o WHERE o.item IN (SELECT unnest(selected_item_ids) FROM unit_selections) GROUP BY ALL")
def b6(spark, folder):
    chosen = table(spark, folder, "unit_selections").select(F.explode("selected_item_ids").alias("item")).distinct()
    return obs(spark, folder).join(chosen, "item", "left_semi").groupBy("run_id", "item").agg(F.count("*").alias("n"))


@query("b7_single_condition_guard", W + "SELECT run_id, count(DISTINCT cond) AS conditions, count(DISTINCT part) AS partitions FROM obs GROUP BY 1 HAVING count(DISTINCT cond) > 1 OR count(DISTINCT part) > 1")
def b7(spark, folder):
    return obs(spark, folder).groupBy("run_id").agg(F.countDistinct("cond").alias("conditions"), F.countDistinct("part").alias("partitions")).filter("conditions > 1 or partitions > 1")


@query("b10_length_finish", "WITH r AS (SELECT DISTINCT request_id, finish_reason, completion_tokens FROM inference_responses WHERE finish_reason = 'length') SELECT request_id, CAST(max(completion_tokens) AS INTEGER) AS completion_tokens FROM r GROUP BY 1")
def b10(spark, folder):
    return table(spark, folder, "inference_responses").filter("finish_reason = 'length'").groupBy("request_id").agg(F.max("completion_tokens").alias("completion_tokens"))


_F1 = f"count(*) AS n, round(sum(CASE WHEN a THEN 0 ELSE 1 END) / count(*), 8) AS answer_failure_rate, round(sum(CASE WHEN acc THEN 1 ELSE 0 END) / count(*), 8) AS coverage, round(sum(CASE WHEN acc AND NOT y THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN acc THEN 1 ELSE 0 END), 0), 8) AS risk, CASE WHEN bool_or(acc) THEN round(sum(CASE WHEN acc AND y THEN 1 ELSE 0 END) / count(*), 8) END AS success, {SUM('acc')} AS accepted, round(coalesce(sum(CASE WHEN a AND NOT c THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN a THEN 1 ELSE 0 END), 0), 0), 8) AS confidence_invalid_rate"


@query("f1_operational_endpoints", W + f"SELECT run_id, cond, {_F1} FROM done GROUP BY ALL")
def f1(spark, folder):
    return ep.operational_endpoints(done(spark, folder), TAU, BY)


_KIND = "CASE WHEN NOT a THEN 'answer_failure' WHEN NOT c THEN 'confidence_failure' WHEN NOT acc THEN 'low_confidence' WHEN y THEN 'accepted_success' ELSE 'accepted_error' END"


@query("f2_outcome_partition", W + ", k AS (SELECT *, " + _KIND + " AS kind FROM done) SELECT run_id, cond, count(*) AS n, " + ", ".join(f"round(sum(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END) / count(*), 8) AS {k}" for k in ("answer_failure", "confidence_failure", "low_confidence", "accepted_error", "accepted_success")) + ", round(sum(CASE WHEN kind LIKE 'accepted%' THEN 1 ELSE 0 END) / count(*), 8) AS coverage, round(1 - round(sum(CASE WHEN kind LIKE 'accepted%' THEN 1 ELSE 0 END) / count(*), 8), 8) AS non_acceptance FROM k GROUP BY ALL")
def f2(spark, folder):
    return ep.outcome_partition(done(spark, folder), TAU, BY)


@query("f3_selective_risk", W + f"SELECT run_id, cond, count(*) AS accepted, {SUM('NOT y')} AS errors, round(sum(CASE WHEN y THEN 0 ELSE 1 END) / count(*), 8) AS risk, count(DISTINCT item) AS units FROM done WHERE acc GROUP BY ALL")
def f3(spark, folder):
    return ep.selective_risk(done(spark, folder), TAU, BY)


@query("f4_invalid_confidence", W + f"SELECT run_id, cond, {SUM('a')} AS valid_answers, {SUM('a AND NOT c')} AS invalid_confidences, round(coalesce(sum(CASE WHEN a AND NOT c THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN a THEN 1 ELSE 0 END), 0), 0), 8) AS rate FROM obs GROUP BY ALL")
def f4(spark, folder):
    return ep.invalid_confidence(obs(spark, folder), BY)


@query("f5_summary", W + f"SELECT run_id, cond, count(*) AS n, count(DISTINCT cluster) AS clusters, array_to_string(list_sort(list(DISTINCT seed) FILTER (seed IS NOT NULL)), ',') AS seeds, round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END), 8) AS accuracy, {SUM('c')} AS valid, {SUM('NOT c')} AS invalid, round(avg(CASE WHEN c THEN conf END), 8) AS mean_confidence, round(median(CASE WHEN c THEN conf END), 8) AS median_confidence, CAST(round(CAST(avg(CASE WHEN c THEN power(conf - CASE WHEN y THEN 1 ELSE 0 END, 2) END) AS DECIMAL(24, 12)), 8) AS DOUBLE) AS brier FROM done GROUP BY ALL")
def f5(spark, folder):
    return ep.summary(done(spark, folder), BY)


@query("f7_expected_calibration_error", W + f", b AS (SELECT run_id, cond, least(9, floor(conf * 10)) AS bin, count(*) AS k, abs(avg(conf) - avg(CASE WHEN y THEN 1.0 ELSE 0.0 END)) AS gap FROM done WHERE c GROUP BY ALL) SELECT run_id, cond, {B('sum(k)')} AS n, round(sum(k * gap) / sum(k), 8) AS ece FROM b GROUP BY ALL")
def f7(spark, folder):
    return ep.expected_calibration_error(done(spark, folder), BY)


@query("f8_brier", W + "SELECT run_id, dataset_id, cond, count(*) AS n, CAST(round(CAST(avg(power(conf - CASE WHEN y THEN 1 ELSE 0 END, 2)) AS DECIMAL(24, 12)), 8) AS DOUBLE) AS brier, round(avg(conf), 8) AS mean_confidence FROM done WHERE c GROUP BY ALL")
def f8(spark, folder):
    return done(spark, folder).filter("c").groupBy("run_id", "dataset_id", "cond").agg(F.count("*").alias("n"), decimal_round(F.avg(F.pow(F.col("conf") - F.col("y").cast("double"), 2))).alias("brier"), F.round(F.avg("conf"), 8).alias("mean_confidence"))


_SAME = "(r.a AND s.a AND coalesce(r.ans = s.ans, false))"


@query("f10_same_answer", W + f"""SELECT r.run_id, count(*) AS pairs, {SUM(_SAME)} AS same, round(sum(CASE WHEN {_SAME} THEN 1 ELSE 0 END) / count(*), 8) AS same_rate,
  round(avg(CASE WHEN {_SAME} THEN CASE WHEN r.y THEN 1.0 ELSE 0.0 END END), 8) AS accuracy_on_same, round(avg(CASE WHEN {_SAME} THEN CASE WHEN s.y THEN 1.0 ELSE 0.0 END END), 8) AS shifted_accuracy_on_same,
  {SUM(_SAME + ' AND r.c AND s.c')} AS valid_pairs, round(avg(CASE WHEN {_SAME} AND r.c AND s.c THEN s.conf - r.conf END), 8) AS mean_confidence_delta
  FROM cell r JOIN cell s ON r.run_id = s.run_id AND r.item = s.item AND r.seed = s.seed WHERE r.cond = 'reference' AND s.cond = 'high-temperature' GROUP BY r.run_id""")
def f10(spark, folder):
    paired = cell(spark, folder).filter(F.col("run_id").isNotNull() & F.col("item").isNotNull() & F.col("seed").isNotNull())
    return ep.same_answer(paired, REFERENCE, HOT)


@query("f11_accuracy_matched", W + ", acc AS (SELECT run_id, cond, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS acc FROM done GROUP BY ALL) SELECT s.run_id, s.cond, round(s.acc - r.acc, 8) AS delta, abs(s.acc - r.acc) <= 0.05 AS matched FROM acc s JOIN acc r ON r.run_id = s.run_id AND r.cond = 'reference' WHERE s.cond <> 'reference'")
def f11(spark, folder):
    return ep.accuracy_matched(done(spark, folder), REFERENCE, 0.05)


_STRENGTH = f"""pair AS (SELECT s.run_id, s.cond, NOT {_SAME} AS ch, (CASE WHEN s.c THEN s.conf END) IS DISTINCT FROM (CASE WHEN r.c THEN r.conf END) AS cc
  FROM cell s JOIN cell r ON r.run_id = s.run_id AND r.item = s.item AND r.seed = s.seed AND r.cond = 'reference' WHERE s.cond <> 'reference'),
strength AS (SELECT run_id, cond, count(*) AS pairs, round(avg(CASE WHEN ch THEN 1.0 ELSE 0.0 END), 8) AS answer_changed, round(avg(CASE WHEN cc THEN 1.0 ELSE 0.0 END), 8) AS confidence_changed, round(avg(CASE WHEN NOT ch THEN CASE WHEN cc THEN 1.0 ELSE 0.0 END END), 8) AS confidence_changed_same_answer FROM pair GROUP BY ALL)"""


@query("f12_intervention_strength", W + f", {_STRENGTH} SELECT *, round(greatest(answer_changed, confidence_changed), 8) AS realisation FROM strength")
def f12(spark, folder):
    return ep.intervention_strength(cell(spark, folder), REFERENCE)


@query("f13_quantisation", W + f""", {ATOMS}, p AS (SELECT *, n / sum(n) OVER (PARTITION BY run_id, cond) AS p FROM atom)
SELECT run_id, cond, count(*) AS atoms, round(-sum(p * log2(p)), 8) + 0.0 AS entropy_bits, round(log2(count(*)), 8) AS max_entropy_bits, arg_max(conf, n * 1000.0 - conf) AS largest_atom, round(max(p), 8) AS largest_mass FROM p GROUP BY ALL""")
def f13(spark, folder):
    return rm.quantisation(rm.atoms(done(spark, folder), BY), BY)


@query("f14_risk_precision", W + f""", e AS (SELECT run_id, cond, sum(CASE WHEN acc THEN 1 ELSE 0 END) AS k, sum(CASE WHEN acc AND NOT y THEN 1 ELSE 0 END) AS e FROM done GROUP BY ALL)
SELECT run_id, cond, {B('k')} AS accepted, round(e / k, 8) AS risk, round(sqrt((e / k) * (1 - e / k) / k), 8) AS se, round(2 * 1.96 * sqrt((e / k) * (1 - e / k) / k), 8) AS width, 2 * 1.96 * sqrt((e / k) * (1 - e / k) / k) <= 0.05 AS fits FROM e WHERE k > 0""")
def f14(spark, folder):
    agg = done(spark, folder).groupBy(*BY).agg(F.count_if(accepts(TAU)).alias("accepted"), F.count_if(accepts(TAU) & ~F.col("y")).alias("e")).filter("accepted > 0")
    r = F.col("e") / F.col("accepted")
    width = 2 * 1.96 * F.sqrt(r * (1 - r) / F.col("accepted"))
    return agg.select(*BY, "accepted", F.round(r, 8).alias("risk"), F.round(F.sqrt(r * (1 - r) / F.col("accepted")), 8).alias("se"), F.round(width, 8).alias("width"), (width <= 0.05).alias("fits"))


@query("f17_item_deltas", W + """, per AS (SELECT run_id, item, cond, avg(CASE WHEN acc THEN 1.0 ELSE 0.0 END) AS k, avg(CASE WHEN a THEN 0.0 ELSE 1.0 END) AS q, avg(CASE WHEN acc AND y THEN 1.0 ELSE 0.0 END) AS s FROM cell GROUP BY ALL)
SELECT r.run_id, r.item, round(s.k - r.k, 8) AS d_k, round(s.q - r.q, 8) AS d_q, round(s.s - r.s, 8) AS d_s FROM per r JOIN per s ON s.run_id IS NOT DISTINCT FROM r.run_id AND s.item IS NOT DISTINCT FROM r.item WHERE r.cond = 'reference' AND s.cond = 'high-temperature'""")
def f17(spark, folder):
    return ep.item_deltas(cell(spark, folder), REFERENCE, HOT, TAU)


@query("f21_sample_variance", W + "SELECT run_id, cond, count(*) AS n, round(var_samp(conf), 8) AS variance FROM done WHERE c GROUP BY ALL")
def f21(spark, folder):
    return done(spark, folder).filter("c").groupBy(*BY).agg(F.count("*").alias("n"), F.round(F.var_samp("conf"), 8).alias("variance"))


@query("f22_partition_counters", "SELECT dataset_id, partition, count(DISTINCT item_id) AS items, CAST(grouping(dataset_id) * 2 + grouping(partition) AS BIGINT) AS grouped FROM items GROUP BY GROUPING SETS ((dataset_id, partition), (dataset_id), (partition), ())")
def f22(spark, folder):
    items = table(spark, folder, "items").select("item_id", "dataset_id", "partition").distinct()
    return items.groupingSets([["dataset_id", "partition"], ["dataset_id"], ["partition"], []], "dataset_id", "partition").agg(F.countDistinct("item_id").alias("items"), F.grouping_id().alias("grouped"))


_AUROC = """walk AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY run_id, cond ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM atom),
auc AS (SELECT run_id, cond, CAST(sum(n) AS BIGINT) AS n, round(sum(pos * below + 0.5 * pos * (n - pos)) / nullif(sum(pos) * sum(n - pos), 0), 8) AS auroc FROM walk GROUP BY ALL)"""


@query("g1_auroc", W + f", {ATOMS}, {_AUROC} SELECT * FROM auc")
def g1(spark, folder):
    return rm.auroc(rm.atoms(done(spark, folder), BY), BY)


@query("g2_aurc", W + f""", {ATOMS}, walk AS (SELECT *, coalesce(sum(n) OVER w, 0) AS n0, coalesce(sum(n - pos) OVER w, 0) AS e0 FROM atom WINDOW w AS (PARTITION BY run_id, cond ORDER BY conf DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ex AS (SELECT run_id, cond, n0, e0, (n - pos) / n AS e, unnest(range(1, CAST(n AS BIGINT) + 1)) AS k FROM walk), s AS (SELECT run_id, cond, count(*) AS valid, sum((e0 + k * e) / (n0 + k)) AS s FROM ex GROUP BY ALL),
t AS (SELECT run_id, cond, count(*) AS total FROM done GROUP BY ALL) SELECT s.run_id, s.cond, s.valid, round(s.s / s.valid, 8) AS aurc, round(s.s / t.total, 8) AS operational_aurc FROM s JOIN t ON t.run_id = s.run_id AND t.cond = s.cond""")
def g2(spark, folder):
    rows = done(spark, folder)
    return rm.aurc(rm.atoms(rows, BY), rows.groupBy(*BY).agg(F.count("*").alias("total")), BY)


_FIT = """cum AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM atom WINDOW w AS (PARTITION BY run_id, cond ORDER BY conf ROWS UNBOUNDED PRECEDING)),
span AS (SELECT i.run_id, i.cond, i.conf AS ci, j.conf AS cj, (j.cp - i.cp + i.pos) / (j.cn - i.cn + i.n) AS m FROM cum i JOIN cum j ON i.run_id = j.run_id AND i.cond = j.cond AND i.conf <= j.conf),
low AS (SELECT a.run_id, a.cond, a.ci, a.cj, min(b.m) AS low FROM span a JOIN span b ON a.run_id = b.run_id AND a.cond = b.cond AND a.ci = b.ci AND b.cj >= a.cj GROUP BY ALL),
fit AS (SELECT t.run_id, t.cond, t.conf, t.n, t.pos, max(l.low) AS fit FROM atom t JOIN low l ON l.run_id = t.run_id AND l.cond = t.cond AND l.cj = t.conf GROUP BY ALL)"""


@query("g3_isotonic_fit", W + f", {ATOMS}, {_FIT} SELECT run_id, cond, conf, n, {B('pos')} AS pos, round(fit, 8) AS fit FROM fit")
def g3(spark, folder):
    return rm.isotonic(rm.atoms(done(spark, folder), BY), BY).select(*BY, "conf", "n", "pos", F.round("fit", 8).alias("fit"))


@query("g4_corp", W + f""", {ATOMS}, {_FIT}, s AS (SELECT run_id, cond, sum(n) AS n, sum(pos) / sum(n) AS base, sum(pos * power(1 - conf, 2) + (n - pos) * power(conf, 2)) / sum(n) AS brier, sum(pos * power(1 - fit, 2) + (n - pos) * power(fit, 2)) / sum(n) AS recal FROM fit GROUP BY ALL),
u AS (SELECT *, base * (1 - base) AS unc FROM s)
SELECT run_id, cond, {B('n')} AS n, CAST(round(CAST(base AS DECIMAL(24, 12)), 8) AS DOUBLE) AS base_rate, CAST(round(CAST(brier AS DECIMAL(24, 12)), 8) AS DOUBLE) AS brier, CAST(round(CAST(brier - recal AS DECIMAL(24, 12)), 8) AS DOUBLE) AS mcb, CAST(round(CAST(unc - recal AS DECIMAL(24, 12)), 8) AS DOUBLE) AS dsc, CAST(round(CAST(unc AS DECIMAL(24, 12)), 8) AS DOUBLE) AS unc, CAST(round(CAST((unc - brier) / nullif(unc, 0) AS DECIMAL(24, 12)), 8) AS DOUBLE) AS brier_skill, CAST(round(CAST((unc - recal) / nullif(unc, 0) AS DECIMAL(24, 12)), 8) AS DOUBLE) AS dsc_share, CAST(round(CAST((brier - recal) / nullif(unc, 0) AS DECIMAL(24, 12)), 8) AS DOUBLE) AS mcb_share FROM u""")
def g4(spark, folder):
    return rm.corp(rm.atoms(done(spark, folder), BY), BY)


@query("g5_empirical_threshold", W + f", {CAND} SELECT run_id, threshold, round(coverage, 8) AS coverage, round(risk, 8) AS risk, {B('accepted')} AS accepted FROM emp")
def g5(spark, folder):
    got = th.empirical_threshold(th.candidates(development(spark, folder), ["run_id"]), ["run_id"], 0.25)
    return got.withColumn("coverage", F.round("coverage", 8)).withColumn("risk", F.round("risk", 8))


@query("g6_contract_threshold", W + f""", {CAND} SELECT t.run_id, CASE WHEN e.threshold IS NULL OR e.coverage < 0.1 THEN 'risk-contract infeasible' ELSE 'candidate' END AS status, e.threshold, round(e.coverage, 8) AS coverage, round(e.risk, 8) AS risk,
CASE WHEN e.threshold IS NULL THEN 'no threshold meets the risk target' WHEN e.coverage < 0.1 THEN 'coverage below the minimum' END AS reason FROM tot t LEFT JOIN emp e ON e.run_id = t.run_id""")
def g6(spark, folder):
    dev = development(spark, folder)
    return th.contract_threshold(th.candidates(dev, ["run_id"]), dev.select("run_id").distinct(), ["run_id"], 0.25, 0.1)


@query("g7_fixed_coverage_threshold", W + f""", {CAND} SELECT b.run_id, CASE WHEN f.threshold IS NULL THEN 'target unattainable' ELSE 'selected' END AS status, f.threshold, round(coalesce(f.coverage, b.best), 8) AS coverage, round(f.risk, 8) AS risk, {B('coalesce(f.accepted, 0)')} AS accepted FROM best b LEFT JOIN fix f ON f.run_id = b.run_id""")
def g7(spark, folder):
    got = th.fixed_coverage_threshold(th.candidates(development(spark, folder), ["run_id"]), ["run_id"], 0.5)
    return got.withColumn("coverage", F.round("coverage", 8)).withColumn("risk", F.round("risk", 8))


_AT = "a AND c AND coalesce(conf >= p.threshold, false)"


@query("g8_frozen_endpoints", W + f""", {CAND}, {FROZEN} SELECT o.run_id, o.cond, p.threshold, p.endpoint, p.risk_contract, count(*) AS n, round(sum(CASE WHEN {_AT} THEN 1 ELSE 0 END) / count(*), 8) AS coverage,
round(sum(CASE WHEN {_AT} AND NOT y THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN {_AT} THEN 1 ELSE 0 END), 0), 8) AS risk FROM done o JOIN pol p ON p.run_id = o.run_id AND p.threshold IS NOT NULL WHERE o.part = 'test' GROUP BY ALL""")
def g8(spark, folder):
    """The flagship: thresholds frozen on development rows, applied unchanged to the test rows of every condition."""
    rows = done(spark, folder)
    policy = th.frozen_endpoint(rows.filter((F.col("part") == "development") & (F.col("cond") == REFERENCE)), ["run_id"], 0.25, 0.1, 0.5)
    joined = rows.filter("part = 'test'").join(policy.filter("threshold is not null"), "run_id")
    acc = accepts(F.col("threshold"))
    return joined.groupBy("run_id", "cond", "threshold", "endpoint", "risk_contract").agg(F.count("*").alias("n"), F.round(F.count_if(acc) / F.count("*"), 8).alias("coverage"), F.round(F.try_divide(F.count_if(acc & ~F.col("y")).cast("double"), F.count_if(acc).cast("double")), 8).alias("risk"))


@query("f27_policy_tally", W + f", {CAND}, {FROZEN} SELECT CASE WHEN threshold IS NULL THEN 'threshold infeasible' ELSE 'selected' END AS status, risk_contract, coalesce(endpoint, '(none)') AS endpoint, count(*) AS policies FROM pol GROUP BY ALL")
def f27(spark, folder):
    return th.policy_tally(th.frozen_endpoint(development(spark, folder), ["run_id"], 0.25, 0.1, 0.5))


@query("g14_coverage_steps", W + f", {ATOMS} SELECT run_id, cond, conf, round(sum(n) OVER (PARTITION BY run_id, cond ORDER BY conf DESC ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY run_id, cond), 8) AS reachable FROM atom")
def g14(spark, folder):
    return rm.coverage_steps(rm.atoms(done(spark, folder), BY), BY)


@query("c16_c17_logit_and_violation", W + "SELECT run_id, cond, round(avg(ln(least(greatest(conf, 0.000001), 0.999999) / (1 - least(greatest(conf, 0.000001), 0.999999)))), 6) AS mean_logit, round(greatest(sum(CASE WHEN y THEN 0 ELSE 1 END) / count(*) - 0.25, 0.0), 8) AS violation FROM done WHERE acc GROUP BY ALL")
def c16(spark, folder):
    agg = done(spark, folder).filter(accepts(TAU)).groupBy(*BY).agg(F.avg(logit(F.col("conf"))).alias("l"), F.avg((~F.col("y")).cast("double")).alias("r"))
    return agg.select(*BY, F.round("l", 6).alias("mean_logit"), F.round(violation(F.col("r"), 0.25), 8).alias("violation"))


@query("n10_condition_coverage", W + "SELECT run_id, " + ", ".join(f"round(avg(CASE WHEN cond = '{c}' THEN CASE WHEN acc THEN 1.0 ELSE 0.0 END END), 8) AS {n}" for n, c in (("reference", "reference"), ("hot", "high-temperature"), ("narrow", "low-top-p"))) + " FROM done GROUP BY run_id")
def n10(spark, folder):
    acc = accepts(TAU).cast("double")
    return done(spark, folder).groupBy("run_id").agg(*[F.round(F.avg(F.when(F.col("cond") == c, acc)), 8).alias(n) for n, c in (("reference", REFERENCE), ("hot", HOT), ("narrow", NARROW))])


@query("n8_report_scalars", W + ", s AS (SELECT run_id, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS acc FROM done GROUP BY 1), r AS (SELECT acc, row_number() OVER (ORDER BY acc) - 1 AS k, count(*) OVER () AS n FROM s) SELECT max(n) AS runs, round(min(acc), 8) AS least, round(max(acc), 8) AS most, round(max(CASE WHEN k = n // 2 THEN acc END), 8) AS upper_median FROM r")
def n8(spark, folder):
    from pyspark.sql import Window

    acc = done(spark, folder).groupBy("run_id").agg(F.avg(F.col("y").cast("double")).alias("acc"))  # one row per run
    ranked = acc.select("acc", (F.row_number().over(Window.orderBy("acc")) - 1).alias("k"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("n"))
    return ranked.agg(F.max("n").alias("runs"), F.round(F.min("acc"), 8).alias("least"), F.round(F.max("acc"), 8).alias("most"), F.round(F.max(F.when(F.col("k") == F.floor(F.col("n") / 2), F.col("acc"))), 8).alias("upper_median"))


@query("f6_threshold_points", W + "SELECT run_id, cond, t.tau, round(sum(CASE WHEN a AND c AND coalesce(conf >= t.tau, false) THEN 1 ELSE 0 END) / count(*), 8) AS coverage, round(sum(CASE WHEN a AND c AND coalesce(conf >= t.tau, false) AND NOT y THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN a AND c AND coalesce(conf >= t.tau, false) THEN 1 ELSE 0 END), 0), 8) AS risk FROM done, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.7 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) t(tau) GROUP BY ALL")
def f6(spark, folder):
    spread = done(spark, folder).withColumn("tau", F.explode(F.array(F.lit(0.5), F.lit(0.7), F.lit(0.9))))
    acc = accepts(F.col("tau"))
    return spread.groupBy(*BY, "tau").agg(F.round(F.count_if(acc) / F.count("*"), 8).alias("coverage"), F.round(F.try_divide(F.count_if(acc & ~F.col("y")).cast("double"), F.count_if(acc).cast("double")), 8).alias("risk"))


@query("b12_effect_eligibility", W + f""", {ATOMS}, v AS (SELECT run_id, cond, var_samp(conf) / count(*) AS variance, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS estimate FROM done WHERE c GROUP BY ALL)
SELECT run_id, cond, CASE WHEN estimate IS NULL THEN 'no estimate' WHEN variance IS NULL THEN 'no variance' WHEN variance <= 0 THEN 'variance is not positive' ELSE 'eligible' END AS reason FROM v""")
def b12(spark, folder):
    agg = done(spark, folder).filter("c").groupBy(*BY).agg((F.var_samp("conf") / F.count("*")).alias("variance"), F.avg(F.col("y").cast("double")).alias("estimate"))
    return agg.select(*BY, F.when(F.col("estimate").isNull(), "no estimate").when(F.col("variance").isNull(), "no variance").when(F.col("variance") <= 0, "variance is not positive").otherwise("eligible").alias("reason"))


@query("f2_outcome_rows", W + f"SELECT {_KIND} AS kind, count(*) AS n FROM done GROUP BY 1")
def f2_rows(spark, folder):
    return done(spark, folder).groupBy(outcome(TAU).alias("kind")).agg(F.count("*").alias("n"))
