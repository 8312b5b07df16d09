"""Resampling, inference, variance and fitting queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemlab.functions.expressions import accepts, decimal_round
from tandemlab.operators import endpoints as ep
from tandemlab.operators import fits, inference, metrics, resample, sampling, variance
from tandemlab.operators import ranking_metrics as rm
from tandemlab.operators import thresholds as th
from tandemlab.operators.ranking import range_rank
from tandemlab.plans.endpoint_queries import _STRENGTH, BY, CAND, FROZEN, HOT, NARROW, REFERENCE, SUM, TAU, W, cell, development, done
from tandemlab.sources.tables import materialize, table

QUERIES, SQL = {}, {}
REPLICATES = 100
#: Bootstrap and randomisation replicates of the main table: all of the studied analysis.
BOOTSTRAPS, SWAPS = 5000, 9999


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def stats(spark, folder):
    rows = cell(spark, folder).filter(F.col("run_id").isNotNull() & F.col("item").isNotNull())
    return materialize(resample.cluster_stats(rows, TAU, REFERENCE, [HOT, NARROW]))


_HASH = lambda *p: f"CAST('0x' || substr(md5({" || ':' || ".join(p)}), 1, 15) AS BIGINT)"
_STATS = """su AS (SELECT run_id, item AS unit, cond, count(*) AS n, sum(CASE WHEN a THEN 0 ELSE 1 END) AS q, sum(CASE WHEN acc THEN 1 ELSE 0 END) AS acc, sum(CASE WHEN acc AND NOT y THEN 1 ELSE 0 END) AS err, sum(CASE WHEN a AND NOT c THEN 1 ELSE 0 END) AS cf FROM cell WHERE run_id IS NOT NULL AND item IS NOT NULL GROUP BY ALL),
st AS (SELECT s.run_id, s.cond AS contrast, s.unit, row_number() OVER (PARTITION BY s.run_id, s.cond ORDER BY s.unit) - 1 AS idx, r.n AS n0, s.n AS n1, r.q AS q0, s.q AS q1, r.acc AS acc0, s.acc AS acc1, r.err AS err0, s.err AS err1, r.cf AS cf0, s.cf AS cf1
  FROM su s JOIN su r ON r.run_id = s.run_id AND r.unit = s.unit AND r.cond = 'reference' WHERE s.cond IN ('high-temperature', 'low-top-p'))"""
_DELTA = """sum(q1) / sum(n1) - sum(q0) / sum(n0) AS d_q, sum(acc1) / sum(n1) - sum(acc0) / sum(n0) AS d_k, sum(err1) / nullif(sum(acc1), 0) - sum(err0) / nullif(sum(acc0), 0) AS d_r,
CASE WHEN sum(acc1) > 0 AND sum(acc0) > 0 THEN (sum(acc1) - sum(err1)) / sum(n1) - (sum(acc0) - sum(err0)) / sum(n0) END AS d_s, sum(err1) / sum(n1) - sum(err0) / sum(n0) AS d_e, sum(cf1) / sum(n1) - sum(cf0) / sum(n0) AS d_c"""
_DRAWS_OF = lambda replicates: f"""sz AS (SELECT run_id, contrast, count(*) AS size FROM st GROUP BY ALL),
dr AS (SELECT run_id, contrast, b, size, unnest(range(0, size)) AS j FROM sz, range(0, {replicates}) t(b)),
pk AS (SELECT run_id, contrast, b, {_HASH("'17'", 'b', 'j')} % size AS idx FROM dr),
bo AS (SELECT p.run_id, p.contrast, p.b, {_DELTA} FROM pk p JOIN st ON st.run_id = p.run_id AND st.contrast = p.contrast AND st.idx = p.idx GROUP BY ALL)"""  # noqa: E731
_DRAWS = _DRAWS_OF(REPLICATES)


@query("h1_resampling_design", W + ", m AS (SELECT dataset_id, count(DISTINCT cluster) AS clusters FROM obs GROUP BY 1) SELECT dataset_id, clusters, clusters < 2 AS dropped FROM m")
def h1(spark, folder):
    from tandemlab.plans.endpoint_queries import obs

    return obs(spark, folder).groupBy("dataset_id").agg(F.countDistinct("cluster").alias("clusters")).withColumn("dropped", F.col("clusters") < 2)


@query("h2_bootstrap_draws", W + f", {_STATS}, {_DRAWS} SELECT run_id, contrast, b, count(*) AS draws, count(DISTINCT idx) AS units FROM pk GROUP BY ALL")
def h2(spark, folder):
    draws = resample.bootstrap_draws(stats(spark, folder), REPLICATES, 17)
    return draws.groupBy("run_id", "contrast", "b").agg(F.count("*").alias("draws"), F.countDistinct("idx").alias("units")).withColumn("b", F.col("b").cast("bigint"))


@query("h4_paired_bootstrap", W + f", {_STATS}, {_DRAWS} SELECT run_id, contrast, count(d_r) AS replicates, CASE WHEN count(d_r) >= 20 THEN round(quantile_cont(d_r, 0.025), 6) END AS ci_low, CASE WHEN count(d_r) >= 20 THEN round(quantile_cont(d_r, 0.975), 6) END AS ci_high FROM bo WHERE d_r IS NOT NULL GROUP BY ALL")
def h4(spark, folder):
    draws = resample.endpoint_deltas(resample.bootstrap_draws(stats(spark, folder), REPLICATES, 17), ["run_id", "contrast", "b"])
    return resample.intervals(draws, ["run_id", "contrast"], "d_r", least=20)


_INDEX = lambda n: f"""rk AS (SELECT run_id, contrast, d_k, row_number() OVER (PARTITION BY run_id, contrast ORDER BY d_k) - 1 AS k, count(*) OVER (PARTITION BY run_id, contrast) AS m FROM bo WHERE d_k IS NOT NULL)
SELECT run_id, contrast, count(*) AS replicates, round(max(CASE WHEN k = least(m - 1, floor((1 - CAST(0.95 AS DOUBLE)) / 2 * {n})) THEN d_k END), 6) AS ci_low, round(max(CASE WHEN k = least(m - 1, floor((1 - (1 - CAST(0.95 AS DOUBLE)) / 2) * {n})) THEN d_k END), 6) AS ci_high FROM rk GROUP BY ALL"""  # noqa: E731


@query("g11_index_quantiles", W + f", {_STATS}, {_DRAWS}, " + _INDEX("m"))
def g11(spark, folder):
    draws = resample.endpoint_deltas(resample.bootstrap_draws(stats(spark, folder), REPLICATES, 17), ["run_id", "contrast", "b"])
    return resample.intervals(draws, ["run_id", "contrast"], "d_k", convention="index_n")


@query("g12_index_quantiles_minus_1", W + f", {_STATS}, {_DRAWS}, " + _INDEX("(m - 1)"))
def g12(spark, folder):
    draws = resample.endpoint_deltas(resample.bootstrap_draws(stats(spark, folder), REPLICATES, 17), ["run_id", "contrast", "b"])
    return resample.intervals(draws, ["run_id", "contrast"], "d_k", convention="index_n_minus_1")


@query("g10_g13_interval", W + f", {_STATS}, {_DRAWS} SELECT run_id, contrast, count(d_k) AS replicates, round(quantile_cont(d_k, 0.05), 6) AS ci_low, round(quantile_cont(d_k, 0.95), 6) AS ci_high FROM bo WHERE d_k IS NOT NULL GROUP BY ALL")
def g13(spark, folder):
    draws = resample.endpoint_deltas(resample.bootstrap_draws(stats(spark, folder), REPLICATES, 17), ["run_id", "contrast", "b"])
    return resample.intervals(draws, ["run_id", "contrast"], "d_k", level=0.9)


@query("h3_endpoint_deltas", W + f", {_STATS}, d AS (SELECT run_id, contrast, {_DELTA} FROM st GROUP BY ALL) SELECT run_id, contrast, " + ", ".join(f"round({c}, 8) AS {c}" for c in ("d_q", "d_k", "d_r", "d_s", "d_e", "d_c")) + " FROM d")
def h3(spark, folder):
    d = resample.endpoint_deltas(stats(spark, folder), ["run_id", "contrast"])
    return d.select("run_id", "contrast", *[F.round(c, 8).alias(c) for c in ("d_q", "d_k", "d_r", "d_s", "d_e", "d_c")])


_CUTS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712)
_WEIGHT = " + ".join(f"CASE WHEN u >= CAST({c} AS DOUBLE) THEN 1 ELSE 0 END" for c in _CUTS)


@query("h3_poisson_bootstrap", W + f", {_STATS}, pu AS (SELECT *, {_HASH("'17'", "b", "unit")} / CAST(1152921504606846976 AS DOUBLE) AS u FROM st, range(0, {REPLICATES}) t(b)), pw AS (SELECT *, {_WEIGHT} AS w FROM pu), pd AS (SELECT run_id, contrast, b, sum(acc1 * w) / sum(n1 * w) - sum(acc0 * w) / sum(n0 * w) AS d_k FROM pw WHERE w > 0 GROUP BY ALL) SELECT run_id, contrast, count(d_k) AS replicates, round(quantile_cont(d_k, 0.025), 6) AS ci_low, round(quantile_cont(d_k, 0.975), 6) AS ci_high FROM pd WHERE d_k IS NOT NULL GROUP BY ALL")
def h3p(spark, folder):
    return resample.intervals(resample.poisson_bootstrap(stats(spark, folder), ["run_id", "contrast"], REPLICATES, 17), ["run_id", "contrast"], "d_k")


_RAND_OF = lambda replicates: f"""ob AS (SELECT run_id, contrast, abs(sum(acc1) / sum(n1) - sum(acc0) / sum(n0)) AS observed FROM st GROUP BY ALL),
sw AS (SELECT run_id, contrast, b, CASE WHEN {_HASH("'29'", 'b', 'idx')} % 2 = 0 THEN acc1 ELSE acc0 END AS x1, CASE WHEN {_HASH("'29'", 'b', 'idx')} % 2 = 0 THEN acc0 ELSE acc1 END AS x0, CASE WHEN {_HASH("'29'", 'b', 'idx')} % 2 = 0 THEN n1 ELSE n0 END AS m1, CASE WHEN {_HASH("'29'", 'b', 'idx')} % 2 = 0 THEN n0 ELSE n1 END AS m0 FROM st, range(0, {replicates}) t(b)),
dd AS (SELECT run_id, contrast, b, abs(sum(x1) / sum(m1) - sum(x0) / sum(m0)) AS d FROM sw GROUP BY ALL),
pv AS (SELECT d.run_id, d.contrast, round(max(o.observed), 8) AS observed, round((sum(CASE WHEN d.d >= o.observed - 1e-12 THEN 1 ELSE 0 END) + 1) / ({replicates} + 1), 8) AS p FROM dd d JOIN ob o ON o.run_id = d.run_id AND o.contrast = d.contrast GROUP BY ALL)"""  # noqa: E731
_RAND = _RAND_OF(REPLICATES)
_HOLM = "hm AS (SELECT *, round(max(s) OVER (PARTITION BY run_id ORDER BY p, contrast ROWS UNBOUNDED PRECEDING), 8) AS adjusted FROM (SELECT *, least(1.0, (count(*) OVER (PARTITION BY run_id) - row_number() OVER (PARTITION BY run_id ORDER BY p, contrast) + 1) * p) AS s FROM pv))"


@query("h8_h9_randomisation", W + f", {_STATS}, {_RAND} SELECT * FROM pv")
def h9(spark, folder):
    return resample.randomisation_p(stats(spark, folder), "d_k", REPLICATES, 29)


@query("g9_holm", W + f", {_STATS}, {_RAND}, {_HOLM} SELECT run_id, contrast, observed, p, adjusted, adjusted <= 0.05 AS reject FROM hm")
def g9(spark, folder):
    return inference.holm(resample.randomisation_p(stats(spark, folder), "d_k", REPLICATES, 29), ["run_id"], "p", F.col("contrast"))


_CI = "ci AS (SELECT run_id, contrast, round(quantile_cont(d_k, 0.025), 6) AS ci_low, round(quantile_cont(d_k, 0.975), 6) AS ci_high FROM bo WHERE d_k IS NOT NULL GROUP BY ALL)"
_CLASS = "cl AS (SELECT h.run_id, h.contrast, h.reject, c.ci_low > -0.05 AND c.ci_high < 0.05 AS equivalent, CASE WHEN h.reject THEN 'change_detected' WHEN c.ci_low > -0.05 AND c.ci_high < 0.05 THEN 'equivalent_within_margin' WHEN c.ci_low IS NULL THEN 'not_estimable' ELSE 'inconclusive' END AS classification FROM (SELECT *, adjusted <= 0.05 AS reject FROM hm) h LEFT JOIN ci c ON c.run_id = h.run_id AND c.contrast = h.contrast)"


def classified(spark, folder, bootstraps=REPLICATES, swaps=REPLICATES):
    st = stats(spark, folder)
    tests = inference.holm(resample.randomisation_p(st, "d_k", swaps, 29), ["run_id"], "p", F.col("contrast"))
    ci = resample.intervals(resample.endpoint_deltas(resample.bootstrap_draws(st, bootstraps, 17), ["run_id", "contrast", "b"]), ["run_id", "contrast"], "d_k")
    return inference.classify(tests.join(ci, ["run_id", "contrast"], "left"), 0.05)


@query("h14_classify", W + f", {_STATS}, {_DRAWS}, {_RAND}, {_HOLM}, {_CI}, {_CLASS} SELECT run_id, contrast, equivalent, classification, reject AND coalesce(equivalent, false) AS overlap FROM cl")
def h14(spark, folder):
    return classified(spark, folder).select("run_id", "contrast", "equivalent", "classification", "overlap")


@query("f26_separation", W + f""", {_STATS}, {_DRAWS}, {_RAND}, {_HOLM}, {_CI}, {_CLASS}, {_STRENGTH}, rl AS (SELECT *, round(greatest(answer_changed, confidence_changed), 8) AS realisation FROM strength),
j AS (SELECT coalesce(c.equivalent, false) AS eq, r.realisation FROM cl c JOIN rl r ON r.run_id = c.run_id AND r.cond = c.contrast WHERE r.realisation IS NOT NULL)
SELECT max(CASE WHEN eq THEN realisation END) AS max_equivalent, min(CASE WHEN NOT eq THEN realisation END) AS min_other, CAST(sum(CASE WHEN eq THEN 1 ELSE 0 END) AS BIGINT) AS equivalent_contrasts, max(CASE WHEN eq THEN realisation END) < min(CASE WHEN NOT eq THEN realisation END) AS separated FROM j""")
def f26(spark, folder):
    strength = ep.intervention_strength(cell(spark, folder), REFERENCE).select("run_id", F.col("cond").alias("contrast"), "realisation")
    return inference.separation(classified(spark, folder).join(strength, ["run_id", "contrast"]))


@query("h11_h12_noninferiority", W + f", {_STATS}, {_DRAWS} SELECT run_id, contrast, count(d_k) AS replicates, round(quantile_cont(d_k, 0.05), 6) AS ci_low, round(quantile_cont(d_k, 0.95), 6) AS ci_high, round(quantile_cont(d_k, 0.95), 6) <= 0.05 AS noninferior FROM bo WHERE d_k IS NOT NULL GROUP BY ALL")
def h12(spark, folder):
    draws = resample.endpoint_deltas(resample.bootstrap_draws(stats(spark, folder), REPLICATES, 17), ["run_id", "contrast", "b"])
    return inference.noninferior(resample.intervals(draws, ["run_id", "contrast"], "d_k", level=0.9), 0.05)


@query("h10_transport", W + f""", {CAND}, g AS (SELECT o.run_id, o.cond, avg(CASE WHEN a AND c AND coalesce(conf >= f.threshold, false) THEN 1.0 ELSE 0.0 END) AS k, sum(CASE WHEN a AND c AND coalesce(conf >= f.threshold, false) AND NOT y THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN a AND c AND coalesce(conf >= f.threshold, false) THEN 1 ELSE 0 END), 0) AS r FROM done o JOIN fix f ON f.run_id = o.run_id GROUP BY ALL)
SELECT s.run_id, s.cond, round(s.k, 8) AS coverage, round(s.r, 8) AS risk, round(s.r - r.r, 8) AS delta_risk, round(s.k - r.k, 8) AS delta_coverage, round(s.k - 0.5, 8) AS delta_from_target FROM g s JOIN g r ON r.run_id = s.run_id AND r.cond = 'reference' WHERE s.cond <> 'reference'""")
def h10(spark, folder):
    policy = th.fixed_coverage_threshold(th.candidates(development(spark, folder), ["run_id"]), ["run_id"], 0.5)
    return inference.transport(done(spark, folder), policy, REFERENCE, 0.5)


def bound_sql(src: str, key: str) -> str:
    """CTE ``bd`` (key, n, e, upper): exact upper bounds of ``src`` (key, n, e) by bisection on the summed binomial terms."""
    return f"""bd AS (
  WITH RECURSIVE t AS (
    SELECT {key}, n, e, e / n AS lo, CAST(1.0 AS DOUBLE) AS hi, 0 AS k FROM {src} WHERE n > 0
    UNION ALL
    SELECT {key}, n, e, CASE WHEN tail <= 0.05 THEN lo ELSE mid END, CASE WHEN tail <= 0.05 THEN mid ELSE hi END, k + 1
    FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(0, CAST(e AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)))) AS tail FROM t WHERE k < 50 AND e < n))
  SELECT {key}, n, e, CASE WHEN e >= n THEN CAST(1.0 AS DOUBLE) ELSE hi END AS upper FROM t WHERE k = 50 OR e >= n)"""


def _certify_sql(target: float) -> str:
    at = "a AND c AND coalesce(conf >= p.threshold, false)"
    return f"""{CAND}, {FROZEN}, ce AS (SELECT o.run_id, any_value(o.dataset_id) AS dataset_id, count(*) AS total, {SUM(at)} AS n, {SUM(at + " AND NOT y")} AS e FROM done o JOIN pol p ON p.run_id = o.run_id AND p.threshold IS NOT NULL WHERE o.part = 'certification' AND o.cond = 'reference' GROUP BY 1),
{bound_sql("ce", "run_id")}, cf AS (SELECT c.run_id, c.dataset_id, c.total, c.n, c.e, round(b.upper, 6) AS upper, round(c.n / c.total, 8) AS coverage, round(c.e / nullif(c.n, 0), 8) AS risk, c.n / c.total < 0.1 AS thin, b.upper IS NULL OR round(b.upper, 6) > {target} AS loose FROM ce c LEFT JOIN bd b ON b.run_id = c.run_id)"""


@query("h6_h7_certify", W + f", {_certify_sql(0.25)} SELECT run_id, total AS n, n AS accepted, e AS errors, coverage, risk, upper, CASE WHEN thin OR loose THEN 'infeasible' ELSE 'certified' END AS status, CASE WHEN thin THEN 'coverage' WHEN loose THEN 'bound' END AS reason FROM cf")
def h7(spark, folder):
    rows = done(spark, folder)
    policy = th.frozen_endpoint(rows.filter((F.col("part") == "development") & (F.col("cond") == REFERENCE)), ["run_id"], 0.25, 0.1, 0.5)
    return inference.certify(rows.filter((F.col("part") == "certification") & (F.col("cond") == REFERENCE)), policy, ["run_id"], 0.25, 0.1)


@query("h6_exact_upper_bound", W + """, e AS (SELECT run_id, count(*) AS n, sum(CASE WHEN y THEN 0 ELSE 1 END) AS e FROM done WHERE acc AND cond = 'reference' GROUP BY 1),
bis AS (
  WITH RECURSIVE t AS (
    SELECT run_id, n, e, e / n AS lo, CAST(1.0 AS DOUBLE) AS hi, 0 AS k FROM e
    UNION ALL
    SELECT run_id, n, e, CASE WHEN tail <= 0.05 THEN lo ELSE mid END, CASE WHEN tail <= 0.05 THEN mid ELSE hi END, k + 1
    FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(range(0, CAST(e AS BIGINT) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((lo + hi) / 2) + (n - i) * ln(1 - (lo + hi) / 2)))) AS tail FROM t WHERE k < 60 AND e < n))
  SELECT run_id, n, e, hi FROM t WHERE k = 60 OR e >= n)
SELECT run_id, n AS accepted, CAST(e AS BIGINT) AS errors, round(CASE WHEN e >= n THEN 1.0 ELSE hi END, 6) AS upper FROM bis""")
def h6(spark, folder):
    agg = done(spark, folder).filter(accepts(TAU) & (F.col("cond") == REFERENCE)).groupBy("run_id").agg(F.count("*").alias("accepted"), F.count_if(~F.col("y")).alias("errors"))
    return inference.with_upper_bound(agg, "errors", "accepted")


@query("h13_auroc_portability", W + """, atm AS (SELECT run_id, cond, conf, count(*) AS n, sum(CASE WHEN y THEN 1 ELSE 0 END) AS pos FROM cell WHERE c GROUP BY ALL),
wk AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY run_id, cond ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM atm),
au AS (SELECT run_id, cond, round(sum(pos * below + 0.5 * pos * (n - pos)) / nullif(sum(pos) * sum(n - pos), 0), 8) AS auroc FROM wk GROUP BY ALL)
SELECT s.run_id, s.cond, round(s.auroc - r.auroc, 8) AS delta FROM au s JOIN au r ON r.run_id = s.run_id AND r.cond = 'reference' WHERE s.cond <> 'reference'""")
def h13(spark, folder):
    auc = rm.auroc(rm.atoms(cell(spark, folder), BY), BY).select(*BY, "auroc")
    ref = auc.filter(F.col("cond") == REFERENCE).select("run_id", F.col("auroc").alias("r"))
    return auc.filter(F.col("cond") != REFERENCE).join(ref, "run_id").select(*BY, F.round(F.col("auroc") - F.col("r"), 8).alias("delta"))


_AUC_B = f"""cu AS (SELECT run_id, item, conf, count(*) AS n, sum(CASE WHEN y THEN 1 ELSE 0 END) AS pos FROM cell WHERE c AND cond = 'reference' AND run_id IS NOT NULL AND item IS NOT NULL GROUP BY ALL),
un AS (SELECT run_id, item, row_number() OVER (PARTITION BY run_id ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT run_id, item FROM cu)),
us AS (SELECT run_id, count(*) AS size FROM un GROUP BY 1), ud AS (SELECT run_id, b, size, unnest(range(0, size)) AS j FROM us, range(0, 40) t(b)),
up AS (SELECT run_id, b, {_HASH("'31'", 'b', 'j')} % size AS idx, count(*) AS w FROM ud GROUP BY ALL),
ba AS (SELECT p.run_id, p.b, c.conf, sum(p.w * c.n) AS n, sum(p.w * c.pos) AS pos FROM up p JOIN un u ON u.run_id = p.run_id AND u.idx = p.idx JOIN cu c ON c.run_id = u.run_id AND c.item = u.item GROUP BY ALL),
bw AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY run_id, b ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ba),
bu AS (SELECT run_id, b, round(sum(pos * below + 0.5 * pos * (n - pos)) / nullif(sum(pos) * sum(n - pos), 0), 8) AS auroc FROM bw GROUP BY ALL)"""


@query("h15_reference_quality_bootstrap", W + f", {_AUC_B} SELECT run_id, count(*) AS replicates, round(quantile_cont(auroc, 0.025), 6) AS ci_low, round(quantile_cont(auroc, 0.975), 6) AS ci_high, round(quantile_cont(auroc, 0.025), 6) > 0.5 OR round(quantile_cont(auroc, 0.975), 6) < 0.5 AS excludes_half FROM bu WHERE auroc IS NOT NULL GROUP BY 1")
def h15(spark, folder):
    """AUROC by item bootstrap: multiplicities are joined to (item, score) counts, so a replicate is a weighted atom table."""
    rows = cell(spark, folder).filter((F.col("cond") == REFERENCE) & F.col("c") & F.col("run_id").isNotNull() & F.col("item").isNotNull())
    counts = materialize(rows.groupBy("run_id", "item", "conf").agg(F.count("*").alias("n"), F.count_if("y").alias("pos")))
    units = range_rank(counts.select("run_id", "item").distinct(), ["run_id"], ["item"], "idx").withColumn("idx", (F.col("idx") - 1).cast("int"))
    sizes = units.groupBy("run_id").agg(F.count("*").alias("size"))
    draws = resample.draw_positions(sizes, ["run_id"], 40)
    picked = draws.groupBy("run_id", "b", (resample.hash_number(F.lit(31), F.col("b"), F.col("j")) % F.col("size")).cast("int").alias("idx")).agg(F.count("*").alias("w"))
    atom = resample.at_positions(resample.at_positions(picked, units, ["run_id", "idx"]), counts, ["run_id", "item"]).groupBy("run_id", "b", "conf").agg(F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("pos")).alias("pos"))
    auc = rm.auroc(atom, ["run_id", "b"])
    return resample.intervals(auc, ["run_id"], "auroc").withColumn("excludes_half", (F.col("ci_low") > 0.5) | (F.col("ci_high") < 0.5))


_GRID = "gr AS (SELECT dataset_id, item, avg(CASE WHEN cond = 'reference' AND seed = 11 THEN CASE WHEN y THEN 1.0 ELSE 0.0 END END) AS r00, avg(CASE WHEN cond = 'high-temperature' AND seed = 11 THEN CASE WHEN y THEN 1.0 ELSE 0.0 END END) AS r10, avg(CASE WHEN cond = 'reference' AND seed = 23 THEN CASE WHEN y THEN 1.0 ELSE 0.0 END END) AS r01, avg(CASE WHEN cond = 'high-temperature' AND seed = 23 THEN CASE WHEN y THEN 1.0 ELSE 0.0 END END) AS r11 FROM cell GROUP BY ALL)"


@query("h16_decomposition", W + f", {_GRID} SELECT dataset_id, count(*) AS units, round(avg(r10 - r00), 8) AS answer_effect, round(avg(r01 - r00), 8) AS readout_effect, round(avg(r11 - r10 - r01 + r00), 8) AS interaction FROM gr WHERE r00 IS NOT NULL AND r10 IS NOT NULL AND r01 IS NOT NULL AND r11 IS NOT NULL GROUP BY 1")
def h16(spark, folder):
    y = F.col("y").cast("double")
    at = lambda c, s: F.avg(F.when((F.col("cond") == c) & (F.col("seed") == s), y))
    grid = cell(spark, folder).groupBy("dataset_id", "item").agg(at(REFERENCE, 11).alias("r00"), at(HOT, 11).alias("r10"), at(REFERENCE, 23).alias("r01"), at(HOT, 23).alias("r11"))
    return variance.decomposition(grid, ["dataset_id"])


@query("f15_seed_summary", W + """, ac AS (SELECT run_id, cond, seed, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS acc FROM cell GROUP BY ALL), dl AS (SELECT s.run_id, s.cond, s.acc - r.acc AS d FROM ac s JOIN ac r ON r.run_id = s.run_id AND r.seed = s.seed AND r.cond = 'reference' WHERE s.cond <> 'reference')
SELECT run_id, cond, count(*) AS seeds, round(avg(d), 8) AS mean, round(stddev_pop(d), 8) AS sd, round(max(d) - min(d), 8) AS spread, count(DISTINCT CASE WHEN d <> 0 THEN sign(d) END) <= 1 AS sign_consistent FROM dl GROUP BY ALL""")
def f15(spark, folder):
    return variance.seed_summary(cell(spark, folder), REFERENCE)


@query("f16_variance_split", W + """, pe AS (SELECT run_id, cond, item, var_pop(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS v, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS m FROM cell GROUP BY ALL HAVING count(DISTINCT seed) >= 2), g AS (SELECT run_id, cond, count(*) AS items, avg(v) AS w, var_pop(m) AS b FROM pe GROUP BY ALL HAVING count(*) >= 2)
SELECT run_id, cond, items, round(w, 8) AS within, round(b, 8) AS between, round(w / nullif(w + b, 0), 8) AS within_share FROM g""")
def f16(spark, folder):
    return variance.variance_split(cell(spark, folder))


@query("i1_calibration_logistic")
def i1(spark, folder):
    return fits.calibration_logistic(done(spark, folder), ["run_id", "cond"])


def _surface_rows(spark, folder):
    """Line items as a response surface: seven temperatures, nine top-p values, suppliers as clusters, one surface for each return flag."""
    rows = table(spark, folder, "lineitem")
    return rows.select(
        F.col("l_returnflag").alias("plan"), F.col("l_suppkey").cast("string").alias("cluster"), (F.col("l_linenumber") * 0.2).alias("t"), F.round(0.5 + F.col("l_tax") * 5, 2).alias("top_p"),
        (F.col("l_quantity") > 400 * F.col("l_discount") + 5).cast("double").alias("y"))


@query("i2_i4_dense_surface")
def i2(spark, folder):
    return fits.dense_surface(_surface_rows(spark, folder), ["plan"], 0.6, 0.9)


@query("i4_surface_family")
def i4(spark, folder):
    """Surfaces of three outcomes with dummies of the line status; the last is defined for returned lines only."""
    rows = table(spark, folder, "lineitem")
    flat = rows.select(
        F.lit("all").alias("plan"), F.col("l_suppkey").cast("string").alias("cluster"), (F.col("l_linenumber") * 0.2).alias("t"), F.round(0.5 + F.col("l_tax") * 5, 2).alias("top_p"), F.col("l_linestatus").alias("mode"),
        (F.col("l_quantity") > 400 * F.col("l_discount") + 5).cast("double").alias("large"), (F.col("l_returnflag") == "R").cast("double").alias("returned"), F.when(F.col("l_returnflag") == "R", (F.col("l_discount") > 0.05).cast("double")).alias("reduced"))
    return fits.surface_family(flat, ["plan"], ["large", "returned", "reduced"], 0.6, 0.9, ["mode"])


@query("i5_moderated_effects")
def i5_moderated(spark, folder):
    """Coverage effects of all runs, pooled per contrast and regressed on model mode and dataset, or stratified where effects are few."""
    st = stats(spark, folder)
    draws = resample.endpoint_deltas(resample.bootstrap_draws(st, REPLICATES, 17), ["run_id", "contrast", "b"])
    var = draws.groupBy("run_id", "contrast").agg(F.var_samp("d_k").alias("variance"))
    point = resample.endpoint_deltas(st, ["run_id", "contrast"]).select("run_id", "contrast", F.col("d_k").alias("estimate"))
    of = table(spark, folder, "calibration_thresholds").filter("run_id is not null").groupBy("run_id").agg(F.min("model_mode").alias("mode"), F.min("dataset_id").alias("dataset"))
    return fits.moderated(point.join(var, ["run_id", "contrast"]).join(of, "run_id").withColumnRenamed("run_id", "effect_id"), ["contrast"], ["mode", "dataset"])


@query("i3_surface_bootstrap")
def i3(spark, folder):
    return fits.surface_bootstrap(_surface_rows(spark, folder), ["plan"], 0.6, 0.9, 25, 5)


@query("i5_i6_pooled_effects")
def i5(spark, folder):
    st = stats(spark, folder)
    draws = resample.endpoint_deltas(resample.bootstrap_draws(st, REPLICATES, 17), ["run_id", "contrast", "b"])
    var = draws.groupBy("run_id", "contrast").agg(F.var_samp("d_k").alias("variance"))
    point = resample.endpoint_deltas(st, ["run_id", "contrast"]).select("run_id", "contrast", F.col("d_k").alias("estimate"))
    return fits.pooled(point.join(var, ["run_id", "contrast"]).withColumnRenamed("run_id", "effect_id"), ["contrast"])


@query("n9_wald_limits", W + ", v AS (SELECT run_id, cond, avg(CASE WHEN y THEN 1.0 ELSE 0.0 END) AS m, var_samp(CASE WHEN y THEN 1.0 ELSE 0.0 END) / count(*) AS v FROM done GROUP BY ALL) SELECT run_id, cond, round(m, 8) AS estimate, round(m - 1.959963984540054 * sqrt(v), 6) AS lower, round(m + 1.959963984540054 * sqrt(v), 6) AS upper FROM v WHERE v > 0")
def n9(spark, folder):
    y = F.col("y").cast("double")
    agg = done(spark, folder).groupBy(*BY).agg(F.avg(y).alias("m"), (F.var_samp(y) / F.count("*")).alias("v")).filter("v > 0")
    return agg.select(*BY, F.round("m", 8).alias("estimate"), F.round(F.col("m") - fits.Z95 * F.sqrt("v"), 6).alias("lower"), F.round(F.col("m") + fits.Z95 * F.sqrt("v"), 6).alias("upper"))


@query("k3_n11_extremes", W + f", {_STATS}, d AS (SELECT run_id, contrast, {_DELTA} FROM st GROUP BY ALL) SELECT contrast, arg_max(run_id, round(abs(d_k), 9) || run_id) AS run_id, round(max(abs(d_k)), 8) AS widest FROM d GROUP BY 1")
def k3(spark, folder):
    d = resample.endpoint_deltas(stats(spark, folder), ["run_id", "contrast"])
    return d.groupBy("contrast").agg(F.max_by("run_id", F.struct(F.round(F.abs("d_k"), 9), "run_id")).alias("run_id"), F.round(F.max(F.abs("d_k")), 8).alias("widest"))


@query("m1_metric_registry", W + """SELECT run_id, cond, round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END), 8) AS accuracy, round(avg(CASE WHEN acc THEN 1.0 ELSE 0.0 END), 8) AS coverage, round(sum(CASE WHEN acc AND NOT y THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN acc THEN 1 ELSE 0 END), 0), 8) AS risk,
round(avg(CASE WHEN c THEN 0.0 ELSE 1.0 END), 8) AS invalid_rate, CAST(round(CAST(avg(CASE WHEN c THEN conf END) AS DECIMAL(24, 12)), 8) AS DOUBLE) AS mean_confidence, CAST(round(CAST(avg(CASE WHEN c THEN power(conf - CASE WHEN y THEN 1 ELSE 0 END, 2) END) AS DECIMAL(24, 12)), 8) AS DOUBLE) AS brier FROM done GROUP BY ALL""")
def m1(spark, folder):
    got = metrics.evaluate(done(spark, folder), list(metrics.METRICS), BY, TAU)
    return got.select(*BY, *[(decimal_round(F.col(m)) if m in ("mean_confidence", "brier") else F.round(m, 8)).alias(m) for m in metrics.METRICS])


@query("f9_confidence_diagnostics", W + """, b AS (SELECT run_id, cond, least(9, floor(conf * 10)) AS bin, count(*) AS k, abs(avg(conf) - avg(CASE WHEN y THEN 1.0 ELSE 0.0 END)) AS gap FROM done WHERE c GROUP BY ALL), e AS (SELECT run_id, cond, CAST(sum(k) AS BIGINT) AS n, round(sum(k * gap) / sum(k), 8) AS ece FROM b GROUP BY ALL),
t AS (SELECT run_id, cond, round(avg(CASE WHEN a AND c THEN 1.0 ELSE 0.0 END), 8) AS max_valid_coverage FROM done GROUP BY ALL) SELECT e.run_id, e.cond, e.n, e.ece, t.max_valid_coverage FROM e JOIN t ON t.run_id = e.run_id AND t.cond = e.cond""")
def f9(spark, folder):
    rows = done(spark, folder)
    top = rows.groupBy(*BY).agg(F.round(F.avg((F.col("a") & F.col("c")).cast("double")), 8).alias("max_valid_coverage"))
    return ep.expected_calibration_error(rows, BY).join(top, BY)


@query("h5_risk_delta_draws", W + f", {_STATS}, {_DRAWS} SELECT run_id, contrast, CAST(b AS BIGINT) AS b, round(d_r, 8) AS d_r FROM bo WHERE d_r IS NOT NULL")
def h5(spark, folder):
    draws = resample.endpoint_deltas(resample.bootstrap_draws(stats(spark, folder), REPLICATES, 17), ["run_id", "contrast", "b"])
    return draws.filter("d_r is not null").select("run_id", "contrast", F.col("b").cast("bigint").alias("b"), F.round("d_r", 8).alias("d_r"))


@query("h17_h21_main_table", W + f""", {_STATS}, {_DRAWS_OF(BOOTSTRAPS)}, {_RAND_OF(SWAPS)}, {_HOLM}, {_CI}, {_CLASS}, d AS (SELECT run_id, contrast, {_DELTA} FROM st GROUP BY ALL)
SELECT d.run_id, d.contrast, round(d.d_q, 8) AS d_q, round(d.d_k, 8) AS d_k, round(d.d_r, 8) AS d_r, c.ci_low, c.ci_high, h.p, h.adjusted, l.classification
FROM d JOIN hm h ON h.run_id = d.run_id AND h.contrast = d.contrast JOIN cl l ON l.run_id = d.run_id AND l.contrast = d.contrast LEFT JOIN ci c ON c.run_id = d.run_id AND c.contrast = d.contrast""")
def h21(spark, folder):
    """The whole held-out analysis as one relation over (run, contrast) instead of a loop over pairs."""
    d = resample.endpoint_deltas(stats(spark, folder), ["run_id", "contrast"]).select("run_id", "contrast", *[F.round(c, 8).alias(c) for c in ("d_q", "d_k", "d_r")])
    return d.join(classified(spark, folder, BOOTSTRAPS, SWAPS).select("run_id", "contrast", "ci_low", "ci_high", "p", "adjusted", "classification"), ["run_id", "contrast"])


@query("h19_certification_by_bound", W + f", {_certify_sql(0.5)} SELECT dataset_id, CASE WHEN thin OR loose THEN 'infeasible' ELSE 'certified' END AS status, count(*) AS runs FROM cf GROUP BY ALL")
def h19(spark, folder):
    """Certified share of the runs of each dataset, by exact bounds on certification rows."""
    rows = done(spark, folder)
    policy = th.frozen_endpoint(rows.filter((F.col("part") == "development") & (F.col("cond") == REFERENCE)), ["run_id", "dataset_id"], 0.25, 0.1, 0.5)
    got = inference.certify(rows.filter((F.col("part") == "certification") & (F.col("cond") == REFERENCE)), policy, ["run_id", "dataset_id"], 0.5, 0.1)
    return got.groupBy("dataset_id", "status").agg(F.count("*").alias("runs"))


@query("b5_b8_role_filter", "WITH it AS (SELECT DISTINCT item_id FROM items WHERE item_id IS NOT NULL) SELECT item_id, c AS cond, CAST(s AS INTEGER) AS seed FROM it, unnest(['reference', 'high-temperature', 'low-top-p']) t(c), unnest([11, 23]) u(s)")
def b5(spark, folder):
    """The coupled cells of a design, by role, as the view that has one condition per observation."""
    items = table(spark, folder, "items").filter("item_id is not null").select("item_id").distinct()
    cells = sampling.expand_design(items, [REFERENCE, HOT, NARROW], [11, 23], REFERENCE)
    return cells.filter(F.array_contains(F.split("roles", "[+]"), "coupled")).select("item_id", F.col("answer_condition").alias("cond"), "seed")
