"""Further queries over effects, strata, quality, joins, audits, registries and reports with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemlab.functions import expressions as ex
from tandemlab.functions import parsing
from tandemlab.operators import agents, audit, inference, metrics, resample, sampling
from tandemlab.operators import ranking_metrics as rm
from tandemlab.operators import thresholds as th
from tandemlab.operators.ranking import range_rank
from tandemlab.plans.endpoint_queries import ATOMS, BY, CAND, HOT, NARROW, REFERENCE, SUM, TAU, W, cell, development, done, obs
from tandemlab.plans.resampling_queries import _DELTA, _DRAWS, _HASH, _STATS, REPLICATES, stats
from tandemlab.sources.tables import materialize, table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _draws(spark, folder):
    return resample.endpoint_deltas(resample.bootstrap_draws(stats(spark, folder), REPLICATES, 17), ["run_id", "contrast", "b"])


_MARGINS = {"d_r": 0.1, "d_k": 0.05}
_ENDS = {"low_95": 0.025, "high_95": 0.975, "low_90": 0.05, "high_90": 0.95}
_EFFECTS = "ef AS (SELECT run_id, contrast, " + ", ".join(f"count({v}) AS {v}_replicates, round(var_samp({v}), 10) AS {v}_variance, " + ", ".join(f"round(quantile_cont({v}, {p}), 6) AS {v}_{e}" for e, p in _ENDS.items()) for v in _MARGINS) + " FROM bo GROUP BY ALL)"
_FLAGS = ", ".join(f"coalesce({v}_low_90 > -{m} AND {v}_high_90 < {m}, false) AS {v}_equivalent, coalesce({v}_high_90 <= {m}, false) AS {v}_noninferior" for v, m in _MARGINS.items())


@query("h11_frozen_coverage_effects", W + f", {_STATS}, {_DRAWS}, {_EFFECTS} SELECT *, {_FLAGS} FROM ef")
def h11(spark, folder):
    """Both intervals, variance and flags of the risk and coverage effects."""
    return inference.effect_report(_draws(spark, folder), ["run_id", "contrast"], _MARGINS)


_ARM = "sum(err1) / nullif(sum(acc1), 0)"


@query("h12_certified_risk_effects", W + f", {_STATS}, {_DRAWS}, {_EFFECTS}, pt AS (SELECT run_id, contrast, {_ARM} AS risk FROM st GROUP BY ALL) SELECT e.run_id, e.contrast, round(p.risk, 8) AS shifted_risk, round(CASE WHEN p.risk IS NOT NULL THEN greatest(p.risk - 0.25, 0.0) END, 8) AS violation, e.d_r_low_90, e.d_r_high_90, coalesce(e.d_r_low_90 > -0.1 AND e.d_r_high_90 < 0.1, false) AS risk_equivalent, coalesce(e.d_r_high_90 <= 0.1, false) AS noninferior FROM ef e JOIN pt p ON p.run_id = e.run_id AND p.contrast = e.contrast")
def h12(spark, folder):
    """The shifted risk against its target, and whether the risk effect is equivalent or at least no worse than the margin."""
    st = stats(spark, folder)
    report = inference.effect_report(resample.endpoint_deltas(resample.bootstrap_draws(st, REPLICATES, 17), ["run_id", "contrast", "b"]), ["run_id", "contrast"], {"d_r": 0.1})
    point = st.groupBy("run_id", "contrast").agg(ex.share(F.sum("err1"), F.sum("acc1")).alias("risk"))
    joined = report.join(point, ["run_id", "contrast"])
    return joined.select("run_id", "contrast", F.round("risk", 8).alias("shifted_risk"), F.round(ex.violation(F.col("risk"), 0.25), 8).alias("violation"), "d_r_low_90", "d_r_high_90", F.col("d_r_equivalent").alias("risk_equivalent"), F.col("d_r_noninferior").alias("noninferior"))


_COIN = _HASH("'29'", "b", "idx") + " % 2 = 0"
_SWAP = ", ".join(f"CASE WHEN {_COIN} THEN {s}{i} ELSE {s}{1 - i} END AS {s}{i}" for s in ("acc", "err") for i in (0, 1))
_RISK = "sum(err1) / nullif(sum(acc1), 0) - sum(err0) / nullif(sum(acc0), 0)"


@query("h8_one_and_two_sided", W + f", {_STATS}, ob AS (SELECT run_id, contrast, {_RISK} AS observed FROM st GROUP BY ALL), sw AS (SELECT run_id, contrast, b, {_SWAP} FROM st, range(0, {REPLICATES}) t(b)), dd AS (SELECT run_id, contrast, b, {_RISK} AS d FROM sw GROUP BY ALL), tl AS (SELECT d.run_id, d.contrast, max(o.observed) AS observed, count(d.d) AS valid, sum(CASE WHEN abs(d.d) >= abs(o.observed) - 1e-12 THEN 1 ELSE 0 END) AS two, sum(CASE WHEN d.d >= o.observed - 1e-12 THEN 1 ELSE 0 END) AS one FROM dd d JOIN ob o ON o.run_id = d.run_id AND o.contrast = d.contrast GROUP BY ALL) SELECT run_id, contrast, round(observed, 8) AS observed, CASE WHEN observed IS NULL THEN 0 ELSE valid END AS valid, CASE WHEN observed IS NULL THEN 1.0 ELSE round((two + 1) / (valid + 1), 8) END AS p_change, CASE WHEN observed IS NULL THEN 1.0 ELSE round((one + 1) / (valid + 1), 8) END AS p_increase FROM tl")
def h8(spark, folder):
    return resample.randomisation_tests(stats(spark, folder), "d_r", REPLICATES, 29)


_AURC = """aw AS (SELECT *, coalesce(sum(n) OVER w, 0) AS n0, coalesce(sum(n - pos) OVER w, 0) AS e0 FROM atom WINDOW w AS (PARTITION BY run_id, cond ORDER BY conf DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ax AS (SELECT run_id, cond, n0, e0, (n - pos) / n AS e, unnest(range(1, CAST(n AS BIGINT) + 1)) AS k FROM aw), ar AS (SELECT run_id, cond, count(*) AS valid, sum((e0 + k * e) / (n0 + k)) AS s FROM ax GROUP BY ALL)"""
_ROC = "rw AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY run_id, cond ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM atom), ro AS (SELECT run_id, cond, round(sum(pos * below + 0.5 * pos * (n - pos)) / nullif(sum(pos) * sum(n - pos), 0), 8) AS auroc FROM rw GROUP BY ALL)"


@query("h13_confidence_portability", W + f""", atom AS (SELECT run_id, cond, conf, count(*) AS n, sum(CASE WHEN y THEN 1 ELSE 0 END) AS pos FROM cell WHERE c GROUP BY ALL), {_AURC}, {_ROC},
br AS (SELECT run_id, cond, CAST(round(CAST(sum(pos * power(1 - conf, 2) + (n - pos) * power(conf, 2)) / sum(n) AS DECIMAL(24, 12)), 6) AS DOUBLE) AS brier FROM atom GROUP BY ALL), iv AS (SELECT run_id, cond, round(avg(CASE WHEN c THEN 0.0 ELSE 1.0 END), 8) AS invalid FROM cell GROUP BY ALL),
q AS (SELECT i.run_id, i.cond, ro.auroc, round(ar.s / ar.valid, 8) AS aurc, br.brier, i.invalid FROM iv i LEFT JOIN ro ON ro.run_id = i.run_id AND ro.cond = i.cond LEFT JOIN ar ON ar.run_id = i.run_id AND ar.cond = i.cond LEFT JOIN br ON br.run_id = i.run_id AND br.cond = i.cond)
SELECT s.run_id, s.cond, CAST(round(CAST(s.auroc - r.auroc AS DECIMAL(24, 12)), 6) AS DOUBLE) AS d_auroc, CAST(round(CAST(s.aurc - r.aurc AS DECIMAL(24, 12)), 6) AS DOUBLE) AS d_aurc, CAST(round(CAST(s.brier - r.brier AS DECIMAL(24, 12)), 6) AS DOUBLE) AS d_brier, CAST(round(CAST(s.invalid - r.invalid AS DECIMAL(24, 12)), 6) AS DOUBLE) AS d_invalid FROM q s JOIN q r ON r.run_id = s.run_id AND r.cond = 'reference' WHERE s.cond <> 'reference'""")
def h13(spark, folder):
    """What ranking, risk-coverage area, Brier score and invalid rate lose or win under each shifted condition."""
    rows = cell(spark, folder)
    atom = materialize(rm.atoms(rows, BY))
    invalid = rows.groupBy(*BY).agg(F.count("*").alias("total"), F.round(F.avg((~F.col("c")).cast("double")), 8).alias("invalid"))
    brier = atom.groupBy(*BY).agg(ex.decimal_round(F.sum(F.col("pos") * F.pow(1 - F.col("conf"), 2) + (F.col("n") - F.col("pos")) * F.pow("conf", F.lit(2))) / F.sum("n"), 6).alias("brier"))
    q = invalid.join(rm.auroc(atom, BY).select(*BY, "auroc"), BY, "left").join(rm.aurc(atom, invalid, BY).select(*BY, "aurc"), BY, "left").join(brier, BY, "left")
    names = ("auroc", "aurc", "brier", "invalid")
    ref = q.filter(F.col("cond") == REFERENCE).select("run_id", *[F.col(c).alias(f"{c}0") for c in names])
    return q.filter(F.col("cond") != REFERENCE).join(ref, "run_id").select(*BY, *[ex.decimal_round(F.col(c) - F.col(f"{c}0"), 6).alias(f"d_{c}") for c in names])


_LANG = "coalesce(nullif(trim(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata END, '$.lang')), ''), NULL)"
_CLUSTERS = f"cl AS (SELECT dataset_id, coalesce(group_id, item_id) AS cluster, CASE WHEN min({_LANG}) = max({_LANG}) THEN min({_LANG}) END AS stratum FROM items WHERE item_id IS NOT NULL AND dataset_id IS NOT NULL GROUP BY 1, 2)"


def _clusters(spark, folder):
    lang = F.trim(F.get_json_object("metadata", "$.lang"))
    lang = F.when(lang != "", lang)
    rows = table(spark, folder, "items").filter("item_id is not null and dataset_id is not null")
    return rows.groupBy("dataset_id", F.coalesce("group_id", "item_id").alias("cluster")).agg(F.when(F.min(lang) == F.max(lang), F.min(lang)).alias("stratum"))


@query("h1_resampling_strata", f"WITH {_CLUSTERS}, s AS (SELECT dataset_id, stratum, count(*) AS k FROM cl GROUP BY 1, 2) SELECT dataset_id, CAST(sum(k) AS BIGINT) AS clusters, count(stratum) AS strata, min(k) AS smallest, NOT bool_or(stratum IS NULL) AND min(k) >= 2 AS used FROM s GROUP BY 1")
def h1(spark, folder):
    """The design: clusters of each dataset and the strata (languages) they would be drawn within."""
    return resample.resampling_strata(_clusters(spark, folder))


@query("h2_stratified_draws", f"""WITH {_CLUSTERS}, k AS (SELECT dataset_id, coalesce(stratum, '') AS stratum, cluster, row_number() OVER (PARTITION BY dataset_id, coalesce(stratum, '') ORDER BY cluster) - 1 AS idx FROM cl), z AS (SELECT dataset_id, stratum, count(*) AS size FROM k GROUP BY 1, 2),
d AS (SELECT dataset_id, stratum, size, b, unnest(range(0, size)) AS j FROM z, range(0, 20) t(b)), p AS (SELECT dataset_id, stratum, b, {_HASH("'23'", "stratum", "b", "j")} % size AS idx FROM d)
SELECT p.dataset_id, p.stratum, CAST(p.b AS INTEGER) AS b, count(*) AS draws, count(DISTINCT k.cluster) AS clusters, max(k.cluster) AS last FROM p JOIN k ON k.dataset_id = p.dataset_id AND k.stratum = p.stratum AND k.idx = p.idx GROUP BY ALL""")
def h2(spark, folder):
    drawn = resample.stratified_draws(_clusters(spark, folder), 20, 23)
    return drawn.groupBy("dataset_id", "stratum", "b").agg(F.count("*").alias("draws"), F.countDistinct("cluster").alias("clusters"), F.max("cluster").alias("last"))


def _fit(src: str, keys: str) -> str:
    """CTEs of the isotonic fit of ``src`` (keys, conf, n, pos) as ``fi``."""
    same = lambda a, b: " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    per = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    return f"""fc AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY conf ROWS UNBOUNDED PRECEDING)),
fs AS (SELECT {per("i")}, i.conf AS ci, j.conf AS cj, (j.cp - i.cp + i.pos) / (j.cn - i.cn + i.n) AS m FROM fc i JOIN fc j ON {same("i", "j")} AND i.conf <= j.conf),
fl AS (SELECT *, min(m) OVER (PARTITION BY {keys}, ci ORDER BY cj DESC ROWS UNBOUNDED PRECEDING) AS low FROM fs), fx AS (SELECT {keys}, cj AS conf, max(low) AS fit FROM fl GROUP BY ALL),
fi AS (SELECT t.*, x.fit FROM {src} t JOIN fx x ON {same("t", "x")} AND x.conf = t.conf)"""


QUALITY = ("accuracy", "mean_confidence", "gap", "auroc", "brier", "mcb", "dsc", "unc", "brier_skill", "dsc_share", "mcb_share")
_QREP = 40
_QUALITY = f"""al AS (SELECT run_id, item, count(*) AS n_all, sum(CASE WHEN y THEN 1 ELSE 0 END) AS y_all FROM cell WHERE cond = 'reference' AND run_id IS NOT NULL AND item IS NOT NULL GROUP BY ALL),
un AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY item) - 1 AS idx FROM al), us AS (SELECT run_id, count(*) AS size FROM un GROUP BY 1),
ud AS (SELECT run_id, b, size, unnest(range(0, size)) AS j FROM us, range(0, {_QREP}) t(b)), up AS (SELECT run_id, b, {_HASH("'37'", "b", "j")} % size AS idx, count(*) AS w FROM ud GROUP BY ALL),
uw AS (SELECT p.run_id, p.b, p.w, u.item, u.n_all, u.y_all FROM up p JOIN un u ON u.run_id = p.run_id AND u.idx = p.idx),
cu AS (SELECT run_id, item, conf, count(*) AS n, sum(CASE WHEN y THEN 1 ELSE 0 END) AS pos FROM cell WHERE c AND cond = 'reference' GROUP BY ALL),
ba AS (SELECT w.run_id, w.b, c.conf, sum(w.w * c.n) AS n, sum(w.w * c.pos) AS pos FROM uw w JOIN cu c ON c.run_id = w.run_id AND c.item = w.item GROUP BY ALL),
{_fit("ba", "run_id, b")}, ws AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY run_id, b ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM fi),
sm AS (SELECT run_id, b, sum(n * conf) / sum(n) AS mc, sum(pos * below + 0.5 * pos * (n - pos)) / nullif(sum(pos) * sum(n - pos), 0) AS auroc, sum(pos) / sum(n) AS base, sum(pos * power(1 - conf, 2) + (n - pos) * power(conf, 2)) / sum(n) AS brier, sum(pos * power(1 - fit, 2) + (n - pos) * power(fit, 2)) / sum(n) AS recal FROM ws GROUP BY ALL),
ac AS (SELECT run_id, b, sum(w * y_all) / sum(w * n_all) AS acc FROM uw GROUP BY ALL),
mt AS (SELECT a.run_id, a.b, a.acc AS accuracy, s.mc AS mean_confidence, s.mc - a.acc AS gap, s.auroc, s.brier, s.brier - s.recal AS mcb, s.base * (1 - s.base) - s.recal AS dsc, s.base * (1 - s.base) AS unc, 1 - s.brier / nullif(s.base * (1 - s.base), 0) AS brier_skill, (s.base * (1 - s.base) - s.recal) / nullif(s.base * (1 - s.base), 0) AS dsc_share, (s.brier - s.recal) / nullif(s.base * (1 - s.base), 0) AS mcb_share FROM ac a LEFT JOIN sm s ON s.run_id = a.run_id AND s.b = a.b),
lg AS ({" UNION ALL ".join(f"SELECT run_id, '{m}' AS metric, b, round({m}, 8) AS v FROM mt" for m in QUALITY)})"""


@query("h15_reference_quality", W + f", {_QUALITY} SELECT run_id, metric, count(v) AS replicates, CASE WHEN count(v) >= 20 THEN round(quantile_cont(v, 0.025), 3) + 0.0 END AS ci_low, CASE WHEN count(v) >= 20 THEN round(quantile_cont(v, 0.975), 3) + 0.0 END AS ci_high FROM lg WHERE v IS NOT NULL GROUP BY ALL")
def h15(spark, folder):
    """Intervals of eleven quality metrics of the reference condition by an item bootstrap: a replicate is a weighted table of scores."""
    rows = cell(spark, folder).filter((F.col("cond") == REFERENCE) & F.col("run_id").isNotNull() & F.col("item").isNotNull())
    every = rows.groupBy("run_id", "item").agg(F.count("*").alias("n_all"), F.count_if("y").alias("y_all"))
    units = materialize(range_rank(every, ["run_id"], ["item"], "idx").withColumn("idx", F.col("idx") - 1))
    sizes = units.groupBy("run_id").agg(F.count("*").alias("size"))
    drawn = resample.draw_positions(sizes, ["run_id"], _QREP).groupBy("run_id", "b", (ex.hash_number(F.lit(37), F.col("b"), F.col("j")) % F.col("size")).alias("idx")).agg(F.count("*").alias("w"))
    weighted = materialize(resample.at_positions(drawn, units, ["run_id", "idx"]))
    counts = rows.filter("c").groupBy("run_id", "item", "conf").agg(F.count("*").alias("n"), F.count_if("y").alias("pos"))
    atom = materialize(resample.at_positions(weighted, counts, ["run_id", "item"]).groupBy("run_id", "b", "conf").agg(F.sum(F.col("w") * F.col("n")).alias("n"), F.sum(F.col("w") * F.col("pos")).alias("pos")))
    per = ["run_id", "b"]
    accuracy = weighted.groupBy(*per).agg(ex.share(F.sum(F.col("w") * F.col("y_all")), F.sum(F.col("w") * F.col("n_all"))).alias("accuracy"))
    mean = atom.groupBy(*per).agg((F.sum(F.col("n") * F.col("conf")) / F.sum("n")).alias("mean_confidence"))
    wide = accuracy.join(mean, per, "left").join(rm.auroc(atom, per).drop("n"), per, "left").join(rm.corp(atom, per).drop("n", "base_rate"), per, "left").withColumn("gap", F.col("mean_confidence") - F.col("accuracy"))
    long = wide.select(*per, F.explode(F.create_map(*[x for m in QUALITY for x in (F.lit(m), F.round(m, 8))])).alias("metric", "v"))
    out = long.filter("v is not null").groupBy("run_id", "metric").agg(F.count("*").alias("replicates"), F.percentile("v", 0.025).alias("lo"), F.percentile("v", 0.975).alias("hi"))
    enough = F.col("replicates") >= 20
    return out.select("run_id", "metric", "replicates", F.when(enough, F.round("lo", 3) + 0.0).alias("ci_low"), F.when(enough, F.round("hi", 3) + 0.0).alias("ci_high"))


@query("f9_diagnostics_bundle", W + f""", {ATOMS}, {_AURC}, {_ROC}, t AS (SELECT run_id, cond, count(*) AS total, round(avg(CASE WHEN a AND c THEN 1.0 ELSE 0.0 END), 8) AS max_valid_coverage FROM done GROUP BY ALL)
SELECT t.run_id, t.cond, t.total, t.max_valid_coverage, ro.auroc, round(ar.s / ar.valid, 8) AS aurc, round(ar.s / t.total, 8) AS operational_aurc FROM t JOIN ar ON ar.run_id = t.run_id AND ar.cond = t.cond JOIN ro ON ro.run_id = t.run_id AND ro.cond = t.cond""")
def f9(spark, folder):
    rows = done(spark, folder)
    atom = materialize(rm.atoms(rows, BY))
    top = rows.groupBy(*BY).agg(F.count("*").alias("total"), F.round(F.avg((F.col("a") & F.col("c")).cast("double")), 8).alias("max_valid_coverage"))
    return top.join(rm.auroc(atom, BY).select(*BY, "auroc"), BY).join(rm.aurc(atom, top.select(*BY, "total"), BY).drop("valid"), BY)


_RESP = "rs AS (SELECT request_id, min(text) AS text FROM inference_responses WHERE request_id IS NOT NULL AND text IS NOT NULL GROUP BY 1), rq AS (SELECT request_id, min(run_id) AS run_id, min(dataset_item_id) AS item, min(seed) AS seed, min(condition_id) AS cond, min(prompt) AS prompt, min(chat_template_kwargs) AS kwargs FROM inference_requests WHERE stage = 'answer' AND request_id IS NOT NULL GROUP BY 1), tx AS (SELECT * FROM (SELECT q.*, r.text, row_number() OVER (PARTITION BY q.run_id, q.item, q.seed, q.cond ORDER BY q.request_id) AS k FROM rq q JOIN rs r ON r.request_id = q.request_id) WHERE k = 1)"


@query("f24_text_invariance", f"""WITH {_RESP}, p AS (SELECT a.request_id, a.item, a.text AS ta, b.text AS tb, a.prompt = b.prompt AS same_prompt, a.kwargs IS NOT DISTINCT FROM b.kwargs AS same_kwargs FROM tx a JOIN tx b ON b.item = a.item AND b.seed = a.seed AND b.run_id = a.run_id WHERE a.cond = 'reference' AND b.cond = 'high-temperature'),
d AS (SELECT coalesce(list_min(list_filter(range(1, least(length(ta), length(tb)) + 1), lambda i: substr(ta, i, 1) <> substr(tb, i, 1))) - 1, least(length(ta), length(tb))) AS shared, row_number() OVER (ORDER BY request_id) AS k FROM p WHERE ta <> tb), h AS (SELECT shared, row_number() OVER (ORDER BY shared) - 1 AS r, count(*) OVER () AS n FROM d WHERE k <= 200)
SELECT (SELECT count(*) FROM p) AS pairs, (SELECT count(*) FROM p WHERE ta = tb) AS identical, (SELECT count(*) FROM p WHERE same_prompt) AS same_prompt, (SELECT count(*) FROM p WHERE same_kwargs) AS same_kwargs, (SELECT CAST(max(CASE WHEN r = n // 2 THEN shared END) AS INTEGER) FROM h) AS upper_median_prefix""")
def f24(spark, folder):
    """How far generation depends on a control: identical texts, equal control fields, and the median shared beginning of the first 200 that differ."""
    text = table(spark, folder, "inference_responses").filter("request_id is not null and text is not null").groupBy("request_id").agg(F.min("text").alias("text"))
    q = table(spark, folder, "inference_requests").filter("stage = 'answer' and request_id is not null").groupBy("request_id").agg(F.min("run_id").alias("run_id"), F.min("dataset_item_id").alias("item"), F.min("seed").alias("seed"), F.min("condition_id").alias("cond"), F.min("prompt").alias("prompt"), F.min("chat_template_kwargs").alias("kwargs"))
    key = ["run_id", "item", "seed"]
    one = q.join(text, "request_id").groupBy(*key, "cond").agg(F.min_by(F.struct("request_id", "text", "prompt", "kwargs"), "request_id").alias("x"))
    a = one.filter(F.col("cond") == REFERENCE).select(*key, F.col("x").alias("a"))
    b = one.filter(F.col("cond") == HOT).select(*key, F.col("x").alias("b"))
    p = materialize(a.join(b, key).select(F.col("a.request_id").alias("request_id"), F.col("a.text").alias("ta"), F.col("b.text").alias("tb"), (F.col("a.prompt") == F.col("b.prompt")).alias("sp"), F.col("a.kwargs").eqNullSafe(F.col("b.kwargs")).alias("sk")))
    first = p.filter("ta != tb").orderBy("request_id").limit(200)  # the control looks at the first 200 by definition
    shared = first.select(parsing.shared_prefix(F.col("ta"), F.col("tb")).alias("s")).agg(F.sort_array(F.collect_list("s")).alias("l")).select(F.get("l", F.floor(F.size("l") / 2).cast("int")).alias("upper_median_prefix"))
    return p.agg(F.count("*").alias("pairs"), F.count_if(F.col("ta") == F.col("tb")).alias("identical"), F.count_if("sp").alias("same_prompt"), F.count_if("sk").alias("same_kwargs")).crossJoin(shared)  # one row each


_SCORES = "sc AS (SELECT record_id, dataset_item_id, seed FROM observations WHERE scoring_status = 'scored' AND correct IS NOT NULL AND record_id IS NOT NULL), rc AS (SELECT record_id, dataset_item_id, seed FROM observations WHERE answer_parse_status = 'valid' AND record_id IS NOT NULL)"


@query("e1_strict_score_join", f"WITH {_SCORES}, r AS (SELECT record_id, count(*) AS nr, min(dataset_item_id) AS ri, min(seed) AS rs FROM rc GROUP BY 1), s AS (SELECT record_id, count(*) AS ns, min(dataset_item_id) AS si, min(seed) AS ss FROM sc GROUP BY 1), f AS (SELECT coalesce(r.record_id, s.record_id) AS record_id, CASE WHEN ns IS NULL THEN 'no score' WHEN nr IS NULL THEN 'no record' WHEN nr > 1 THEN 'record repeated' WHEN ns > 1 THEN 'score repeated' WHEN ri IS DISTINCT FROM si OR rs IS DISTINCT FROM ss THEN 'other ' || concat_ws(',', CASE WHEN ri IS DISTINCT FROM si THEN 'dataset_item_id' END, CASE WHEN rs IS DISTINCT FROM ss THEN 'seed' END) END AS fault FROM r FULL JOIN s ON s.record_id = r.record_id) SELECT * FROM f WHERE fault IS NOT NULL")
def e1(spark, folder):
    """Valid answers against scores: what keeps the two from being joined one to one with equal provenance."""
    o = table(spark, folder, "observations").filter("record_id is not null").select("record_id", "dataset_item_id", "seed", "scoring_status", "correct", "answer_parse_status")
    return audit.strict_join(o.filter("answer_parse_status = 'valid'"), o.filter("scoring_status = 'scored' and correct is not null"), "record_id", ["dataset_item_id", "seed"])


@query("e14_documents_without_held_out", "SELECT DISTINCT s.s_suppkey AS case_id, n.n_name AS name FROM supplier s JOIN nation h ON h.n_nationkey = s.s_nationkey JOIN nation n ON n.n_regionkey IN (h.n_regionkey, (h.n_regionkey + 1) % 5) WHERE n.n_nationkey <> s.s_nationkey")
def e14(spark, folder):
    """Cases (suppliers) with two classes (regions), the documents of both (nations), without the one held out (the supplier's own)."""
    nation = table(spark, folder, "nation")
    cases = table(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("case_id"), F.array("n_regionkey", ((F.col("n_regionkey") + 1) % 5).cast("int")).alias("classes"), F.col("n_name").alias("name"))
    return agents.class_documents(cases, nation.select(F.col("n_regionkey").alias("class"), F.col("n_name").alias("name")), cases)


@query("a7b_config_agrees_with_records", "WITH o AS (SELECT DISTINCT run_id, experiment_id, dataset_id FROM observations WHERE run_id IS NOT NULL), c AS (SELECT DISTINCT run_id, experiment_id, dataset_id FROM calibration_thresholds WHERE run_id IS NOT NULL) SELECT o.run_id, o.experiment_id AS found_experiment, o.dataset_id AS found_dataset, concat_ws(',', CASE WHEN o.experiment_id IS DISTINCT FROM c.experiment_id THEN 'experiment_id' END, CASE WHEN o.dataset_id IS DISTINCT FROM c.dataset_id THEN 'dataset_id' END) AS fields, c.run_id IS NULL AS unplanned FROM o LEFT JOIN c ON c.run_id = o.run_id")
def a7b(spark, folder):
    """Of each run as it was observed: the fields in which its records leave the plan, and whether a plan exists."""
    o = table(spark, folder, "observations").filter("run_id is not null").select("run_id", "experiment_id", "dataset_id").distinct()
    c = table(spark, folder, "calibration_thresholds").filter("run_id is not null").select("run_id", F.col("experiment_id").alias("e"), F.col("dataset_id").alias("d"), F.lit(True).alias("planned")).distinct()
    odd = lambda a, b: F.when(~F.col(a).eqNullSafe(F.col(b)), F.lit(a))
    return o.join(c, "run_id", "left").select("run_id", F.col("experiment_id").alias("found_experiment"), F.col("dataset_id").alias("found_dataset"), F.array_join(F.array_compact(F.array(odd("experiment_id", "e"), odd("dataset_id", "d"))), ",").alias("fields"), F.col("planned").isNull().alias("unplanned"))


_FIELDS = ["answer_raw_record_id", "confidence_raw_record_id", "answer_raw_record_sha256", "confidence_raw_record_sha256", "run_id", "experiment_id", "dataset_id", "dataset_item_id", "cluster_id", "dataset_partition", "condition_id", "seed", "answer_parse_status", "confidence_parse_status", "parse_status", "parsed_answer", "confidence", "scoring_status", "correct", "answer_parse_error", "confidence_parse_error", "created_at", "ingested_at"]


@query("a7c_resume_identity", "SELECT * FROM (SELECT record_id, concat_ws(',', " + ", ".join(f"CASE WHEN min({c}) <> max({c}) OR (count({c}) > 0 AND count({c}) < count(*)) THEN '{c}' END" for c in _FIELDS) + ") AS fields FROM observations WHERE record_id IS NOT NULL GROUP BY 1) WHERE fields <> ''")
def a7c(spark, folder):
    """Records delivered again: the fields, of all, in which a copy is not what is stored."""
    return audit.copies_that_differ(table(spark, folder, "observations"), "record_id", _FIELDS)


@query("c9_answer_identity_key", "SELECT DISTINCT request_id, sha256(coalesce(prompt, '') || chr(0) || coalesce(CAST(seed AS VARCHAR), '') || chr(0) || coalesce(condition_id, '') || chr(0) || coalesce(chat_template_kwargs, '')) AS answer_key FROM inference_requests WHERE stage = 'answer' AND request_id IS NOT NULL")
def c9(spark, folder):
    """A key of the inputs that an answer depends on, and of nothing else (no run, no time)."""
    q = table(spark, folder, "inference_requests").filter("stage = 'answer' and request_id is not null")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return q.select("request_id", ex.stable_id(*[text(c) for c in ("prompt", "seed", "condition_id", "chat_template_kwargs")]).alias("answer_key")).distinct()


@query("c23_display", W + ", r AS (SELECT run_id, cond, count(*) AS n, round(100.0 * sum(CASE WHEN acc THEN 1 ELSE 0 END) / count(*), 1) AS k, round(sqrt(avg(CASE WHEN acc THEN 1.0 ELSE 0.0 END) * (1 - avg(CASE WHEN acc THEN 1.0 ELSE 0.0 END)) / count(*)), 3) AS se FROM done GROUP BY ALL) SELECT run_id, cond, printf('%.1f%% [n=%d, se %.3f]', k, n, se) AS shown FROM r")
def c23(spark, folder):
    """Shares, counts and errors as a report shows them."""
    acc = ex.accepts(TAU)
    k = F.avg(acc.cast("double"))
    agg = done(spark, folder).groupBy(*BY).agg(F.count("*").alias("n"), F.round(F.lit(100.0) * F.count_if(acc) / F.count("*"), 1).alias("k"), F.round(F.sqrt(k * (1 - k) / F.count("*")), 3).alias("se"))
    return agg.select(*BY, F.format_string("%.1f%% [n=%d, se %.3f]", "k", "n", "se").alias("shown"))


@query("m2_outcome_registry", W + ", k AS (SELECT run_id, cond, y, c, acc FROM done) SELECT run_id, cond, 'correctness' AS outcome, count(*) AS n, round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END), 8) AS mean FROM k GROUP BY ALL UNION ALL SELECT run_id, cond, 'coverage', count(*), round(avg(CASE WHEN acc THEN 1.0 ELSE 0.0 END), 8) FROM k GROUP BY ALL UNION ALL SELECT run_id, cond, 'invalid', count(*), round(avg(CASE WHEN c THEN 0.0 ELSE 1.0 END), 8) FROM k GROUP BY ALL UNION ALL SELECT run_id, cond, 'selective_error', count(*), round(avg(CASE WHEN y THEN 0.0 ELSE 1.0 END), 8) FROM k WHERE acc GROUP BY ALL")
def m2(spark, folder):
    """Every registered outcome of a surface over one scan: rows where it is undefined do not count."""
    long = done(spark, folder).select(*BY, F.explode(F.create_map(*[x for name, column in metrics.OUTCOMES.items() for x in (F.lit(name), column(TAU))])).alias("outcome", "v")).filter("v is not null")
    return long.groupBy(*BY, "outcome").agg(F.count("*").alias("n"), F.round(F.avg("v"), 8).alias("mean"))


@query("n4_access_log", "SELECT run_id, dataset_partition AS part, epoch_us(min(created_at)) AS first_access, count(DISTINCT record_id) AS records FROM observations WHERE run_id IS NOT NULL AND dataset_partition IS NOT NULL GROUP BY ALL")
def n4(spark, folder):
    """One event for each run that touched a partition: when it first did, and how much it took."""
    return table(spark, folder, "observations").filter("run_id is not null and dataset_partition is not null").groupBy("run_id", F.col("dataset_partition").alias("part")).agg(F.unix_micros(F.min("created_at")).alias("first_access"), F.countDistinct("record_id").alias("records"))


_EX = f", {_STATS}, d AS (SELECT run_id, contrast, {_DELTA} FROM st GROUP BY ALL)"
_PICKS = {"widest coverage": "abs(d_k)", "widest failure": "abs(d_q)", "widest risk": "abs(d_r)", "highest risk": "d_r", "lowest coverage": "-d_k"}


@query("k3_all_extremes", W + _EX + " " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{n}' AS pick, run_id, contrast, round({e}, 8) + 0.0 AS value FROM d WHERE {e} IS NOT NULL ORDER BY round({e}, 8) DESC, run_id DESC, contrast DESC LIMIT 1)" for n, e in _PICKS.items()))
def k3(spark, folder):
    """The extreme contrasts of a report, each by one partial aggregate."""
    d = resample.endpoint_deltas(stats(spark, folder), ["run_id", "contrast"])
    long = d.select("run_id", "contrast", F.explode(F.create_map(*[x for n, e in _PICKS.items() for x in (F.lit(n), F.expr(f"round({e}, 8)"))])).alias("pick", "value")).filter("value is not null")
    return long.groupBy("pick").agg(F.max_by(F.struct("run_id", "contrast", (F.col("value") + 0.0).alias("value")), F.struct("value", "run_id", "contrast")).alias("x")).select("pick", "x.*")


@query("n11_intervals_off_zero", W + f", {_STATS}, {_DRAWS}, {_EFFECTS} SELECT run_id, contrast, component, low, high FROM (SELECT run_id, contrast, 'risk' AS component, d_r_low_95 AS low, d_r_high_95 AS high FROM ef UNION ALL SELECT run_id, contrast, 'coverage', d_k_low_95, d_k_high_95 FROM ef) WHERE low > 0 OR high < 0")
def n11(spark, folder):
    """The components whose interval excludes zero."""
    e = inference.effect_report(_draws(spark, folder), ["run_id", "contrast"], _MARGINS)
    long = e.select("run_id", "contrast", F.explode(F.array(*[F.struct(F.lit(n).alias("component"), F.col(f"{v}_low_95").alias("low"), F.col(f"{v}_high_95").alias("high")) for n, v in (("risk", "d_r"), ("coverage", "d_k"))])).alias("x"))
    return long.select("run_id", "contrast", "x.*").filter("low > 0 or high < 0")


_DISTINCT = {"runs": "run_id", "datasets": "dataset_id", "items": "item", "clusters": "cluster", "conditions": "cond", "seeds": "seed"}
_SUCH = {
    "scored": "y IS NOT NULL", "pending": "y IS NULL", "correct": "y", "valid_answers": "a", "valid_confidences": "c", "both_valid": "a AND c", "full_confidence": "c AND conf = 1", "no_confidence": "c AND conf = 0",
    "confident_errors": "c AND conf >= 0.9 AND NOT y",
}


@query("n8_counts", W + "SELECT count(*) AS records, " + ", ".join([f"count(DISTINCT {c}) AS {n}" for n, c in _DISTINCT.items()] + [f"{SUM(c)} AS {n}" for n, c in _SUCH.items()]) + " FROM obs")
def n8(spark, folder):
    """The counts that a report quotes, in one aggregation."""
    return obs(spark, folder).agg(F.count("*").alias("records"), *[F.countDistinct(c).alias(n) for n, c in _DISTINCT.items()], *[F.count_if(F.expr(c)).alias(n) for n, c in _SUCH.items()])


@query("h18_development_report", W + f", {CAND}, {ATOMS.replace('done', 'dev').replace('atom AS', 'atm AS')}, {_ROC.replace('FROM atom', 'FROM atm')} SELECT t.run_id, t.n, round(e.threshold, 8) AS risk_threshold, round(f.threshold, 8) AS coverage_threshold, ro.auroc, q.accuracy, q.valid_rate FROM tot t LEFT JOIN emp e ON e.run_id = t.run_id LEFT JOIN fix f ON f.run_id = t.run_id LEFT JOIN ro ON ro.run_id = t.run_id LEFT JOIN (SELECT run_id, round(avg(CASE WHEN y THEN 1.0 ELSE 0.0 END), 8) AS accuracy, round(avg(CASE WHEN a AND c THEN 1.0 ELSE 0.0 END), 8) AS valid_rate FROM dev GROUP BY 1) q ON q.run_id = t.run_id")
def h18(spark, folder):
    """The whole development analysis as one relation over runs: thresholds of both rules, ranking, accuracy and validity."""
    dev = materialize(development(spark, folder))
    cand = th.candidates(dev, ["run_id"])
    base = dev.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.avg(F.col("y").cast("double")), 8).alias("accuracy"), F.round(F.avg((F.col("a") & F.col("c")).cast("double")), 8).alias("valid_rate"))
    risk = th.empirical_threshold(cand, ["run_id"], 0.25).select("run_id", F.round("threshold", 8).alias("risk_threshold"))
    cover = th.fixed_coverage_threshold(cand, ["run_id"], 0.5).select("run_id", F.round("threshold", 8).alias("coverage_threshold"))
    auc = rm.auroc(rm.atoms(dev, ["run_id"]), ["run_id"]).select("run_id", "auroc")
    return base.join(risk, "run_id", "left").join(cover, "run_id", "left").join(auc, "run_id", "left").select("run_id", "n", "risk_threshold", "coverage_threshold", "auroc", "accuracy", "valid_rate")


@query("h20_episode_contrasts", "WITH q AS (SELECT request_id, min(run_id) AS run_id, min(dataset_item_id) AS item, min(condition_id) AS cond FROM inference_requests WHERE request_id IS NOT NULL GROUP BY 1), p AS (SELECT request_id, max(status) AS status FROM parse_outcomes GROUP BY 1), e AS (SELECT run_id, item, cond, count(*) AS steps, sum(CASE WHEN p.status = 'invalid' THEN 1 ELSE 0 END) AS bad FROM q LEFT JOIN p ON p.request_id = q.request_id WHERE run_id IS NOT NULL AND item IS NOT NULL AND cond IS NOT NULL GROUP BY ALL) SELECT s.run_id, s.cond, count(*) AS episodes, CAST(sum(CASE WHEN (s.bad = 0) = (r.bad = 0) THEN 1 ELSE 0 END) AS BIGINT) AS success_matched, CAST(sum(CASE WHEN s.steps = r.steps AND s.bad = r.bad THEN 1 ELSE 0 END) AS BIGINT) AS same_course, round(avg(s.steps - r.steps), 8) + 0.0 AS mean_step_change FROM e s JOIN e r ON r.run_id = s.run_id AND r.item = s.item AND r.cond = 'reference' WHERE s.cond <> 'reference' GROUP BY ALL")
def h20(spark, folder):
    """Episodes of shifted conditions against those of the reference: matched success, the same course, and the change of length."""
    key = ["run_id", "item"]
    eps = agents.episodes(table(spark, folder, "inference_requests"), table(spark, folder, "parse_outcomes")).filter("run_id is not null and item is not null and cond is not null").select(*key, "cond", "n_steps", "invalid_outputs")
    ref = eps.filter(F.col("cond") == REFERENCE).select(*key, F.col("n_steps").alias("s0"), F.col("invalid_outputs").alias("b0"))
    both = eps.filter(F.col("cond") != REFERENCE).join(ref, key)
    ok = (F.col("invalid_outputs") == 0) == (F.col("b0") == 0)
    return both.groupBy("run_id", "cond").agg(F.count("*").alias("episodes"), F.count_if(ok).alias("success_matched"), F.count_if((F.col("n_steps") == F.col("s0")) & (F.col("invalid_outputs") == F.col("b0"))).alias("same_course"), (F.round(F.avg(F.col("n_steps") - F.col("s0")), 8) + 0.0).alias("mean_step_change"))


@query("d10_source_contracts", "WITH r AS (SELECT dataset_id, count(DISTINCT item_id) AS items, count(*) AS rows, sum(CASE WHEN question IS NULL THEN 1 ELSE 0 END) AS no_question, sum(CASE WHEN answer IS NULL THEN 1 ELSE 0 END) AS no_answer, count(DISTINCT dataset_revision) AS revisions, sum(CASE WHEN NOT json_valid(coalesce(scoring_payload, '')) THEN 1 ELSE 0 END) AS bad_payload FROM items WHERE dataset_id IS NOT NULL GROUP BY 1) SELECT dataset_id, concat_ws(';', CASE WHEN rows > items THEN 'repeated' END, CASE WHEN no_question > 0 THEN 'no question' END, CASE WHEN no_answer > 0 THEN 'no answer' END, CASE WHEN revisions <> 1 THEN 'revisions' END, CASE WHEN bad_payload > 0 THEN 'payload' END) AS broken, items FROM r")
def d10(spark, folder):
    """The contracts of a source: each item once, fields that must be there, one revision, payloads that can be read."""
    bad = F.try_parse_json(F.coalesce("scoring_payload", F.lit(""))).isNull()
    r = table(spark, folder, "items").filter("dataset_id is not null").groupBy("dataset_id").agg(F.countDistinct("item_id").alias("items"), F.count("*").alias("rows"), F.count_if(F.col("question").isNull()).alias("q"), F.count_if(F.col("answer").isNull()).alias("a"), F.countDistinct("dataset_revision").alias("v"), F.count_if(bad).alias("p"))
    broken = F.concat_ws(";", F.when(F.col("rows") > F.col("items"), "repeated"), F.when(F.col("q") > 0, "no question"), F.when(F.col("a") > 0, "no answer"), F.when(F.col("v") != 1, "revisions"), F.when(F.col("p") > 0, "payload"))
    return r.select("dataset_id", broken.alias("broken"), "items")


@query("d16_derived_configs", f"SELECT experiment_id || '-' || p.phase || '-s' || CAST(s.seed AS VARCHAR) AS config_id, experiment_id, p.phase, s.seed, c.cond, dataset_id FROM (SELECT DISTINCT experiment_id, dataset_id FROM calibration_thresholds WHERE experiment_id IS NOT NULL) e, unnest(['development', 'certification', 'test']) p(phase), unnest([11, 23, 47]) s(seed), unnest(['{REFERENCE}', '{HOT}', '{NARROW}']) c(cond)")
def d16(spark, folder):
    """Configs of every phase, seed and condition derived from the base experiments; the plan side is literals."""
    base = table(spark, folder, "calibration_thresholds").filter("experiment_id is not null").select("experiment_id", "dataset_id").distinct()
    out = base
    for name, values in (("phase", ["development", "certification", "test"]), ("seed", [11, 23, 47]), ("cond", [REFERENCE, HOT, NARROW])):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.select(F.concat("experiment_id", F.lit("-"), "phase", F.lit("-s"), F.col("seed").cast("string")).alias("config_id"), "experiment_id", "phase", "seed", "cond", "dataset_id")


@query("c21_option_letters", r"WITH i AS (SELECT DISTINCT item_id, upper(trim(answer)) AS letter, question FROM items WHERE item_id IS NOT NULL AND question IS NOT NULL AND regexp_matches(upper(trim(answer)), '^[A-J]$')), o AS (SELECT item_id, letter, regexp_extract_all(question, '(?m)^([A-J])[)] ', 1) AS letters FROM i) SELECT item_id, letter, CAST(len(letters) AS INTEGER) AS options, ascii(letter) - 64 <= len(letters) AND coalesce(letters[ascii(letter) - 64] = letter, false) AS consistent FROM o")
def c21(spark, folder):
    """Whether the keyed letter of an item names the option that stands at its place in the question."""
    rows = table(spark, folder, "items").filter("item_id is not null and question is not null").select("item_id", F.upper(F.trim("answer")).alias("letter"), "question").filter(F.col("letter").rlike("^[A-J]$")).distinct()
    letters = F.regexp_extract_all("question", F.lit(r"(?m)^([A-J])[)] "), F.lit(1))
    place = F.ascii("letter") - 64
    return rows.select("item_id", "letter", F.size(letters).alias("options"), ((place <= F.size(letters)) & F.coalesce(F.get(letters, place - 1) == F.col("letter"), F.lit(False))).alias("consistent"))


_SEED = "CAST('0x' || substr('01234567', CAST('0x' || substr({h}, 1, 1) AS INTEGER) % 8 + 1, 1) || substr({h}, 2, 15) AS BIGINT)"
_STEP = "sha256('tandem-step-1' || chr(0) || seed || chr(0) || item_id || chr(0) || t || chr(0) || s)"


@query("c7_step_seeds", f"WITH i AS (SELECT DISTINCT item_id FROM items WHERE item_id IS NOT NULL), h AS (SELECT item_id, CAST(seed AS INTEGER) AS seed, CAST(t AS INTEGER) AS turn, CAST(s AS INTEGER) AS step, {_STEP} AS h, sha256('tandem-pair-1' || chr(0) || 'm' || chr(0) || 'r1' || chr(0) || 'plain' || chr(0) || seed || chr(0) || item_id) AS pair FROM i, unnest([11, 23]) a(seed), unnest([0, 1]) b(t), unnest([0, 1]) c(s)) SELECT item_id, seed, turn, step, {_SEED.format(h='h')} AS step_seed, pair FROM h")
def c7(spark, folder):
    """Seeds of episode steps and the names that pair messages of all conditions."""
    at = table(spark, folder, "items").filter("item_id is not null").select("item_id").distinct()
    for name, values in (("seed", (11, 23)), ("turn", (0, 1)), ("step", (0, 1))):
        at = at.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    c = F.col
    return at.select("item_id", "seed", "turn", "step", ex.step_seed("tandem-step-1", c("seed"), c("item_id"), c("turn"), c("step")).alias("step_seed"), ex.pairing_id("tandem-pair-1", F.lit("m"), F.lit("r1"), F.lit("plain"), c("seed"), c("item_id")).alias("pair"))


@query("c19_first_difference", "WITH m AS (SELECT item_id, CASE WHEN json_valid(metadata) AND json_type(metadata) = 'OBJECT' THEN metadata END AS j FROM (SELECT item_id, min(metadata) AS metadata FROM items WHERE item_id IS NOT NULL GROUP BY 1)), v AS (SELECT item_id, coalesce(json_extract_string(j, '$.instruction_count'), '') AS n, coalesce(json_extract_string(j, '$.lang'), '') AS l FROM m WHERE j IS NOT NULL) SELECT item_id, CASE WHEN n <> '1' THEN 'count' WHEN l <> 'en' THEN 'of.lang' END AS path FROM v")
def c19(spark, folder):
    """The first entry in which an item's metadata leave what was asked for."""
    meta = table(spark, folder, "items").filter("item_id is not null").groupBy("item_id").agg(F.min("metadata").alias("j")).filter(F.schema_of_variant(F.try_parse_json("j")).startswith("OBJECT"))
    part = lambda k: F.coalesce(F.get_json_object("j", f"$.{k}"), F.lit(""))
    mine = F.to_json(F.struct(part("instruction_count").alias("count"), F.struct(part("lang").alias("lang"), F.lit("x").alias("same")).alias("of")))
    return meta.select("item_id", parsing.first_difference(mine, F.lit('{"of": {"same": "x", "lang": "en"}, "count": "1"}')).alias("path"))


@query("m3_m4_registries", "WITH t AS (SELECT request_id, min(text) AS text FROM inference_responses WHERE text IS NOT NULL AND request_id IS NOT NULL GROUP BY 1) SELECT count(*) AS texts, CAST(sum(CASE WHEN length(regexp_replace(text, '\\s+', '', 'g')) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS v0, CAST(sum(CASE WHEN regexp_matches(trim(text), '^[Bb]$') THEN 1 ELSE 0 END) AS BIGINT) AS exact, CAST(sum(CASE WHEN regexp_matches(text, '^[^a-zA-Z0-9_]*[Bb]([^a-zA-Z0-9_]|$)') THEN 1 ELSE 0 END) AS BIGINT) AS letter, CAST(0 AS BIGINT) AS external FROM t")
def m3(spark, folder):
    """Parsers and scorers taken from their registries by name."""
    t = table(spark, folder, "inference_responses").filter("text is not null and request_id is not null").groupBy("request_id").agg(F.min("text").alias("text"))
    right = {name: F.count_if(F.coalesce(score(F.col("text"), F.lit("B")), F.lit(False))) for name, score in parsing.SCORERS.items()}
    return t.agg(F.count("*").alias("texts"), F.count(parsing.ANSWER_PARSERS["v0"](F.col("text"))).alias("v0"), *[c.alias(n) for n, c in right.items()])


@query("d5b_anchors_by_category", "WITH o AS (SELECT CAST(l_orderkey AS VARCHAR) AS g, l_returnflag AS c, count(*) AS k FROM lineitem GROUP BY 1, 2), l AS (SELECT list_sort(list(DISTINCT c)) AS levels FROM o), w AS (SELECT g FROM o GROUP BY 1 HAVING count(*) = (SELECT len(levels) FROM l) AND max(k) = 1), t AS (SELECT g, row_number() OVER (ORDER BY sha256('tandem-anchor-1' || chr(0) || g), g) AS r FROM w) SELECT levels[CAST((r - 1) % len(levels) + 1 AS INTEGER)] AS category, count(*) AS anchors FROM t, l GROUP BY 1")
def d5b(spark, folder):
    """One variant for each group, categories in turn; groups that have every category once take part."""
    rows = table(spark, folder, "lineitem").select(F.lit("all").alias("dataset_id"), F.col("l_orderkey").cast("string").alias("group_id"), F.col("l_returnflag").alias("category"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("item_id"))
    return sampling.balanced_anchors(rows, ["dataset_id"], "group_id", "category", "item_id", "tandem-anchor-1").groupBy("category").agg(F.count("*").alias("anchors"))


@query("d11_prepared_manifest", "WITH i AS (SELECT DISTINCT dataset_id, item_id FROM items WHERE item_id IS NOT NULL AND dataset_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY sha256('tandem-prepare-1' || chr(0) || item_id), item_id) AS k, count(*) OVER (PARTITION BY dataset_id) AS n FROM i), s AS (SELECT dataset_id, item_id, CASE WHEN k <= n // 2 THEN 'development' WHEN k <= n // 2 + n // 4 THEN 'certification' ELSE 'test' END AS split FROM r) SELECT dataset_id, split, count(*) AS items, min(item_id) AS first, CAST(bit_xor(CAST('0x' || substr(sha256(item_id), 1, 15) AS BIGINT)) AS BIGINT) AS fingerprint FROM s GROUP BY ALL")
def d11(spark, folder):
    """A dataset prepared in one go: checked, sampled by salted hash, assigned and counted, with a fingerprint that depends on no order."""
    rows = table(spark, folder, "items").filter("item_id is not null and dataset_id is not null").select("dataset_id", "item_id").distinct()
    ranked = sampling.ranked(rows, ["dataset_id"], "item_id", "tandem-prepare-1")
    sizes = rows.groupBy("dataset_id").agg(F.count("*").alias("n"))
    half, quarter = F.floor(F.col("n") / 2), F.floor(F.col("n") / 4)
    split = F.when(F.col("rank") <= half, "development").when(F.col("rank") <= half + quarter, "certification").otherwise("test")
    word = F.conv(F.substring(F.sha2("item_id", 256), 1, 15), 16, 10).cast("bigint")
    return ranked.join(sizes, "dataset_id").groupBy("dataset_id", split.alias("split")).agg(F.count("*").alias("items"), F.min("item_id").alias("first"), F.bit_xor(word).alias("fingerprint"))


@query("a6_planned_cells", f"SELECT i.dataset_id, c.cond AS condition, CAST(s.seed AS INTEGER) AS seed, count(DISTINCT i.item_id) AS items FROM items i, unnest(['{REFERENCE}', '{HOT}']) c(cond), unnest([11, 23]) s(seed) WHERE i.item_id IS NOT NULL AND i.dataset_id = 'wide-exam' GROUP BY ALL")
def a6(spark, folder):
    """The cells of a plan that was read from its file and checked."""
    import json
    import uuid

    from tandemlab.sources import config
    from tandemlab.sources.tables import shared_dir

    path = f"{shared_dir(spark)}/plan-{uuid.uuid4().hex}"
    plan = {"experiment_id": "e1", "dataset_id": "wide-exam", "reference": REFERENCE, "conditions": [REFERENCE, HOT], "seeds": [11, 23], "target_risk": 0.25, "minimum_coverage": 0.1, "fixed_coverage": 0.5}
    spark.createDataFrame([(json.dumps(plan),)], "value string").coalesce(1).write.text(path)
    study = config.load_plan(spark, path)
    items = table(spark, folder, "items").filter((F.col("dataset_id") == study.dataset_id) & F.col("item_id").isNotNull())
    return study.design(items).groupBy(F.lit(study.dataset_id).alias("dataset_id"), "condition", "seed").agg(F.count("*").alias("items"))
