"""Operators against identities, brute force and known values."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandemlab.functions.expressions import OUTCOMES
from tandemlab.operators import audit, endpoints, fits, inference, ranking_metrics, resample, sampling, thresholds, variance
from tandemlab.operators.graph import components
from tandemlab.operators.observations import observations
from tandemlab.operators.ranking import bucketed_rank, range_rank

OBS = "record_id string, run_id string, dataset_id string, item string, cluster string, part string, cond string, seed bigint, a boolean, c boolean, conf double, ans string, y boolean"


def obs(spark, rows):
    """rows: (item, cond, conf or None, y, a, ans); the answer may be left out"""
    return spark.createDataFrame([(f"r{i}", "run", "d", it, it, "test", cond, 1, a, conf is not None, conf, (*ans, "A")[0], y) for i, (it, cond, conf, y, a, *ans) in enumerate(rows)], OBS)


def test_five_outcomes_sum_to_one(spark):
    rows = [("1", "ref", 0.9, True, True), ("2", "ref", 0.9, False, True), ("3", "ref", 0.1, True, True), ("4", "ref", None, False, True), ("5", "ref", 0.95, False, False)]
    got = endpoints.outcome_partition(obs(spark, rows), 0.8, ["cond"]).first()
    assert all(got[k] == pytest.approx(0.2) for k in OUTCOMES)
    assert got["coverage"] + got["non_acceptance"] == pytest.approx(1.0)


def test_nothing_accepted_is_undefined(spark):
    got = endpoints.operational_endpoints(obs(spark, [("1", "ref", 0.1, True, True)]), 0.8, ["cond"]).first()
    assert got["risk"] is None and got["success"] is None and got["coverage"] == 0.0


def test_same_risk_other_coverage(spark):
    rows = [(str(i), "a", 0.9, i % 2 == 0, True) for i in range(20)] + [(str(i), "b", 0.9 if i < 4 else 0.1, i % 2 == 0, True) for i in range(20)]
    got = {r["cond"]: r for r in endpoints.operational_endpoints(obs(spark, rows), 0.8, ["cond"]).collect()}
    assert got["a"]["risk"] == got["b"]["risk"] and (got["a"]["coverage"], got["b"]["coverage"]) == (1.0, 0.2)


def test_the_same_answer_is_not_the_same_correctness(spark):
    rows = [
        ("1", "ref", 0.9, False, True, "A"), ("1", "new", 0.8, False, True, "B"), ("2", "ref", 0.9, True, True, "C"), ("2", "new", 0.7, False, True, "C"), ("3", "ref", 0.5, False, False, None), ("3", "new", 0.5, False, False, None),
        ("4", "ref", None, True, True, "D"), ("4", "new", 0.9, True, True, "D"), ("5", "ref", 0.9, True, True, "A"),
    ]
    cells = obs(spark, rows)
    got = endpoints.same_answer(cells, "ref", "new").first()
    assert (got["pairs"], got["same"], got["accuracy_on_same"], got["shifted_accuracy_on_same"], got["valid_pairs"]) == (4, 2, 1.0, 0.5, 1)
    assert got["mean_confidence_delta"] == pytest.approx(-0.2)
    strength = endpoints.intervention_strength(cells, "ref").first()
    assert (strength["answer_changed"], strength["confidence_changed"], strength["confidence_changed_same_answer"], strength["realisation"]) == (0.5, 0.75, 1.0, 0.75)


def test_of_the_copies_of_a_record_the_first_ingested_counts(spark):
    schema = "record_id string, run_id string, dataset_id string, dataset_item_id string, cluster_id string, dataset_partition string, condition_id string, seed bigint, answer_parse_status string, confidence_parse_status string, confidence double, parsed_answer string, correct boolean, ingested_at timestamp"
    row = lambda i, ans, day: (i, "r", "d", "x", None, "test", "ref", 1, "valid", "valid", 0.5, ans, True, None if day is None else dt.datetime(2026, 1, day))
    df = spark.createDataFrame([row("a", "B", 2), row("a", "A", 3), row("a", "C", None), row("b", "Z", None), row("b", "Y", None), row(None, "A", 1)], schema)
    assert {r["record_id"]: r["ans"] for r in observations(df.repartition(3)).collect()} == {"a": "B", "b": "Y"}


def arms(spark, change):
    ref = [(f"i{n:02d}", "ref", 0.9, n % 3 == 0, True) for n in range(40)]
    return resample.cluster_stats(obs(spark, ref + [change(*r) for r in ref]), 0.8, "ref", ["new"])


def test_identical_arms_have_no_effect(spark):
    stats = arms(spark, lambda it, c, p, y, a: (it, "new", p, y, a))
    d = resample.endpoint_deltas(stats, ["run_id", "contrast"]).first()
    assert all(d[k] == 0 for k in ("d_q", "d_k", "d_r", "d_s"))
    assert resample.randomisation_p(stats, "d_r", 50, 2).first()["p"] == 1.0
    boot = resample.intervals(resample.endpoint_deltas(resample.bootstrap_draws(stats, 30, 1), ["run_id", "contrast", "b"]), ["run_id", "contrast"], "d_k")
    assert (boot.first()["ci_low"], boot.first()["ci_high"], boot.first()["replicates"]) == (0.0, 0.0, 30)


def test_failing_the_wrong_answers_lowers_coverage(spark):
    stats = arms(spark, lambda it, c, p, y, a: (it, "new", p, y, y))
    d = resample.endpoint_deltas(stats, ["run_id", "contrast"]).first()
    assert d["d_r"] < 0 < d["d_q"] and d["d_k"] < 0 and d["d_s"] == pytest.approx(0)


def test_bootstrap_draws_as_many_as_units(spark):
    draws = resample.bootstrap_draws(arms(spark, lambda it, c, p, y, a: (it, "new", p, y, a)), 10, 3)
    assert {r["count"] for r in draws.groupBy("b").count().collect()} == {40}


@pytest.mark.parametrize(("convention", "at"), [("linear", 24.375), ("index_n", 25.0), ("index_n_minus_1", 24.0)])
def test_quantile_conventions(spark, convention, at):
    draws = spark.createDataFrame([("g", float(i)) for i in range(1000)] + [("g", None)], "g string, v double")
    got = resample.intervals(draws, ["g"], "v", 0.95, convention).first()
    assert got["replicates"] == 1000
    assert got["ci_low"] == pytest.approx({"linear": 24.975}.get(convention, at))


def _pav(atoms):
    blocks = []
    for c, n, p in sorted(atoms):
        blocks.append([p, n, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            p2, n2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p2, blocks[-1][1] + n2, blocks[-1][2] + k2]
    return [b[0] / b[1] for b in blocks for _ in range(b[2])]


def test_isotonic_fit_is_pav(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g in range(30):
        atoms = [(c / 10, n := rng.randint(1, 9), rng.randint(0, n)) for c in rng.sample(range(11), rng.randint(1, 9))]
        rows += [(g, *a) for a in atoms]
        want[g] = _pav(atoms)
    fit = ranking_metrics.isotonic(spark.createDataFrame(rows, "g int, conf double, n bigint, pos bigint"), ["g"]).orderBy("g", "conf").collect()
    for g, w in want.items():
        assert [r["fit"] for r in fit if r["g"] == g] == pytest.approx(w)


def test_corp_identity_and_auroc_ties(spark):
    c, y = [0.1, 0.2, 0.4, 0.5, 0.6, 0.8, 0.9, 0.95], [0, 0, 1, 0, 1, 1, 1, 0]
    atom = ranking_metrics.atoms(obs(spark, [(str(i), "g", p, bool(v), True) for i, (p, v) in enumerate(zip(c, y, strict=True))]), ["cond"])
    got = ranking_metrics.corp(atom, ["cond"]).first()
    assert got["brier"] == pytest.approx(got["mcb"] - got["dsc"] + got["unc"], abs=1e-7)
    flat = ranking_metrics.atoms(obs(spark, [(str(i), "g", 0.5, i % 2 == 0, True) for i in range(6)]), ["cond"])
    assert ranking_metrics.auroc(flat, ["cond"]).first()["auroc"] == 0.5
    one = ranking_metrics.atoms(obs(spark, [("1", "g", 0.5, True, True)]), ["cond"])
    assert ranking_metrics.auroc(one, ["cond"]).first()["auroc"] is None


def test_quantisation_of_known_masses(spark):
    masses = {0.5: 4, 0.6: 1, 0.7: 2, 0.8: 5, 0.85: 20, 0.9: 49, 0.95: 28, 0.98: 183, 1.0: 8}
    rows = [(f"{p}-{i}", "g", p, True, True) for p, n in masses.items() for i in range(n)]
    got = ranking_metrics.quantisation(ranking_metrics.atoms(obs(spark, rows), ["cond"]), ["cond"]).first()
    assert got["entropy_bits"] == pytest.approx(1.8383253806, abs=1e-6) and got["largest_atom"] == 0.98
    steps = ranking_metrics.coverage_steps(ranking_metrics.atoms(obs(spark, rows), ["cond"]), ["cond"])
    assert steps.filter("conf = 0.98").first()["reachable"] == pytest.approx(0.6367, abs=1e-4)


def test_threshold_ties_and_fallback(spark):
    # 0.9 holds only an invalid answer: no candidate; 0.6 and 0.5 have the same coverage since 0.5 adds no valid answer
    rows = [("1", "g", 0.9, True, False), ("2", "g", 0.8, True, True), ("3", "g", 0.6, False, True), ("4", "g", 0.5, True, False)]
    cand = thresholds.candidates(obs(spark, rows), ["cond"])
    assert sorted(r["threshold"] for r in cand.collect()) == [0.5, 0.6, 0.8]
    assert thresholds.empirical_threshold(cand, ["cond"], 0.5).first()["threshold"] == 0.5  # lowest on a tie
    assert thresholds.fixed_coverage_threshold(cand, ["cond"], 0.5).first()["threshold"] == 0.6  # highest on a tie
    assert thresholds.fixed_coverage_threshold(cand, ["cond"], 0.9).first()["status"] == "target unattainable"
    frozen = thresholds.frozen_endpoint(obs(spark, rows), ["cond"], 0.1, 0.5, 0.5).first()
    assert (frozen["risk_contract"], frozen["endpoint"], frozen["threshold"]) == ("infeasible", "fixed_coverage_0.50", 0.6)


def test_holm(spark):
    rows = [("f", n, p) for n, p in {"a": 0.01, "b": 0.04, "c": 0.03, "d": 0.005}.items()] + [("f", "e", None)]
    got = {r["name"]: (r["adjusted"], r["reject"]) for r in inference.holm(spark.createDataFrame(rows, "fam string, name string, p double"), ["fam"], "p", F.col("name")).collect()}
    assert {k: v[0] for k, v in got.items()} == pytest.approx({"d": 0.02, "a": 0.03, "c": 0.06, "b": 0.06})
    assert [got[k][1] for k in "dacb"] == [True, True, False, False]


def test_exact_bound_known_values():
    assert inference.binomial_upper(4, 3328) == pytest.approx(0.002748, abs=1e-6)
    assert inference.binomial_upper(0, 3328) == pytest.approx(1 - 0.05 ** (1 / 3328), rel=1e-6)
    assert inference.binomial_upper(5, 5) == 1.0 and inference.binomial_upper(0, 0) is None


@pytest.mark.parametrize(
    ("low", "high", "reject", "label", "overlap"),
    [(0.007, 0.026, True, "change_detected", False), (-0.004, 0.011, False, "equivalent_within_margin", False), (-0.03, 0.015, False, "inconclusive", False), (None, None, False, "not_estimable", False), (0.001, 0.02, True, "change_detected", True), (-0.025, 0.0, False, "inconclusive", False)],
)
def test_classification(spark, low, high, reject, label, overlap):
    got = inference.classify(spark.createDataFrame([(low, high, reject)], "ci_low double, ci_high double, reject boolean"), 0.025).first()
    assert (got["classification"], got["overlap"]) == (label, overlap)


def test_separation(spark):
    rows = [(True, 0.015), (False, 1.0), (None, 0.115), (True, None)]
    got = inference.separation(spark.createDataFrame(rows, "equivalent boolean, realisation double")).first()
    assert (got["max_equivalent"], got["min_other"], got["separated"]) == (0.015, 0.115, True)


def test_total_variance(spark):
    rows = [(i, s, bool(v)) for i, vs in {"a": [0, 1, 1], "b": [1, 1, 1], "c": [0, 0, 1]}.items() for s, v in enumerate(vs)]
    cells = spark.createDataFrame([("r", "c", i, s, y) for i, s, y in rows], "run_id string, cond string, item string, seed int, y boolean")
    got = variance.variance_split(cells).first()
    assert got["within"] + got["between"] == pytest.approx(np.var([v for _, _, v in rows]), abs=1e-7)


def test_shards_nest_and_splits_follow_ids(spark):
    ids = spark.createDataFrame([("d", f"item-{i}") for i in range(2000)], "ds string, id string")
    k = ids.select(sampling.shard(F.col("id"), 2).alias("two"), sampling.shard(F.col("id"), 4).alias("four"))
    assert k.filter("four = 0 and two != 0").count() == 0
    a = {r["id"]: r["split"] for r in sampling.deterministic_split(ids, ["ds"], "id", "salt", (0.5, 0.3, 0.2)).collect()}
    b = {r["id"]: r["split"] for r in sampling.deterministic_split(ids.repartition(7).union(ids), ["ds"], "id", "salt", (0.5, 0.3, 0.2)).collect()}
    assert a == b and [list(a.values()).count(s) for s in sampling.SPLITS] == [1000, 600, 400]


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 400))
def test_largest_remainders(spark, n):
    got = sampling.split_counts(spark.createDataFrame([(n,)], "n bigint"), (0.4, 0.35, 0.25)).first()
    exact = [n * s for s in (0.4, 0.35, 0.25)]
    assert got["c0"] + got["c1"] + got["c2"] == n and all(abs(got[f"c{i}"] - e) < 1 for i, e in enumerate(exact))


def test_anchors_are_balanced(spark):
    v = spark.createDataFrame([("d", f"g{g}", lv, f"g{g}-{lv}") for g in range(23) for lv in range(1, 6)] + [("d", "partial", 1, "x")], "ds string, g string, lv int, item string")
    got = sampling.balanced_anchors(v, ["ds"], "g", "lv", "item", "salt").collect()
    counts = [sum(r["lv"] == lv for r in got) for lv in range(1, 6)]
    assert len(got) == 23 and max(counts) - min(counts) <= 1


def test_design_roles(spark):
    items = spark.createDataFrame([("i",)], "item string")
    got = {(r["answer_condition"], r["readout"]): r["roles"] for r in sampling.expand_design(items, ["ref", "hot"], [1], "ref", ["verbal"]).collect()}
    assert got == {("ref", "ref"): "coupled+standardized", ("ref", "verbal"): "report_only", ("hot", "hot"): "coupled", ("hot", "ref"): "standardized"}


def test_components_match_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1120)] + [(5000, x) for x in range(5001, 5200)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_bucketed_rank_is_row_number(spark):
    rows = [(k, i, f"{(i * 7919) % 1000:03d}") for k in ("x", None) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i int, h string")
    got = bucketed_rank(df, ["k"], F.substring("h", 1, 1), [F.col("h"), F.col("i")], "rank").collect()
    for k in ("x", None):
        mine = sorted((r["h"], r["i"], r["rank"]) for r in got if r["k"] == k)
        assert [m[2] for m in mine] == list(range(1, 301))


def test_logistic_statuses_and_recovery():
    rng = np.random.default_rng(1)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.4 + 1.3 * x)))).astype(float)
    status, a, b, _ = fits.newton_logistic(x, y, np.ones(4000))
    assert status == "estimated" and (a, b) == pytest.approx((0.4, 1.3), abs=0.15)
    assert fits.newton_logistic(x, np.ones(4000), np.ones(4000))[0] == "no_outcome_variation"
    assert fits.newton_logistic(np.zeros(10), y[:10] * 0 + np.arange(10) % 2, np.ones(10))[0] == "singular"


def test_reml_of_equal_effects_has_no_heterogeneity():
    got = fits.reml(np.array([0.2, 0.2, 0.2]), np.array([0.01, 0.02, 0.03]), np.ones((3, 1)))
    assert got["tau2"] == 0.0 and got["beta"][0] == pytest.approx(0.2) and got["i2"] == 0.0
    two = fits.reml(np.array([0.0, 1.0]), np.array([0.01, 0.01]), np.ones((2, 1)))
    assert two["tau2"] == pytest.approx(0.49, abs=1e-6)  # the sample variance of the two less their own
    assert fits.reml(np.array([1.0, 2.0]), np.array([1.0, 1.0]), np.ones((2, 2))) is None


def test_surface_recovers_coefficients():
    rng = np.random.default_rng(2)
    t, p = rng.uniform(0, 1, 6000), rng.uniform(0.5, 0.95, 6000)
    design = fits.surface_terms(t, p, 0.5, 0.8)
    beta = np.array([0.3, -1.0, 0.5, 0.2, -0.1, 0.4])
    y = (rng.random(6000) < 1 / (1 + np.exp(-design @ beta))).astype(float)
    got = fits.fractional_logit(design, y, np.ones(6000), np.arange(6000) % 200)
    assert got["beta"][:2] == pytest.approx(beta[:2], abs=0.35) and got["clusters"] == 200
    assert fits.fractional_logit(np.ones((9, 2)), y[:9], np.ones(9), np.arange(9)) is None


def test_audits(spark):
    e, f = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("b",), ("c",)], "id string")
    assert {(r["id"], r["kind"]) for r in audit.missing_and_unexpected(e, f, ["id"]).collect()} == {("a", "missing"), ("c", "unexpected")}
    x, y = spark.createDataFrame([("a", 1, None), ("b", 2, 3)], "id string, u int, v int"), spark.createDataFrame([("a", 1, None), ("b", 2, 4)], "id string, u int, v int")
    assert [tuple(r) for r in audit.mismatches(x, y, ["id"], ["u", "v"]).collect()] == [("b", "v")]
    assert audit.republish_difference(x, x).count() == 0 and audit.republish_difference(x, y).count() == 2


def test_poisson_bootstrap_is_near_the_resampling_one(spark):
    stats = arms(spark, lambda it, c, p, y, a: (it, "new", 0.9 if int(it[1:]) % 4 else 0.1, y, a))
    by = ["run_id", "contrast"]
    spread = lambda d: d.agg(F.stddev("d_k")).first()[0]
    a = spread(resample.poisson_bootstrap(stats, by, 200, 1))
    b = spread(resample.endpoint_deltas(resample.bootstrap_draws(stats, 200, 1), [*by, "b"]))
    assert a == pytest.approx(b, rel=0.3) and not math.isclose(a, 0)


def test_a_single_score_may_hold_any_number_of_rows(spark):
    atom = spark.createDataFrame([("x", 0.9, 10, 4), ("x", 0.5, 7, 7), ("x", 0.2, 90, 1), ("big", 0.5, 10**9, 4 * 10**8)], "g string, conf double, n bigint, pos bigint")
    totals = spark.createDataFrame([("x", 200), ("big", 10**9)], "g string, total bigint")
    got = {r["g"]: r for r in ranking_metrics.aurc(atom, totals, ["g"]).collect()}
    n0 = e0 = s = 0
    for n, pos in ((10, 4), (7, 7), (90, 1)):
        s += sum((e0 + k * (n - pos) / n) / (n0 + k) for k in range(1, n + 1))
        n0, e0 = n0 + n, e0 + n - pos
    assert got["x"]["aurc"] == pytest.approx(s / 107, abs=1e-8) and got["x"]["operational_aurc"] == pytest.approx(s / 200, abs=1e-8)
    assert got["big"]["aurc"] == pytest.approx(0.6, abs=1e-8)


def test_isotonic_fit_of_many_scores_is_that_of_all_at_once(spark):
    rng = random.Random(12)
    rows = [("skewed" if i % 10 else "other", i / 20_000, rng.randint(1, 5), 0) for i in range(20_000)]
    rows = [(g, c, n, sum(rng.random() < c for _ in range(n))) for g, c, n, _ in rows]
    fit = {(r["g"], r["conf"]): r["fit"] for r in ranking_metrics.isotonic(spark.createDataFrame(rows, "g string, conf double, n bigint, pos bigint"), ["g"]).collect()}
    for g in ("skewed", "other"):
        mine = [r for r in rows if r[0] == g]
        block = ranking_metrics.pool([r[2] for r in mine], [r[3] for r in mine])
        sums = {}
        for b, r in zip(block, mine, strict=True):
            n, p = sums.get(b, (0, 0))
            sums[b] = n + r[2], p + r[3]
        assert all(fit[g, r[1]] == sums[b][1] / sums[b][0] for b, r in zip(block, mine, strict=True))
        rates = [p / n for n, p in (sums[b] for b in sorted(sums))]
        assert rates == sorted(rates)


def test_bounds_of_many_errors():
    import math
    import time

    began = time.time()
    got = inference.binomial_upper_bounds(np.array([10**6, 400_000, 3, 0]), np.array([10**8, 10**6, 10, 50]))
    assert time.time() - began < 20
    assert got[0] == pytest.approx(0.01 + 1.645 * math.sqrt(0.01 * 0.99 / 1e8), rel=1e-4) and got[3] == pytest.approx(1 - 0.05 ** (1 / 50), rel=1e-9)
    tail = sum(math.comb(10, k) * got[2] ** k * (1 - got[2]) ** (10 - k) for k in range(4))
    assert tail == pytest.approx(0.05, abs=1e-9)


def test_a_million_units_of_one_contrast(spark):
    sizes = spark.createDataFrame([("r", "c", 1_000_000), ("r", "d", 3)], "run_id string, contrast string, size bigint")
    draws = resample.draw_positions(sizes, ["run_id", "contrast"], 2)
    got = {(r["contrast"], r["b"]): (r["n"], r["least"], r["most"]) for r in draws.groupBy("contrast", "b").agg(F.count("*").alias("n"), F.min("j").alias("least"), F.max("j").alias("most")).collect()}
    assert got == {("c", 0): (10**6, 0, 10**6 - 1), ("c", 1): (10**6, 0, 10**6 - 1), ("d", 0): (3, 0, 2), ("d", 1): (3, 0, 2)}
    units = spark.range(1_000_000).select(F.lit("r").alias("run_id"), F.concat(F.lit("u"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("unit"), "id")
    ranked = range_rank(units, ["run_id"], ["unit"], "k")
    assert ranked.filter("k != id + 1").count() == 0 and ranked.rdd.getNumPartitions() > 1


def test_the_distributed_surface_is_the_one_of_all_rows(spark):
    rng = np.random.default_rng(3)
    n = 4000
    t, p, c, mode = rng.choice([0.2, 0.4, 0.6, 0.8, 1.0], n), rng.choice([0.7, 0.8, 0.9, 0.95], n), rng.integers(0, 60, n), rng.choice(["a", "b", "c"], n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + 1.2 * (t - 0.5) - 0.5 * (mode == "b") + 0.02 * (c % 7))))).astype(float)
    rows = spark.createDataFrame([("g", str(k), float(a), float(b), m, float(z)) for k, a, b, m, z in zip(c, t, p, mode, y)] + [("one", "x", 0.5, 0.8, "a", 1.0)], "g string, cluster string, t double, top_p double, mode string, y double")
    got = {r["term"]: r for r in fits.dense_surface(rows, ["g"], 0.5, 0.8, ["mode"]).collect()}
    design = np.column_stack([fits.surface_terms(t, p, 0.5, 0.8), mode == "b", mode == "c"]).astype(float)
    want = fits.fractional_logit(design, y, np.ones(n), c)
    assert list(got) == [*fits.TERMS, "mode[b]", "mode[c]"]
    for i, r in enumerate(got.values()):
        assert r["estimate"] == pytest.approx(want["beta"][i], abs=2e-6) and r["se"] == pytest.approx(want["se"][i], abs=2e-6) and r["clusters"] == 60


def test_moderated_effects_and_their_sparse_form(spark):
    rng = np.random.default_rng(4)
    rows = [("many", f"e{i:03d}", float(0.1 + 0.4 * (i % 2) + rng.normal(0, 0.05)), 0.0025, "xy"[i % 2]) for i in range(60)] + [("few", f"e{i}", 0.2 + 0.1 * i, 0.01, ["u", "u", None][i]) for i in range(3)] + [("one", "e", 0.1, 0.1, "x"), ("many", "bad", None, 0.1, "x"), ("many", "flat", 0.3, 0.0, "x")]
    effects = spark.createDataFrame(rows, "panel string, effect_id string, estimate double, variance double, m string")
    got = {(r["panel"], r["stratum"], r["term"]): r for r in fits.moderated(effects, ["panel"], ["m"]).collect()}
    assert set(got) == {("many", "all", "intercept"), ("many", "all", "m[y]"), ("few", "m[u]", "intercept"), ("few", "m[(null)]", "intercept")}
    assert got["many", "all", "m[y]"]["estimate"] == pytest.approx(0.4, abs=0.04) and got["many", "all", "m[y]"]["status"] == "estimated"
    assert got["few", "m[u]", "intercept"]["estimate"] == pytest.approx(0.25) and got["few", "m[(null)]", "intercept"]["status"] == "single"
    model = fits.RandomEffects(np.array([0.0, 1.0, 0.2, 3.0]), np.array([0.01, 0.04, 0.09, 0.02]), np.ones((4, 1)))
    assert model.score(model.between()) == pytest.approx(0, abs=1e-6)
