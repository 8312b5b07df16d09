"""Draws are spread from a plan of few rows that Spark takes for all there is: they must never be collected for a broadcast."""

import re

import pytest

from tandemlab.plans import registry

#: Queries that join draws to the units at their positions.
DRAWING = [
    "h14_classify",
    "g12_index_quantiles_minus_1",
    "h12_certified_risk_effects",
    "f26_separation",
    "h17_h21_main_table",
    "h15_reference_quality_bootstrap",
    "h5_risk_delta_draws",
    "g10_g13_interval",
    "h11_frozen_coverage_effects",
    "h2_bootstrap_draws",
    "i5_i6_pooled_effects",
    "n11_intervals_off_zero",
    "g11_index_quantiles",
    "h11_h12_noninferiority",
    "h4_paired_bootstrap",
    "i5_moderated_effects",
]


@pytest.mark.parametrize("name", DRAWING)
def test_draws_meet_their_units_on_many_tasks(spark, smallest, name):
    df = registry.QUERIES[name](spark, smallest)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joins = re.findall(r"(\w+Join)(?:\(skew=true\))? \[[^\]]*\bidx#[^\]]*\].* (Build\w+)", plan)
    assert joins and set(joins) == {("ShuffledHashJoin", "BuildRight")}


def test_drawn_items_meet_their_scores_on_many_tasks(spark, smallest):
    df = registry.QUERIES["h15_reference_quality_bootstrap"](spark, smallest)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joins = re.findall(r"(\w+Join)(?:\(skew=true\))? \[[^\]]*\bitem#[^\]]*\].* (Build\w+)", plan)
    assert joins == [("ShuffledHashJoin", "BuildRight")]
