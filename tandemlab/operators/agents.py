"""Agent episodes: nested steps, scoring short cuts and the view of an episode as an observation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP_LIMIT = 20


def episodes(requests: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(run_id, item, cond, steps array, n_steps, force_terminated, invalid_outputs): the requests of a run, item and condition as one episode."""
    ok = outcomes.groupBy("request_id").agg(F.max("status").alias("status"))
    one = requests.filter(F.col("request_id").isNotNull()).dropDuplicates(["request_id"]).join(ok, "request_id", "left")
    step = F.struct(F.col("created_at").alias("at"), "request_id", "stage", F.coalesce("status", F.lit("missing")).alias("status"))
    agg = one.groupBy("run_id", F.col("dataset_item_id").alias("item"), F.col("condition_id").alias("cond")).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    return agg.select("*", F.size("steps").alias("n_steps"), (F.size("steps") > STEP_LIMIT).alias("force_terminated"), F.size(F.filter("steps", lambda s: s["status"] == "invalid")).alias("invalid_outputs"))


def class_documents(cases: DataFrame, documents: DataFrame, held_out: DataFrame) -> DataFrame:
    """(case_id, name): the function documents of each case's classes, without those held out from it.

    ``cases``: (case_id, classes array), ``documents``: (class, name), ``held_out``: (case_id, name). A class without documents adds nothing.
    """
    asked = cases.select("case_id", F.explode("classes").alias("class"))
    return asked.join(documents.select("class", "name"), "class").select("case_id", "name").distinct().join(held_out.select("case_id", "name"), ["case_id", "name"], "left_anti")


def episode_scores(eps: DataFrame) -> DataFrame:
    """Forced termination fails first, then malformed output; the rest waits for the official checker (null)."""
    return eps.withColumn("success", F.when(F.col("force_terminated") | (F.col("invalid_outputs") > 0), F.lit(False)))


def as_observations(eps: DataFrame) -> DataFrame:
    """(run_id, item, cond, a, parsed_answer): an episode's answer is valid if it ended by itself without malformed output; its transcript's hash stands for it."""
    text = F.array_join(F.transform("steps", lambda s: F.concat_ws("=", s["request_id"], s["status"])), "\n")
    return eps.select("run_id", "item", "cond", (~F.col("force_terminated") & (F.col("invalid_outputs") == 0)).alias("a"), F.sha2(text, 256).alias("parsed_answer"))
