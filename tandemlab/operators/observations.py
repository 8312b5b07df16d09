"""The observation relation: one row per record, with short names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: (name here, expression over the delivered columns)
COLUMNS = {
    "record_id": "record_id", "run_id": "run_id", "dataset_id": "dataset_id", "item": "dataset_item_id",
    "cluster": "coalesce(cluster_id, dataset_item_id)", "part": "dataset_partition", "cond": "condition_id", "seed": "seed",
    "a": "coalesce(answer_parse_status = 'valid', false)",
    "c": "coalesce(confidence_parse_status = 'valid' and confidence is not null and not isnan(confidence), false)",
    "conf": "confidence", "ans": "parsed_answer", "y": "correct",
}


def observations(delivered: DataFrame) -> DataFrame:
    """Delivered observations once each: a answer valid, c confidence valid, ans the parsed answer, y correct or null while pending.

    Of the copies of a record the one ingested first counts, the least by its other columns where several are; the same on every run.
    """
    rows = delivered.filter(F.col("record_id").isNotNull()).selectExpr("ingested_at", *[f"{e} as {n}" for n, e in COLUMNS.items()])
    kept = [n for n in COLUMNS if n != "record_id"]
    first = F.min_by(F.struct(*kept), F.struct(F.coalesce("ingested_at", F.timestamp_seconds(F.lit(1e11))), *kept))
    return rows.groupBy("record_id").agg(first.alias("x")).select("record_id", *[F.col(f"x.{n}") for n in kept])


def scored(obs: DataFrame) -> DataFrame:
    """The observations whose correctness is known."""
    return obs.filter(F.col("y").isNotNull())


def cells(obs: DataFrame) -> DataFrame:
    """One scored observation for each (run, item, condition, seed): that with the least record_id."""
    w = Window.partitionBy("run_id", "item", "cond", "seed").orderBy("record_id")
    return scored(obs).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")
