"""Study plans from JSON files, checked when they are read, and the folder that results go to."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class PlanError(ValueError):
    """A plan that cannot be followed."""


@dataclass(frozen=True)
class StudyPlan:
    """What a study observes: every item under each condition and seed, with the rule that a policy is frozen by."""

    experiment_id: str
    dataset_id: str
    reference: str
    conditions: tuple[str, ...]
    seeds: tuple[int, ...]
    target_risk: float
    minimum_coverage: float
    fixed_coverage: float
    replicates: int = 5000
    randomisations: int = 9999

    def __post_init__(self) -> None:
        faults = {
            "names must not be blank": not (self.experiment_id.strip() and self.dataset_id.strip()),
            "conditions must be distinct and hold the reference": len(set(self.conditions)) != len(self.conditions) or self.reference not in self.conditions,
            "a plan needs a condition besides the reference": len(self.conditions) < 2,
            "seeds must be distinct": not self.seeds or len(set(self.seeds)) != len(self.seeds),
            "shares must lie between 0 and 1": not all(0 <= x <= 1 for x in (self.target_risk, self.minimum_coverage, self.fixed_coverage)),
            "resampling needs a replicate": min(self.replicates, self.randomisations) < 1,
        }
        broken = [name for name, there in faults.items() if there]
        if broken:
            raise PlanError("; ".join(broken))

    def design(self, items: DataFrame) -> DataFrame:
        """(item_id, condition, seed): what is to be observed; the plan side is literals."""
        from pyspark.sql import functions as F

        over = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
        return items.select("item_id").distinct().withColumn("condition", over(self.conditions)).withColumn("seed", over(self.seeds))


def plan_from(values: Mapping[str, object]) -> StudyPlan:
    """A plan from a mapping: unknown, missing or mistyped entries are errors, never defaults."""
    known = {f.name: f for f in fields(StudyPlan)}
    odd = sorted(set(values) - set(known))
    if odd:
        raise PlanError(f"unknown entries: {', '.join(odd)}")
    kinds = {"str": str, "float": (int, float), "int": int, "tuple[str, ...]": list, "tuple[int, ...]": list}
    wrong = sorted(k for k, v in values.items() if isinstance(v, bool) or not isinstance(v, kinds[known[k].type]))
    if wrong:
        raise PlanError(f"entries of another type: {', '.join(wrong)}")
    try:
        return StudyPlan(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
    except TypeError as e:
        raise PlanError(str(e)) from None


def load_plan(spark: SparkSession, path: str) -> StudyPlan:
    """The plan of a JSON file, read where the session reads files; a key that stands twice is an error."""

    def once(pairs: list[tuple[str, object]]) -> dict[str, object]:
        if len({k for k, _ in pairs}) != len(pairs):
            raise PlanError("an entry stands twice")
        return dict(pairs)

    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        values = json.loads(text, object_pairs_hook=once)
    except json.JSONDecodeError:
        raise PlanError("the plan is no JSON") from None
    if not isinstance(values, dict):
        raise PlanError("the plan is no object")
    return plan_from(values)


def storage_root(environment: Mapping[str, str] | None = None, name: str = "TANDEMLAB_STORAGE") -> str:
    """The folder for results that the environment names; unset, relative, or within this package's repository it is refused."""
    root = (os.environ if environment is None else environment).get(name, "")
    if "://" in root:
        return root.rstrip("/")
    if not root or not Path(root).is_absolute():
        raise PlanError(f"{name} must name an absolute folder")
    if Path(root).resolve().is_relative_to(Path(__file__).resolve().parents[2]):
        raise PlanError(f"{name} lies within the repository")
    return str(Path(root).resolve())
