"""Column expressions that operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTCOMES = ("answer_failure", "confidence_failure", "low_confidence", "accepted_error", "accepted_success")


def accepts(tau: Column | float) -> Column:
    """Whether an observation is accepted: valid answer, valid confidence, confidence at least ``tau`` (inclusive). Null never accepts."""
    at = F.lit(tau) if isinstance(tau, (int, float)) else tau
    return F.col("a") & F.col("c") & F.coalesce(F.col("conf") >= at, F.lit(False))


def outcome(tau: Column | float) -> Column:
    """One of OUTCOMES, by precedence: a failed answer hides a failed confidence, which hides a low one."""
    return (
        F.when(~F.col("a"), "answer_failure").when(~F.col("c"), "confidence_failure").when(~accepts(tau), "low_confidence")
        .when(F.col("y"), "accepted_success").otherwise("accepted_error")
    )


def share(part: Column, whole: Column) -> Column:
    """part / whole, null where there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def decimal_round(x: Column, digits: int = 8) -> Column:
    """``x`` rounded half up in decimal arithmetic of 12 places, so that sums added up in another order round alike."""
    return F.round(x.cast("decimal(24,12)"), digits).cast("double")


def hash_number(*parts: Column) -> Column:
    """A bigint below 2^60 from the md5 of the parts joined by ':'; the same on every engine and layout."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("bigint")


def stable_id(*parts: Column) -> Column:
    """sha256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def sampling_seed(seed: Column, item: Column, stage: Column) -> Column:
    """A 63-bit seed from the first 8 bytes of a stable id, without the sign bit; it does not depend on the condition."""
    return seed_of(seed.cast("string"), item, stage)


def seed_of(*parts: Column) -> Column:
    """A 63-bit seed from the first 8 bytes of the sha256 of the parts joined by NUL."""
    h = stable_id(*parts)
    first = F.conv(F.substring(h, 1, 1), 16, 10).cast("int") % 8
    return F.conv(F.concat(F.conv(first.cast("string"), 10, 16), F.substring(h, 2, 15)), 16, 10).cast("bigint")


def step_seed(scheme: str, seed: Column, item: Column, turn: Column, step: Column) -> Column:
    """The seed of a step of an episode, shared by all conditions: of the scheme's name, replicate seed, item, turn and step."""
    return seed_of(F.lit(scheme), *[c.cast("string") for c in (seed, item, turn, step)])


def pairing_id(scheme: str, model: Column, revision: Column, mode: Column, seed: Column, item: Column) -> Column:
    """A name for what conditions have in common, by which their messages are paired: nothing of the condition enters it."""
    return stable_id(F.lit(scheme), *[c.cast("string") for c in (model, revision, mode, seed, item)])


def logit(p: Column, eps: float = 1e-6) -> Column:
    """ln(p / (1 - p)) of p clipped into [eps, 1 - eps]."""
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def violation(risk: Column, target: float) -> Column:
    """How far a risk exceeds its target; 0 within it, null where the risk is undefined."""
    return F.when(risk.isNotNull(), F.greatest(risk - target, F.lit(0.0)))
