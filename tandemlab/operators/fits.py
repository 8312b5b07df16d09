"""Iterative fits over compressed groups: data are added up to distinct (x, outcome) rows by Spark, and only those meet a grouped map."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlab.sources.tables import materialize

Z95 = 1.959963984540054


def invert(matrix: np.ndarray, tolerance: float = 1e-12) -> np.ndarray | None:
    """The inverse of a symmetric matrix, or None where the least pivot of its elimination is within ``tolerance``."""
    work = np.hstack([matrix.astype(float), np.eye(len(matrix))])
    n = len(matrix)
    for i in range(n):
        p = i + int(np.argmax(np.abs(work[i:, i])))
        if abs(work[p, i]) <= tolerance:
            return None
        work[[i, p]] = work[[p, i]]
        work[i] /= work[i, i]
        for j in range(n):
            if j != i:
                work[j] -= work[j, i] * work[i]
    return work[:, n:]


def newton_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, eps: float = 1e-6, rounds: int = 100) -> tuple[str, float | None, float | None, int]:
    """Weighted two-parameter logistic fit of y on x: (status, intercept, slope, rounds)."""
    # Steps cut at 5, linear part at 40, singular below 1e-12, done below 1e-8, given up above 100.
    total, hits = w.sum(), (w * y).sum()
    if total == 0 or hits == 0 or hits == total:
        return "no_outcome_variation", None, None, 0
    rate = min(1 - eps, max(eps, hits / total))
    beta = np.array([np.log(rate / (1 - rate)), 1.0])
    for k in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(beta[0] + beta[1] * x, -40, 40)))
        v = w * p * (1 - p)
        grad = np.array([(w * (y - p)).sum(), (w * (y - p) * x).sum()])
        h = np.array([[v.sum(), (v * x).sum()], [(v * x).sum(), (v * x * x).sum()]])
        det = h[0, 0] * h[1, 1] - h[0, 1] ** 2
        if det <= 1e-12:
            return "singular", None, None, k
        step = np.array([h[1, 1] * grad[0] - h[0, 1] * grad[1], h[0, 0] * grad[1] - h[0, 1] * grad[0]]) / det
        beta = beta + step * min(1.0, 5.0 / max(np.abs(step).max(), 5.0))
        if np.abs(step).max() < 1e-8:
            return "estimated", float(beta[0]), float(beta[1]), k
        if np.abs(beta).max() > 100:
            break
    return "nonconvergent", None, None, rounds


def calibration_logistic(obs: DataFrame, by: list[str], eps: float = 1e-6) -> DataFrame:
    """(by, status, intercept, slope): logistic recalibration of correctness on the logit of confidence; groups are atoms, not observations."""
    atom = obs.filter("c").groupBy(*by, "conf", "y").agg(F.count("*").alias("n"))
    types = dict(obs.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf["conf"].clip(eps, 1 - eps).to_numpy()
        status, a, b, _ = newton_logistic(np.log(p / (1 - p)), pdf["y"].astype(float).to_numpy(), pdf["n"].to_numpy(dtype=float), eps)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "status": [status], "intercept": [a], "slope": [b]})

    out = atom.groupBy(*by).applyInPandas(fit, ", ".join(f"{k} {types[k]}" for k in by) + ", status string, intercept double, slope double")
    return out.withColumn("intercept", F.round("intercept", 6)).withColumn("slope", F.round("slope", 6))


def fractional_logit(design: np.ndarray, y: np.ndarray, w: np.ndarray, cluster: np.ndarray, rounds: int = 100) -> dict | None:
    """IRLS fit of a mean surface with cluster sandwich errors; rows are weighted by how many observations they stand for. None: no fit."""
    n, k = w.sum(), design.shape[1]
    if n <= k:
        return None
    mean = min(1 - 1e-6, max(1e-6, (w * y).sum() / n))
    beta = np.zeros(k)
    beta[0] = np.log(mean / (1 - mean))
    for _ in range(rounds):
        eta = np.clip(design @ beta, -30, 30)
        p = 1 / (1 + np.exp(-eta))
        v = np.maximum(1e-9, p * (1 - p))
        inv = invert((design * (w * v)[:, None]).T @ design)
        if inv is None:
            return None
        new = inv @ ((design * (w * v)[:, None]).T @ (eta + (y - p) / v))
        moved, beta = np.abs(new - beta).max(), new
        if moved < 1e-9:
            break
    else:
        return None
    p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
    bread = invert((design * (w * np.maximum(1e-9, p * (1 - p)))[:, None]).T @ design)
    codes, names = pd.factorize(cluster)
    scores = np.zeros((len(names), k))
    np.add.at(scores, codes, design * (w * (y - p))[:, None])
    robust = bread @ (scores.T @ scores) @ bread
    g = len(names)
    if g > 1:
        robust = robust * (g / (g - 1) * (n - 1) / (n - k))
    return {"beta": beta, "se": np.sqrt(np.maximum(0, np.diag(robust))), "clusters": g, "n": int(n)}


def surface_terms(t: np.ndarray, top_p: np.ndarray, t0: float, p0: float, eps: float = 1e-6) -> np.ndarray:
    """Intercept, centred temperature and top-p logit, their squares and product."""
    lg = lambda q: np.log(np.clip(q, eps, 1 - eps) / (1 - np.clip(q, eps, 1 - eps)))
    a, b = t - t0, lg(top_p) - lg(np.array(p0))
    return np.column_stack([np.ones_like(a), a, b, a * a, b * b, a * b])


TERMS = ("intercept", "temperature", "top_p", "temperature2", "top_p2", "temperature_top_p")


def _surface_design(pdf: pd.DataFrame, t0: float, p0: float, categories: list[str]) -> tuple[list[str], np.ndarray]:
    """Terms and design of a group's coordinates: the quadratic, then a dummy for every level of a category but its first; null is a level."""
    names, columns = list(TERMS), [surface_terms(pdf["t"].to_numpy(float), pdf["top_p"].to_numpy(float), t0, p0)]
    for c in categories:
        values = pdf[c].fillna("(null)").astype(str)
        for level in sorted(values.unique())[1:]:
            names.append(f"{c}[{level}]")
            columns.append((values == level).to_numpy(float)[:, None])
    return names, np.hstack(columns)


def dense_surface(rows: DataFrame, by: list[str], t0: float, p0: float, categories: list[str] | None = None) -> DataFrame:
    """``rows``: (by, cluster, t, top_p, y, categories). (by, term, estimate, se, lower, upper, clusters, n): a response surface with cluster errors.

    The mean surface depends on the coordinates alone, so it is fitted to the sums of each coordinate, of which a plan has few. Clusters enter
    the sandwich only: their scores, sums over coordinates, and the products of scores are plain aggregations, so no group of clusters ever
    meets one task.
    """
    cats = categories or []
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    keys, at = ", ".join(f"{k} {types[k]}" for k in by), [*by, "t", "top_p", *cats]
    small = materialize(rows.filter(F.col("y").isNotNull()).groupBy(*at, "cluster").agg(F.count("*").alias("w"), F.sum("y").alias("s")))
    points = small.groupBy(*at).agg(F.sum("w").alias("w"), F.sum("s").alias("s"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names, x = _surface_design(pdf, t0, p0, cats)
        w, y = pdf["w"].to_numpy(float), (pdf["s"] / pdf["w"]).to_numpy(float)
        got = fractional_logit(x, y, w, np.arange(len(pdf)))
        if got is None:
            return pd.DataFrame(columns=[*at, "x", "p", "terms", "beta"])
        p = 1 / (1 + np.exp(-np.clip(x @ got["beta"], -30, 30)))
        return pdf[at].assign(x=list(x), p=p, terms=[names] * len(pdf), beta=[got["beta"]] * len(pdf))

    fitted = materialize(points.groupBy(*by).applyInPandas(fit, f"{keys}, " + ", ".join(f"{c} {types[c]}" for c in at[len(by) :]) + ", x array<double>, p double, terms array<string>, beta array<double>"))
    k = fitted.agg(F.max(F.size("x"))).first()[0] or 0  # terms of a surface
    same = lambda l, r, cols: reduce(lambda a, b: a & b, [F.col(f"{l}.{c}").eqNullSafe(F.col(f"{r}.{c}")) for c in cols])
    joined = small.alias("a").join(fitted.alias("f"), same("a", "f", at))
    residual = F.col("a.s") - F.col("a.w") * F.col("f.p")
    part = lambda i: F.coalesce(F.get("f.x", F.lit(i)), F.lit(0.0))
    scores = joined.groupBy(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a.cluster").alias("cluster")).agg(*[F.sum(part(i) * residual).alias(f"g{i}") for i in range(k)])
    meat = scores.groupBy(*by).agg(F.count("*").alias("clusters"), *[F.sum(F.col(f"g{i}") * F.col(f"g{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)])
    bread = joined.groupBy(*[F.col(f"a.{c}").alias(c) for c in by]).agg(F.sum("a.w").alias("n"), F.first("f.terms").alias("terms"), F.first("f.beta").alias("beta"), *[F.sum(F.col("a.w") * F.greatest(F.lit(1e-9), F.col("f.p") * (1 - F.col("f.p"))) * part(i) * part(j)).alias(f"b{i}_{j}") for i in range(k) for j in range(i, k)])

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, r in pdf.iterrows():
                m = len(r["terms"])
                square = lambda c, r=r, m=m: np.array([[r[f"{c}{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)], dtype=float)
                inv, n, g, beta = invert(square("b")), float(r["n"]), int(r["clusters"]), np.asarray(r["beta"])
                if inv is None:
                    continue
                robust = inv @ square("m") @ inv
                if g > 1:
                    robust = robust * (g / (g - 1) * (n - 1) / (n - m))
                se = np.sqrt(np.maximum(0, np.diag(robust)))
                yield pd.DataFrame({**{c: [r[c]] * m for c in by}, "term": r["terms"], "estimate": beta, "se": se, "lower": beta - Z95 * se, "upper": beta + Z95 * se, "clusters": g, "n": int(n)})

    both = bread.alias("a").join(meat.alias("f"), same("a", "f", by)).select("a.*", *[F.col(f"f.{c}") for c in meat.columns if c not in by])
    out = both.mapInPandas(errors, f"{keys}, term string, estimate double, se double, lower double, upper double, clusters bigint, n bigint")
    return out.select(*by, "term", *[F.round(c, 6).alias(c) for c in ("estimate", "se", "lower", "upper")], "clusters", "n")


def surface_family(rows: DataFrame, by: list[str], outcomes: list[str], t0: float, p0: float, categories: list[str] | None = None) -> DataFrame:
    """(by, outcome, term, ...): one surface for each of the ``outcomes`` (columns of numbers, null where an outcome is undefined) in one pass."""
    long = rows.withColumn("__o", F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("y")) for o in outcomes])))
    flat = long.select(*by, F.col("__o.outcome").alias("outcome"), "cluster", "t", "top_p", *(categories or []), F.col("__o.y").alias("y"))
    return dense_surface(flat, [*by, "outcome"], t0, p0, categories)


def surface_bootstrap(rows: DataFrame, by: list[str], t0: float, p0: float, replicates: int, seed: int) -> DataFrame:
    """(by, term, replicates, ci_low, ci_high): cluster bootstrap of the surface; a refit per replicate over Poisson cluster weights, failed fits left out.

    Weights are added up per coordinate before the fit, so a replicate is as small as the plan's coordinates.
    """
    small = materialize(rows.filter(F.col("y").isNotNull()).groupBy(*by, "cluster", "t", "top_p").agg(F.count("*").alias("w"), F.sum("y").alias("s")))
    types = dict(rows.dtypes)
    spread = small.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("cluster"))), 1, 15), 16, 10).cast("bigint") / F.lit(float(1 << 60))
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563]
    times = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    weighted = spread.withColumn("k", times).filter("k > 0").groupBy(*by, "b", "t", "top_p").agg(F.sum(F.col("w") * F.col("k")).alias("w"), F.sum(F.col("s") * F.col("k")).alias("s"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf["w"].to_numpy(float)
        got = fractional_logit(surface_terms(pdf["t"].to_numpy(float), pdf["top_p"].to_numpy(float), t0, p0), pdf["s"].to_numpy(float) / w, w, np.arange(len(pdf)))
        if got is None:
            return pd.DataFrame(columns=[*by, "b", "term", "estimate"])
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in by}, "b": pdf["b"].iloc[0], "term": TERMS, "estimate": got["beta"]})

    draws = weighted.groupBy(*by, "b").applyInPandas(fit, ", ".join(f"{k} {types[k]}" for k in by) + ", b int, term string, estimate double")
    return draws.groupBy(*by, "term").agg(F.count("*").alias("replicates"), F.round(F.percentile("estimate", 0.025), 6).alias("ci_low"), F.round(F.percentile("estimate", 0.975), 6).alias("ci_high"))


class RandomEffects:
    """Weighted least squares of effects at a given between-variance, and the REML score that tells where it lies."""

    def __init__(self, estimate: np.ndarray, variance: np.ndarray, design: np.ndarray) -> None:
        self.y, self.v, self.x = estimate, variance, design

    def solve(self, tau2: float) -> tuple[np.ndarray, np.ndarray] | None:
        """(coefficients, their covariance), None where the design is singular."""
        weighted = self.x / (self.v + tau2)[:, None]
        covariance = invert(weighted.T @ self.x)
        return None if covariance is None else (covariance @ (weighted.T @ self.y), covariance)

    def score(self, tau2: float) -> float:
        """Twice the derivative of the restricted log likelihood, y'PPy - tr P with P the projection that takes the fit out."""
        w = 1 / (self.v + tau2)
        beta, covariance = self.solve(tau2)
        left = w * (self.y - self.x @ beta)
        return float(left @ left - (w.sum() - np.einsum("ij,ij->", covariance, (self.x * (w * w)[:, None]).T @ self.x)))

    def between(self) -> float:
        """The root of the score, 0 where it is negative from the start; false position with halved weights (Illinois) in a grown bracket."""
        # Least bracket 1e-8, 60 doublings, relative width 1e-12.
        low, at_low = 0.0, self.score(0.0)
        if at_low <= 0:
            return 0.0
        high = max(1e-8, float((self.y**2 + self.v).max()))
        for _ in range(60):
            if (at_high := self.score(high)) <= 0:
                break
            low, at_low, high = high, at_high, high * 2
        side = 0
        for _ in range(200):
            if high - low <= 1e-12 * max(1.0, high):
                break
            mid = (low * at_high - high * at_low) / (at_high - at_low)
            if not low < mid < high:
                mid = (low + high) / 2
            here = self.score(mid)
            if here > 0:
                low, at_low = mid, here
                at_high = at_high / 2 if side > 0 else at_high
                side = 1
            else:
                high, at_high = mid, here
                at_low = at_low / 2 if side < 0 else at_low
                side = -1
        return (low + high) / 2


def reml(estimate: np.ndarray, variance: np.ndarray, design: np.ndarray) -> dict | None:
    """Random-effects fit by restricted maximum likelihood with Cochran's Q and I2 of the plain mean; None where the design is singular."""
    model = RandomEffects(estimate, variance, design)
    if model.solve(0.0) is None:
        return None
    tau2 = model.between()
    beta, covariance = model.solve(tau2)
    plain = np.average(estimate, weights=1 / variance)
    q = float(((estimate - plain) ** 2 / variance).sum())
    return {"beta": beta, "se": np.sqrt(np.maximum(0, np.diag(covariance))), "tau2": tau2, "q": q, "i2": max(0.0, (q - (len(estimate) - 1)) / q) if q > 0 else 0.0}


def moderated(effects: DataFrame, by: list[str], moderators: list[str], least: int = 10) -> DataFrame:
    """``effects``: (by, effect_id, estimate, variance, moderators). (by, status, stratum, term, effects, estimate, se, tau2, i2).

    One random-effects regression per group on dummies of the moderators (first level as reference), status 'estimated'. A group with fewer
    than ``least`` effects a coefficient is not regressed: each level of each moderator is pooled by itself instead (status 'stratified', or
    'single' for a level of one effect, whose own estimate and error stand there). Groups of one effect, and singular designs, give no row.
    A null moderator is a level of its own. A group is a panel's list of effects: small.
    """
    ok = effects.filter(F.col("estimate").isNotNull() & (F.col("variance") > 0))
    types = {f.name: f.dataType.simpleString() for f in effects.schema}
    cols = [*by, "status", "stratum", "term", "effects", "estimate", "se", "tau2", "i2"]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("effect_id")
        key, y, v = [pdf[k].iloc[0] for k in by], pdf["estimate"].to_numpy(float), pdf["variance"].to_numpy(float)
        levels = {m: pdf[m].fillna("(null)").astype(str) for m in moderators}
        dummies = [(f"{m}[{x}]", (s == x).to_numpy(float)) for m, s in levels.items() for x in sorted(s.unique())[1:]]
        if len(pdf) < 2:
            return pd.DataFrame(columns=cols)
        out = []
        if not moderators or len(pdf) >= least * (1 + len(dummies)):
            got = reml(y, v, np.column_stack([np.ones(len(pdf)), *[d for _, d in dummies]]))
            for i, term in enumerate(["intercept", *[n for n, _ in dummies]] if got else []):
                out.append([*key, "estimated", "all", term, len(pdf), got["beta"][i], got["se"][i], got["tau2"], got["i2"]])
        else:
            for m, s in levels.items():
                for x in sorted(s.unique()):
                    pick = (s == x).to_numpy()
                    got = reml(y[pick], v[pick], np.ones((int(pick.sum()), 1))) if pick.sum() > 1 else {"beta": y[pick], "se": np.sqrt(v[pick]), "tau2": None, "i2": None}
                    out.append([*key, "stratified" if pick.sum() > 1 else "single", f"{m}[{x}]", "intercept", int(pick.sum()), got["beta"][0], got["se"][0], got["tau2"], got["i2"]])
        return pd.DataFrame(out, columns=cols)

    schema = ", ".join(f"{k} {types[k]}" for k in by) + ", status string, stratum string, term string, effects bigint, estimate double, se double, tau2 double, i2 double"
    out = ok.groupBy(*by).applyInPandas(fit, schema)
    return out.select(*by, "status", "stratum", "term", "effects", *[F.round(c, 6).alias(c) for c in ("estimate", "se", "tau2", "i2")])


def pooled(effects: DataFrame, by: list[str]) -> DataFrame:
    """``effects``: (by, effect_id, estimate, variance). One random-effects mean per group of two or more effects of positive variance."""
    ok = effects.filter(F.col("estimate").isNotNull() & (F.col("variance") > 0))
    types = dict(effects.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("effect_id")
        cols = [*by, "effects", "estimate", "se", "lower", "upper", "tau2", "q", "i2"]
        got = reml(pdf["estimate"].to_numpy(float), pdf["variance"].to_numpy(float), np.ones((len(pdf), 1))) if len(pdf) > 1 else None
        if got is None:
            return pd.DataFrame(columns=cols)
        b, s = got["beta"][0], got["se"][0]
        return pd.DataFrame([[*[pdf[k].iloc[0] for k in by], len(pdf), b, s, b - Z95 * s, b + Z95 * s, got["tau2"], got["q"], got["i2"]]], columns=cols)

    schema = ", ".join(f"{k} {types[k]}" for k in by) + ", effects bigint, estimate double, se double, lower double, upper double, tau2 double, q double, i2 double"
    out = ok.groupBy(*by).applyInPandas(fit, schema)
    return out.select(*by, "effects", *[F.round(c, 6).alias(c) for c in ("estimate", "se", "lower", "upper", "tau2", "q", "i2")])
