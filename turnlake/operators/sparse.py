"""L1 and elastic-net regression on a relation (doc_id, term, weight).

Terms stay rows of a table, however many there are.  The driver holds those that
have, or are about to get, a coefficient: it solves the quadratic problem of
these by coordinate descent, and a pass over all weights then tells which other
terms the penalty no longer holds at zero.  When none is left and no coefficient
moves, the solution is that of the whole problem.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.sources.scratch import Steps

#: Terms taken in at once, and most of them with a coefficient: their products
#: are a matrix on the driver.  Most rounds before an error.
TAKEN, ACTIVE, ROUNDS = 200, 3_000, 200


@dataclass
class Fit:
    """Intercept and coefficients that aren't 0, the objective, and the rounds."""

    intercept: float
    coefficients: dict[str, float] = field(default_factory=dict)
    objective: float = 0.0
    rounds: int = 0


def margins(weights: DataFrame, rows: DataFrame, found: Fit) -> DataFrame:
    """``rows`` with ``margin``: intercept and weighted coefficients; a document
    without a chosen term has the intercept."""
    if not found.coefficients:
        return rows.withColumn("margin", F.lit(found.intercept))
    known = rows.sparkSession.createDataFrame(list(found.coefficients.items()), "term string, _b double")
    part = weights.join(known, "term").groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("_b")).alias("_m"))
    return rows.join(part, "doc_id", "left").withColumn("margin", F.coalesce("_m", F.lit(0.0)) + found.intercept).drop("_m")


def _descended(h: np.ndarray, g: np.ndarray, at: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Coordinates that minimise the quadratic form around ``at`` with the
    penalty; the last one, the intercept, isn't penalised."""
    x, slope = at.copy(), g.copy()  # slope of the smooth part without the penalty
    k = len(x) - 1
    diagonal = np.diag(h)
    order = [j for j in range(k + 1) if diagonal[j] > 0]
    for sweep in range(20_000):
        if sweep % 20 == 19 and (exact := _solved(h, g, at, x, l1, l2)) is not None:
            return exact
        most = 0.0
        for j in order:
            if j == k:
                new = x[j] - slope[j] / diagonal[j]
            else:
                z = diagonal[j] * x[j] - slope[j]
                new = np.sign(z) * max(abs(z) - l1, 0.0) / (diagonal[j] + l2)
            if new != x[j]:
                step = new - x[j]
                slope += h[:, j] * step
                x[j] = new
                most = max(most, abs(step) * diagonal[j] ** 0.5)
        if most < 1e-13:
            break
    return x


def _solved(h: np.ndarray, g: np.ndarray, at: np.ndarray, x: np.ndarray, l1: float, l2: float) -> np.ndarray | None:
    """The solution if the coordinates that aren't 0, and their signs, are right
    already: a linear system; None if they aren't."""
    k = len(x) - 1
    some = np.flatnonzero(np.append(x[:-1] != 0, True))
    sign = np.append(np.sign(x[:-1]), 0.0)
    ridge = np.where(some < k, l2, 0.0)
    made = np.zeros(k + 1)
    made[some] = np.linalg.lstsq(h[np.ix_(some, some)] + np.diag(ridge), (h @ at - g - l1 * sign)[some], rcond=None)[0]
    slope = g + h @ (made - at)
    rest = np.setdiff1d(np.arange(k), some)
    fits = (np.sign(made[:-1]) == sign[:-1])[some[:-1]].all() and (np.abs(slope[rest]) <= l1 * (1 + 1e-9) + 1e-15).all()
    return made if fits and np.allclose((slope + l2 * np.append(made[:-1], 0) + l1 * sign)[some], 0, atol=1e-13) else None


def fit(weights: DataFrame, rows: DataFrame, y: str, strength: float, ratio: float = 1.0, logistic: bool = False, weight: str | None = None, start: Fit | None = None, tolerance: float = 1e-9) -> Fit:
    """Minimise the mean loss plus strength * (ratio * |b| + (1 - ratio) / 2 * b^2).

    ``weights``: (doc_id, term, weight); ``rows``: one for each doc_id, with y (0
    or 1 if ``logistic``) and maybe a row weight.  The loss is half the squared
    error, or the logistic loss; the intercept is free.  Weights of documents that
    aren't in ``rows`` take no part; null y and null ids don't either.  ``start``
    is where a neighbouring strength ended.  Without rows all is 0.
    """
    spark, keep = rows.sparkSession, Steps(rows.sparkSession)
    s = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = keep.stored(rows.select("doc_id", F.col(y).cast("double").alias("_y"), s.alias("_s")).dropna(), "rows")
    weights = keep.stored(weights.select("doc_id", "term", "weight").join(rows.select("doc_id"), "doc_id", "left_semi"), "weights")
    total, mean = rows.agg(F.sum("_s"), F.sum(F.col("_s") * F.col("_y")) / F.sum("_s")).first()
    if not total:
        keep.clear()
        return Fit(0.0)
    l1, l2 = strength * ratio, strength * (1 - ratio)
    if start is None:
        start = Fit(float(np.log(mean / (1 - mean))) if logistic and 0 < mean < 1 else 0.0 if logistic else float(mean))
    now, before, penalty = start, None, lambda f: sum(l1 * abs(b) + l2 / 2 * b * b for b in f.coefficients.values())
    active = sorted(now.coefficients)
    for round_ in range(1, ROUNDS + 1):
        steps = Steps(spark)
        eta = F.col("margin")
        p = 1 / (1 + F.exp(-eta))
        loss = F.greatest(eta, F.lit(0.0)) - eta * F.col("_y") + F.log1p(F.exp(-F.abs(eta))) if logistic else F.pow(eta - F.col("_y"), 2) / 2
        slope, bend = (p - F.col("_y"), F.greatest(p * (1 - p), F.lit(1e-6))) if logistic else (eta - F.col("_y"), F.lit(1.0))
        facts = steps.stored(margins(weights, rows, now).select("doc_id", (F.col("_s") * slope / total).alias("g"), (F.col("_s") * bend / total).alias("h"), (F.col("_s") * loss / total).alias("l")), "facts")
        value, g0, h0 = facts.agg(F.sum("l"), F.sum("g"), F.sum("h")).first()
        value += penalty(now)
        if before is not None and value > before[1] + 1e-15 and _gap(now, before[0]) > tolerance:
            # A step too far: half the way back.
            names = {*now.coefficients, *before[0].coefficients}
            half = {t: (now.coefficients.get(t, 0.0) + before[0].coefficients.get(t, 0.0)) / 2 for t in names}
            now = Fit((now.intercept + before[0].intercept) / 2, {t: b for t, b in half.items() if b})
            steps.clear()
            continue
        met = weights.join(facts, "doc_id")
        slopes = steps.stored(met.groupBy("term").agg(F.sum(F.col("weight") * F.col("g")).alias("g"), F.sum(F.col("weight") * F.col("h")).alias("h")), "slopes")
        known = spark.createDataFrame([(t, i) for i, t in enumerate(active)], "term string, i int")
        free = slopes.join(known.select("term"), "term", "left_anti").filter(F.abs("g") > l1 * (1 + 1e-7) + 1e-14)
        taken = [r["term"] for r in free.orderBy(F.desc(F.abs("g")), "term").limit(TAKEN).collect()]
        if len(active) + len(taken) > ACTIVE:
            raise ValueError(f"more than {ACTIVE} terms with a coefficient: a greater strength is needed")
        active = [*active, *taken]
        k = len(active)
        known = spark.createDataFrame([(t, i) for i, t in enumerate(active)], "term string, i int")
        h, g = np.zeros((k + 1, k + 1)), np.zeros(k + 1)
        g[k], h[k, k] = g0, h0
        if k:
            for r in slopes.join(known, "term").collect():  # at most ACTIVE rows
                g[r["i"]], h[r["i"], k] = r["g"], r["h"]
                h[k, r["i"]] = r["h"]
            chosen = steps.stored(weights.join(known, "term").select("doc_id", "i", "weight"), "chosen")
            a, b = chosen.alias("a"), chosen.alias("b")
            pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.i") <= F.col("b.i"))).select(F.col("a.doc_id").alias("doc_id"), F.col("a.i").alias("i"), F.col("b.i").alias("j"), (F.col("a.weight") * F.col("b.weight")).alias("w"))
            for r in pairs.join(facts.select("doc_id", "h"), "doc_id").groupBy("i", "j").agg(F.sum(F.col("w") * F.col("h")).alias("v")).collect():  # at most ACTIVE squared, and only pairs that meet
                h[r["i"], r["j"]] = h[r["j"], r["i"]] = r["v"]
        at = np.array([*(now.coefficients.get(t, 0.0) for t in active), now.intercept])
        made = _descended(h, g, at, l1, l2)
        new = Fit(float(made[k]), {t: float(v) for t, v in zip(active, made, strict=False) if v})
        # How far fitted values move, in root mean squares: equal columns may swap.
        moved = float(np.sqrt(max((made - at) @ h @ (made - at), 0.0)))
        before, now = (now, value), new
        steps.clear()
        # A squared loss is its own quadratic form: solved at once.
        if not taken and (moved < tolerance or (not logistic and round_ > 1)):
            break
        active = sorted(now.coefficients)
    else:
        raise RuntimeError(f"coefficients still move after {ROUNDS} rounds")
    keep.clear()
    return Fit(now.intercept, now.coefficients, before[1], round_)


def _gap(a: Fit, b: Fit) -> float:
    names = {*a.coefficients, *b.coefficients}
    return max([abs(a.intercept - b.intercept), *(abs(a.coefficients.get(t, 0.0) - b.coefficients.get(t, 0.0)) for t in names)])
