"""Regressions with effects of any number of levels, absorbed by projections.

Rows are summed once to cells of equal effects; each sweep sets the levels of
one effect after another to the weighted mean of what the others leave, until
the levels stand still.  Levels are tables, joined by effect: nothing of their
number reaches the driver, only sums over regressors do.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnlake.sources.scratch import Steps

#: Levels stand still when a sweep moves a column's fitted values by less than
#: this part of the column, in root mean squares; most sweeps before an error.
STILL, SWEEPS = 1e-12, 2_000

#: What is left of a regressor, as a part of its sum of squares, below which the
#: effects hold it.
HELD = 1e-12


class NotSettled(RuntimeError):
    """The sweeps or steps allowed weren't enough."""


def _levels(rows: DataFrame, columns: list[str], effects: list[str], weight: str | None, keep: Steps, start: list[DataFrame] | None, still: float) -> list[DataFrame]:
    """For each effect (level, coefficient of each column as ``_a<effect>_<column>``),
    from where ``start``, levels of a like problem, ended."""
    w = F.col(weight) if weight else F.lit(1.0)
    k = range(len(columns))
    summed = rows.groupBy(*effects).agg(F.sum(w).alias("_w"), *[F.sum(w * F.col(c)).alias(f"_s{i}") for i, c in enumerate(columns)])
    cells = keep.stored(summed, "cells")
    scale = rows.agg(*[F.sum(w * F.col(c) * F.col(c)) for c in columns]).first()

    def solved(j: int, known: dict[int, DataFrame]) -> DataFrame:
        left, others = cells, [h for h in known if h != j]
        for h in others:
            left = left.join(known[h].drop(f"_w{h}"), effects[h])
        rest = lambda i: F.col(f"_s{i}") - F.col("_w") * sum((F.col(f"_a{h}_{i}") for h in others), F.lit(0.0))
        return left.groupBy(effects[j]).agg(F.sum("_w").alias(f"_w{j}"), *[(F.sum(rest(i)) / F.sum("_w")).alias(f"_a{j}_{i}") for i in k])

    # The first effect follows from the others, so it needn't be written.
    now, steps = dict(enumerate(start or [])), Steps(rows.sparkSession)
    for j in range(len(now), len(effects)):
        now[j] = steps.stored(solved(j, now), "levels") if j else solved(j, now)
    for _ in range(SWEEPS if len(effects) > 1 else 0):
        new, next_steps, moved = dict(now), Steps(rows.sparkSession), np.zeros(len(columns))
        for j in range(len(effects)):
            new[j] = next_steps.stored(solved(j, new), "levels") if j else solved(j, {h: t for h, t in new.items() if h})
            if j:
                before = now[j].select(effects[j], *[F.col(f"_a{j}_{i}").alias(f"_b{i}") for i in k])
                change = lambda i: F.col(f"_w{j}") * F.pow(F.col(f"_a{j}_{i}") - F.col(f"_b{i}"), 2)  # noqa: B023, E731
                moved += [v or 0.0 for v in new[j].join(before, effects[j]).agg(*[F.sum(change(i)) for i in k]).first()]
        steps.clear()
        now, steps = new, next_steps
        if all(m <= still**2 * (s or 0.0) for m, s in zip(moved, scale, strict=True)):
            break
    else:
        if len(effects) > 1:
            raise NotSettled(f"effects still move after {SWEEPS} sweeps")
    out = [keep.stored(solved(0, {h: t for h, t in now.items() if h}), "levels"), *[now[j] for j in range(1, len(effects))]]
    keep.paths += steps.paths
    return out


def absorb(rows: DataFrame, columns: list[str], effects: list[str], weight: str | None = None, keep: Steps | None = None) -> DataFrame:
    """``rows`` with each column less what the effects explain of it, weighted.

    Rows are complete in all columns named, or they are an error of the caller;
    extra columns pass.  ``keep`` holds the written steps, for its owner to clear
    once the result is used; without it they stay in the shared folder.
    """
    return _less(rows, columns, effects, _levels(rows, columns, effects, weight, keep or Steps(rows.sparkSession), None, STILL))


def _less(rows: DataFrame, columns: list[str], effects: list[str], found: list[DataFrame]) -> DataFrame:
    out = rows
    for j, (g, t) in enumerate(zip(effects, found, strict=True)):
        out = out.join(t.drop(f"_w{j}"), g)
    less = lambda i: sum((F.col(f"_a{j}_{i}") for j in range(len(effects))), F.lit(0.0))
    return out.select(*[(F.col(c) - less(columns.index(c))).alias(c) if c in columns else F.col(f"`{c}`") for c in rows.columns])


def parts(cells: DataFrame, a: str, b: str) -> int:
    """How many connected parts the levels of two effects form: the smallest
    label travels along cells until none changes."""
    pairs = cells.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    steps = Steps(cells.sparkSession)
    pairs = steps.stored(pairs, "pairs")
    label = steps.stored(pairs.groupBy("a").agg(F.xxhash64("a").alias("l")), "parts")
    while True:
        of_b = pairs.join(label, "a").groupBy("b").agg(F.min("l").alias("l"))
        new = steps.stored(pairs.join(of_b, "b").groupBy("a").agg(F.min("l").alias("l")), "parts")
        if not new.join(label.withColumnRenamed("l", "was"), "a").filter("l <> was").limit(1).count():
            break
        label = new
    found = new.agg(F.count_distinct("l")).first()[0]
    steps.clear()
    return found


def absorbed_rank(rows: DataFrame, effects: list[str]) -> int:
    """Free levels of the effects: of a further effect, its levels less the
    connected parts it forms with an earlier one (exact for two effects)."""
    levels = rows.agg(*[F.count_distinct(g) for g in effects]).first()
    rank = levels[0]
    for j in range(1, len(effects)):
        rank += levels[j] - max(parts(rows, effects[i], effects[j]) for i in range(j))
    return rank


def _products(rows: DataFrame, x: list[str], weight: Column) -> np.ndarray:
    k = len(x)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = rows.agg(*[F.sum(F.col(x[i]) * F.col(x[j]) * weight) for i, j in pairs]).first()
    out = np.zeros((k, k))
    for (i, j), v in zip(pairs, row, strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return out


def _terms(x: list[str], held: list[bool], beta: np.ndarray, cov: np.ndarray, n: int, rank: int) -> list[dict]:
    out = []
    for name, gone, b, v in zip(x, held, beta, np.diag(cov), strict=True):
        s = math.sqrt(max(v, 0.0))
        z = None if gone or not s else float(b / s)
        out.append({"term": name, "coef": None if gone else float(b), "std_err": None if gone else s, "z": z, "p": None if z is None else math.erfc(abs(z) / math.sqrt(2)), "n": n, "absorbed": rank})
    return out


def _inverse(a: np.ndarray, held: list[bool]) -> np.ndarray:
    free = [i for i, gone in enumerate(held) if not gone]
    out = np.zeros_like(a)
    if free:
        out[np.ix_(free, free)] = np.linalg.pinv(a[np.ix_(free, free)], hermitian=True)
    return out


def absorbed_ols(df: DataFrame, x: list[str], y: str, effects: list[str], least: int = 400) -> list[dict]:
    """Coefficients of the regressors with HC1 errors, the effects absorbed.

    Rows that miss a value go; none are returned below ``least`` rows.  A
    regressor that the effects hold has no coefficient.  Degrees of freedom count
    the effects' free levels (``absorbed``).
    """
    spark, keep = df.sparkSession, Steps(df.sparkSession)
    cast = [F.col(c).cast("double").alias(c) for c in (*x, y)]
    rows = keep.stored(df.dropna(subset=[*x, y, *effects]).select(*cast, *effects), "rows")
    n = rows.count()
    if n < least:
        keep.clear()
        return []
    flat = keep.stored(absorb(rows, [*x, y], effects, keep=keep), "absorbed")
    whole = rows.agg(*[F.sum(F.col(c) * F.col(c)) for c in x]).first()
    both = _products(flat, [*x, y], F.lit(1.0))
    held = [both[i, i] <= HELD * (whole[i] or 0.0) for i in range(len(x))]
    inverse = _inverse(both[:-1, :-1], held)
    beta = inverse @ both[:-1, -1]
    e = F.col(y) - sum((F.col(c) * float(b) for c, b in zip(x, beta, strict=True)), F.lit(0.0))
    rank = absorbed_rank(rows, effects)
    free = n - rank - (len(x) - sum(held))
    cov = inverse @ _products(flat, x, e * e) @ inverse * n / max(free, 1)
    keep.clear()
    return _terms(x, held, beta, cov, n, rank)


def absorbed_poisson(df: DataFrame, x: list[str], y: str, effects: list[str], least: int = 500, steps: int = 60, tolerance: float = 1e-10) -> list[dict]:
    """Poisson regression with the effects absorbed in every reweighting step,
    HC1 errors.

    Rows that miss a value go, and so do rows of a level all of whose counts are
    0: its effect is minus infinity and says nothing on the regressors.
    """
    keep = Steps(df.sparkSession)
    cast = [F.col(c).cast("double").alias(c) for c in (*x, y)]
    rows, n = keep.stored(df.dropna(subset=[*x, y, *effects]).select(*cast, *effects), "rows"), -1
    while (m := rows.count()) != n:
        n = m
        for g in effects:
            some = rows.groupBy(g).agg(F.sum(y).alias("_t")).filter("_t > 0").select(g)
            rows = keep.stored(rows.join(some, g, "left_semi"), "rows")
    if n < max(least, 1):
        keep.clear()
        return []
    mean = rows.agg(F.avg(y)).first()[0]
    now = rows.withColumn("_eta", F.ln((F.col(y) + mean) / 2))
    beta, moved, found = np.zeros(len(x)), 1.0, None
    for _ in range(steps):
        mu = F.exp("_eta")
        ready = keep.stored(now.withColumn("_mu", mu).withColumn("_z", F.col("_eta") + (F.col(y) - mu) / mu).withColumn("_work", F.col("_z")).withColumns({f"_x{i}": F.col(c) for i, c in enumerate(x)}), "step")
        names = [f"_x{i}" for i in range(len(x))]
        # Early steps needn't be exact, and each begins where the last one ended.
        still = max(STILL, min(1e-4, moved * 1e-4))
        found = _levels(ready, [*names, "_work"], effects, "_mu", keep, found, still)
        flat = keep.stored(_less(ready, [*names, "_work"], effects, found), "absorbed")
        both = _products(flat, [*names, "_work"], F.col("_mu"))
        whole = flat.agg(*[F.sum(F.col("_mu") * F.col(c) * F.col(c)) for c in x]).first()
        held = [both[i, i] <= HELD * (whole[i] or 0.0) for i in range(len(x))]
        inverse = _inverse(both[:-1, :-1], held)
        new = inverse @ both[:-1, -1]
        left = F.col("_work") - sum((F.col(c) * float(b) for c, b in zip(names, new, strict=True)), F.lit(0.0))
        fitted = flat.withColumn("_eta", F.col("_z") - left)
        drift = fitted.agg(F.max(F.abs(F.exp("_eta") - F.col("_mu")) / (1 + F.col("_mu")))).first()[0]
        moved, beta = np.abs(new - beta).max(), new
        now = fitted.select(*rows.columns, "_eta")
        if moved < tolerance and drift < math.sqrt(tolerance) and still < tolerance:
            break
    else:
        raise NotSettled(f"coefficients still move after {steps} steps")
    e = F.col(y) - F.col("_mu")
    rank = absorbed_rank(rows, effects)
    free = n - rank - (len(x) - sum(held))
    cov = inverse @ _products(flat, names, e * e) @ inverse * n / max(free, 1)
    keep.clear()
    return _terms(x, held, beta, cov, n, rank)
