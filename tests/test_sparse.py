"""The sparse solver against plain coordinate descent on a dense matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.operators import sparse


def _made(n=90, k=60, seed=4):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, k)) < 0.15, rng.random((n, k)) + 0.1, 0.0)
    beta = np.zeros(k)
    beta[:5] = [2.0, -1.5, 1.0, 0.8, -0.7]
    f = 0.3 + x @ beta
    return x, f + 0.1 * rng.normal(size=n), (rng.random(n) < 1 / (1 + np.exp(-2 * f))).astype(float), rng.random(n) + 0.5


def _dense(x, y, s, strength, ratio, logistic):
    """Cyclic descent on the whole matrix, a Newton step with a bound a coordinate."""
    n, k = x.shape
    s = s / s.sum()
    b, c = np.zeros(k), 0.0
    l1, l2 = strength * ratio, strength * (1 - ratio)
    curve = 0.25 if logistic else 1.0
    f = np.zeros(n)
    for _ in range(60_000):
        most = 0.0
        slope = lambda: s * ((1 / (1 + np.exp(-f)) if logistic else f) - y)  # noqa: B023, E731
        step = slope().sum() / (curve * s.sum())
        c, f = c - step, f - step
        most = abs(step)
        for j in range(k):
            d = curve * (s * x[:, j] ** 2).sum()
            if d:
                z = d * b[j] - x[:, j] @ slope()
                new = np.sign(z) * max(abs(z) - l1, 0) / (d + l2)
                f += x[:, j] * (new - b[j])
                most, b[j] = max(most, abs(new - b[j])), new
        if most < 1e-11:
            break
    return c, b


def _frames(spark, x, y, s):
    cells = [(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    more = [(10_000, "t0", 5.0), (10_001, "t1", 5.0)]  # not in rows, and without y
    return spark.createDataFrame([*cells, *more], "doc_id long, term string, weight double"), spark.createDataFrame([*((i, float(y[i]), float(s[i])) for i in range(len(y))), (10_001, None, 1.0)], "doc_id long, y double, s double")


@pytest.mark.parametrize("logistic, ratio, strength", [(False, 0.5, 0.01), (False, 1.0, 0.02), (True, 1.0, 0.01)])
def test_equals_coordinate_descent(spark, monkeypatch, logistic, ratio, strength):
    monkeypatch.setattr(sparse, "TAKEN", 7)
    x, y, c, s = _made()
    y = c if logistic else y
    weights, rows = _frames(spark, x, y, s)
    found = sparse.fit(weights, rows, "y", strength, ratio, logistic, "s")
    intercept, beta = _dense(x, y, s, strength, ratio, logistic)
    assert abs(found.intercept - intercept) < 1e-6 and all(abs(found.coefficients.get(f"t{j}", 0.0) - b) < 1e-6 for j, b in enumerate(beta))
    assert 0 < len(found.coefficients) < 60
    again = sparse.fit(weights, rows, "y", strength, ratio, logistic, "s", start=found)
    assert again.rounds <= 2 and sparse._gap(found, again) < 1e-8
    scores = {r.doc_id: r.margin for r in sparse.margins(weights, rows.filter("y IS NOT NULL"), found).collect()}
    assert np.allclose([scores[i] for i in range(len(y))], intercept + x @ beta, atol=1e-5)


def test_nothing_to_fit(spark):
    x, y, c, s = _made(20, 5)
    weights, rows = _frames(spark, x, y, s)
    strong = sparse.fit(weights, rows, "y", 1e3)
    assert strong.coefficients == {} and abs(strong.intercept - y.mean()) < 1e-9
    assert sparse.fit(weights, rows.limit(0), "y", 0.1).coefficients == {} and sparse.fit(weights.limit(0), rows, "y", 0.1).coefficients == {}
    one = sparse.fit(weights, rows.withColumn("y", F.lit(0.5)), "y", 0.01)
    assert one.coefficients == {} and abs(one.intercept - 0.5) < 1e-9
