"""Absorbed effects against dummies in numpy."""

import numpy as np
from pyspark.sql import functions as F

from turnlake.operators import effects, stats


def _dummies(groups):
    return np.column_stack([(g == v).astype(float) for g in groups for v in sorted(set(g))])


def _made(n=400, firms=60, seed=5, split=False):
    """Firms are in unlike quarters (unbalanced); with ``split`` the first half of
    firms shares no quarter with the others, so the effects form two parts."""
    rng = np.random.default_rng(seed)
    firm = rng.integers(0, firms, n)
    quarter = rng.integers(0, 9, n)
    if split:
        quarter = np.where(firm < firms // 2, quarter % 4, 4 + quarter % 5)
    x = rng.normal(size=(n, 2)) + firm[:, None] * 0.05
    y = x @ [0.7, -0.3] + 0.2 * firm + 0.1 * quarter + rng.normal(size=n) * (0.5 + 0.2 * np.abs(x[:, 0]))
    return x, firm.astype(str), quarter.astype(str), y, rng.poisson(np.exp(0.2 + x @ [0.3, -0.2] + 0.01 * firm))


def _frame(spark, x, firm, quarter, y, c):
    rows = [(float(a), float(b), f, q, float(v), int(k), 1) for (a, b), f, q, v, k in zip(x, firm, quarter, y, c, strict=True)]
    return spark.createDataFrame([*rows, (None, 1.0, "0", "1", 1.0, 1, 1), (1.0, 1.0, None, "1", 1.0, 1, 1)], "a double, b double, firm string, quarter string, y double, c int, _w int")


def _hc1(d, k, y):
    inverse = np.linalg.pinv(d.T @ d)
    beta = inverse @ d.T @ y
    e = y - d @ beta
    cov = inverse @ (d.T * e**2) @ d @ inverse * len(y) / (len(y) - np.linalg.matrix_rank(d))
    return beta[:k], np.sqrt(np.diag(cov))[:k]


def test_two_effects_equal_dummies(spark):
    x, firm, quarter, y, c = _made(split=True)
    df = _frame(spark, x, firm, quarter, y, c)
    d = _dummies([firm, quarter])
    beta, errors = _hc1(np.column_stack([x, d]), 2, y)
    found = effects.absorbed_ols(df, ["a", "b"], "y", ["firm", "quarter"])
    assert np.allclose([r["coef"] for r in found], beta, atol=1e-8) and np.allclose([r["std_err"] for r in found], errors, atol=1e-8)
    assert {r["absorbed"] for r in found} == {np.linalg.matrix_rank(d)} and found[0]["n"] == len(y)
    rows = df.dropna()
    assert effects.parts(rows, "firm", "quarter") == 2


def test_three_effects_and_one(spark):
    x, firm, quarter, y, c = _made(300, 25, 8)
    half = (firm.astype(int) % 3).astype(str)  # within firms
    df = _frame(spark, x, firm, quarter, y, c).withColumn("half", (F.col("firm").cast("int") % 3).cast("string"))
    beta, errors = _hc1(np.column_stack([x, _dummies([firm, quarter, half])]), 2, y)
    found = effects.absorbed_ols(df, ["a", "b"], "y", ["firm", "quarter", "half"], least=1)
    assert np.allclose([r["coef"] for r in found], beta, atol=1e-8) and np.allclose([r["std_err"] for r in found], errors, atol=1e-8)
    beta, errors = _hc1(np.column_stack([x, _dummies([firm])]), 2, y)
    found = effects.absorbed_ols(df, ["a", "b"], "y", ["firm"], least=1)
    assert np.allclose([r["coef"] for r in found], beta, atol=1e-9) and np.allclose([r["std_err"] for r in found], errors, atol=1e-9)


def test_a_regressor_that_effects_hold(spark):
    x, firm, quarter, y, c = _made(300, 20, 3)
    df = _frame(spark, x, firm, quarter, y, c).withColumn("size", F.col("firm").cast("double") * 2)
    a, size = effects.absorbed_ols(df, ["a", "size"], "y", ["firm", "quarter"], least=1)
    assert size["coef"] is None and abs(a["coef"] - effects.absorbed_ols(df, ["a"], "y", ["firm", "quarter"], least=1)[0]["coef"]) < 1e-9
    assert effects.absorbed_ols(df, ["a"], "y", ["firm"], least=10_000) == [] and effects.absorbed_ols(df.limit(0), ["a"], "y", ["firm"]) == []


def test_poisson_equals_dummies(spark):
    x, firm, quarter, y, c = _made(300, 15, 4)
    c = np.where(firm == "7", 0, c)
    df = _frame(spark, x, firm, quarter, y, c)
    kept = firm != "7"
    d = np.column_stack([x[kept], _dummies([firm[kept], quarter[kept]])])
    k, beta = c[kept], np.zeros(d.shape[1])
    for _ in range(60):
        mu = np.exp(d @ beta)
        beta = beta + np.linalg.pinv(d.T @ (d * mu[:, None])) @ d.T @ (k - mu)
    mu = np.exp(d @ beta)
    inverse = np.linalg.pinv(d.T @ (d * mu[:, None]))
    errors = np.sqrt(np.diag(inverse @ (d.T * (k - mu) ** 2) @ d @ inverse * len(k) / (len(k) - np.linalg.matrix_rank(d))))
    found = effects.absorbed_poisson(df, ["a", "b"], "c", ["firm", "quarter"], least=1)
    assert np.allclose([r["coef"] for r in found], beta[:2], atol=1e-7) and np.allclose([r["std_err"] for r in found], errors[:2], atol=1e-6) and found[0]["n"] == kept.sum()
    assert effects.absorbed_poisson(df, ["a"], "c", ["firm"]) == []


def test_many_levels_go_through_fixed_effects(spark):
    """More levels than a dense matrix holds: no error, and no rows on the driver."""
    df = spark.range(12_000).select((F.col("id") % 6_000).alias("firm"), (F.hash("id") % 100 / 50.0).alias("a")).withColumn("y", 2 * F.col("a") + F.col("firm") + F.hash("a", "firm") % 10 / 1e3)
    found = stats.fixed_effects(df, ["a"], "y", ["firm"])
    assert [r["term"] for r in found] == ["a"] and abs(found[0]["coef"] - 2) < 1e-2 and found[0]["absorbed"] == 6_000
