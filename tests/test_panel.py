import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.operators import ml, panel, stats


def test_features(spark):
    rows = [("t", 2020, i % 4 + 1 if i < 4 else 1, 100.0 * (i + 1), 10.0, 5.0, 1.0) for i in range(4)] + [("t", 2021, 1, 0.0, 1.0, 0.0, None)]
    df = spark.createDataFrame(rows, "ticker string, year int, quarter int, mkvaltq double, xrdq double, prccq double, epspxq double")
    out = {(r.year, r.quarter): r for r in panel.panel_features(df).collect()}
    assert out[2020, 1].rd_intensity == 0.1 and out[2021, 1].rd_intensity is None and out[2021, 1].eps_positive == 0.0
    assert out[2020, 1].y_next_mktcap_growth == 1.0 and out[2020, 2].mktcap_growth_qoq == 1.0 and out[2021, 1].ln_price is None


def test_strict_calendar(spark):
    df = spark.createDataFrame([("t", 2020, 1, 1.0, 1.0, 1.0, 1.0), ("t", 2020, 3, 2.0, 1.0, 1.0, 1.0)], "ticker string, year int, quarter int, mkvaltq double, xrdq double, prccq double, epspxq double")
    first = lambda s: panel.panel_features(df, s).filter("quarter = 1").first().y_next_mktcap_growth
    assert first(False) == 1.0 and first(True) is None


def test_latest_and_keys(spark):
    raw = spark.createDataFrame([("T", "2024Q1", "a", 1.0), ("T", "2024Q1", "b", 2.0), (None, "2024Q1", "a", 3.0), ("T", "bad", "a", 4.0)], "tic string, datacqtr string, datadate string, v double")
    assert [(r.ticker, r.year, r.quarter, r.v) for r in panel.fundamentals_keys(raw).collect()] == [("T", 2024, 1, 2.0)]


def test_asof(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    left = spark.createDataFrame([("a", 1, at(1)), ("a", 2, at(5)), ("b", 3, at(9))], "k string, i int, t timestamp")
    right = spark.createDataFrame([("a", 10, at(5)), ("a", 11, at(5)), ("a", 12, at(7))], "k string, v int, t timestamp")
    out = {r.i: r.v for r in panel.asof_backward(left, right, "k", "t", "t", ["v"], "v").collect()}
    assert out == {1: None, 2: 11, 3: None}  # before the first; exact match and tie; no partner


def test_targets(spark):
    df = spark.createDataFrame([("a", 2020, 1, "s", 1.0), ("b", 2020, 1, "s", 1.0), ("a", 2020, 2, "s", 3.0), ("b", 2020, 2, "s", 2.0)], "ticker string, year int, quarter int, sector string, mkvaltq double")
    out, source = panel.binary_target(df)
    assert source == "sector_median" and {r.ticker: r.target for r in out.collect()} == {"a": 1, "b": 0}
    assert panel.binary_target(spark.createDataFrame([(1.0,), (0.0,)], "eps_positive double"))[1] == "eps_sign"
    with pytest.raises(ValueError):
        panel.binary_target(spark.createDataFrame([(1,)], "x int"))


def _frame(spark, n=300):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + rng.normal(size=n) * (0.5 + np.abs(x[:, 0]))
    return x, y, spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y double")


def test_ols_hc1(spark):
    x, y, df = _frame(spark)
    d = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.inv(d.T @ d)
    beta = inv @ d.T @ y
    e = y - d @ beta
    cov = inv @ (d.T * e**2) @ d @ inv * len(y) / (len(y) - 3)
    for r, b, s in zip(stats.ols_hc1(df, ["a", "b"], "y"), beta, np.sqrt(np.diag(cov)), strict=True):
        assert abs(r["coef"] - b) < 1e-9 and abs(r["std_err"] - s) < 1e-9


def test_kendall(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 8, 120), rng.integers(0, 8, 120)
    sign = lambda v: np.sign(v[:, None] - v[None, :])[np.triu_indices(len(v), 1)]
    sa, sb = sign(a), sign(b)
    wanted = (sa * sb).sum() / math.sqrt((sa != 0).sum() * (sb != 0).sum())
    assert abs(stats.kendall_tau(spark.createDataFrame([(float(i), float(j)) for i, j in zip(a, b, strict=True)], "a double, b double"), "a", "b") - wanted) < 1e-12


def test_tests(spark):
    assert abs(stats._beta_fraction(2, 3, 0.4) - 0.5248) < 1e-9 and abs(stats._beta_fraction(0.5, 0.5, 0.5) - 0.5) < 1e-9
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0)] + [("b", v) for v in (2.0, 4.0, 6.0)], "g string, v double")
    w = stats.welch_t(df, "g", "v", "a", "b")
    assert abs(w["t"] + 2 / math.sqrt(5 / 3)) < 1e-12 and 0.2 < w["p"] < 0.3
    assert abs(stats.anova(df, "g", "v")["f"] - 2.4) < 1e-12


def test_auc_and_kappa(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "y int, s double")
    assert stats.roc_auc(df, "y", "s").first().auc == 0.875
    assert stats.roc_auc(df.filter("y = 1"), "y", "s").first().auc == 0.5 and stats.roc_auc(df.filter("y = 1"), "y", "s", None).first().auc is None
    pairs = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", None)], "a string, b string")
    r = stats.agreement(pairs, "a", "b").first()
    assert r.n == 3 and abs(r.kappa - 0.4) < 1e-12
    assert stats.agreement(spark.createDataFrame([("x", "x")], "a string, b string"), "a", "b").first().kappa is None


def test_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(f"g{i % 7}", i) for i in range(50)], "g string, i int")
    folds = stats.group_folds(df, "g", 3).groupBy("g").agg(F.count_distinct("fold").alias("n")).collect()
    assert all(r.n == 1 for r in folds)


def test_benchmark_sorted(spark):
    rng = np.random.default_rng(1)
    rows = [(f"t{i % 12}", float(x := rng.normal()), "ab"[i % 2], int(x + rng.normal() * 0.3 > 0)) for i in range(120)]
    out = ml.benchmark(spark.createDataFrame(rows, "ticker string, x double, sector string, target int"), "target", "ticker", ["x"], ["sector"], folds=2, trees=5).collect()
    assert [r.auc_mean for r in out] == sorted((r.auc_mean for r in out), reverse=True) and out[-1].model == "majority" and out[0].auc_mean > 0.8


def test_topics(spark):
    docs = spark.createDataFrame([(str(i), "cloud server data " * 3 if i % 2 else "retail store customer " * 3) for i in range(12)], "doc_id string, text string")
    found, mixed = ml.topics(docs)
    assert found.count() >= 2 and mixed.count() == 12 and ml.topics(docs.limit(3)) is None
