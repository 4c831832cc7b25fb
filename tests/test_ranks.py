"""Order statistics, rank correlation and folds against plain definitions."""

from collections import Counter
from itertools import combinations
from math import sqrt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.operators import ordered, panel, ranks, stats


def _tau(x, y):
    """The definition, pair by pair."""
    up = down = ta = tb = 0
    for (a, b), (c, d) in combinations(zip(x, y, strict=True), 2):
        s = (a > c) - (a < c), (b > d) - (b < d)
        up, down = up + (s[0] * s[1] > 0), down + (s[0] * s[1] < 0)
        ta, tb = ta + (s[0] != 0), tb + (s[1] != 0)
    return up, down, (up - down) / sqrt(ta) / sqrt(tb) if ta and tb else 0.0


@pytest.mark.parametrize("kind", ["ties", "none", "half", "same", "falling"])
def test_kendall_against_the_definition(spark, kind):
    rng = np.random.default_rng(7)
    n = 260
    x, y = rng.normal(size=n), rng.normal(size=n)
    if kind == "ties":
        x, y = rng.integers(0, 6, n), rng.integers(0, 40, n)
    if kind == "half":  # one value holds half of the rows, in both columns
        x, y = np.where(rng.random(n) < 0.5, 0.0, x), np.where(rng.random(n) < 0.5, 1.0, y + x)
    if kind == "same":
        x = np.ones(n)
    if kind == "falling":
        y = -x
    df = spark.createDataFrame([*zip(map(float, x), map(float, y), strict=True), (None, 1.0), (2.0, None), (float("nan"), 1.0)], "a double, b double")
    want = _tau(x.tolist(), y.tolist())
    for size in (20, ranks.POINTS):
        found = ranks.kendall(df, "a", "b", size)
        assert (found["n"], found["concordant"], found["discordant"]) == (n, *want[:2]) and abs(found["tau"] - want[2]) < 1e-12
    assert abs(stats.kendall_tau(df, "a", "b") - want[2]) < 1e-12


def test_kendall_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert ranks.kendall(df.limit(0), "a", "b")["tau"] == 0.0 and ranks.kendall(df, "a", "b") == {"n": 1, "concordant": 0, "discordant": 0, "tau": 0.0}


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 101):
        x, y, w = rng.integers(0, 9, n).astype(float), rng.integers(0, 9, n).astype(float), rng.integers(1, 4, n)
        want = sum(int(w[i] * w[j]) for i in range(n) for j in range(n) if x[i] < x[j] and y[i] > y[j])
        assert ranks.inversions(x, y, w) == want
    huge = np.array([3_000_000_000, 3_000_000_000])
    assert ranks.inversions(np.array([0.0, 1.0]), np.array([1.0, 0.0]), huge) == 9_000_000_000_000_000_000


@pytest.mark.parametrize("few", [5, ordered.FEW])
def test_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW", few)
    monkeypatch.setattr(ordered, "BINS", 8)
    rng = np.random.default_rng(11)
    rows = []
    for g in ("a", "b", None, "one", "empty"):
        for i in range({"one": 1, "empty": 2}.get(g, 120)):
            v = None if g == "empty" or i % 13 == 5 else float(rng.choice([0.0, rng.normal(), 1e300 * rng.normal(), 5e-324 * rng.integers(0, 4), -1e-9]))
            rows.append((g, i % 2, v, float(i) if i % 3 else 0.0))
    df = spark.createDataFrame(rows, "g string, h int, v double, w double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.95, 0.995, 1.0]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g VARCHAR, h INTEGER, v DOUBLE, w DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    for by in ([], ["g"], ["g", "h"]):
        found = {(*r[: len(by)], r.metric, r.share): r.value for r in ordered.quantiles(df, ["v", "w"], shares, by).collect()}
        want = {}
        for c in ("v", "w"):
            for s in shares:
                keys = ", ".join(by)
                for r in con.execute(f"SELECT {keys + ',' if by else ''} quantile_cont({c}, {s}) FROM t WHERE {c} IS NOT NULL {'GROUP BY ' + keys if by else ''}").fetchall():
                    want[(*r[:-1], c, s)] = r[-1]
        # The engines' roundings of the same product and sum differ by one place at most.
        assert found.keys() == want.keys() and all(v == want[k] or abs(v - want[k]) <= 4e-16 * abs(want[k]) for k, v in found.items())


def test_medians_of_groups_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), (None, 2.0), (None, 5.0)], "g string, v double")
    found = {(r.g, r.v): r.up for r in panel.above_group_median(df, "v", ["g"], "up").collect()}
    assert found == {("a", 1.0): 0, ("a", 3.0): 1, ("a", None): None, (None, 2.0): 0, (None, 5.0): 1}
    assert ordered.quantile_row(df.limit(0), {"m": ("v", 0.5)}).first().m is None
    assert panel.winsorised(df.limit(0), ["v"]).count() == 0


def _greedy(sizes, k):
    load = [0] * k
    for s in sorted(sizes, reverse=True):
        load[min(range(k), key=lambda i: (load[i], i))] += s
    return load


def test_folds_load_as_the_greedy_rule(spark):
    rng = np.random.default_rng(3)
    for sizes in ([50, *[1] * 130], rng.integers(1, 9, 90).tolist(), [7] * 23, [100, 60, 60, 3, 3, 3, 2, 1], [1]):
        for k in (2, 5):
            load = [0] * k
            seen = Counter()
            for size, a, b, stride, fold in stats._dealt(list(Counter(sizes).items()), k):
                for rank in range(a, b + 1, stride):
                    load[fold] += size
                    seen[size, rank] += 1
            assert load == _greedy(sizes, k) and sorted(seen) == sorted((s, r) for s, m in Counter(sizes).items() for r in range(m)) and set(seen.values()) == {1}
    df = spark.createDataFrame([(f"g{i}", j) for i, s in enumerate([50, *[1] * 60, *[4] * 9]) for j in range(s)] + [(None, 0)], "g string, j int")
    out = stats.group_folds(df, "g", 4)
    assert out.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n <> 1").count() == 0
    assert sorted(r["count"] for r in out.groupBy("fold").count().collect()) == sorted(_greedy([50, *[1] * 60, *[4] * 9], 4))


def test_folds_of_many_groups_list_few_lines():
    assert len(stats._dealt([(10**9, 1), (3, 10**7), (1, 10**9)], 5)) < 60
