from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from turnlake.operators import ml
from turnlake.operators import textmodels as M


def _texts(spark, n=48):
    rows = [(str(i), "growth strong orders " * 2 + f"t{i % 5}" if i % 2 else "weak decline costs " * 2 + f"t{i % 7}", i % 2, float(i % 2) + 0.01 * (i % 3), 2020 + i // 16, i // 4 % 4 + 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id string, text string, target int, y double, year int, quarter int")


def test_sparse_classifier(spark):
    out = M.sparse_classifier(_texts(spark), "target", extra=["y"], folds=2, terms=50)
    assert {"accuracy", "precision", "recall", "f1", "roc_auc"} <= out["measures"].keys() and out["measures"]["roc_auc"] > 0.95
    assert out["scores"].count() == 48 and out["terms"].count() > 0
    assert M.sparse_classifier(_texts(spark).limit(5), "target") is None


def test_text_regression(spark):
    found = {r.term: r.coefficient for r in M.text_regression(_texts(spark), "y", terms=12, draws=2).collect()}
    assert found and all(v > 0 for t, v in found.items() if t in ("growth", "strong", "orders"))


def test_out_of_fold_tau(spark):
    rng = np.random.default_rng(2)
    rows = [(f"g{i % 6}", float(x := rng.normal()), float(2 * x + rng.normal() * 0.2), 2000 + i // 20, i // 5 % 4 + 1) for i in range(120)]
    df = spark.createDataFrame(rows, "ticker string, x double, y double, year int, quarter int")
    out, tau = M.out_of_fold_tau(df, ["x"], "y", "ticker", 3)
    assert out.count() == 120 and tau > 0.8
    assert len(M.expanding_refits(df, ["x"], "y", 2, 6)) == 3
    assert {r["path"] for r in M.dual_path(df, {"a": (["x"], "y")}, ["year"])} == {"a"} and M.dual_path(df.limit(3), {"a": (["x"], "y")}, ["year"]) == []
    assert abs(M.standardised_association(df, "x", "y", ["year"], 50)[1]["coef"] - 1) < 0.1
    assert M.series_by_size(df, "y", "x").agg(F.sum("n")).first()[0] == 120


def test_cases_and_rows(spark):
    s = spark.createDataFrame([("a", 0, "x", True), ("a", 1, "y", True), ("b", 0, "z", True), ("c", 0, "w", False)], "doc_id string, original_idx int, text string, kw_is_ai boolean")
    p = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("c", 1.0)], "doc_id string, prediction double")
    out = {(r.case, r.doc_id): r.snippets for r in M.cases(p, s, 1).collect()}
    assert out == {("highest", "a"): "x | y", ("lowest", "b"): "z"}
    assert sorted(r[0] for r in M.head_and_tail(spark.range(10), ["id"], 2).collect()) == [0, 1, 8, 9]
    years = spark.createDataFrame([(2020, "ai and AI models"), (2021, "none")], "year int, text string")
    assert [tuple(r) for r in M.terms_by_year(years, ["ai", "ai models"]).orderBy("term").collect()] == [(2020, "ai", 1), (2020, "ai models", 1)]
    mixed = spark.createDataFrame([("a", [0.3, 0.7], 1)], "doc_id string, mixture array<double>, dominant_topic int")
    assert {r.doc_id: (r.topic_1, r.dominant_1) for r in M.topic_features(mixed, p.select("doc_id"), 2).collect()} == {"a": (0.7, 1), "b": (0.0, 0), "c": (0.0, 0)}


def _fold_texts(spark):
    rows = [(i, i % 3, " ".join(f"w{(i * k) % 11}x" if k % 4 else "only" + "abc"[i % 3] for k in range(1, 9)), i % 2) for i in range(30)] + [(90, 0, "", 1), (91, 1, None, 0)]
    return rows, spark.createDataFrame(rows, "doc_id long, fold int, text string, target int")


def test_vocabularies_of_folds_know_nothing_of_what_is_held_out(spark):
    rows, df = _fold_texts(spark)
    found = {}
    for r in M.fold_weights(df, 3, 1, 2, min_df=2, max_df=0.9, max_terms=12).collect():
        found[r.held, r.doc_id, r.term] = r.weight
    want = {}
    for held in range(3):
        of = {}
        for i, fold, text, _ in rows:
            w = "".join(c if "a" <= c <= "z" else " " for c in (text or "").lower()).split()
            of[i] = (fold, Counter([*w, *map(" ".join, zip(w, w[1:], strict=False))]))
        train = [c for fold, c in of.values() if fold != held]
        df_, n = Counter(t for c in train for t in c), sum(train, Counter())
        kept = sorted((t for t in df_ if df_[t] >= 2 and df_[t] <= len(train) * 0.9), key=lambda t: (-n[t], t))[:12]
        assert not any("only" + "abc"[held] in t for t in kept)  # a word of the held-out fold alone
        for i, (_, c) in of.items():
            w = {t: (1 + np.log(c[t])) * (np.log((1 + len(train)) / (1 + df_[t])) + 1) for t in kept if c[t]}
            norm = np.sqrt(sum(v * v for v in w.values()))
            want |= {(held, i, t): v / norm for t, v in w.items()}
    assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-12 for k, v in want.items())


def test_benchmark_of_four_models(spark):
    rows = [(i, f"g{i % 8}", float(i % 5), "ab"[i % 2], "growth strong orders" if i // 8 % 2 else "weak decline costs", i // 8 % 2) for i in range(64)]
    df = spark.createDataFrame(rows, "doc_id long, ticker string, x double, sector string, text string, target int")
    out = ml.compared(df, "target", "ticker", ["x"], [], folds=2, trees=3, text="text")
    summary = {r.model: r for r in out["summary"].collect()}
    assert set(summary) == {"majority", "logistic_l1", "random_forest", "text_l1"} and out["overlap"] == 0
    assert summary["text_l1"].auc_mean == 1.0 and summary["majority"].auc_mean == 0.5 and summary["text_l1"].folds == 2
    curve = [(r.tpr, r.fpr) for r in out["roc"].filter("model = 'text_l1'").orderBy("threshold").collect()]
    assert curve[0] == (1.0, 1.0) and out["folds"].count() == 8
    one = M.fold_scores(df.select("doc_id", "text", (F.col("doc_id") % 2).cast("int").alias("fold"), F.lit(1).alias("target")), "target", 2)
    assert {r.score for r in one.collect()} == {1.0}
