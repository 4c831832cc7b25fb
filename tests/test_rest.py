"""Operators that no query runs, against plain Python and numpy."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlake.functions import scalars as S
from turnlake.operators import metrics, ml, ordered, panel, sampling, stats, textmodels, tokens, turns
from turnlake.plans.report import markdown_table
from turnlake.sources import tables


def _design(x, groups):
    columns = [np.ones(len(x)), *x.T]
    for g in groups:
        columns += [(g == v).astype(float) for v in sorted(set(g))[1:]]
    return np.column_stack(columns)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    n = 500
    x, g, h = rng.normal(size=(n, 2)), rng.integers(0, 6, n).astype(str), rng.integers(0, 4, n).astype(str)
    y = 1 + x @ [0.5, -0.25] + g.astype(int) * 0.3 + h.astype(int) * 0.1 + rng.normal(size=n) * (0.4 + 0.3 * np.abs(x[:, 0]))
    c = rng.poisson(np.exp(0.3 + x @ [0.4, -0.2] + g.astype(int) * 0.1))
    df = spark.createDataFrame([(float(a), float(b), p, q, float(v), int(k)) for (a, b), p, q, v, k in zip(x, g, h, y, c, strict=True)], "a double, b double, g string, h string, y double, c int")
    return x, g, h, y, c, df.unionByName(df.limit(1).withColumn("y", F.lit(None).cast("double")).withColumn("c", F.lit(None).cast("int")))


def test_fixed_effects_equal_dummies(spark, data):
    x, g, h, y, _, df = data
    d = _design(x, [g, h])
    inverse = np.linalg.pinv(d.T @ d)
    beta = inverse @ d.T @ y
    e = y - d @ beta
    errors = np.sqrt(np.diag(inverse @ (d.T * e**2) @ d @ inverse * len(y) / (len(y) - d.shape[1])))
    found = stats.fixed_effects(df, ["a", "b"], "y", ["g", "h"], dummies=True)
    assert np.allclose([r["coef"] for r in found], beta) and np.allclose([r["std_err"] for r in found], errors) and found[3]["term"] == "g[1]" and found[0]["n"] == 500
    assert [r["term"] for r in stats.fixed_effects(df, ["a"], "y", ["g"])] == ["Intercept", "a"] and stats.fixed_effects(df, ["a"], "y", ["g"], least=501) == []
    with pytest.raises(ValueError, match="levels"):
        stats.fixed_effects(spark.range(5_000).select(F.col("id").cast("double").alias("y"), F.col("id").cast("double").alias("a"), F.col("id").alias("g")), ["a"], "y", ["g"], dummies=True)


def test_demeaning_gives_the_same_slope(spark, data):
    x, g, h, y, _, df = data
    flat = stats.demeaned(df.dropna().drop("c"), ["a", "b", "y"], ["g", "h"]).toPandas()
    slope = np.linalg.lstsq(flat[["a", "b"]].to_numpy(), flat["y"].to_numpy(), rcond=None)[0]
    assert np.allclose(slope, [r["coef"] for r in stats.fixed_effects(df, ["a", "b"], "y", ["g", "h"])][1:])


def test_poisson(spark, data):
    x, g, _, _, c, df = data
    for groups, effects in (([], None), ([g], ["g"])):
        d = _design(x, groups)
        beta = np.zeros(d.shape[1])
        for _ in range(50):
            mu = np.exp(d @ beta)
            beta = beta + np.linalg.solve(d.T @ (d * mu[:, None]), d.T @ (c - mu))
        mu = np.exp(d @ beta)
        inverse = np.linalg.inv(d.T @ (d * mu[:, None]))
        errors = np.sqrt(np.diag(inverse @ (d.T * (c - mu) ** 2) @ d @ inverse * len(c) / (len(c) - d.shape[1])))
        found = stats.poisson(df, ["a", "b"], "c", effects=effects)
        assert np.allclose([r["coef"] for r in found], beta[:3], atol=1e-6) and np.allclose([r["std_err"] for r in found], errors[:3], atol=1e-6)
    assert stats.poisson(df, ["a"], "c", least=501) == []


@pytest.mark.parametrize("rows", [90, 10_000])
def test_running_sums_and_folds(spark, rows):
    rng = np.random.default_rng(4)
    values = [(i, float(v) if i % 17 else None, int(i % 3)) for i, v in enumerate(rng.integers(0, 40, 700))]
    df = spark.createDataFrame(values, "i int, v double, w int")
    out = ordered.running(ordered.laid(df, ["v", "i"], rows), ["v", "i"], {"w": F.col("w"), "n": F.lit(1)}).collect()
    want, total = {}, 0
    for place, (i, _, w) in enumerate(sorted(values, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))):
        want[i] = (total, place)
        total += w
    assert {r.i: (r._w_before, r._n_before) for r in out} == want and {(r._w_all, r._n_all) for r in out} == {(total, 700)}
    folds = stats.hash_folds(df, "i", 5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [140] * 5 and sorted(r.fold for r in folds) == [0, 1, 2, 3, 4]
    parts = stats.hash_folds(df, "i", 2, stratum="w").groupBy("fold", "w").count().collect()
    assert len(parts) == 6 and all(r["count"] in (116, 117) for r in parts)
    empty = df.limit(0)
    assert panel.deciles(empty, "v", ["i"]).count() == 0 and stats.hash_folds(empty, "i").count() == 0
    one = panel.deciles(df.limit(1).withColumn("v", F.lit(2.0)), "v", ["i"]).collect()
    assert [r.decile for r in one] == [0]


def test_labels_and_agreement(spark):
    rows = [("a", "a", "a"), ("a", "b", None), ("b", "b", "b"), ("c", "a", "a"), (None, "a", "b"), ("b", None, "a")]
    df = spark.createDataFrame(rows, "t string, g string, k string")
    labels, pairs = ["a", "b", "c"], [(t, g) for t, g, _ in rows if t and g]
    cells = {(r.t, r.g): (r.n, r.row_share) for r in stats.confusion(df, "t", "g", labels).collect()}
    assert len(cells) == 9 and all(cells[p][0] == pairs.count(p) for p in cells) and cells["a", "b"][1] == 0.5 and cells["c", "c"] == (0, 0.0)
    f1 = [2 * pairs.count((v, v)) / max(1, sum(t == v for t, _ in pairs) + sum(g == v for _, g in pairs)) for v in labels]
    assert abs(stats.macro_f1(df, "t", "g", labels).first()[0] - sum(f1) / 3) < 1e-12
    found = {(r.a, r.b): r for r in stats.agreements(df, [("t", "g"), ("t", "k"), ("g", "k")]).collect()}
    for (a, b), r in found.items():
        both = [(x, y) for x, y in ((dict(zip("tgk", row, strict=True))[a], dict(zip("tgk", row, strict=True))[b]) for row in rows) if x and y]
        same = sum(x == y for x, y in both) / len(both)
        chance = sum(sum(x == v for x, _ in both) * sum(y == v for _, y in both) for v in labels) / len(both) ** 2
        assert r.n == len(both) and abs(r.agreement - same) < 1e-12 and abs(r.kappa - (same - chance) / (1 - chance)) < 1e-12
    assert stats.agreement(spark.createDataFrame([("a", "a")], "t string, g string"), "t", "g").first().kappa is None


def test_document_metrics_of_whatever_is_given(spark):
    whole = spark.createDataFrame([("d", 0.5)], "doc_id string, overall_kw_ai_ratio double")
    assert metrics.any_document_metrics(whole).first().overall_kw_ai_ratio == 0.5
    sections = spark.createDataFrame([("d", "qa", 4, 1, 0.25), ("d", "speech", 6, 4, 2 / 3)], "doc_id string, section string, total_sentences long, kw_ai_sentences long, kw_ai_ratio double")
    assert metrics.any_document_metrics(sections).first().overall_kw_ai_ratio == 0.5
    counts = spark.createDataFrame([("d", 1, 4, 4, 6), ("e", None, None, 0, 0)], "doc_id string, qa_kw_ai_sentences int, qa_total_sentences int, speech_kw_ai_sentences int, speech_total_sentences int")
    assert [r.overall_kw_ai_ratio for r in metrics.any_document_metrics(counts).orderBy("doc_id").collect()] == [0.5, 0.0]
    with pytest.raises(ValueError):
        metrics.any_document_metrics(spark.createDataFrame([("d",)], "doc_id string"))


def test_batch_parsing_keeps_errors(spark):
    good = json.dumps([{"speaker": "Jane CEO", "text": "Hello."}])
    df = spark.createDataFrame([("a", good), ("b", None), (None, good), ("c", good), ("c", good), ("d", "not json"), ("e", " ")], "doc_id string, structured_content string")
    parsed, errors = turns.parse_batch(df)
    assert sorted(r.doc_id for r in parsed.collect()) == ["a", "d"]
    assert sorted(map(tuple, errors.collect()), key=repr) == sorted([("b", "no content"), (None, "no id"), ("c", "repeated id"), ("c", "repeated id"), ("e", "no content")], key=repr)


def test_keyword_measures_and_samples(spark):
    rows = [("d", "speech", i, i < 2, i, float(i), f"alpha beta {i}") for i in range(5)] + [("d", "qa", 10 + i, False, 0, 0.0, "beta") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id string, section string, original_idx int, kw_is_ai boolean, kw_match_count int, kw_ai_score double, text string")
    r = metrics.keyword_metrics(df).first()
    assert (r.speech_sentences, r.speech_ai_sentences, r.speech_ai_ratio, r.speech_matches, r.speech_mean_score) == (5, 2, 0.4, 10, 2.0) and (r.qa_sentences, r.qa_ai_ratio, r.qa_matches) == (2, 0.0, 0)
    terms = spark.createDataFrame([("alpha",), ("beta",), ("none",)], "term string")
    assert {x.term: x.text for x in tokens.example_sentences(df, terms).collect()} == {"alpha": "alpha beta 0", "beta": "alpha beta 0"}
    scored = spark.createDataFrame([(i, float(i)) for i in range(101)], "doc_id int, s double")
    found = sampling.bands(scored, "s", 3, ["doc_id"]).collect()
    assert sorted(r.band for r in found) == ["high"] * 3 + ["low"] * 3 + ["mid"] * 3
    assert all({"low": r.s <= 10, "mid": 45 <= r.s <= 55, "high": r.s >= 90}[r.band] for r in found)
    typed = spark.createDataFrame([("d", i, "ab"[i % 2]) for i in range(9)], "doc_id string, exchange_idx int, initiation_type string")
    assert sorted(r.initiation_type for r in sampling.exchange_audit(typed, 2).collect()) == ["a", "a", "b", "b"]
    assert [r.doc_id for r in tables.first_rows(scored, ["doc_id"], 2).collect()] == [0, 1]


def test_frames_and_scalars(spark, tmp_path):
    df = spark.createDataFrame([(2020 + i // 4, i % 4 + 1, float(i)) for i in range(8)], "year int, quarter int, v double")
    train, test = ml.later_quarters(df, 3)
    assert (train.count(), test.count(), test.agg(F.min("v")).first()[0]) == (5, 3, 5.0)
    z = [r.v for r in stats.zscored(df, ["v"]).collect()]
    assert abs(sum(z)) < 1e-9 and abs(np.std(z, ddof=1) - 1) < 1e-9
    points = spark.createDataFrame([([float(i), 2.0 * i, 0.0],) for i in range(5)], "m array<double>")
    p = np.array([r.pca for r in ml.principal(points, "m").collect()])
    assert np.allclose(np.abs(np.diff(p[:, 0])), math.sqrt(5)) and np.allclose(p[:, 1], p[0, 1])
    x = spark.createDataFrame([("Prepared Remarks", "Yes", float("inf")), ("Q&A", "0.0", 1.0), (" ", "maybe", float("nan"))], "s string, b string, f double")
    out = [tuple(r) for r in x.select(S.section_label("s"), S.binary_label("b"), S.finite("f"), S.quarter_label(F.lit(2024), F.lit(3))).collect()]
    assert out == [("speech", 1, None, "2024Q3"), ("qa", 0, 1.0, "2024Q3"), ("other", None, None, "2024Q3")]
    tables.write_json({"b": 1, "a": [2]}, str(tmp_path / "x" / "m.json"))
    assert json.loads((tmp_path / "x" / "m.json").read_text()) == {"a": [2], "b": 1}
    parsed = spark.createDataFrame([("d", [("A", "analyst", "x" * 200)], [("B", "management", "y")])], "doc_id string, speech_turns array<struct<speaker:string,role:string,text:string>>, qa_turns array<struct<speaker:string,role:string,text:string>>")
    previews = textmodels.turn_previews(parsed)
    t = previews.first().turns
    assert [(x.section, x.turn_idx, len(x.text)) for x in t] == [("speech", 0, 163), ("qa", 0, 1)]
    tables.write_jsonl(previews, str(tmp_path / "turns"))
    assert spark.read.json(str(tmp_path / "turns")).first().turns[1].speaker == "B"
    assert markdown_table(spark.createDataFrame([(1, None, 0.5)], "a int, b string, c double")) == "| a | b | c |\n| --- | --- | --- |\n| 1 |  | 0.5000 |"


def test_topics_by_quarter(spark):
    rng = np.random.default_rng(8)
    rows = [(f"{q}-{i}", 2020, q, " ".join(f"{'abc'[i % 3]}word{rng.integers(0, 6)}x" for _ in range(30))) for q in (1, 2) for i in range(12)] + [("few", 2020, 3, "one text")]
    found = ml.topics_by_quarter(spark.createDataFrame(rows, "doc_id string, year int, quarter int, text string"))
    assert found and {(r.year, r.quarter) for r in found[0].select("year", "quarter").distinct().collect()} == {(2020, 1), (2020, 2)} and found[1].count() == 24
    assert ml.topics_by_quarter(spark.createDataFrame(rows[-1:], "doc_id string, year int, quarter int, text string")) is None
