"""The stages behind the pipeline, end to end on made calls, and their frames."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from turnlake.operators import rankings, textmodels
from turnlake.plans.analysis import Options, analysed
from turnlake.plans.stages import Pipeline


def _calls(spark, firms=10, quarters=3):
    rng = random.Random(3)
    rows, facts = [], []
    for f in range(firms):
        for q in range(quarters):
            topic = "machine learning" if rng.random() < 0.6 else "orders"
            talk = f"Our {topic} products grew strongly this quarter. We see strong growth. " * 12
            turns = [("Operator", "Welcome to the conference call."), ("Jane CEO", talk), ("Tom CFO", talk), ("Operator", "Our first question comes from Bob Lee with UBS. Please go ahead.")]
            turns += [("Bob Lee", f"How do you use {rng.choice(['machine learning', 'cash'])} in the business today?"), ("Jane CEO", f"We use {rng.choice(['machine learning', 'cash'])} in all of our products now."), ("Bob Lee", "What is the outlook for margins?"), ("Tom CFO", "Margins rise with growth and weak costs decline.")]
            rows.append((f"F{f}", 2020 + q // 4, q % 4 + 1, json.dumps([{"speaker": s, "text": t} for s, t in turns])))
        value = 100.0 * (f + 1)
        for q in range(quarters + 1):
            value *= 1 + rng.uniform(-0.2, 0.25)
            facts.append((f"F{f}", 2020 + q // 4, q % 4 + 1, value, value * rng.random() / 10, 10 + rng.random(), rng.random() - 0.3, "AB"[f % 2]))
    return spark.createDataFrame(rows, "ticker string, year int, quarter int, structured_content string"), spark.createDataFrame(facts, "ticker string, year int, quarter int, mkvaltq double, xrdq double, prccq double, epspxq double, sector string")


def test_all_stages(spark, tmp_path):
    calls, facts = _calls(spark)
    options = Options(folds=2, trees=2, lasso_folds=2, terms=30, test_quarters=1, topics=False, text_model="raw", effects=["year_quarter"])
    done = analysed(Pipeline(spark, str(tmp_path)), calls, facts, options)
    wanted = {"funnel", "ratio_summary", "exchange_split", "quarter_trends", "trends_by_size", "quadrants", "quadrant_financials", "quadrant_boxes", "research_dataset", "attrition", "regression", "out_of_fold", "benchmark_summary", "benchmark_roc", "lasso_terms", "lasso_volcano", "company_years", "company_top", "industry_years", "term_counts", "time_split", "cases"}
    assert wanted <= {*done.out} and all(done.out[n].count() > 0 for n in wanted - {"cases", "lasso_terms"}), wanted - {*done.out}
    assert done.notes["dataset"]["ok"] and done.notes["benchmark"] == {"target": "sector_median", "groups_in_two_folds": 0}
    assert {r.model for r in done.out["benchmark_summary"].collect()} == {"majority", "logistic_l1", "random_forest", "text_l1"}
    assert done.out["out_of_fold"].filter("predicted IS NULL").count() == 0 and "# Report" in done.notes["report"]
    kept = done.out["research_dataset"].filter("total_ai_exchanges > 0").count()
    assert [(r.step, r.kept) for r in done.out["attrition"].collect()][0] == ("exchanges on the topic", kept) and 0 < kept < 30
    years = {r.term: r.n for r in done.out["term_counts"].filter("year IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    assert {r.term: r.n for r in done.out["term_counts"].filter("year IS NULL").collect()} == years
    again = Pipeline(spark, str(tmp_path))
    later = analysed(again, calls, facts, Options(start=13, research=False, effects=["year_quarter"]))
    assert again.made == [] and "benchmark_summary" not in later.out and later.out["company_years"].count() == 10


def test_company_years_and_boxes(spark):
    kind = "ticker string, year int, overall_kw_ai_ratio double, speech_kw_ai_ratio double, qa_kw_ai_ratio double, speech_kw_ai_sentences long, qa_kw_ai_sentences long, speech_total_sentences long, qa_total_sentences long"
    rows = [("a", 2020, 0.5, 0.5, 0.0, 2, None, 4, 1), ("a", 2020, 0.1, 0.0, 0.2, 1, 3, 6, 9), ("b", 2021, 0.0, 0.0, 0.0, None, None, 5, 0), (None, 2021, 1.0, 1.0, 1.0, 1, 1, 1, 1), ("b", None, 1.0, 1.0, 1.0, 1, 1, 1, 1)]
    found = {r.ticker: r for r in rankings.company_years(spark.createDataFrame(rows, kind)).collect()}
    assert (found["a"].num_calls, found["a"].overall_kw_ai_sentences, found["a"].overall_total_sentences, found["a"].overall_kw_ai_ratio) == (2, 6, 20, 0.3)
    assert (found["b"].num_calls, found["b"].overall_kw_ai_sentences, found["b"].speech_kw_ai_sentences) == (1, 0, None)
    rng = np.random.default_rng(1)
    values = [("x", float(v)) for v in rng.normal(size=40)] + [("x", 99.0), ("x", None), ("y", 1.0), (None, 2.0)]
    boxes = {r.g: r for r in rankings.boxes(spark.createDataFrame(values, "g string, v double"), "g", ["v"]).collect()}
    x = np.array([v for g, v in values if g == "x" and v is not None])
    q1, med, q3 = np.quantile(x, [0.25, 0.5, 0.75])
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    assert np.allclose([boxes["x"].low, boxes["x"].q1, boxes["x"].median, boxes["x"].q3, boxes["x"].high], [inside.min(), q1, med, q3, inside.max()]) and boxes["x"].n == 41
    assert (boxes["y"].low, boxes["y"].high, boxes[None].median) == (1.0, 1.0, 2.0)


def test_volcano(spark):
    rng = np.random.default_rng(2)
    x, y = np.where(rng.random((30, 3)) < 0.5, rng.random((30, 3)), 0.0), rng.random(30)
    weights = spark.createDataFrame([(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)] + [(i, "all", 1.0) for i in range(30)], "doc_id long, term string, weight double")
    rows = spark.createDataFrame([(i, float(y[i])) for i in range(30)], "doc_id long, y double")
    found = {r.term: r for r in textmodels.volcano(weights, rows, "y", spark.createDataFrame([("t1", 0.5)], "term string, coefficient double")).collect()}
    for j in range(3):
        r = np.corrcoef(x[:, j], y)[0, 1]
        assert abs(found[f"t{j}"].correlation - r) < 1e-9 and abs(found[f"t{j}"].t - r * np.sqrt(28 / (1 - r * r))) < 1e-6
    assert found["all"].correlation is None and found["t1"].coefficient == 0.5 and found["t0"].coefficient == 0.0
