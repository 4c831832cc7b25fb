"""Stages 4 and 7 to 14 of a run: topics, exploration, trends, quadrants,
regressions, models, rankings and a report, from the relations of stages 1 to 6.

Each relation is a stage of the pipeline: written once for the same inputs.
Figures are delivered as the frames behind them.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions import scalars as S
from turnlake.operators import metrics, ml, panel, rankings, stats, textmodels, tokens
from turnlake.plans.report import interpretation, report
from turnlake.plans.stages import Pipeline, check_dataset, research_dataset
from turnlake.sources.tables import content_digest, write_json

RATIOS = ["overall_kw_ai_ratio", "speech_kw_ai_ratio", "qa_kw_ai_ratio"]
FUNDAMENTALS = ["ticker", "year", "quarter", "mkvaltq", "xrdq", "prccq", "epspxq"]


@dataclass
class Options:
    """What a run does: which stages it skips, and the sizes of its models."""

    start: int = 1
    topics: bool = True
    exploration: bool = True
    benchmark: bool = True
    lasso: bool = True
    research: bool = True
    folds: int = 5
    trees: int = 300
    text: str = "qa"
    text_model: str = "ratios"
    terms: int = 5_000
    longest: int = 2
    lasso_folds: int = 5
    target: str = "y_next_mktcap_growth"
    test_quarters: int = 4
    seed: int = 42
    effects: list[str] = field(default_factory=lambda: ["ticker", "year_quarter"])


class Analysis:
    """Runs the stages over a pipeline and what it returned.

    ``fundamentals`` has FUNDAMENTALS and may have ``sector``; rows that repeat a
    key are an error of the caller.  A stage with too few rows for its model
    leaves its relation out and says so in ``skipped``.
    """

    def __init__(self, pipeline: Pipeline, out: dict[str, DataFrame], fundamentals: DataFrame, options: Options | None = None):
        self.run, self.out, self.options, self.skipped, self.notes = pipeline, dict(out), options or Options(), {}, {}
        self.fundamentals = fundamentals
        pipeline.prints["fundamentals"] = content_digest(fundamentals)

    def _keep(self, name: str, make, reads: list[str], **parameters) -> DataFrame:
        self.out[name] = self.run.stage(name, make, reads, **parameters)
        return self.out[name]

    def all(self) -> dict[str, DataFrame]:
        """Every stage from ``options.start`` on, in order; the relations by name."""
        o = self.options
        self.documents = self.out["document_metrics"].withColumns({"ticker": S.key_ticker("doc_id"), "year": S.key_year("doc_id"), "quarter": S.key_quarter("doc_id")})
        stages = [(4, o.topics, self.topics), (7, o.exploration, self.exploration), (8, True, self.trends), (9, True, self.quadrants), (10, True, self.regression), (11, o.benchmark, self.benchmark), (12, o.lasso, self.lasso), (13, True, self.rankings), (14, o.research, self.research)]
        for number, wanted, stage in stages:
            if number >= o.start and wanted:
                stage()
            elif number == 10:
                self.dataset()  # later stages read it
        write_json({"skipped": self.skipped, "notes": self.notes}, f"{self.run.output}/analysis.json", self.run.spark)
        return self.out

    def topics(self) -> None:
        said = tokens.document_text(self.out["sentences_with_keywords"], "topical")
        docs = said.withColumns({"year": S.key_year("doc_id"), "quarter": S.key_quarter("doc_id")})
        found = ml.topics_by_quarter(docs, self.options.seed)
        if found is None:
            self.skipped["topics"] = "no quarter has enough documents"
            return
        for name, df in zip(("quarter_topics", "document_topics"), found, strict=True):
            self._keep(name, lambda df=df: df, ["sentences_with_keywords"], seed=self.options.seed)

    def exploration(self) -> None:
        o = self.out
        self._keep("funnel", lambda: metrics.funnel(o["parsed_transcripts"], o["sentences"], o["initiation_scores"]), ["parsed_transcripts", "sentences", "initiation_scores"])
        self._keep("ratio_summary", lambda: metrics.ratio_summary(o["document_metrics"], RATIOS), ["document_metrics"])
        self._keep("exchange_split", lambda: metrics.zero_split(o["initiation_scores"], "total_ai_exchanges"), ["initiation_scores"])
        for c in RATIOS:
            self._keep(f"histogram_{c}", lambda c=c: metrics.histogram(o["document_metrics"], c), ["document_metrics"])

    def trends(self) -> None:
        self._keep("quarter_trends", lambda: rankings.quarter_trends(self.documents, RATIOS), ["document_metrics"])

        def by_size() -> DataFrame:
            sized = self.documents.join(self.fundamentals.select("ticker", "year", "quarter", "mkvaltq"), ["ticker", "year", "quarter"]).dropna(subset=["mkvaltq"])
            return textmodels.series_by_size(sized, "overall_kw_ai_ratio", "mkvaltq")

        self._keep("trends_by_size", by_size, ["document_metrics", "fundamentals"])

    def quadrants(self) -> None:
        entity = self.documents.groupBy("ticker").agg(*[F.avg(c).alias(c) for c in RATIOS])
        placed = self._keep("quadrants", lambda: rankings.quadrants(entity, "speech_kw_ai_ratio", "qa_kw_ai_ratio", "median_nonzero"), ["document_metrics"])
        facts = lambda: placed.select("ticker", "quadrant").join(panel.panel_features(self.fundamentals.select(FUNDAMENTALS)), "ticker")
        measured = ["rd_intensity", "log_mktcap", "mktcap_growth_qoq"]
        self._keep("quadrant_financials", lambda: rankings.quadrant_stats(facts(), measured), ["quadrants", "fundamentals"])
        self._keep("quadrant_boxes", lambda: rankings.boxes(facts(), "quadrant", measured), ["quadrants", "fundamentals"])
        self.notes["quadrants_welch"] = {m: stats.welch_t(facts(), "quadrant", m, "Aligned", "Self-Promoting") for m in measured}

    def dataset(self) -> DataFrame:
        if "research_dataset" not in self.out:
            made = lambda: research_dataset(self.out, self.fundamentals.select(FUNDAMENTALS)).withColumn("year_quarter", S.quarter_label("year", "quarter"))
            self._keep("research_dataset", made, ["parsed_transcripts", "document_metrics", "initiation_scores", "sentences_with_keywords", "fundamentals"])
        return self.out["research_dataset"]

    def _frame(self, name: str, rows: list[dict], schema: str, reads: list[str], **parameters) -> None:
        if rows:
            names = [x.split()[0] for x in schema.split(", ")]
            self._keep(name, lambda: self.run.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema), reads, **parameters)
        else:
            self.skipped[name] = "too few rows"

    def regression(self) -> None:
        """Initiation against size and research, calls without an exchange on the
        topic left out; out-of-fold agreement, and who dropped out where."""
        data = self.dataset()
        x, y = ["log_mktcap", "rd_intensity", "eps_positive"], "ai_initiation_score"
        active = data.filter("total_ai_exchanges > 0")
        self._keep("attrition", lambda: stats.attrition(data, {"exchanges on the topic": F.col("total_ai_exchanges") > 0, "market value": F.col("log_mktcap").isNotNull(), "research": F.col("rd_intensity").isNotNull()}), ["research_dataset"])
        paths = {"initiation": (x, y), "intensity": (x, "overall_kw_ai_ratio")}
        rows = textmodels.dual_path(active, paths, self.options.effects)
        terms = "path string, effects boolean, term string, coef double, std_err double, z double, p double, n long"
        self._frame("regression", rows, terms, ["research_dataset"], effects=self.options.effects)
        predicted, tau = textmodels.out_of_fold_tau(active, x, y, "ticker", self.options.folds)
        self._keep("out_of_fold", lambda: predicted.select("doc_id", "ticker", "fold", y, "predicted"), ["research_dataset"], folds=self.options.folds)
        self.notes["out_of_fold_tau"] = tau
        self.notes["regression"] = interpretation(rows) if rows else ""

    def _target(self) -> tuple[DataFrame, str]:
        keys = ["ticker", "year", "quarter"]
        extra = self.fundamentals.select(*keys, *[c for c in ("sector",) if c in self.fundamentals.columns])
        return panel.binary_target(self.dataset().join(extra, keys, "left"))

    def benchmark(self) -> None:
        o = self.options
        labelled, source = self._target()
        rows = labelled.dropna(subset=["target"])
        if rows.count() < 2 * o.folds or rows.select("target").distinct().count() < 2:
            self.skipped["benchmark"] = "too few rows or one class"
            return
        numeric, text = ["log_mktcap", "rd_intensity", *RATIOS], None
        if o.text_model == "raw":
            said = tokens.document_text(self.out["sentences_with_keywords"], "all", None if o.text == "all" else o.text)
            rows, text = rows.join(said.withColumnRenamed("text", "said"), "doc_id", "left"), "said"
        found = ml.compared(rows, "target", "ticker", numeric, [c for c in ("sector",) if c in rows.columns], o.folds, o.trees, text)
        for part in ("summary", "folds", "roc"):
            self._keep(f"benchmark_{part}", lambda part=part: found[part], ["research_dataset"], folds=o.folds, trees=o.trees, text=[o.text_model, o.text])
        self.notes["benchmark"] = {"target": source, "groups_in_two_folds": found["overlap"]}

    def lasso(self) -> None:
        o = self.options
        said = tokens.document_text(self.out["sentences_with_keywords"], "topical").join(tokens.tone(self.out["sentences_with_keywords"]), "doc_id", "left")
        labelled, _ = self._target()
        rows = said.join(labelled.select("doc_id", "target"), "doc_id")
        extra = ["positive_tone_ratio", "negative_tone_ratio"]
        found = textmodels.sparse_classifier(rows, "target", extra, folds=o.lasso_folds, terms=o.terms, longest=o.longest)
        if found is None:
            self.skipped["lasso"] = "too few texts or one class"
            return
        self._keep("lasso_terms", lambda: found["terms"], ["research_dataset"], terms=o.terms, folds=o.lasso_folds)
        self._keep("lasso_volcano", lambda: textmodels.volcano(textmodels.text_weights(rows, o.terms, extra, high=o.longest), rows, "target", self.out["lasso_terms"]), ["lasso_terms"])
        self._keep("lasso_scores", lambda: found["scores"], ["research_dataset"], folds=o.lasso_folds)
        self.notes["lasso"] = found["measures"]

    def rankings(self) -> None:
        years = self._keep("company_years", lambda: rankings.company_years(self.documents), ["document_metrics"])
        self._keep("company_top", lambda: rankings.top_k(years, ["year"], RATIOS, 10, "ticker"), ["company_years"])
        if "sector" in self.fundamentals.columns:
            sector = self.fundamentals.groupBy("ticker").agg(F.max_by("sector", F.struct("year", "quarter")).alias("sector"))
            self._keep("industry_years", lambda: rankings.group_year(years.join(sector, "ticker"), "sector", "ticker", "overall_kw_ai_ratio"), ["company_years", "fundamentals"])
        words = [w for own in self.run.lexicon.categories.values() for w in own]
        said = self.out["sentences_with_keywords"].withColumn("year", S.key_year("doc_id"))
        self._keep("term_counts", lambda: textmodels.terms_by_year(said, words, overall=True), ["sentences_with_keywords"])

    def research(self) -> None:
        o, data = self.options, self.dataset()
        x, y = ["overall_kw_ai_ratio", "rd_intensity", "log_mktcap"], o.target
        terms = "term string, coef double, std_err double, z double, p double, n long"
        self._frame("fixed_effects", stats.fixed_effects(data, x, y, o.effects, least=40), terms, ["research_dataset"], target=y, effects=o.effects)
        self._frame("association", textmodels.standardised_association(data, "overall_kw_ai_ratio", "ai_initiation_score", ["year_quarter"], least=40), terms, ["research_dataset"])
        self._frame("refits", textmodels.expanding_refits(data, x, y, first=8, every=6), "cutoff int, mae double, mse double, rmse double, r2 double", ["research_dataset"], target=y)
        train, test = ml.later_quarters(data.dropna(subset=[*x, y]), o.test_quarters)
        if train.count() > len(x) + 1 and not test.isEmpty():
            beta = [r["coef"] for r in stats.ols_hc1(train, x, y)]
            made = sum((F.col(c) * b for c, b in zip(x, beta[1:], strict=True)), F.lit(beta[0]))
            predicted = self._keep("time_split", lambda: test.withColumn("prediction", made).select("doc_id", y, "prediction"), ["research_dataset"], target=y, quarters=o.test_quarters)
            self.notes["time_split"] = stats.regression_metrics(predicted, y, "prediction").first().asDict()
            self._keep("cases", lambda: textmodels.cases(predicted, self.out["sentences_with_keywords"]), ["time_split", "sentences_with_keywords"])
        else:
            self.skipped["time_split"] = "too few quarters"
        self.notes["dataset"] = check_dataset(data)
        shown = {n: self.out[n] for n in ("funnel", "ratio_summary", "regression", "benchmark_summary", "fixed_effects", "association", "refits", "cases") if n in self.out}
        text = report("Report", {**shown, "Left out": "\n".join(f"- {k}: {v}" for k, v in self.skipped.items()) or "nothing"})
        self.notes["report"] = text


def analysed(pipeline: Pipeline, calls: DataFrame, fundamentals: DataFrame, options: Options | None = None) -> Analysis:
    """All stages of a run; stages before ``options.start`` must be there."""
    options = options or Options()
    done = Analysis(pipeline, pipeline.run(calls, min(options.start, 7)), fundamentals, replace(options))
    done.all()
    pipeline.manifest()
    return done
