"""Command line: run the transcript stages, or one query.

    python -m turnlake run --calls calls.parquet --output out [--fundamentals panel.csv] [--start-stage 3] [--force] [--dev 100]
    python -m turnlake query initiation_scores --data /path/to/tables
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from turnlake.plans.analysis import Options, analysed
from turnlake.plans.catalogue import QUERIES
from turnlake.plans.report import report
from turnlake.plans.stages import Pipeline
from turnlake.sources.tables import first_rows, read_table


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="turnlake")
    what = parser.add_subparsers(dest="what", required=True)
    run = what.add_parser("run", help="parse calls, score them, write every stage")
    run.add_argument("--calls", required=True)
    run.add_argument("--output", required=True)
    run.add_argument("--start-stage", type=int, default=1)
    run.add_argument("--force", action="store_true")
    run.add_argument("--dev", type=int, help="only the first calls by key")
    run.add_argument("--fundamentals", help="quarterly panel; with it stages 4 and 7 to 14 run as well")
    run.add_argument("--seed", type=int, default=42)
    run.add_argument("--ai-method", choices=["kw", "topic"], default="topic", help="topic: quarterly topics too")
    for name in ("lasso", "benchmark", "exploration", "research"):
        run.add_argument(f"--skip-{name}", action="store_true")
    run.add_argument("--lasso-terms", type=int, default=5_000)
    run.add_argument("--lasso-longest", type=int, default=2, help="words of a term at most")
    run.add_argument("--lasso-folds", type=int, default=5)
    run.add_argument("--benchmark-folds", type=int, default=5)
    run.add_argument("--benchmark-trees", type=int, default=300)
    run.add_argument("--benchmark-text-model", choices=["ratios", "raw"], default="ratios")
    run.add_argument("--benchmark-text-section", choices=["qa", "speech", "all"], default="qa")
    run.add_argument("--target", default="y_next_mktcap_growth")
    run.add_argument("--test-quarters", type=int, default=4)
    one = what.add_parser("query", help="show the first rows of a query")
    one.add_argument("name", choices=sorted(QUERIES))
    one.add_argument("--data", required=True)
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if given.what == "query":
        QUERIES[given.name](spark, given.data).show(truncate=False)
        return
    calls = read_table(spark, given.calls)
    if given.dev:
        calls = first_rows(calls, ["ticker", "year", "quarter"], given.dev)
    stages = Pipeline(spark, given.output, force=given.force)
    if given.fundamentals:
        options = Options(
            start=given.start_stage, topics=given.ai_method == "topic", exploration=not given.skip_exploration, benchmark=not given.skip_benchmark, lasso=not given.skip_lasso, research=not given.skip_research,
            folds=given.benchmark_folds, trees=given.benchmark_trees, text=given.benchmark_text_section, text_model=given.benchmark_text_model, terms=given.lasso_terms, longest=given.lasso_longest,
            lasso_folds=given.lasso_folds, target=given.target, test_quarters=given.test_quarters, seed=given.seed,
        )
        done = analysed(stages, calls, read_table(spark, given.fundamentals), options)
        print(done.notes.get("report") or report("Run", {n: done.out[n] for n in ("document_metrics", "initiation_scores")}))
        return
    out = stages.run(calls, given.start_stage)
    stages.manifest()
    print(report("Run", {name: df for name, df in out.items() if name in ("document_metrics", "initiation_scores")}))


if __name__ == "__main__":
    main()
