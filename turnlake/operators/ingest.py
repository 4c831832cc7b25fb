"""Joining calls to fundamentals: cleaning, coverage, as-of match, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions.scalars import first_filled, normal_key, number, sector_code
from turnlake.operators.panel import asof_backward, covering

#: Calls that take part: from the first day to before the last, and the years
#: that an entity must have calls in.
FIRST_DAY, LAST_DAY, YEARS = "2020-05-01", "2025-06-01", [2020, 2021, 2022, 2023, 2024, 2025]

REQUIRED = ["ticker", "year", "quarter", "date", "structured_content", "sector"]


def require(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> None:
    """Columns are there, have no nulls, and the keys are unique; one pass."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    nulls = {c: n for c, n in df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first().asDict().items() if n}
    if nulls:
        raise ValueError(f"null values: {nulls}")
    if keys and not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"repeated keys: {keys}")


def mapped(df: DataFrame, column: str, values: dict[str, str], name: str) -> DataFrame:
    """Add ``name`` by a fixed dictionary; a value it lacks is an error."""
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    out = df.withColumn(name, known[F.col(column)])
    unknown = [r[0] for r in out.filter(F.col(name).isNull() & F.col(column).isNotNull()).select(column).distinct().limit(10).collect()]
    if unknown:
        raise ValueError(f"no {name} for {unknown}")
    return out


def clean_calls(calls: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Calls of the window, keys normalised, of entities with a call in every
    year; rows without a date, year or quarter are an error."""
    typed = calls.withColumn("date", F.try_to_timestamp("date")).withColumn("year", number("year").cast("int")).withColumn("quarter", number("quarter").cast("int")).withColumn("ticker", normal_key("symbol"))
    kept = typed.dropna(subset=["date"]).filter((F.col("date") >= F.lit(FIRST_DAY).cast("timestamp")) & (F.col("date") < F.lit(LAST_DAY).cast("timestamp")))
    require(kept, ["ticker", "year", "quarter"])
    whole = covering(kept, "ticker", F.year("date"), years or YEARS)
    return kept.join(whole, "ticker", "left_semi")


def with_fundamentals(calls: DataFrame, fundamentals: DataFrame, sectors: dict[str, str]) -> DataFrame:
    """Calls with the latest fundamentals at or before each; every call must find
    some, none later than itself."""
    facts = fundamentals.withColumn("ticker", normal_key("tic")).withColumn("datadate", F.try_to_timestamp("datadate")).dropna(subset=["ticker", "datadate"]).withColumn("sequence", F.monotonically_increasing_id())
    have = calls.join(facts.select("ticker").distinct(), "ticker", "left_semi")
    joined = asof_backward(have, facts.select("ticker", "datadate", "conm", F.col("gsector").cast("string").alias("gsector"), "gsubind", "sequence"), "ticker", "date", "datadate", ["conm", "gsector", "gsubind"], "sequence")
    facts_ = joined.agg(F.count_if(F.col("matched_time").isNull()).alias("unmatched"), F.count_if(F.col("matched_time") > F.col("date")).alias("later")).first()
    if facts_["unmatched"] or facts_["later"]:
        raise ValueError(f"{facts_['unmatched']} calls without earlier fundamentals, {facts_['later']} matched to later ones")
    named = mapped(joined, "gsector", sectors, "sector").withColumn("Company_name", first_filled("company", "conm", "ticker")).withColumn("industry_code", sector_code("gsubind")).withColumnRenamed("matched_time", "wrds_datadate")
    require(named, REQUIRED)
    return named
