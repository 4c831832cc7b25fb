"""Entity and industry aggregates, ranks, quadrants, extremes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.operators.ordered import quantile_row, quantiles


def quarter_trends(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, sample standard deviation and count by quarter."""
    parts = [e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))]
    return df.groupBy("year", "quarter").agg(*parts, F.count("*").alias("n"))


def entity_year(df: DataFrame, entity: str, means: list[str], sums: list[str]) -> DataFrame:
    return df.groupBy(entity, "year").agg(*[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums], F.count("*").alias("n"))


def company_years(documents: DataFrame) -> DataFrame:
    """(ticker, year, mean ratios, sums of sentences by section, the same of both
    sections together, num_calls) of document metrics with ticker and year.
    Documents without either go; a missing count adds nothing to a total."""
    sections, kinds = ("speech", "qa"), ("kw_ai_sentences", "total_sentences")
    means = ["overall_kw_ai_ratio", *[f"{s}_kw_ai_ratio" for s in sections]]
    out = entity_year(documents.dropna(subset=["ticker", "year"]), "ticker", means, [f"{s}_{k}" for k in kinds for s in sections]).withColumnRenamed("n", "num_calls")
    both = lambda k: sum((F.coalesce(f"{s}_{k}", F.lit(0)) for s in sections), F.lit(0)).cast("long")
    return out.withColumns({f"overall_{k}": both(k) for k in kinds})


def boxes(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """(group, metric, n, low, q1, median, q3, high): what a box plot draws, with
    whiskers at the outermost values within one and a half boxes."""
    q = quantiles(df, metrics, [0.25, 0.5, 0.75], [group])
    of = lambda s: F.max(F.when(F.col("share") == s, F.col("value")))
    box = q.groupBy(group, "metric").agg(of(0.25).alias("q1"), of(0.5).alias("median"), of(0.75).alias("q3"))
    long = df.unpivot([group], [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value").filter("value IS NOT NULL AND NOT isnan(value)")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    met = long.alias("l").join(box.alias("b"), F.col(f"l.{group}").eqNullSafe(F.col(f"b.{group}")) & (F.col("l.metric") == F.col("b.metric")))
    return met.select("b.*", "value").groupBy(group, "metric", "q1", "median", "q3").agg(F.count("*").alias("n"), F.min(F.when(inside, F.col("value"))).alias("low"), F.max(F.when(inside, F.col("value"))).alias("high")).select(group, "metric", "n", "low", "q1", "median", "q3", "high")


def group_year(entities: DataFrame, group: str, entity: str, metric: str) -> DataFrame:
    return entities.groupBy(group, "year").agg(F.avg(metric).alias(metric), F.count_distinct(entity).alias("n_entities"))


def top_k(df: DataFrame, groups: list[str], metrics: list[str], k: int, tie: str) -> DataFrame:
    """(groups, metric, rank, tie, value): the k greatest of each metric within
    each group; equal values in the order of ``tie``."""
    long = df.unpivot([*groups, tie], metrics, "metric", "value").filter("value IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy(*groups, "metric").orderBy(F.desc("value"), tie))
    return long.withColumn("rank", rank).filter(F.col("rank") <= k)


def extremes(df: DataFrame, metric: str, k: int, tie: str) -> DataFrame:
    """The k greatest and the k least rows, once each."""
    high = df.orderBy(F.desc(metric), tie).limit(k)
    low = df.orderBy(F.asc(metric), tie).limit(k)
    return high.unionByName(low).dropDuplicates([tie])


def thresholds(df: DataFrame, cuts: dict[str, str], rule: str = "mean") -> DataFrame:
    """One row with the cut of each column under its name: the mean, the median,
    or the median of what isn't 0 (0.0 where all is)."""
    if rule == "mean":
        return df.agg(*[F.avg(c).alias(name) for name, c in cuts.items()])
    if rule not in ("median", "median_nonzero"):
        raise ValueError(f"no rule {rule}")
    x = {name: F.col(c).cast("double") for name, c in cuts.items()}
    values = df.select(*[(v if rule == "median" else F.when(v != 0, v)).alias(name) for name, v in x.items()])
    found = quantile_row(values, {name: (name, 0.5) for name in cuts})
    return found if rule == "median" else found.fillna(0.0)


QUADRANTS = ["Aligned", "Passive", "Self-Promoting", "Silent"]


#: The same four in the words of the association chart: x is topic, y analysts' share.
ASSOCIATION = ["High-High", "Low AI / High Analyst", "High AI / Low Analyst", "Low-Low"]


def quadrants(df: DataFrame, x: str, y: str, rule: str = "mean", inclusive: bool = False, labels: list[str] | None = None) -> DataFrame:
    """Label by both cuts: high x and y Aligned, low x high y Passive, high x
    low y Self-Promoting, else Silent, or the four ``labels`` in that order.
    ``inclusive``: a value at the cut is high."""
    both, second, first, neither = labels or QUADRANTS
    cuts = F.broadcast(thresholds(df, {"_x": x, "_y": y}, rule))  # one row
    high = (lambda v, c: F.col(v) >= F.col(c)) if inclusive else (lambda v, c: F.col(v) > F.col(c))
    a, b = F.coalesce(high(x, "_x"), F.lit(False)), F.coalesce(high(y, "_y"), F.lit(False))
    label = F.when(a & b, both).when(~a & b, second).when(a, first).otherwise(neither)
    return df.crossJoin(cuts).withColumn("quadrant", label).drop("_x", "_y")


def quadrant_stats(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, sample deviation and count by quadrant; all four are there."""
    every = df.sparkSession.createDataFrame([(q,) for q in QUADRANTS], "quadrant string")
    parts = [e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"), F.count(m).alias(f"{m}_n"))]
    found = df.groupBy("quadrant").agg(*parts)
    return F.broadcast(every).join(found, "quadrant", "left").fillna(0, [f"{m}_n" for m in metrics])


def value_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(value, n, share) in a fixed set of values."""
    every = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    n = every.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])
    return n.withColumn("share", F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy()).cast("double")), F.lit(0.0)))


def around(rows: DataFrame, hits: DataFrame, k: int, key: str = "doc_id", place: str = "original_idx") -> DataFrame:
    """Rows at most k places from a hit of the same document, once each: every
    hit names its neighbours, so the join is on equal places."""
    near = hits.select(key, F.explode(F.sequence(F.col(place) - k, F.col(place) + k)).alias(place)).distinct()
    return rows.join(near, [key, place], "left_semi")
