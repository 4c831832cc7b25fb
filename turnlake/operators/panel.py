"""Quarterly panels: keys, ratios, lags and leads, as-of joins, trimming.

Windows are by entity; ratios are missing where they can't be formed.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions.scalars import open_ratio, positive_flag
from turnlake.operators.ordered import laid, quantile_row, quantiles, running


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, which should end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def earliest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def fundamentals_keys(raw: DataFrame, quarter_col: str = "datacqtr") -> DataFrame:
    """tic and a label such as 2024Q1 to (ticker, year, quarter); rows without a
    full key go, and of a repeated key the latest datadate stays."""
    label = F.col(quarter_col).cast("string")
    keyed = raw.withColumnRenamed("tic", "ticker").withColumn("year", F.substring(label, 1, 4).try_cast("int")).withColumn("quarter", F.right(label, F.lit(1)).try_cast("int"))
    return latest(keyed.dropna(subset=["ticker", "year", "quarter"]), ["ticker", "year", "quarter"], ["datadate"])


def change(x: str, k: int, w) -> F.Column:
    """x / x k rows before, less one; missing on a zero base."""
    return open_ratio(F.col(x), F.lag(x, k).over(w)) - 1.0


def panel_features(panel: DataFrame, strict_calendar: bool = False) -> DataFrame:
    """Ratios, changes and next-quarter targets of (ticker, year, quarter,
    mkvaltq, xrdq, prccq, epspxq).  Lags and leads go by row; with
    ``strict_calendar`` a missing quarter makes them missing."""
    w = Window.partitionBy("ticker").orderBy("year", "quarter")
    t = F.col("year") * 4 + F.col("quarter")
    out = panel.withColumn("rd_intensity", open_ratio("xrdq", "mkvaltq")).withColumn("log_mktcap", F.ln(F.nullif(F.col("mkvaltq"), F.lit(0.0)))).withColumn("ln_price", F.ln(F.nullif(F.col("prccq"), F.lit(0.0)))).withColumn("eps_positive", positive_flag("epspxq").cast("double"))
    kept = lambda x, k: F.when(F.lag(t, k).over(w) == t - k, x) if strict_calendar else x
    ahead = lambda x: F.when(F.lead(t).over(w) == t + 1, x) if strict_calendar else x
    out = out.withColumn("eps_growth_yoy", kept(change("epspxq", 4, w), 4)).withColumn("price_growth_yoy", kept(change("prccq", 4, w), 4)).withColumn("mktcap_growth_qoq", kept(change("mkvaltq", 1, w), 1)).withColumn("rd_intensity_change_qoq", kept(F.col("rd_intensity") - F.lag("rd_intensity").over(w), 1))
    return (
        out.withColumn("y_next_rd_intensity_change", ahead(F.lead("rd_intensity").over(w)) - F.col("rd_intensity"))
        .withColumn("y_next_mktcap_growth", open_ratio(ahead(F.lead("mkvaltq").over(w)), "mkvaltq") - 1.0)
        .withColumn("y_next_eps_growth_yoy", ahead(F.lead("eps_growth_yoy").over(w)))
    )


def asof_backward(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, value: list[str], tie: str) -> DataFrame:
    """Left rows with the latest right row at or before them; of equal right
    times the greatest ``tie`` wins.  One shuffle on ``by``: both sides in one
    ordered window, left rows after right rows of the same time."""
    right_row = F.struct(F.col(right_time).alias("matched_time"), *value)
    names = left.columns
    a = left.select(by, F.col(left_time).alias("_t"), F.lit(1).alias("_left"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.struct(*names).alias("_row"), F.lit(None).cast(right.select(right_row.alias("r")).schema["r"].dataType).alias("_r"))
    b = right.select(by, F.col(right_time).alias("_t"), F.lit(0).alias("_left"), F.col(tie).alias("_tie"), F.lit(None).cast(left.select(F.struct(*names).alias("r")).schema["r"].dataType).alias("_row"), right_row.alias("_r"))
    w = Window.partitionBy(by).orderBy("_t", "_left", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_left = 1").select("_row.*", "_r.*")


def above_group_median(df: DataFrame, value: str, groups: list[str], name: str) -> DataFrame:
    """1 above the median of the group, 0 at or below it, missing where missing."""
    med = quantiles(df, [value], [0.5], groups).select(*[F.col(g).alias(f"_m{i}") for i, g in enumerate(groups)], F.col("value").alias("_med"))
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_m{i}")) for i, g in enumerate(groups)])
    out = df.join(med, same, "left")
    return out.select(*df.columns, F.when(F.col(value).isNotNull(), (F.col(value) > F.col("_med")).cast("int")).alias(name))


def binary_target(panel: DataFrame, target: str = "target", groups: tuple[str, ...] = ("year", "quarter", "sector")) -> tuple[DataFrame, str]:
    """(panel with a 0/1 target, its source): a given 0/1 column, else next growth
    above the sector median, else the sign of earnings."""
    if target in panel.columns:
        return panel.filter(F.col(target).isin(0, 1)), "given"
    if {"mkvaltq", *groups} <= {*panel.columns}:
        w = Window.partitionBy("ticker").orderBy("year", "quarter")
        grown = panel.withColumn("next_growth", open_ratio(F.lead("mkvaltq").over(w), "mkvaltq") - 1.0)
        labelled = above_group_median(grown, "next_growth", list(groups), target).filter(F.col(target).isNotNull())
        if labelled.select(target).distinct().count() == 2:
            return labelled, "sector_median"
    if "eps_positive" in panel.columns:
        return panel.withColumn(target, F.col("eps_positive").cast("int")).filter(F.col(target).isNotNull()), "eps_sign"
    raise ValueError("no target can be formed")


def winsorised(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip to the quantiles of the whole column, found for all columns together."""
    sides = {"l": low, "h": high}
    bounds = F.broadcast(quantile_row(df, {f"_{s}_{c}": (c, q) for c in columns for s, q in sides.items()}))  # one row
    out = df.crossJoin(bounds)
    for c in columns:
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.greatest(F.col(f"_l_{c}"), F.least(F.col(f"_h_{c}"), F.col(c)))))
    return out.drop(*[f"_{s}_{c}" for c in columns for s in sides])


def deciles(df: DataFrame, value: str, order: list[str], bins: int = 10) -> DataFrame:
    """Quantile bins of the first-come rank, 0 to bins - 1."""
    ranked = running(laid(df.filter(F.col(value).isNotNull()), [value, *order]), [value, *order], {"r": F.lit(1)})
    return ranked.withColumn("decile", F.greatest(F.ceil(F.col("_r_before") * bins / F.greatest(F.col("_r_all") - 1, F.lit(1))) - 1, F.lit(0)).cast("int")).drop("_r_before", "_r_all")


def covering(df: DataFrame, key: str, value: F.Column, wanted: list) -> DataFrame:
    """Keys that have every wanted value (relational division)."""
    return df.filter(value.isin(wanted)).groupBy(key).agg(F.count_distinct(value).alias("_n")).filter(F.col("_n") == len(wanted)).select(key)


def unpivoted(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "metric", "value")


def one_hot(df: DataFrame, key: str, column: str, values: list) -> DataFrame:
    """0/1 columns of known values: no pass to find them."""
    return df.select(key, *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in values])


def data_dictionary(df: DataFrame) -> DataFrame:
    """(column, dtype, non_missing_share) of every column in one pass."""
    shares = df.agg(*[F.avg(F.col(f"`{c}`").isNotNull().cast("int")).alias(c) for c in df.columns])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("dtype"), F.col(f"`{c}`").alias("non_missing_share")) for c, t in df.dtypes]))
    return shares.select(rows)
