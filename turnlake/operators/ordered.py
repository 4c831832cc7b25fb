"""Running sums, ranks and order statistics of whole tables and groups, without
a window in one task or a buffer of all values.

``laid`` deals rows out by ranges of their order; a range is a window of its own,
and the sums of the ranges before it come from one row a range.  ``quantiles``
narrows the interval that holds a rank, histogram by histogram, for all columns
and groups at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.sources.scratch import Steps

#: Rows of a range, about; and bins of a histogram, and values of an interval that
#: are put in order rather than into a further histogram.
ROWS, BINS, FEW = 250_000, 256, 20_000


def laid(df: DataFrame, order: list[str], rows: int = ROWS) -> DataFrame:
    """Add ``_bucket``: rows of one bucket lie together, and buckets ascend with
    ``order``, nulls first.

    The table is written, so that its source is read once and the ranges, which
    are drawn from a sample, are the same for all who read them.  Equal rows of
    the order are in one bucket: it should end in a unique column, or rows of
    equal order should have been counted first.
    """
    steps = Steps(df.sparkSession)
    base = steps.stored(df, "rows")
    k = -(-base.count() // rows)
    if k <= 1:
        return base.withColumn("_bucket", F.lit(0))
    return steps.stored(base.repartitionByRange(k, *order).withColumn("_bucket", F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """For each sum, ``_<name>_before``: its total over all rows before this one,
    and ``_<name>_all``.  ``df`` has ``_bucket``, which ascends with ``order``."""
    values = df.withColumns({f"_{n}": c for n, c in sums.items()})
    per = values.groupBy("_bucket").agg(*[F.sum(f"_{n}").alias(f"_{n}_own") for n in sums])
    below = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # over one row a bucket
    zero = lambda c: F.coalesce(c, F.lit(0))
    steps = per.select("_bucket", *[zero(F.sum(f"_{n}_own").over(below)).alias(f"_{n}_base") for n in sums], *[F.sum(f"_{n}_own").over(Window.partitionBy()).alias(f"_{n}_all") for n in sums])
    within = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = values.withColumns({f"_{n}_before": zero(F.sum(f"_{n}").over(within)) for n in sums}).join(F.broadcast(steps), "_bucket")  # rows / ROWS of them
    return out.withColumns({f"_{n}_before": F.col(f"_{n}_before") + F.col(f"_{n}_base") for n in sums}).drop("_bucket", *[f"_{n}" for n in sums], *[f"_{n}_base" for n in sums])


def _place(low: Column, high: Column, value: Column) -> Column:
    """Bin of a value among BINS of equal width; halves can't overflow, and a
    width of nothing parts the highest value from the others."""
    width = high / 2 - low / 2
    bin_ = F.floor((value / 2 - low / 2) / F.when(width > 0, width) * BINS)
    return F.least(F.coalesce(bin_, F.when(value >= high, BINS).otherwise(0)), F.lit(BINS - 1)).cast("int")


def quantiles(df: DataFrame, columns: list[str], shares: list[float], by: list[str] | None = None) -> DataFrame:
    """(by..., metric, share, value): exact quantiles with linear interpolation.

    One row for each group, column and share; a column without values in a group
    has none.  Nulls and NaN take no part.  The values are written once; a round
    reads them once for all columns, shares and groups, and its result is one row
    for each rank sought.  Groups are joined by key, so their number may be large.
    """
    by, steps = by or [], Steps(df.sparkSession)
    keys = [f"_g{i}" for i in range(len(by))]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in columns])).alias("p")
    values = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], pairs).select(*keys, "p.metric", "p.v").filter("v IS NOT NULL AND NOT isnan(v)")
    values = steps.stored(values, "values")
    sought = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.lit(side).alias("side")) for s in shares for side in (0, 1)])).alias("q")
    extent = values.groupBy(*keys, "metric").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).select("*", sought)
    at = F.floor((F.col("n") - 1) * F.col("q.share"))
    state = extent.select(*keys, "metric", "q.share", "q.side", "n", F.least(at + F.col("q.side"), F.col("n") - 1).alias("k"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    who = [*keys, "metric", "share", "side"]
    few = values.count() <= FEW  # then every interval is short enough as it is
    state = state if few else steps.stored(state, "ranks")
    while not few and (state.filter("low < high").agg(F.max("inside")).first()[0] or 0) > FEW:
        open_ = _within(values, state.filter("low < high"), keys)
        bins = open_.groupBy(*who, _place(F.col("low"), F.col("high"), F.col("v")).alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("l"), F.max("v").alias("h"), F.first("n").alias("n"), F.first("k").alias("k"), F.first("below").alias("below"))
        before = F.col("below") + F.coalesce(F.sum("c").over(Window.partitionBy(*who).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over BINS rows
        hit = bins.withColumn("below", before).filter((F.col("below") <= F.col("k")) & (F.col("k") < F.col("below") + F.col("c")))
        state = steps.stored(hit.select(*who, "n", "k", F.col("l").alias("low"), F.col("h").alias("high"), "below", F.col("c").alias("inside")).unionByName(state.filter("low = high").select(*who, "n", "k", "low", "high", "below", "inside")), "ranks")
    rank = F.row_number().over(Window.partitionBy(*who).orderBy("v")) - 1 + F.col("below")
    in_order = lambda some: _within(values, some, keys).withColumn("_r", rank).filter(F.col("_r") == F.col("k")).select(*who, "n", F.col("v").alias("value"))
    found = in_order(state) if few else in_order(state.filter("low < high")).unionByName(state.filter("low = high").select(*who, "n", F.col("low").alias("value")))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("value")))
    wide = found.groupBy(*keys, "metric", "share").agg(F.max("n").alias("n"), side(0).alias("a"), side(1).alias("b"))
    t = (F.col("n") - 1) * F.col("share")
    part = t - F.floor(t)
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - part) + F.col("b") * part)
    return wide.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], "metric", "share", value.alias("value"))


def _within(values: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Each value with the intervals that hold it; groups that are null are equal."""
    a, b = values.alias("a"), state.alias("b")
    same = F.col("a.metric") == F.col("b.metric")
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same & F.col("a.v").between(F.col("b.low"), F.col("b.high"))).select("b.*", "a.v")


def quantile_row(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """One row with each wanted quantile (column, share) under its name, null
    where the column has no values."""
    columns, shares = sorted({c for c, _ in wanted.values()}), sorted({s for _, s in wanted.values()})
    found = quantiles(df, columns, shares)
    return found.agg(*[F.max(F.when((F.col("metric") == c) & (F.col("share") == float(s)), F.col("value"))).alias(name) for name, (c, s) in wanted.items()])
