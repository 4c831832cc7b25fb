"""Rank correlation of large tables, by counting inversions in parts.

Both columns are cut into ranges of about as many points.  Pairs of points in
unlike ranges of both columns are counted on the grid of ranges, which is the
same problem again, only smaller; pairs in one range of a column are counted
where its points are.  A value that fills ranges by itself has no such pairs.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.operators.ordered import laid, running
from turnlake.sources.scratch import Steps

#: Distinct points that a task counts by itself, and so of a range.
POINTS = 200_000


def inversions(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """Pairs with x ascending and y falling of weighted points: merges of sorted
    halves, all of one width at a time."""
    order = np.lexsort([y, x])  # equal x: y ascends, no pair
    y = np.unique(y[order], return_inverse=True)[1].astype(np.int64)
    n, at, total, width, levels = n[order].astype(object if float(n.sum()) > 2e9 else np.int64), np.arange(len(y)), 0, 1, len(y) + 1
    while width < len(y):
        block, right = at // (2 * width), at // width % 2
        place = np.argsort((block * levels + y) * 2 + right, kind="stable")
        late = right[place] == 1
        left = np.cumsum(np.where(late, 0, n[place]))
        last = np.append(np.flatnonzero(np.diff(block[place])), len(y) - 1)
        above = np.repeat(left[last], np.diff(np.append(-1, last))) - left  # of its block's left half
        total += int((n[place] * above)[late].sum())
        width *= 2
    return total


def _counted(groups: DataFrame, by: str) -> int:
    """Inversions within each group of points (x, y, n), added up."""

    def count(table: pa.Table) -> pa.Table:
        columns = [table[c].to_numpy() for c in ("x", "y", "n")]
        return pa.table({"d": pa.array([Decimal(inversions(*columns))], pa.decimal128(38, 0))})

    return int(groups.groupBy(by).applyInArrow(count, "d decimal(38,0)").agg(F.sum("d")).first()[0] or 0)


def _ranges(points: DataFrame, column: str, steps: Steps, size: int) -> DataFrame:
    """(value, range, alone): ranges ascend with the values; a value with
    ``size`` points and more has an odd range for itself."""
    values = points.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    before = running(laid(values, ["value"]), ["value"], {"c": F.col("c")})
    alone = F.col("c") >= size
    return steps.stored(before.select("value", (F.floor(F.col("_c_before") / size) * 2 + alone.cast("long")).alias("range"), alone.alias("alone")), "ranges")


def discordant(points: DataFrame, size: int = POINTS) -> int:
    """Pairs of (x, y, n) with x ascending and y falling, each n times n."""
    steps, total = Steps(points.sparkSession), 0
    points = steps.stored(points, "points")
    while points.count() > size:
        for column in ("x", "y"):
            of = _ranges(points, column, steps, size).select(F.col("value").alias(column), F.col("range").alias(f"r{column}"), F.col("alone").alias(f"a{column}"))
            points = points.join(of, column)
        points = steps.stored(points, "points")
        in_x = points.filter("NOT ax").select("rx", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "n")
        # In a range of y, of points in unlike ranges of x: the others are counted above.
        in_y = points.filter("NOT ay").groupBy("ry", "rx", "y").agg(F.sum("n").alias("n")).select("ry", F.col("rx").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "n")
        total += _counted(in_x, "rx") + _counted(in_y, "ry")
        points = steps.stored(points.groupBy(F.col("rx").alias("x"), F.col("ry").alias("y")).agg(F.sum("n").alias("n")), "points")
    rest = points.select(F.lit(0).alias("all"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "n")
    total += _counted(rest, "all")  # at most ``size`` points
    steps.clear()
    return total


def kendall(pairs: DataFrame, a: str, b: str, size: int = POINTS) -> dict:
    """{n, concordant, discordant, tau}: Kendall's tau-b over rows that have both
    values; 0.0 where it isn't defined.  Numbers are compared as doubles."""
    steps = Steps(pairs.sparkSession)
    points = pairs.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    points = steps.stored(points.groupBy("x", "y").agg(F.count("*").alias("n")), "points")
    wide = F.col("n").cast("decimal(38,0)")
    tied = lambda df: int(df.agg(F.sum((wide * (wide - 1) / 2).cast("decimal(38,0)"))).first()[0] or 0)
    n = int(points.agg(F.sum("n")).first()[0] or 0)
    whole, both = n * (n - 1) // 2, tied(points)
    in_a, in_b = (tied(points.groupBy(c).agg(F.sum("n").alias("n"))) for c in ("x", "y"))
    falling = discordant(points, size) if n > 1 else 0
    rising = whole - in_a - in_b + both - falling
    below = math.sqrt(whole - in_a) * math.sqrt(whole - in_b)
    steps.clear()
    return {"n": n, "concordant": rising, "discordant": falling, "tau": (rising - falling) / below if below else 0.0}
