"""Orders over a whole table or within groups, at two levels, so that no group has to pass through one task.

Values are cut at quantiles of all distinct values (a sketch of bounded size, read as a scalar subquery), so a
bucket holds a small share of them wherever they lie: scores of a sure model crowd near 1 and still part.
Sums run over the few buckets, and inside each bucket on their own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

PARTS, STRIDE = 256, 16
BUCKET_CELLS = 100_000


def settled(cells: DataFrame, value: str, bucket_cells: int = BUCKET_CELLS) -> DataFrame:
    """cells written once to the shared folder, with their bucket; cells that have one stay as they are.

    All that is summed later reads these few rows and not the table they were counted from. There are as many
    buckets as make about bucket_cells cells each (one for 0), so a task does not grow with the data; one bucket is cut nowhere. The cuts
    (eight bytes a bucket) are read once and stand in the plan as numbers.
    """
    if "bucket" in cells.columns:
        return cells
    cells = written(cells, "cells")
    parts = -(-cells.count() // bucket_cells) if bucket_cells else 1
    if parts < 2:
        return cells.withColumn("bucket", F.lit(0))
    shares = F.expr(f"array({', '.join(f'{k / parts}D' for k in range(1, parts))})")
    cuts = cells.agg(F.percentile_approx(value, shares, F.lit(10 * parts)).alias("cuts")).first()["cuts"]
    stride = math.isqrt(parts) + 1
    # First the stretches of `stride` cuts that lie wholly at or below the value, then the cuts of the one it falls in.
    ends, stretches = cuts[stride - 1 :: stride], [cuts[k : k + stride] for k in range(0, parts, stride)]
    numbers = lambda xs: "array(" + ", ".join(f"{x!r}D" for x in xs) + ")"
    coarse = F.size(F.filter(F.expr(f"cast({numbers(ends)} as array<double>)"), lambda c: c <= F.col(value)))
    table = F.expr(f"cast(array({', '.join(numbers(x) for x in stretches)}) as array<array<double>>)")
    fine = F.size(F.filter(F.coalesce(F.get(table, F.col("__coarse")), F.expr("cast(array() as array<double>)")), lambda c: c <= F.col(value)))
    return cells.withColumn("__coarse", coarse).withColumn("bucket", F.col("__coarse") * stride + fine).drop("__coarse")


def cut_points(cells: DataFrame, value: str, count: str, parts: int = PARTS) -> Column:
    """parts - 1 values that part the rows of cells about evenly; null for no rows. A scalar subquery.

    It names the count, so that it reads the same shuffled cells as the query around it.
    """
    shares = F.expr(f"array({', '.join(f'{k / parts}D' for k in range(1, parts))})")
    return cells.agg(F.percentile_approx(F.when(F.col(count) >= 0, F.col(value)), shares, F.lit(10 * parts)).alias("cuts")).scalar()


def bucket(value: Column, cuts: Column) -> Column:
    """How many cuts are at or below the value: first every STRIDE-th is looked at, then those between two of them."""
    coarse = F.size(F.filter(cuts, lambda c, i: ((i + 1) % STRIDE == 0) & (c <= value)))
    fine = F.size(F.filter(F.slice(cuts, coarse * STRIDE + 1, F.lit(STRIDE - 1)), lambda c: c <= value))
    return F.coalesce(coarse * STRIDE + fine, F.lit(0))


def bucketed(cells: DataFrame, value: str, count: str, parts: int = PARTS) -> DataFrame:
    """cells with their bucket, unless they have one; one bucket for parts = 0.

    Cells that are joined or repeated before they are summed are best bucketed first, so that the subquery is small.
    """
    if "bucket" in cells.columns:
        return cells
    if not parts:
        return cells.withColumn("bucket", F.lit(0))
    return cells.withColumn("__cuts", cut_points(cells, value, count, parts)).withColumn("bucket", bucket(F.col(value), F.col("__cuts"))).drop("__cuts")


def exact_quantiles(df: DataFrame, value: str, share: float, by: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """by..., n, quantile: the interpolated quantile of the finite values of each group.

    Repeated values collapse to one row with a count; then the bucket that holds the rank is known from the
    buckets' counts, and only that bucket is ordered. Null group keys are a group.
    """
    by = list(by)
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    cells = df.select(*by, v.alias("v")).filter("v is not null").groupBy(*by, "v").agg(F.count(F.lit(1)).alias("times"))
    return quantiles_of_cells(cells, share, by, parts)


def quantiles_of_cells(cells: DataFrame, share: float, by: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """The same from cells (by..., v, times) of distinct values."""
    by = list(by)
    cells = bucketed(cells, "v", "times", parts)
    totals = cells.groupBy(*by, "bucket").agg(F.sum("times").alias("held"))
    below = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "bucket", "held", F.coalesce(F.sum("held").over(below), F.lit(0)).alias("below"), F.sum("held").over(Window.partitionBy(*by)).alias("n"))
    place = (F.col("n") - 1) * F.lit(float(share))
    totals = totals.withColumns({"low": F.floor(place), "high": F.ceil(place), "part": place - F.floor(place)})
    totals = totals.filter("(low >= below and low < below + held) or (high >= below and high < below + held)")  # two buckets a group at most
    totals = totals.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("bucket").alias("__bucket"), "below", "n", "low", "high", "part")
    same = cells["bucket"] == totals["__bucket"]
    for c in by:
        same = same & cells[c].eqNullSafe(totals[f"__{c}"])
    run = Window.partitionBy(*by, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = cells.join(totals, same).withColumn("to", F.col("below") + F.sum("times").over(run))
    at = lambda rank: F.max(F.when((F.col(rank) < F.col("to")) & (F.col(rank) >= F.col("to") - F.col("times")), F.col("v")))
    out = found.groupBy(*by).agg(F.max("n").alias("n"), at("low").alias("a"), at("high").alias("b"), F.max("part").alias("part"))
    return out.select(*by, "n", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))
