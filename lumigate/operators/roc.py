"""Cumulative counts by falling score, and what is read from them.

Rows are first collapsed to one cell per distinct score. The running sums over cells are taken at
two levels, so that no group, and not the whole table, has to pass through one task: cells are written once, scores are cut at
their quantiles (`ranked.settled`), bucket totals are summed over the few buckets, and each bucket then runs on its
own from the sum above it. Areas need no more than a few sums of each bucket, so they join nothing back.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import written

from .ranked import BUCKET_CELLS, settled


def cells(df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """by..., score, pos, neg: counts per distinct score. Missing scores, labels and group values drop out."""
    s = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    rows = df.select(*by, s.alias("score"), F.col(label).cast("int").alias("__y"), (F.col(weight) if weight else F.lit(1)).alias("__w"))
    rows = rows.dropna(subset=[*by, "score", "__y"])
    one = F.col("__w")
    return rows.groupBy(*by, "score").agg(F.sum(F.when(F.col("__y") == 1, one).otherwise(0)).alias("pos"), F.sum(F.when(F.col("__y") == 1, 0).otherwise(one)).alias("neg"))


def _down(by: Sequence[str]) -> Window:
    """From the highest bucket to the one above this."""
    return Window.partitionBy(*by).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)


def _run(by: Sequence[str]) -> Window:
    return Window.partitionBy(*by, "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def curve(found: DataFrame, by: Sequence[str] = (), bucket_cells: int = BUCKET_CELLS) -> DataFrame:
    """cells with tp, fp (counts at score >= this one), p, n (the group's totals), and next_pos, next_neg (the cell below; null for the last)."""
    by = list(by)
    found = settled(found, "score", bucket_cells)
    top = F.max_by(F.struct("pos", "neg"), "score")
    totals = found.groupBy(*by, "bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"), top.alias("top"))
    above, whole = _down(by), Window.partitionBy(*by)
    # A row per bucket and group comes here, not per score.
    totals = totals.select(
        *by,
        "bucket",
        F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("above_p"),
        F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("above_n"),
        F.sum("bp").over(whole).alias("p"),
        F.sum("bn").over(whole).alias("n"),
        F.lead("top").over(Window.partitionBy(*by).orderBy(F.desc("bucket"))).alias("below"),
    )
    order = Window.partitionBy(*by, "bucket").orderBy(F.desc("score"))
    return (
        found.join(totals, [*by, "bucket"])
        .withColumns({"tp": F.col("above_p") + F.sum("pos").over(_run(by)), "fp": F.col("above_n") + F.sum("neg").over(_run(by))})
        .withColumns({f"next_{c}": F.coalesce(F.lead(c).over(order), F.col(f"below.{c}")) for c in ("pos", "neg")})
        .drop("bucket", "above_p", "above_n", "below")
    )


def summary(found: DataFrame, by: Sequence[str] = (), sums: dict[str, Column] | None = None, bucket_cells: int = BUCKET_CELLS) -> DataFrame:
    """Per group of cells: p, n, auroc (ties count half; null with one class), and sums over the cells by name."""
    by = list(by)
    sums = sums or {}
    found = settled(found, "score", bucket_cells)
    found = found.withColumn("here", F.sum("pos").over(_run(by)))
    won = F.sum(F.col("neg") * (F.col("here") - F.col("pos") / 2))
    totals = found.groupBy(*by, "bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"), won.alias("won"), *(F.sum(c).alias(k) for k, c in sums.items()))
    totals = totals.withColumn("above", F.coalesce(F.sum("bp").over(_down(by)), F.lit(0)))
    p, n = F.sum("bp"), F.sum("bn")
    area = F.when((p > 0) & (n > 0), F.try_divide(F.sum(F.col("won") + F.col("bn") * F.col("above")), p.cast("double") * n))
    return totals.groupBy(*by).agg(p.alias("p"), n.alias("n"), area.alias("auroc"), *(F.sum(k).alias(k) for k in sums))


def collinear_dropped(points: DataFrame) -> DataFrame:
    """Points of `curve` that do not lie on a straight run of it; the first and the last stay."""
    bend = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    return points.filter(F.coalesce(bend, F.lit(True)) | first)


def area() -> Column:
    """AUROC over the points of a group: ties count half; null with one class."""
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    p, n = F.max("p"), F.max("n")
    return F.when((p > 0) & (n > 0), F.try_divide(won, p.cast("double") * n))


def average_precision() -> Column:
    """Sum of the recall gained times the precision at each score (the formula is assumed); null without positives."""
    p = F.max("p")
    return F.when(p > 0, F.try_divide(F.sum(F.col("pos") * F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))), p))


def rate(part: str, whole: str) -> Column:
    """part / whole, null where the whole is 0 (a division by 0 is an error in ANSI mode, in rows that a filter would drop too)."""
    return F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))


def youden() -> Column:
    """The score of the largest TPR - FPR; of equals the highest; null with one class."""
    j = rate("tp", "p") - rate("fp", "n")
    return F.max_by("score", F.when(j.isNotNull(), F.struct(j.alias("j"), "score")))


def at_sensitivity(target: Column | float) -> Column:
    """The highest score whose TPR reaches the target; the lowest if none does; 0.5 with one class."""
    target = target if isinstance(target, Column) else F.lit(target)
    both = (F.max("p") > 0) & (F.max("n") > 0)
    return F.when(both, F.coalesce(F.max(F.when(rate("tp", "p") >= target, F.col("score"))), F.min("score"))).otherwise(0.5)


def auroc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return summary(cells(df, score, label, by), by).drop("p", "n")


def auprc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return curve(cells(df, score, label, by), by).groupBy(*by).agg(average_precision().alias("auprc"))


def youden_threshold(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return curve(cells(df, score, label, by), by).groupBy(*by).agg(youden().alias("umbral"))


def sensitivity_threshold(df: DataFrame, score: str, label: str, target: float, by: Sequence[str] = (), drop_intermediate: bool = False) -> DataFrame:
    points = curve(cells(df, score, label, by), by)
    if drop_intermediate:
        points = collinear_dropped(points)
    return points.groupBy(*by).agg(at_sensitivity(target).alias("umbral"))


def bootstrap(df: DataFrame, score: str, label: str, n_boot: int = 1000, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """auroc_lo, auroc_hi, auprc_lo, auprc_hi: the 2.5 and 97.5 percentiles over replicates with Poisson(1) weights.

    Rows of a cell are alike, so c of them weigh Poisson(c) together. A cell's weights in all replicates are one array, made in a
    task from md5 of (seed, group, score, class, part, number), so the result repeats and cells are never multiplied: what
    is shuffled are cells and, a bucket of them, arrays of n_boot sums. Sums run at two levels: first each bucket's, then
    those of the buckets above it, then inside the bucket from there on.
    """
    by = list(by)
    key = F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in by), F.col("score").cast("string"))
    found = settled(cells(df, score, label, by), "score", REPLICATED_CELLS)
    found = found.select(*by, "bucket", "score", F.col("pos").cast("long").alias("pos"), F.col("neg").cast("long").alias("neg"), key.alias("key"))
    place = [*by, "bucket"]
    keys = T.StructType([found.schema[c] for c in place])
    sums = T.StructType([*keys, T.StructField("p", T.ArrayType(T.LongType())), T.StructField("n", T.ArrayType(T.LongType()))])
    areas = T.StructType([*sums, T.StructField("won", T.ArrayType(T.DoubleType())), T.StructField("ap", T.ArrayType(T.DoubleType()))])
    wide = len(place)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        yield from itertools.groupby(rows, key=lambda row: row[:wide])

    def sent(key: tuple, arrays: Sequence[np.ndarray], schema: T.StructType) -> pa.RecordBatch:
        columns = [pa.array([k], field.type) for k, field in zip(key, to_arrow_schema(keys))]
        columns += [pa.ListArray.from_arrays(pa.array([0, n_boot], pa.int32()), pa.array(a)) for a in arrays]
        return pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(schema))

    def bucket_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in runs(batches):
            p, n = np.zeros(n_boot, dtype=np.int64), np.zeros(n_boot, dtype=np.int64)
            for *_, pos, neg, name in rows:
                p += weights(f"{name}:p", pos, n_boot)
                n += weights(f"{name}:n", neg, n_boot)
            yield sent(at, (p, n), sums)

    def above(group: pd.DataFrame) -> pd.DataFrame:
        """Of a group's buckets the sums of those above each (a row a bucket comes here)."""
        group = group.sort_values("bucket", ascending=False)
        for c in ("p", "n"):
            held = np.stack(group[c].to_list())
            group[c] = list(np.cumsum(held, axis=0) - held)
        return group

    def bucket_areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in runs(batches):
            p = n = won = ap = None
            for _, _, pos, neg, name, above_p, above_n in (row[wide:] for row in rows):
                if name is None:  # the sums above this bucket stand before its cells
                    p, n = np.array(above_p, dtype=np.int64), np.array(above_n, dtype=np.int64)
                    base_p, base_n = p.copy(), n.copy()
                    won, ap = np.zeros(n_boot), np.zeros(n_boot)
                    continue
                w, v = weights(f"{name}:p", pos, n_boot), weights(f"{name}:n", neg, n_boot)
                p += w
                n += v
                won += v * (p - w / 2)
                ap += w * (p / np.maximum(p + n, 1))
            yield sent(at, (p - base_p, n - base_n, won, ap), areas)

    def ends(group: pd.DataFrame) -> pd.DataFrame:
        p, n, won, ap = (np.stack(group[c].to_list()).sum(axis=0) for c in ("p", "n", "won", "ap"))
        with np.errstate(divide="ignore", invalid="ignore"):
            found = {"auroc": np.where((p > 0) & (n > 0), won / (p.astype(float) * n), np.nan), "auprc": np.where(p > 0, ap / p, np.nan)}
        row = {c: group[c].iloc[0] for c in by}
        for name, values in found.items():
            values = values[~np.isnan(values)]
            for end, q in (("lo", 0.025), ("hi", 0.975)):
                row[f"{name}_{end}"] = float(np.quantile(values, q)) if len(values) else None
        return pd.DataFrame([row])

    group = by or [F.lit(0).alias("one")]
    order = [*place, "head", F.desc("score")]
    near = found.repartition(*place).sortWithinPartitions(*place)
    totals = written(near.mapInArrow(bucket_sums, sums), "bucket_sums")  # a row a bucket
    over = totals.groupBy(*group).applyInPandas(above, sums)
    heads = over.select(*place, F.lit(0).alias("head"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("neg"), F.lit(None).cast("string").alias("key"), "p", "n")
    empty = F.lit(None).cast("array<bigint>")
    both = heads.unionByName(found.select(*place, F.lit(1).alias("head"), "score", "pos", "neg", "key", empty.alias("p"), empty.alias("n")))
    rows = both.repartition(*place).sortWithinPartitions(*order).mapInArrow(bucket_areas, areas)
    out = T.StructType([found.schema[c] for c in by] + [T.StructField(f"{m}_{e}", T.DoubleType()) for m in ("auroc", "auprc") for e in ("lo", "hi")])
    return rows.groupBy(*group).applyInPandas(ends, out)


REPLICATED_CELLS = 1_000  # cells of a bucket whose weights one task makes
WHOLE = 16  # rows are drawn in parts of 1, 2, 4 ... 2 ** WHOLE, by the bits of their number


@functools.lru_cache(maxsize=None)
def _cuts(part: int) -> np.ndarray:
    return np.array(poisson_cuts(1 << part), dtype=np.int64)


def weights(name: str, count: int, n_boot: int) -> np.ndarray:
    """The weight of so many rows in each replicate: a sum of Poisson draws, one a set bit of the count and one a whole 2 ** WHOLE.

    A draw takes 32 of the 128 bits of md5(name:part:number), four replicates a number.
    """
    parts = [(str(k), k) for k in range(WHOLE) if count >> k & 1] + [(f"{WHOLE}.{j}", WHOLE) for j in range(count >> WHOLE)]
    out = np.zeros(n_boot, dtype=np.int64)
    for part, k in parts:
        drawn = b"".join(hashlib.md5(f"{name}:{part}:{q}".encode()).digest() for q in range(-(-n_boot // 4)))
        out += np.searchsorted(_cuts(k), np.frombuffer(drawn, dtype=">u4")[:n_boot].astype(np.int64), side="right")
    return out


def poisson_cuts(mean: int) -> list[int]:
    """The shares of 2 ** 32 below which Poisson(mean) draws 0, 0 or 1, 0 to 2 ..., by rule."""
    most, share, out = mean + 12 * math.isqrt(mean) + 12, 0.0, []
    for i in range(most):
        share += math.exp(i * math.log(mean) - mean - math.lgamma(i + 1))
        out.append(math.floor(2**32 * min(share, 1.0)))
    return out
