"""Do several photos or scores of one subject agree?"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written

ONE, AGREE = "Una sola foto: no se puede estimar la incertidumbre.", "Las fotos coinciden."
DISAGREE = "Las fotos no coinciden: no se da un resultado."
SAME, OTHER = "Parecen de la misma zona.", "Alguna foto parece de otra zona."
DEVIATION_MAX, RANGE_MAX, SIMILARITY_MIN = 0.15, 0.30, 0.55


def predictions(df: DataFrame, group: str = "group_id", prob: str = "prob", deviation: float = DEVIATION_MAX, span: float = RANGE_MAX) -> DataFrame:
    """Per group: n, media, desviacion (sample; 0 for one), rango, coherente, mensaje; judged before rounding. Groups without a score give no row."""
    rows = df.dropna(subset=[group, prob])
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(prob).alias("m"), F.coalesce(F.stddev_samp(prob), F.lit(0.0)).alias("s"), (F.max(prob) - F.min(prob)).alias("r"))
    good = (F.col("s") <= deviation) & (F.col("r") <= span)
    text = F.when(F.col("n") == 1, ONE).when(good, AGREE).otherwise(DISAGREE)
    return out.select(group, "n", F.round("m", 4).alias("media"), F.round("s", 4).alias("desviacion"), F.round("r", 4).alias("rango"), good.alias("coherente"), text.alias("mensaje"))


BLOCK = 512  # photos of a subject that meet in one task


def photo_pairs(df: DataFrame, group: str = "group_id", position: str = "pos") -> DataFrame:
    """Pairs a < b inside a group, each side as a struct. Meant for the few photos of one subject.

    A larger group is dealt over blocks of about BLOCK photos and its pairs of blocks are keys of their own, so no group is one task.
    """
    names = [c for c in df.columns if c != group]
    sizes = df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("__n"))
    held = df.join(sizes, group).select(group, F.struct(*names).alias("s"), F.pmod(F.xxhash64(position), F.col("__n")).cast("int").alias("__b"), "__n")
    other = F.explode(F.sequence(F.lit(0), F.col("__n") - 1))
    a = held.select(group, F.col("s").alias("a"), F.col("__b").alias("i"), other.alias("j"))
    b = held.select(group, F.col("s").alias("b"), F.col("__b").alias("j"), other.alias("i"))
    return a.join(b, [group, "i", "j"]).filter(F.col(f"a.{position}") < F.col(f"b.{position}")).drop("i", "j")


def _unit_rows(members: pa.Array) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Of (pos, v) structs: positions, which histograms are flat, and by length of histogram the rows and their histograms less the mean, at length 1."""
    position = np.asarray(members.field("pos"))
    values = members.field("v")
    ends = np.asarray(values.offsets)
    flat_values = np.asarray(values.values, dtype=np.float64)
    lengths = np.diff(ends)
    flat, by_length = np.zeros(len(position), dtype=bool), {}
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        z = flat_values[ends[rows][:, None] + np.arange(n)]
        z = z - z.mean(axis=1, keepdims=True)
        size = np.sqrt((z * z).sum(axis=1))
        flat[rows] = size == 0
        by_length[int(n)] = rows, z / np.where(size > 0, size, 1)[:, None]
    return position, flat, by_length


def _similarities(a: pa.Array, b: pa.Array | None) -> np.ndarray:
    """The similarities of all pairs of two blocks, or of one block with itself: one product of matrices."""
    at_a, flat_a, rows_a = _unit_rows(a)
    at_b, flat_b, rows_b = (at_a, flat_a, rows_a) if b is None else _unit_rows(b)
    alike = np.ones((len(at_a), len(at_b)))
    for n, (i, z) in rows_a.items():
        if n in rows_b:
            j, y = rows_b[n]
            alike[np.ix_(i, j)] = z @ y.T
    alike[flat_a] = 1.0
    alike[:, flat_b] = 1.0
    return alike[at_a[:, None] < at_b[None, :]] if b is None else alike.ravel()


def block_similarities(df: DataFrame, group: str, position: str, values: str) -> DataFrame:
    """group, low, total, pairs: of each pair of blocks of a group's photos the least similarity, the sum and the number.

    A group of up to BLOCK photos is one block; a larger one is dealt over blocks by hash, and each pair of blocks is a task of
    its own, in which their histograms (of any common length) meet in one product of matrices; no pair leaves it.
    Photos of one position are no pair. Two histograms of unlike length, and a flat one with any, count as alike (1.0).
    """
    rows = df.filter(F.col(position).isNotNull() & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(position).cast("long").alias("pos"), F.col(values).alias("v"))
    large = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n")).filter("n > 1").withColumnRenamed("g", "large")
    held = rows.join(large, rows["g"] == large["large"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    block = F.pmod(F.xxhash64("pos"), F.col("n")).cast("int")
    packed = written(held.groupBy("g", "n", block.alias("block")).agg(F.collect_list(F.struct("pos", "v")).alias("m")), "blocks")
    none = F.lit(None).cast(packed.schema["m"].dataType)
    own = packed.select("g", F.col("m").alias("a"), none.alias("b"))
    several = packed.filter("n > 1")
    one = several.filter("block < n - 1").select("g", F.col("block").alias("i"), F.explode(F.sequence(F.col("block") + 1, F.col("n") - 1)).alias("j"), F.col("m").alias("a"))
    two = several.filter("block > 0").select("g", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), F.col("m").alias("b"))
    both = own if several.isEmpty() else own.unionByName(one.join(two, ["g", "i", "j"]).select("g", "a", "b"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, total, pairs = [], [], []
            a, b = batch.column("a"), batch.column("b")
            for k in range(batch.num_rows):
                c = _similarities(a[k].values, b[k].values if b[k].is_valid else None)
                low.append(float(np.fmin.reduce(c)) if len(c) else None)
                total.append(float(c.sum()))
                pairs.append(len(c))
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(low, pa.float64()), pa.array(total, pa.float64()), pa.array(pairs, pa.int64())], names=["g", "low", "total", "pairs"])

    schema = T.StructType([packed.schema["g"]]).add("low", "double").add("total", "double").add("pairs", "long")
    return both.mapInArrow(work, schema).withColumnRenamed("g", group)


def same_subject(df: DataFrame, group: str = "group_id", position: str = "pos", hist: str = "hist", least: float = SIMILARITY_MIN) -> DataFrame:
    """Per group: n, comparadas, similitud_minima, similitud_media, coherente, mensaje; one photo is coherent with 1.0.

    A photo without a histogram is compared with none and not counted in comparadas. A flat histogram counts as like any
    other (1.0). Rows without a group are one group of photos that are compared with none.
    """
    values = F.col(hist).cast("array<double>")
    rows = df.filter(values.isNotNull() & (F.size(values) > 0) & ~F.exists(values, lambda x: x.isNull())).select(group, position, values.alias("v"))
    found = block_similarities(rows, group, position, "v").groupBy(group).agg(F.min("low").alias("low"), F.try_divide(F.sum("total"), F.sum("pairs").cast("double")).alias("mean"))
    usable = F.count_if(values.isNotNull() & (F.size(values) > 0) & ~F.coalesce(F.exists(values, lambda x: x.isNull()), F.lit(True)))
    out = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), usable.alias("comparadas")).join(found, group, "left")
    low = F.coalesce("low", F.lit(1.0))
    return out.select(
        group, "n", "comparadas", F.round(low, 4).alias("similitud_minima"), F.round("mean", 4).alias("similitud_media"), (low >= least).alias("coherente"),
        F.when(F.col("comparadas") <= 1, ONE).when(low >= least, SAME).otherwise(OTHER).alias("mensaje"),
    )
