"""Agreement between raters and between annotations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import correlation

def rater_agreement(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """df with n_valoraciones, suma and unanime (more than one rating, all equal)."""
    given = F.filter(F.array(*(F.col(c).cast("int") for c in raters)), lambda x: x.isNotNull())
    out = df.withColumn("__v", given).withColumn("n_valoraciones", F.size("__v"))
    out = out.withColumn("suma", F.aggregate("__v", F.lit(0), lambda a, x: a + x))
    return out.withColumn("unanime", (F.col("n_valoraciones") > 1) & (F.array_min("__v") == F.array_max("__v"))).withColumn("unanime", F.coalesce("unanime", F.lit(False))).drop("__v")


def unanimous(df: DataFrame) -> DataFrame:
    return df.filter("unanime")


def pairwise_kappa(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """par, n, acuerdo, kappa of each pair of 0/1 raters, from one pass over the rows."""
    pairs = F.array(*(F.struct(F.lit(f"{a}-{b}").alias("par"), F.col(a).cast("int").alias("x"), F.col(b).cast("int").alias("y")) for a, b in combinations(raters, 2)))
    long = df.select(F.explode(pairs).alias("p")).select("p.*").dropna()
    n = F.count(F.lit(1))
    same = F.count_if(F.col("x") == F.col("y")) / n
    by_chance = F.avg("x") * F.avg("y") + (1 - F.avg("x")) * (1 - F.avg("y"))
    return long.groupBy("par").agg(n.alias("n"), same.alias("acuerdo"), F.when(by_chance < 1, (same - by_chance) / (1 - by_chance)).alias("kappa"))


def ordinal_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, exacto, mas_menos_1, corr (null where either is constant) of two ordinal annotations."""
    rows = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    off = F.abs(F.col("a") - F.col("b"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg((off == 0).cast("double")).alias("exacto"), F.avg((off <= 1).cast("double")).alias("mas_menos_1"), correlation("a", "b").alias("corr"))
