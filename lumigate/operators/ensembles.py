"""Aggregation of scores over seeds, views and crops, and training histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def seed_spread(table: DataFrame, metrics: Sequence[str], seed: str = "seed") -> DataFrame:
    """metrica, media, std (sample), valores in seed order."""
    long = table.select(seed, F.explode(F.array(*(F.struct(F.lit(m).alias("metrica"), F.col(m).cast("double").alias("valor")) for m in metrics))).alias("x")).select(seed, "x.*")
    values = F.transform(F.array_sort(F.collect_list(F.struct(seed, "valor"))), lambda s: s["valor"])
    return long.groupBy("metrica").agg(F.avg("valor").alias("media"), F.stddev_samp("valor").alias("std"), values.alias("valores"))


def mean_score(df: DataFrame, key: str = "image_path", prob: str = "prob") -> DataFrame:
    """Mean over seeds or flip views per image: rows meet by key, not by position."""
    return df.groupBy(key).agg(F.avg(prob).alias("prob"))


def crop_scores(df: DataFrame, key: str = "image_path", prob: str = "prob", choose: str = "max", top: int = 3) -> DataFrame:
    """prob, prob_max, prob_top3 (mean of the best three, fewer if there are fewer), n_recortes.

    Rows meet once, by key.
    """
    if choose not in ("max", "top3"):
        raise ValueError("choose is 'max' or 'top3'")
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(prob))
    first = F.when(F.row_number().over(w) <= top, F.col(prob))
    out = df.select(key, F.col(prob).alias("__p"), first.alias("__t")).groupBy(key).agg(F.avg("__t").alias("prob_top3"), F.max("__p").alias("prob_max"), F.count("__p").alias("n_recortes"))
    return out.withColumn("prob", F.col("prob_max" if choose == "max" else "prob_top3"))


def top_scores(df: DataFrame, key: str = "image_path", prob: str = "prob", tie: str = "view_id", k: int = 3) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(prob), tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def training_report(history: DataFrame, run: str = "run") -> DataFrame:
    """Per run: best epoch by val_auroc (the first of equals), its value, the last epoch, and the train/val gap there."""
    best = F.struct("val_auroc", (-F.col("epoch")).alias("e"))
    return history.groupBy(run).agg(
        F.max_by("epoch", best).alias("mejor_epoca"),
        F.max("val_auroc").alias("mejor_val_auroc"),
        F.max("epoch").alias("ultima_epoca"),
        F.max_by(F.col("train_auroc") - F.col("val_auroc"), "epoch").alias("brecha_final"),
    )
