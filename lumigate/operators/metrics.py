"""Binary metrics at a threshold, over all rows or by group. A call is positive at score >= threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import score_band
from . import roc


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.try_divide(a, b))


def correlation(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; null where either column is constant (which is an error in ANSI mode otherwise)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def confusion(label: Column, prob: Column, threshold: Column) -> dict[str, Column]:
    """Aggregates: n, prevalencia, accuracy ... fn. Null where a denominator is 0."""
    y, called = label == 1, prob >= threshold
    tp, fp, tn, fn = F.count_if(y & called), F.count_if(~y & called), F.count_if(~y & ~called), F.count_if(y & ~called)
    n = F.count(label)
    return {
        "n": n,
        "prevalencia": _ratio(tp + fn, n),
        "accuracy": _ratio(tp + tn, n),
        "sensibilidad": _ratio(tp, tp + fn),
        "especificidad": _ratio(tn, tn + fp),
        "ppv": _ratio(tp, tp + fp),
        "npv": _ratio(tn, tn + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "fnr": _ratio(fn, tp + fn),
        "fpr": _ratio(fp, fp + tn),
        "brier": F.avg((prob - label) * (prob - label)),
        "tp": tp,
        "fp": fp,
        "tn": tn,
        "fn": fn,
    }


def binary_metrics(df: DataFrame, threshold: float | str, label: str = "label", prob: str = "prob", by: Sequence[str] = ()) -> DataFrame:
    """threshold: a number, or the name of a column that holds it. Rows without label, score or group drop out."""
    cut = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    rows = df.dropna(subset=[label, prob, *by]).filter(~F.isnan(prob))
    return rows.groupBy(*by).agg(*(c.alias(k) for k, c in confusion(F.col(label), F.col(prob), cut).items()))


def report(df: DataFrame, threshold: float | str, by: Sequence[str], label: str = "label", prob: str = "prob", min_n: int = 1) -> DataFrame:
    """Metrics and AUROC by group, for groups with both classes and at least min_n rows."""
    base = binary_metrics(df, threshold, label, prob, by).filter((F.col("n") >= min_n) & (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0))
    return base.join(roc.auroc(df, prob, label, by), list(by)) if by else base.withColumn("auroc", roc.auroc(df, prob, label).scalar())


def subsets(df: DataFrame, named: dict[str, Column], threshold: float, label: str = "label", prob: str = "prob") -> DataFrame:
    """The same metrics on several subsets of the rows; subsets of one class drop out. One pass tags the rows."""
    tags = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in named.items())), lambda x: x.isNotNull())
    tagged = df.withColumn("subconjunto", F.explode(tags))
    return report(tagged, threshold, ["subconjunto"], label, prob)


def category_sensitivity(df: DataFrame, threshold: float, category: str, wanted: str, label: str = "label", prob: str = "prob") -> DataFrame:
    """Sensitivity for one category against the other positives."""
    kind = F.when(F.col(category) == wanted, F.lit(wanted)).otherwise(F.lit("otros"))
    called = (F.col(prob) >= threshold).cast("double")
    return df.filter(F.col(label) == 1).groupBy(kind.alias("categoria")).agg(F.count(F.lit(1)).alias("n"), F.avg(called).alias("sensibilidad"))


def missed_by_category(df: DataFrame, threshold: float, category: str, label: str = "label", prob: str = "prob") -> DataFrame:
    """Of each category's positives, the share that is missed."""
    missed = (F.col(prob) < threshold).cast("double")
    return df.filter((F.col(label) == 1) & F.col(category).isNotNull()).groupBy(F.col(category).alias("categoria")).agg(F.count(F.lit(1)).alias("n"), F.avg(missed).alias("perdidos"))


def reliability(df: DataFrame, label: str = "label", prob: str = "prob") -> DataFrame:
    """Score band -> n and the positive share."""
    return df.dropna(subset=[label, prob]).groupBy(score_band(F.col(prob)).alias("banda")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("positivos"))


def operating_points(df: DataFrame, scores: Sequence[str], targets: Sequence[float], label: str = "label") -> DataFrame:
    """Per score column and target sensitivity: threshold and specificity there (null without negatives); no row without positives."""
    long = df.select(F.col(label), F.explode(F.array(*(F.struct(F.lit(s).alias("puntuacion"), F.col(s).cast("double").alias("prob")) for s in scores))).alias("x")).select(label, "x.*")
    points = roc.curve(roc.cells(long, "prob", label, ["puntuacion"]), ["puntuacion"])
    points = points.withColumn("objetivo", F.explode(F.array(*map(F.lit, targets))))
    reached = points.filter(roc.rate("tp", "p") >= F.col("objetivo"))
    spec = F.lit(1.0) - roc.rate("fp", "n")
    return reached.groupBy("puntuacion", "objetivo").agg(F.max("score").alias("umbral"), F.max_by(spec, "score").alias("especificidad"))


def attach_category(predictions: DataFrame, categories: DataFrame, key: str = "image_path") -> DataFrame:
    """Predictions with the fine category where it is known; one row a prediction even if the categories repeat a key."""
    first = categories.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*[c for c in categories.columns if c != key]))).filter("__n = 1").drop("__n")
    return predictions.join(first, key, "left")
