"""Error gaps across subgroups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics, roc


def subgroup_report(
    df: DataFrame,
    attributes: Sequence[str],
    threshold: float,
    intersections: Sequence[tuple[str, str]] = (),
    label: str = "label",
    prob: str = "prob",
    min_n: int = 15,
) -> DataFrame:
    """atributo, subgrupo, n, prevalencia, auroc, sensibilidad, especificidad, fnr_infradiagnostico, fpr.

    Rows are first collapsed to one cell per combination of all attributes and score, and only the cells are
    repeated, once an attribute or intersection; counts and area come from the same sums. Subgroups with fewer than
    min_n rows or one class are left out. Order for display: attribute, then FNR from the worst (`ordered`).
    """
    sets = [(a, (a,)) for a in attributes] + [(f"{a} x {b}", (a, b)) for a, b in intersections]
    used = list(dict.fromkeys(c for _, cs in sets for c in cs))
    text = {c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in used}  # "" is missing
    found = roc.cells(df.select(*(text[c].alias(c) for c in used), F.col(label).alias("label"), F.col(prob).alias("prob")), "prob", "label", used)

    def kind(name: str, cs: Sequence[str]) -> Column:
        whole = reduce(lambda a, b: a & b, [F.col(c) != "" for c in cs])
        return F.when(whole, F.struct(F.lit(name).alias("atributo"), F.concat_ws(" | ", *(F.substr(c, F.lit(2)) for c in cs)).alias("subgrupo")))

    kinds = F.filter(F.array(*(kind(n, cs) for n, cs in sets)), lambda x: x.isNotNull())
    keys = ["atributo", "subgrupo"]
    long = found.select("score", "pos", "neg", F.explode(kinds).alias("k")).select("score", "pos", "neg", "k.*")
    long = long.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    called = F.col("score") >= F.lit(float(threshold))
    table = roc.summary(long, keys, {"tp": F.when(called, F.col("pos")).otherwise(0), "fp": F.when(called, F.col("neg")).otherwise(0)})
    table = table.withColumn("total", F.col("p") + F.col("n")).filter((F.col("total") >= min_n) & (F.col("p") > 0) & (F.col("n") > 0))
    fpr = roc.rate("fp", "n")
    return table.select(
        *keys, F.col("total").alias("n"), roc.rate("p", "total").alias("prevalencia"), "auroc", roc.rate("tp", "p").alias("sensibilidad"), (F.lit(1.0) - fpr).alias("especificidad"),
        F.try_divide((F.col("p") - F.col("tp")).cast("double"), F.col("p").cast("double")).alias("fnr_infradiagnostico"), fpr.alias("fpr"),
    )


def ordered(report: DataFrame) -> DataFrame:
    return report.orderBy("atributo", F.desc("fnr_infradiagnostico"), "subgrupo")


def fnr_gaps(report: DataFrame) -> DataFrame:
    """Per attribute: largest and smallest FNR, their gap, and the worst subgroup (the first by name of equals)."""
    f = F.col("fnr_infradiagnostico")
    worst = F.min_by("subgrupo", F.when(f.isNotNull(), F.struct((-f).alias("f"), "subgrupo")))
    return report.groupBy("atributo").agg(F.max(f).alias("maximo"), F.min(f).alias("minimo"), (F.max(f) - F.min(f)).alias("brecha"), worst.alias("peor_subgrupo"))


def gate_fairness(df: DataFrame, tone: str = "fitzpatrick", not_gradable: str = "no_evaluable", rejected: str = "rechazada") -> DataFrame:
    """Per tone: n, share not gradable, rejection rate, good photos, and the rejection rate among them."""
    good = F.col(not_gradable) == 0
    call = F.col(rejected).cast("double")
    return df.filter(F.col(tone).isNotNull()).groupBy(F.col(tone).alias("tono")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col(not_gradable).cast("double")).alias("tasa_no_evaluable"),
        F.avg(call).alias("tasa_rechazo"),
        F.count_if(good).alias("n_buenas"),
        F.avg(F.when(good, call)).alias("tasa_rechazo_buenas"),
    )


def gate_gap(table: DataFrame, min_good: int = 30, limit: float = 0.12) -> DataFrame:
    """The gap of rejection among good photos, over tones with enough of them (two at least), and a warning."""
    rows = table.filter(F.col("n_buenas") >= min_good)
    rate = F.col("tasa_rechazo_buenas")
    gap = F.when(F.count(rate) >= 2, F.max(rate) - F.min(rate))
    return rows.agg(gap.alias("brecha"), F.count(rate).alias("tonos"), F.when(gap >= limit, "AVISO").when(gap.isNotNull(), "OK").alias("veredicto"))


def not_gradable_by_tone(df: DataFrame, tone: str = "fitzpatrick", not_gradable: str = "no_evaluable") -> DataFrame:
    return df.filter(F.col(tone).isNotNull()).groupBy(F.col(tone).alias("tono")).agg(F.avg(F.col(not_gradable).cast("double")).alias("tasa"), F.count(F.lit(1)).alias("n"))


def bias_verdict(report: DataFrame, attribute: str = "fitzpatrick") -> DataFrame:
    """One row from the numeric tones of a subgroup table: correlation of tone and FPR (null where either is constant), FPR gap, verdict."""
    tone = F.col("subgrupo").try_cast("double")
    rows = report.filter(F.col("atributo") == attribute).select(tone.alias("tono"), "fpr").dropna()
    n, gap, corr = F.count(F.lit(1)), F.max("fpr") - F.min("fpr"), metrics.correlation("tono", "fpr")
    verdict = F.when(n < 3, "SIN_DATOS").when(F.coalesce(corr > 0.5, F.lit(False)) & (gap > 0.10), "NO_DESPLEGAR").when(gap > 0.15, "CAUTELA").otherwise("LIMPIO")
    return rows.agg(n.alias("tonos"), F.when(n >= 3, corr).alias("correlacion"), F.when(n >= 3, gap).alias("brecha"), verdict.alias("veredicto"))
