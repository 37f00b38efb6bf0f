"""Thresholds derived on val and applied to test, and the comparison of strategies.

Thresholds never see test rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import roc
from .ranked import settled


def strategies(val: DataFrame, group: str = "grupo", label: str = "label", prob: str = "prob", target: float = 0.85, min_n: int = 25) -> DataFrame:
    """u_unico, u_grupo, u_sens per group of val, and with a null group the single threshold of all of val.

    Groups with fewer than min_n rows or one class take the single threshold (0.5 where val as a whole has one class).
    Rows are collapsed to cells once; the curve of all is that of the groups' cells summed.
    """
    found = settled(roc.cells(val, prob, label, [group]), "score").withColumn("todo", F.lit(False))
    every = found.groupBy("score", "bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    every = every.select(F.lit(None).cast(found.schema[group].dataType).alias(group), "score", "pos", "neg", "bucket", F.lit(True).alias("todo"))
    by = ["todo", "g"]
    both = found.unionByName(every).withColumn("g", F.coalesce(F.col(group).cast("string"), F.lit("")))
    points = roc.curve(both, by)
    enough = (F.max("p") + F.max("n") >= min_n) & (F.max("p") > 0) & (F.max("n") > 0)
    own = points.groupBy(*by).agg(F.max(group).alias(group), roc.youden().alias("youden"), roc.at_sensitivity(target).alias("reached"), enough.alias("enough"))
    # The row of all of val is one more row of a small table; every other row reads it.
    single = F.coalesce(F.max(F.when(F.col("todo"), F.col("youden"))).over(Window.partitionBy()), F.lit(0.5))
    own = own.select(group, "todo", single.alias("u_unico"), "youden", "reached", "enough")
    pick = lambda c: F.when(F.col("enough") & ~F.col("todo"), F.col(c)).otherwise(F.col("u_unico"))
    return own.select(group, "u_unico", pick("youden").alias("u_grupo"), pick("reached").alias("u_sens"))


def attach(test: DataFrame, own: DataFrame, group: str = "grupo") -> DataFrame:
    """Test rows (or cells) with their thresholds; groups that val lacks take the single one.

    The groups of test meet those of val first (a row a group), and the single threshold, the same in every row, fills the gaps.
    """
    groups = test.select(F.col(group).alias("__g")).filter("__g is not null").distinct()
    met = groups.join(own, groups["__g"] == own[group], "full")
    single = F.coalesce(F.max("u_unico").over(Window.partitionBy()), F.lit(0.5))
    met = met.select("__g", single.alias("u_unico"), *(F.coalesce(c, single).alias(c) for c in ("u_grupo", "u_sens"))).filter("__g is not null")
    return test.join(met, test[group] == met["__g"]).drop("__g")


def evaluate(val: DataFrame, test: DataFrame, group: str = "grupo", label: str = "label", prob: str = "prob", target: float = 0.85, min_n: int = 25) -> DataFrame:
    """estrategia, grupo, umbral, n, auroc, sensibilidad, especificidad, fnr, tp, fn, p: three strategies on test, by group.

    Test rows are collapsed to cells once; all counts and the area come from them. p: positives of all of test (for `summary`).
    """
    found = settled(roc.cells(test, prob, label, [group]), "score")
    ready = attach(found, strategies(val, group, label, prob, target, min_n), group)
    names = [("umbral_unico", "u_unico"), ("umbral_por_grupo", "u_grupo"), (f"sensibilidad_{target:.2f}_por_grupo", "u_sens")]
    sums = {f"{side}_{c}": F.when(F.col("score") >= F.col(c), F.col(side)).otherwise(0) for _, c in names for side in ("pos", "neg")}
    found = roc.summary(ready, [group, *(c for _, c in names)], sums)
    rows = F.array(*(F.struct(F.lit(k).alias("orden"), F.lit(n).alias("estrategia"), F.col(c).alias("umbral"), F.col(f"pos_{c}").alias("tp"), F.col(f"neg_{c}").alias("fp")) for k, (n, c) in enumerate(names)))
    long = found.select(group, "p", "n", "auroc", F.explode(rows).alias("x")).select(group, F.col("p").alias("pos"), F.col("n").alias("neg"), "auroc", "x.*")
    long = long.withColumn("positivos", F.sum("pos").over(Window.partitionBy("orden"))).withColumn("detectados", F.sum("tp").over(Window.partitionBy("orden")))  # over groups
    out = long.filter((F.col("pos") + F.col("neg") >= min_n) & (F.col("pos") > 0) & (F.col("neg") > 0))
    return out.select(
        "orden", "estrategia", F.col(group).cast("string").alias("grupo"), (F.col("pos") + F.col("neg")).alias("n"), "umbral", "auroc",
        roc.rate("tp", "pos").alias("sensibilidad"), (F.lit(1.0) - roc.rate("fp", "neg")).alias("especificidad"), (F.lit(1.0) - roc.rate("tp", "pos")).alias("fnr"),
        "tp", (F.col("pos") - F.col("tp")).alias("fn"), "detectados", "positivos",
    )


def summary(evaluated: DataFrame) -> DataFrame:
    """Per strategy: brecha_fnr, fnr_maximo, peor_grupo (the first by name of equals), and overall sensitivities.

    sensibilidad_propia is over the groups that are judged, sensibilidad_todos over all of test, small groups too, each
    at its own thresholds; sensibilidad_global is that of the single threshold, which the published tables give beside every strategy.
    """
    worst = F.min_by("grupo", F.when(F.col("fnr").isNotNull(), F.struct((-F.col("fnr")).alias("f"), "grupo")))
    return evaluated.groupBy("orden", "estrategia").agg(
        (F.max("fnr") - F.min("fnr")).alias("brecha_fnr"),
        F.max("fnr").alias("fnr_maximo"),
        worst.alias("peor_grupo"),
        F.try_divide(F.sum("tp").cast("double"), F.sum(F.col("tp") + F.col("fn")).cast("double")).alias("sensibilidad_propia"),
        F.max(roc.rate("detectados", "positivos")).alias("sensibilidad_todos"),
    ).withColumn("sensibilidad_global", F.max(F.when(F.col("orden") == 0, F.col("sensibilidad_todos"))).over(Window.partitionBy()))  # a row a strategy


def choose(summed: DataFrame) -> DataFrame:
    """The strategy of the smallest gap; of equals the first."""
    return summed.agg(F.min_by("estrategia", F.struct("brecha_fnr", "orden")).alias("elegida"), F.min("brecha_fnr").alias("brecha_fnr"))


def over_seeds(summed: DataFrame, band: DataFrame | None = None) -> DataFrame:
    """Strategy by seed (a column `seed`): mean and sample deviation of the gap; band: (estrategia, seed, fnr) of one group."""
    out = summed.groupBy("estrategia").agg(F.avg("brecha_fnr").alias("brecha_media"), F.stddev_samp("brecha_fnr").alias("brecha_std"), F.count(F.lit(1)).alias("semillas"))
    if band is not None:
        out = out.join(band.groupBy("estrategia").agg(F.avg("fnr").alias("fnr_medio_banda")), "estrategia", "left")
    return out


def best_configuration(table: DataFrame, metric: str, deployable: str = "desplegable") -> DataFrame:
    """The best configuration of all and of the deployable ones; ties go to the first by `orden`."""
    rank = F.struct(F.col(metric), -F.col("orden"))
    allowed = F.when(F.col(deployable), rank)
    return table.agg(F.max_by("configuracion", rank).alias("mejor"), F.max_by("configuracion", allowed).alias("mejor_desplegable"))
