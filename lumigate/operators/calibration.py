"""Measures calibrated against human labels (1: not gradable)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.gate import Thresholds
from . import roc
from .ranked import quantiles_of_cells, settled

# In which direction each measure is expected to speak for "not gradable".
DIRECTIONS = {
    "nitidez_normalizada": "bajo",
    "nitidez_global": "bajo",
    "rango_dinamico": "bajo",
    "estructura": "bajo",
    "lado_corto": "bajo",
    "brillo_medio": "ambos",
    "fraccion_quemada": "alto",
    "fraccion_apagada": "alto",
    "fraccion_reflejo_mayor": "alto",
    "ratio_centro_marco": "bajo",
    "tinte": "alto",
}
# The threshold of the gate that each measure is held against.
THRESHOLD_OF = {
    "nitidez_normalizada": "nitidez_min",
    "rango_dinamico": "rango_dinamico_min",
    "estructura": "estructura_min",
    "lado_corto": "lado_corto_min",
    "fraccion_quemada": "quemada_max",
    "fraccion_apagada": "apagada_max",
    "fraccion_reflejo_mayor": "reflejo_max",
    "tinte": "tinte_max",
    "ratio_centro_marco": "ratio_centro_marco_min",
}
LEAST_FINITE, TELLING = 30, 0.57


# The limits of the readings.
def reading(auc: Column) -> Column:
    return F.when(auc >= 0.65, "predice bien").when(auc >= TELLING, "predice algo").when(auc >= 0.52, "casi nada").when(auc.isNotNull(), "no aporta")


def _finite(c: Column) -> Column:
    return F.when(F.abs(F.nanvl(c, F.lit(None).cast("double"))) < float("inf"), c)


def directed_cells(df: DataFrame, label: str, directions: dict[str, str] | None = None, by: str | None = None) -> DataFrame:
    """(by), medida, sentido, score, pos, neg: each measure's values, turned so that high speaks for the label, as cells.

    Rows are unpivoted and counted once; the centres of two-sided measures and their scores come from the counts.
    """
    directions = directions or {m: d for m, d in DIRECTIONS.items() if m in df.columns}
    parts = F.array(*(F.struct(F.lit(m).alias("medida"), F.lit(d).alias("sentido"), _finite(F.col(m).cast("double")).alias("x")) for m, d in directions.items()))
    keep = [by] if by else []
    long = df.select(*keep, F.col(label).cast("int").alias("y"), F.explode(parts).alias("m")).select(*keep, "y", "m.*")
    values = settled(roc.cells(long, "x", "y", [*keep, "medida", "sentido"]), "score").withColumnRenamed("score", "x")
    one_sided = values.filter("sentido <> 'ambos'").withColumn("score", F.when(F.col("sentido") == "alto", F.col("x")).otherwise(-F.col("x"))).drop("x", "bucket")
    if "ambos" not in directions.values():
        return one_sided
    # The centre of a two-sided measure is the median of the gradable rows: a row a measure (and group).
    two_sided = values.filter("sentido = 'ambos'")
    keys = [*keep, "medida"]
    centres = quantiles_of_cells(two_sided.filter("neg > 0").select(*keys, F.col("x").alias("v"), F.col("neg").alias("times"), "bucket"), 0.5, keys).select(*keys, F.col("quantile").alias("centro"))
    away = two_sided.join(centres, keys).withColumn("score", F.abs(F.col("x") - F.col("centro")))
    away = away.groupBy(*keys, "sentido", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return one_sided.unionByName(away)


def directed_auc(df: DataFrame, label: str = "no_evaluable", directions: dict[str, str] | None = None, by: str | None = None) -> DataFrame:
    """medida, sentido, auc, lectura (by group if asked): null under 30 finite values or with one class."""
    keys = ([by] if by else []) + ["medida", "sentido"]
    found = roc.summary(directed_cells(df, label, directions, by), keys)
    auc = F.when(F.col("p") + F.col("n") >= LEAST_FINITE, F.col("auroc"))
    return found.select(*keys, auc.alias("auc")).withColumn("lectura", reading(F.col("auc")))


def suggested_cuts(df: DataFrame, label: str = "no_evaluable", directions: dict[str, str] | None = None, least: float = TELLING) -> DataFrame:
    """medida, corte, sens, esp by Youden, for one-sided measures that tell something; with the threshold in use."""
    keys = ["medida", "sentido"]
    directions = {m: d for m, d in (directions or DIRECTIONS).items() if m in df.columns and d != "ambos"}
    points = roc.curve(directed_cells(df, label, directions), keys)
    j = F.struct((roc.rate("tp", "p") - roc.rate("fp", "n")).alias("j"), "score")
    best = points.filter("p > 0 and n > 0").groupBy(*keys).agg(
        F.when(F.max("p") + F.max("n") >= LEAST_FINITE, roc.area()).alias("auc"),
        F.max_by("score", j).alias("corte"),
        F.max_by(roc.rate("tp", "p"), j).alias("sens"),
        F.max_by(F.lit(1.0) - roc.rate("fp", "n"), j).alias("esp"),
    )
    use = Thresholds()
    current = F.create_map(*(x for m, t in THRESHOLD_OF.items() for x in (F.lit(m), F.lit(float(getattr(use, t))))))
    cut = F.when(F.col("sentido") == "bajo", -F.col("corte")).otherwise(F.col("corte"))
    return best.filter(F.col("auc") >= least).select("medida", "auc", cut.alias("corte"), "sens", "esp", F.try_element_at(current, F.col("medida")).alias("actual"))
