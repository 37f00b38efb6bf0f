"""Every query of the library on the given tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import gate, scalars
from ..operators import agreement, calibration, concordance, ensembles, fairness, manifest, measures, metrics, roc, splits, thresholds
from ..sources import photos as source
from . import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "threshold_strategies"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, whole numbers as long, for comparison with SQL."""
    kinds = {"double": lambda c: F.round(c, digits), "float": lambda c: F.round(c.cast("double"), digits), "int": lambda c: c.cast("long")}
    return df.select(*(kinds.get(t, lambda c: c)(F.col(n)).alias(n) for n, t in df.dtypes))


def curve_sql(rows: str, by: str, where: str = "true") -> str:
    """Cumulative counts by falling score: rows has label, prob and the columns `by`."""
    part = f"partition by {by}" if by else ""
    comma = f"{by}, " if by else ""
    return f"""
  select *, sum(pos) over ({part} order by score desc rows unbounded preceding) as tp, sum(neg) over ({part} order by score desc rows unbounded preceding) as fp,
    sum(pos) over ({part}) as p, sum(neg) over ({part}) as n
  from (select {comma} prob as score, cast(sum(label) as double) as pos, cast(sum(1 - label) as double) as neg from ({rows}) where {where} group by {comma} prob)"""


AREA = "sum(neg * (tp - pos / 2e0)) / (max(p) * max(n))"
BEST_J = "arg_max(score, tp / p - fp / n + score * 1e-13)"
REACHED = "max(case when tp / p >= {t} then score end)"


def confusion_sql(cut: str) -> str:
    pos, call = "label = 1", f"prob >= {cut}"
    tp, fp = f"count(*) filter ({pos} and {call})", f"count(*) filter (label = 0 and {call})"
    tn, fn = f"count(*) filter (label = 0 and not {call})", f"count(*) filter ({pos} and not {call})"
    ratio = lambda a, b: f"round(cast({a} as double) / nullif({b}, 0), 6)"
    return f"""count(*) as n, {ratio(f"{tp} + {fn}", "count(*)")} as prevalencia, {ratio(f"{tp} + {tn}", "count(*)")} as accuracy,
    {ratio(tp, f"({tp} + {fn})")} as sensibilidad, {ratio(tn, f"({tn} + {fp})")} as especificidad, {ratio(tp, f"({tp} + {fp})")} as ppv, {ratio(tn, f"({tn} + {fn})")} as npv,
    {ratio(f"2 * {tp}", f"(2 * {tp} + {fp} + {fn})")} as f1, {ratio(fn, f"({tp} + {fn})")} as fnr, {ratio(fp, f"({tn} + {fp})")} as fpr,
    round(avg((prob - label) * (prob - label)), 6) as brier, {tp} as tp, {fp} as fp, {tn} as tn, {fn} as fn"""


P = A.PREDICTIONS
VAL, TEST = f"select * from ({P}) where split = 'val'", f"select * from ({P}) where split = 'test'"

# --- thresholds ---------------------------------------------------------------------------------

STRATEGIES = f"""
with val_all as ({curve_sql(VAL, "")}), single as (select {BEST_J} as u from val_all),
val_by as ({curve_sql(VAL, "grupo")}),
own as (select grupo, {BEST_J} as u_grupo, {REACHED.format(t="0.85e0")} as u_sens from val_by group by grupo),
ready as (select t.*, u as u0, coalesce(u_grupo, u) as u1, coalesce(u_sens, u) as u2 from ({TEST}) t cross join single left join own using (grupo)),
long as (select 0 as orden, 'umbral_unico' as estrategia, grupo, label, prob, u0 as umbral from ready
  union all select 1, 'umbral_por_grupo', grupo, label, prob, u1 from ready union all select 2, 'sensibilidad_0.85_por_grupo', grupo, label, prob, u2 from ready),
counted as (select orden, estrategia, grupo, count(*) as n, max(umbral) as umbral, count(*) filter (label = 1 and prob >= umbral) as tp, count(*) filter (label = 1 and prob < umbral) as fn,
  count(*) filter (label = 0 and prob >= umbral) as fp, count(*) filter (label = 0 and prob < umbral) as tn from long group by all),
areas as (select grupo, {AREA} as auroc from ({curve_sql(TEST, "grupo")}) group by grupo),
evaluated as (select orden, estrategia, grupo, n, umbral, auroc, cast(tp as double) / (tp + fn) as sensibilidad, cast(tn as double) / (tn + fp) as especificidad, cast(fn as double) / (tp + fn) as fnr, tp, fn
  from counted join areas using (grupo) where n >= 25 and tp + fn > 0 and tn + fp > 0)
"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.predictions(spark, sf_dir)
    return thresholds.evaluate(splits.only(df, "val"), splits.only(df, "test"))


@query(STRATEGIES + "select estrategia, grupo, n, round(umbral, 6) as umbral, round(auroc, 6) as auroc, round(sensibilidad, 6) as sensibilidad, round(especificidad, 6) as especificidad, round(fnr, 6) as fnr from evaluated")
def threshold_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds from val, applied to test, by group, under three strategies."""
    return rounded(_evaluated(spark, sf_dir).drop("orden", "tp", "fn", "detectados", "positivos"))


SUMMARY = STRATEGIES + """, summed as (select orden, estrategia, max(fnr) - min(fnr) as brecha_fnr, max(fnr) as fnr_maximo, (list(grupo order by fnr desc, grupo))[1] as peor_grupo,
  cast(sum(tp) as double) / sum(tp + fn) as sensibilidad_propia from evaluated group by orden, estrategia),
every as (select orden, cast(sum(tp) as double) / sum(tp + fn) as todos from counted group by orden)
"""


@query(SUMMARY + "select estrategia, round(brecha_fnr, 6) as brecha_fnr, round(fnr_maximo, 6) as fnr_maximo, peor_grupo, round(sensibilidad_propia, 6) as sensibilidad_propia, round(todos, 6) as sensibilidad_todos, round((select todos from every where orden = 0), 6) as sensibilidad_global from summed join every using (orden)")
def strategy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(thresholds.summary(_evaluated(spark, sf_dir)).drop("orden"))


@query(SUMMARY + """, tied as (select orden, estrategia, unnest([grupo, grupo || 'b', grupo || '0']) as grupo, fnr from evaluated)
select estrategia, round(max(fnr), 6) as fnr_maximo, (list(grupo order by fnr desc, grupo))[1] as peor_grupo from tied group by estrategia""")
def strategy_summary_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst group where every group ties with two others, whose names begin alike."""
    names = F.explode(F.array(F.concat("grupo", F.lit("b")), F.concat("grupo", F.lit("0")), F.col("grupo")))
    return rounded(thresholds.summary(_evaluated(spark, sf_dir).withColumn("grupo", names)).select("estrategia", "fnr_maximo", "peor_grupo"))


@query(SUMMARY + "select (list(estrategia order by brecha_fnr, orden))[1] as elegida, round(min(brecha_fnr), 6) as brecha_fnr from summed")
def strategy_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(thresholds.choose(thresholds.summary(_evaluated(spark, sf_dir))))


@query(f"select grupo, round({AREA}, 6) as auroc from ({curve_sql(P, 'grupo')}) group by grupo")
def auroc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(roc.auroc(A.predictions(spark, sf_dir), "prob", "label", ["grupo"]))


@query(f"select round({AREA}, 6) as auroc from ({curve_sql(P, '')})")
def auroc_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(roc.auroc(A.predictions(spark, sf_dir), "prob", "label"))


@query(f"select grupo, round(sum(pos * tp / (tp + fp)) / max(p), 6) as auprc from ({curve_sql(P, 'grupo')}) group by grupo")
def auprc_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(roc.auprc(A.predictions(spark, sf_dir), "prob", "label", ["grupo"]))


# Two more groups: one of negatives alone, one of positives alone.
ONE_CLASS = f"select * replace (case when l_quantity = 50 then case when label = 1 then 'P' else 'N' end else grupo end as grupo) from ({P})"


def _one_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    alone = F.when(F.col("label") == 1, "P").otherwise("N")
    return A.predictions(spark, sf_dir).withColumn("grupo", F.when(F.col("l_quantity") == 50, alone).otherwise(F.col("grupo")))


@query(f"select grupo, round(case when max(p) > 0 and max(n) > 0 then arg_max(score, tp / nullif(p, 0) - fp / nullif(n, 0) + score * 1e-13) end, 6) as umbral from ({curve_sql(ONE_CLASS, 'grupo')}) group by grupo")
def youden_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(roc.youden_threshold(_one_class(spark, sf_dir), "prob", "label", ["grupo"]))


@query(f"select grupo, round(case when max(p) > 0 and max(n) > 0 then max(case when tp / nullif(p, 0) >= 0.9e0 then score end) else 0.5e0 end, 6) as umbral from ({curve_sql(ONE_CLASS, 'grupo')}) group by grupo")
def sensitivity_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(roc.sensitivity_threshold(_one_class(spark, sf_dir), "prob", "label", 0.9, ["grupo"]))


@query(f"""
with c as ({curve_sql(P, "grupo")}),
b as (select *, lead(tp) over w - 2 * tp + coalesce(lag(tp) over w, 0) as bt, lead(fp) over w - 2 * fp + coalesce(lag(fp) over w, 0) as bf, row_number() over w as rn, lead(score) over w as nx from c window w as (partition by grupo order by score desc))
select grupo, round({REACHED.format(t="0.9e0")}, 6) as umbral from b where rn = 1 or nx is null or bt <> 0 or bf <> 0 group by grupo""")
def sensitivity_threshold_collinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(roc.sensitivity_threshold(A.predictions(spark, sf_dir), "prob", "label", 0.9, ["grupo"], drop_intermediate=True))


REPLICAS, BITS = 1000, 9
POISSON = "case k " + " ".join(f"when {k} then " + " + ".join(f"cast(u >= {c} as bigint)" for c in roc.poisson_cuts(1 << k)) for k in range(BITS)) + " end"
DRAWN = f"""with cells as (select grupo, prob as score, sum(label) as pos, sum(1 - label) as neg from ({P}) group by 1, 2),
sides as (select grupo, score, 'p' as side, cast(pos as bigint) as c from cells where pos > 0 union all select grupo, score, 'n', cast(neg as bigint) from cells where neg > 0),
parts as (select * from sides, generate_series(0, {BITS - 1}) b(k) where (c >> k) & 1 = 1),
hashed as (select grupo, score, side, k, q, md5('7:' || grupo || ':' || score || ':' || side || ':' || k || ':' || q) as h from parts, generate_series(0, {REPLICAS // 4 - 1}) r(q)),
draws as (select grupo, score, side, k, 4 * q + j as replica, cast('0x' || substr(h, cast(1 + 8 * j as bigint), 8) as bigint) as u from hashed, generate_series(0, 3) r(j)),
weighed as (select grupo, replica, score, cast(coalesce(sum({POISSON}) filter (side = 'p'), 0) as double) as pos, cast(coalesce(sum({POISSON}) filter (side = 'n'), 0) as double) as neg from draws group by 1, 2, 3),
points as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by grupo, replica) as p, sum(neg) over (partition by grupo, replica) as n from weighed where pos + neg > 0 window w as (partition by grupo, replica order by score desc rows unbounded preceding)),
each as (select grupo, replica, {AREA} as auroc, sum(pos * tp / (tp + fp)) / max(p) as auprc from points group by 1, 2)
select grupo, {", ".join(f"round(quantile_cont({m}, {q}), 6) as {m}_{e}" for m in ("auroc", "auprc") for e, q in (("lo", 0.025), ("hi", 0.975)))} from each group by grupo"""


@query(DRAWN)
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95 % intervals of both areas, from weights that md5 makes."""
    return rounded(roc.bootstrap(A.predictions(spark, sf_dir), "prob", "label", REPLICAS, 7, ["grupo"]))


# --- metrics ------------------------------------------------------------------------------------


@query(f"select {confusion_sql('0.5e0')} from ({P})")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.binary_metrics(A.predictions(spark, sf_dir), 0.5))


@query(f"select source, {confusion_sql('0.5e0')}, any_value(auroc) as auroc from ({P}) join (select source, round({AREA}, 6) as auroc from ({curve_sql(P, 'source')}) group by source) using (source) group by source")
def metrics_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.report(A.predictions(spark, sf_dir), 0.5, ["source"]))


SUBSETS = f"select *, 'todos' as subconjunto from ({P}) union all select *, 'biopsiados' from ({P}) where l_quantity > 25"


@query(f"select subconjunto, {confusion_sql('0.5e0')}, any_value(auroc) as auroc from ({SUBSETS}) join (select subconjunto, round({AREA}, 6) as auroc from ({curve_sql(SUBSETS, 'subconjunto')}) group by subconjunto) using (subconjunto) group by subconjunto")
def metrics_on_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.subsets(A.predictions(spark, sf_dir), {"todos": F.lit(True), "biopsiados": F.col("l_quantity") > 25}, 0.5))


@query(f"select case when fitzpatrick = '3' then '3' else 'otros' end as categoria, count(*) as n, round(avg(case when prob >= 0.4e0 then 1e0 else 0e0 end), 6) as sensibilidad from ({P}) where label = 1 group by 1")
def category_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.category_sensitivity(A.predictions(spark, sf_dir), 0.4, "fitzpatrick", "3"))


@query(f"select fitzpatrick as categoria, count(*) as n, round(avg(case when prob < 0.4e0 then 1e0 else 0e0 end), 6) as perdidos from ({P}) where label = 1 group by 1")
def missed_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.missed_by_category(A.predictions(spark, sf_dir), 0.4, "fitzpatrick"))


BAND = "case when prob < 0.05e0 then 1 when prob < 0.15e0 then 2 when prob < 0.35e0 then 3 when prob < 0.65e0 then 4 else 5 end"


@query(f"select cast({BAND} as bigint) as banda, count(*) as n, round(avg(cast(label as double)), 6) as positivos from ({P}) group by 1")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.reliability(A.predictions(spark, sf_dir)))


LONG = f"select 'prob' as puntuacion, label, prob from ({P}) union all select 'cantidad', label, l_quantity from ({P})"


@query(f"select puntuacion, objetivo, round(max(score), 6) as umbral, round(arg_max(1 - fp / n, score), 6) as especificidad from ({curve_sql(LONG, 'puntuacion')}), (values (0.9e0), (0.92e0), (0.95e0), (0.98e0)) t(objetivo) where tp / p >= objetivo group by 1, 2")
def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.predictions(spark, sf_dir).withColumnRenamed("l_quantity", "cantidad")
    return rounded(metrics.operating_points(df, ["prob", "cantidad"], [0.9, 0.92, 0.95, 0.98]))


@query(f"select prob, round(case when prob >= 1 then 1 else o / (1 + o) end, 6) as corregida, cast({BAND} as bigint) as banda, count(*) as n from (select *, prob / (1 - prob) * (0.05e0 / 0.95e0) / (0.25e0 / 0.75e0) as o from ({P})) group by all")
def prior_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.predictions(spark, sf_dir).groupBy("prob").agg(F.count(F.lit(1)).alias("n"))
    return rounded(df.select("prob", scalars.prior_correct(F.col("prob"), 0.25, 0.05).alias("corregida"), scalars.score_band(F.col("prob")).alias("banda"), "n"))


# --- fairness -----------------------------------------------------------------------------------

ATTRIBUTES = (
    f"select *, 'fitzpatrick' as atributo, fitzpatrick as subgrupo from ({P}) union all select *, 'sex', sex from ({P}) "
    f"union all select *, 'source', source from ({P}) union all select *, 'fitzpatrick x sex', fitzpatrick || ' | ' || sex from ({P})"
)
REPORT = f"""with rows as ({ATTRIBUTES}), base as (select atributo, subgrupo, {confusion_sql("0.5e0")} from rows group by all),
areas as (select atributo, subgrupo, round({AREA}, 6) as auroc from ({curve_sql("select * from rows", "atributo, subgrupo")}) group by all),
report as (select atributo, subgrupo, n, prevalencia, auroc, sensibilidad, especificidad, fnr as fnr_infradiagnostico, fpr from base join areas using (atributo, subgrupo) where n >= 15)
"""


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fairness.subgroup_report(A.predictions(spark, sf_dir), ["fitzpatrick", "sex", "source"], 0.5, [("fitzpatrick", "sex")])


@query(REPORT + "select * from report")
def subgroup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_report(spark, sf_dir))


@query(REPORT + "select atributo, max(fnr_infradiagnostico) as maximo, min(fnr_infradiagnostico) as minimo, round(max(fnr_infradiagnostico) - min(fnr_infradiagnostico), 6) as brecha, (list(subgrupo order by fnr_infradiagnostico desc, subgrupo))[1] as peor_subgrupo from report group by atributo")
def fnr_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fairness.fnr_gaps(rounded(_report(spark, sf_dir))))


# Every group once more under its name with a 0 behind it: all gaps are ties, and one name begins the other.
TWICE_REPORT = REPORT + ", tied as (select atributo, unnest([subgrupo, subgrupo || '0']) as subgrupo, fnr_infradiagnostico from report)"


@query(TWICE_REPORT + "select atributo, max(fnr_infradiagnostico) as maximo, min(fnr_infradiagnostico) as minimo, round(max(fnr_infradiagnostico) - min(fnr_infradiagnostico), 6) as brecha, (list(subgrupo order by fnr_infradiagnostico desc, subgrupo))[1] as peor_subgrupo from tied group by atributo")
def fnr_gaps_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps where every subgroup ties with another."""
    report = rounded(_report(spark, sf_dir))
    tied = report.withColumn("subgrupo", F.explode(F.array(F.concat("subgrupo", F.lit("0")), F.col("subgrupo"))))
    return rounded(fairness.fnr_gaps(tied))


@query(REPORT + """, v as (select count(*) as tonos, round(corr(cast(subgrupo as double), fpr), 4) as correlacion, round(max(fpr) - min(fpr), 6) as brecha from report where atributo = 'fitzpatrick')
select tonos, correlacion, brecha, case when correlacion > 0.5 and brecha > 0.1 then 'NO_DESPLEGAR' when brecha > 0.15 then 'CAUTELA' else 'LIMPIO' end as veredicto from v""")
def bias_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fairness.bias_verdict(rounded(_report(spark, sf_dir)))).withColumn("correlacion", F.round("correlacion", 4))


# --- gate ---------------------------------------------------------------------------------------

RULE_SQL = {
    "resolucion": "lado_corto < 300",
    "nitidez": "nitidez_normalizada < 0.01e0",
    "oscura": "brillo_medio < 0.18e0 or fraccion_apagada > 0.1e0",
    "quemada": "brillo_medio > 0.88e0 or fraccion_quemada > 0.1e0",
    "reflejo": "fraccion_reflejo_mayor > 0.04e0",
    "plana": "rango_dinamico < 0.25e0 or estructura < 0.04e0",
    "tinte_extremo": "tinte > 0.45e0",
    "nitidez_justa": "nitidez_normalizada >= 0.01e0 and nitidez_normalizada < 0.02e0",
    "descentrada": "ratio_centro_marco < 0.55e0",
    "tinte_moderado": "tinte > 0.22e0 and tinte <= 0.45e0",
}
DOUBTS = ("nitidez_justa", "descentrada", "tinte_moderado")
JUDGED = f"""with judged as (select *, array_to_string(list_filter([{", ".join(f"case when {c} then '{r}' end" for r, c in RULE_SQL.items())}], lambda x: x is not null), '|') as reglas,
 case when {" or ".join(f"coalesce({c}, false)" for r, c in RULE_SQL.items() if r not in DOUBTS)} then 'rechazada' when {" or ".join(f"coalesce({RULE_SQL[r]}, false)" for r in DOUBTS)} then 'dudosa' else 'aceptada' end as veredicto from ({A.MEASURES}))
"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.judge(A.measures(spark, sf_dir))


ADVICE = "case split_part(reglas, '|', 1) " + " ".join(f"when '{r.name}' then '{r.advice}'" for r in gate.RULES) + f" else '{gate.NO_PROBLEM}' end"


@query(JUDGED + f"select photo_id, veredicto, reglas, veredicto <> 'rechazada' as aceptable, {ADVICE} as mensaje from judged")
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("photo_id", "veredicto", "reglas", "aceptable", "mensaje")


@query(f"""select count(*) filter (coalesce(lado_corto < 250, false) or coalesce(nitidez_normalizada < 0.005e0, false) or brillo_medio < 0.1e0 or fraccion_apagada > 0.2e0 or brillo_medio > 0.95e0 or fraccion_quemada > 0.1e0 or fraccion_reflejo_mayor > 0.045e0
 or rango_dinamico < 0.25e0 or estructura < 0.04e0 or tinte > 0.45e0) as rechazada, count(*) as total from ({A.MEASURES})""")
def gate_overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate with some thresholds replaced by name, as text or number."""
    u = gate.thresholds(lado_corto_min="250", nitidez_min=0.005, brillo_min="0.1", brillo_max=0.95, apagada_max=0.2, reflejo_max="0.045")
    return gate.verdict_counts(gate.judge(A.measures(spark, sf_dir), u)).select("rechazada", "total")


@query(JUDGED + "select count(*) filter (veredicto = 'aceptada') as aceptada, count(*) filter (veredicto = 'dudosa') as dudosa, count(*) filter (veredicto = 'rechazada') as rechazada, count(*) as total, round(cast(count(*) filter (veredicto = 'rechazada') as double) / count(*), 6) as tasa from judged")
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gate.verdict_counts(_judged(spark, sf_dir)))


@query(JUDGED + "select regla, count(*) as n from (select unnest(string_split(reglas, '|')) as regla from judged where reglas <> '') group by regla")
def gate_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.rule_counts(_judged(spark, sf_dir))


FAIR = JUDGED + """, fair as (select fitzpatrick as tono, count(*) as n, avg(cast(no_evaluable as double)) as tasa_no_evaluable, avg(case when veredicto = 'rechazada' then 1e0 else 0e0 end) as tasa_rechazo,
 count(*) filter (no_evaluable = 0) as n_buenas, avg(case when veredicto = 'rechazada' then 1e0 else 0e0 end) filter (no_evaluable = 0) as tasa_rechazo_buenas from judged group by 1)
"""


def _fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _judged(spark, sf_dir).withColumn("rechazada", F.col("veredicto") == gate.REJECTED)
    return fairness.gate_fairness(judged)


@query(FAIR + "select tono, n, round(tasa_no_evaluable, 6) as tasa_no_evaluable, round(tasa_rechazo, 6) as tasa_rechazo, n_buenas, round(tasa_rechazo_buenas, 6) as tasa_rechazo_buenas from fair")
def gate_fairness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_fair(spark, sf_dir))


@query(FAIR + "select round(max(tasa_rechazo_buenas) - min(tasa_rechazo_buenas), 6) as brecha, count(*) as tonos, case when max(tasa_rechazo_buenas) - min(tasa_rechazo_buenas) >= 0.12e0 then 'AVISO' else 'OK' end as veredicto from fair where n_buenas >= 30")
def gate_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fairness.gate_gap(_fair(spark, sf_dir)))


@query(f"select fitzpatrick as tono, round(avg(cast(no_evaluable as double)), 6) as tasa, count(*) as n from ({A.MEASURES}) group by 1")
def not_gradable_by_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fairness.not_gradable_by_tone(A.measures(spark, sf_dir)))


@query(JUDGED + f", called as (select no_evaluable as label, case when veredicto = 'rechazada' then 1e0 else 0e0 end as prob from judged) select {confusion_sql('1')} from called")
def gate_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's rejection read as a call of "not gradable"."""
    df = _judged(spark, sf_dir).select(F.col("no_evaluable").alias("label"), (F.col("veredicto") == gate.REJECTED).cast("double").alias("prob"))
    return rounded(metrics.binary_metrics(df, 1.0))


# --- calibration --------------------------------------------------------------------------------

MEASURE_ROWS = " union all ".join(
    f"select '{m}' as medida, '{d}' as sentido, no_evaluable as label, cast({m} as double) as x from ({A.MEASURES}) where {m} is not null" for m, d in calibration.DIRECTIONS.items()
)
DIRECTED = f"""with long as ({MEASURE_ROWS}), centre as (select medida, quantile_cont(x, 0.5) as centro from long where sentido = 'ambos' and label = 0 group by 1),
scored as (select medida, sentido, label, case sentido when 'alto' then x when 'bajo' then -x else abs(x - centro) end as prob from long left join centre using (medida)),
points as ({curve_sql("select * from scored", "medida, sentido")}), areas as (select medida, sentido, {AREA} as auc from points group by all)
"""


@query(DIRECTED + "select medida, sentido, round(auc, 6) as auc, case when auc >= 0.65e0 then 'predice bien' when auc >= 0.57e0 then 'predice algo' when auc >= 0.52e0 then 'casi nada' else 'no aporta' end as lectura from areas")
def directed_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calibration.directed_auc(A.measures(spark, sf_dir)))


# The same by type of shot, for which the given rows' tone stands.
MEASURE_ROWS_BY = MEASURE_ROWS.replace("no_evaluable as label", "no_evaluable as label, fitzpatrick as tipo")
DIRECTED_BY = f"""with long as ({MEASURE_ROWS_BY}), centre as (select tipo, medida, quantile_cont(x, 0.5) as centro from long where sentido = 'ambos' and label = 0 group by all),
scored as (select tipo, medida, sentido, label, case sentido when 'alto' then x when 'bajo' then -x else abs(x - centro) end as prob from long left join centre using (tipo, medida)),
points as ({curve_sql("select * from scored", "tipo, medida, sentido")}), areas as (select tipo, medida, sentido, case when max(p) + max(n) >= 30 then {AREA} end as auc from points group by all)
"""


@query(DIRECTED_BY + "select tipo, medida, sentido, round(auc, 6) as auc, case when auc >= 0.65e0 then 'predice bien' when auc >= 0.57e0 then 'predice algo' when auc >= 0.52e0 then 'casi nada' when auc is not null then 'no aporta' end as lectura from areas")
def directed_auc_by_shot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directed areas of each measure within each type of shot."""
    return rounded(calibration.directed_auc(A.measures(spark, sf_dir).withColumnRenamed("fitzpatrick", "tipo"), by="tipo"))


# A label that two of the measures tell something about.
TELLING = f"select * replace (case when nitidez_global * 200 + lado_corto % 5 < 5.5e0 or tinte > 0.5e0 then 1 else 0 end as no_evaluable) from ({A.MEASURES})"


def _in_use() -> str:
    use = gate.Thresholds()
    return "case medida " + " ".join(f"when '{m}' then {float(getattr(use, t))}" for m, t in calibration.THRESHOLD_OF.items()) + " end"


@query(DIRECTED.replace(A.MEASURES, TELLING) + f""", best as (select medida, sentido, arg_max(score, j) as cut, arg_max(tp / p, j) as sens, arg_max(1 - fp / n, j) as esp from (select *, tp / p - fp / n + score * 1e-13 as j from points) where sentido <> 'ambos' group by all)
select medida, round(auc, 6) as auc, round(case when sentido = 'bajo' then -cut else cut end, 6) as corte, round(sens, 6) as sens, round(esp, 6) as esp, round(cast({_in_use()} as double), 6) as actual from best join areas using (medida, sentido) where auc >= 0.57e0""")
def suggested_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.measures(spark, sf_dir)
    told = (F.col("nitidez_global") * 200 + F.col("lado_corto") % 5 < 5.5) | (F.col("tinte") > 0.5)
    return rounded(calibration.suggested_cuts(df.withColumn("no_evaluable", told.cast("int"))))


# --- raters -------------------------------------------------------------------------------------


@query(f"select doc_id, cast(len(v) as bigint) as n_valoraciones, cast(coalesce(list_sum(v), 0) as bigint) as suma, len(v) > 1 and list_min(v) = list_max(v) as unanime from (select *, list_filter([r1, r2, r3], lambda x: x is not null) as v from ({A.RATERS}))")
def rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.rater_agreement(A.raters(spark, sf_dir), ["r1", "r2", "r3"]).drop("r1", "r2", "r3"))


KAPPA = " union all ".join(f"select '{a}-{b}' as par, {a} as x, {b} as y from ({A.RATERS}) where {a} is not null and {b} is not null" for a, b in (("r1", "r2"), ("r1", "r3"), ("r2", "r3")))


@query(f"select par, n, round(o, 6) as acuerdo, round((o - e) / (1 - e), 6) as kappa from (select par, count(*) as n, avg(case when x = y then 1e0 else 0e0 end) as o, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) as e from ({KAPPA}) group by par)")
def pairwise_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.pairwise_kappa(A.raters(spark, sf_dir), ["r1", "r2", "r3"]))


@query("select count(*) as n, round(avg(case when d = 0 then 1e0 else 0e0 end), 6) as exacto, round(avg(case when d <= 1 then 1e0 else 0e0 end), 6) as mas_menos_1, round(corr(a, b), 6) as corr from (select cast(1 + l_partkey % 6 as double) as a, cast(1 + l_suppkey % 6 as double) as b, abs(l_partkey % 6 - l_suppkey % 6) as d from lineitem)")
def ordinal_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = A.table(spark, sf_dir, "lineitem").select((1 + F.col("l_partkey") % 6).alias("a"), (1 + F.col("l_suppkey") % 6).alias("b"))
    return rounded(agreement.ordinal_agreement(li, "a", "b"))


# --- scalars ------------------------------------------------------------------------------------

TONE_TEXT = "case c_nationkey % 8 when 0 then '2' when 1 then '3.0' when 2 then 'clara' when 3 then '' when 4 then '2.7' when 5 then '7' when 6 then 'FST5' else null end"


def _tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.array(*(F.lit(t) for t in ("2", "3.0", "clara", "", "2.7", "7", "FST5", None)))
    return A.table(spark, sf_dir, "customer").select("c_custkey", F.get(texts, F.col("c_nationkey") % 8).alias("tono"))


@query(f"""select c_custkey, case when x between 1 and 6 then cast(cast(floor(x) as bigint) as varchar) else 'UNKNOWN' end as codigo,
 case when t like '%clara%' or floor(x) between 1 and 2 then '1-2 clara' when floor(x) between 3 and 4 then '3-4 media' when floor(x) between 5 and 6 then '5-6 oscura' else 'UNKNOWN' end as banda,
 coalesce(cast(cast(floor(x) as bigint) as varchar), '-1') as exacto, coalesce(nullif(regexp_extract(t, 'FST([0-9])', 1), ''), 'UNKNOWN') as fst
 from (select c_custkey, {TONE_TEXT} as t, try_cast({TONE_TEXT} as double) as x from customer)""")
def tone_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tono")
    return _tones(spark, sf_dir).select("c_custkey", scalars.tone_code(t).alias("codigo"), scalars.tone_band(t).alias("banda"), scalars.tone_exact(t).alias("exacto"), scalars.fst_digit(t).alias("fst"))


DIAGNOSES = ("BCC", " scc ", "Mel", "ACK", "nev", "SEK", "XYZ", None)
META = """select o_orderkey, o_custkey, case o_orderkey % 2 when 0 then 'pat_' || cast(o_custkey as varchar) || '_1_2.png' else 'IMG_' || cast(o_custkey as varchar) || '.png' end as img_id,
 case o_orderkey % 8 when 0 then 'BCC' when 1 then ' scc ' when 2 then 'Mel' when 3 then 'ACK' when 4 then 'nev' when 5 then 'SEK' when 6 then 'XYZ' else null end as diagnostic,
 case o_orderstatus when 'F' then 'True' when 'O' then 'false' else 'yes' end as biopsed, cast(o_orderkey % 90 as varchar) as age, case o_orderkey % 3 when 0 then 'female' when 1 then 'Male' else null end as gender from orders"""


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, customer = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return A.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(k % 2 == 0, F.concat(F.lit("pat_"), customer, F.lit("_1_2.png"))).otherwise(F.concat(F.lit("IMG_"), customer, F.lit(".png"))).alias("img_id"),
        F.get(F.array(*map(F.lit, DIAGNOSES)), (k % 8).cast("int")).alias("diagnostic"),
        F.when(F.col("o_orderstatus") == "F", "True").when(F.col("o_orderstatus") == "O", "false").otherwise("yes").alias("biopsed"),
        (k % 90).cast("string").alias("age"),
        F.when(k % 3 == 0, "female").when(k % 3 == 1, "Male").alias("gender"),
    )


LABEL = "case when upper(trim(diagnostic)) in ('BCC', 'SCC', 'MEL') then 1 when upper(trim(diagnostic)) in ('ACK', 'NEV', 'SEK') then 0 end"
PATIENT = "case when regexp_matches(img_id, '^(?i)pat_[0-9]+') then upper(regexp_extract(img_id, '^(?i)(pat_[0-9]+)', 1)) else img_id end"


@query(f"""select o_orderkey, {PATIENT} as paciente, cast({LABEL} as bigint) as label, upper(biopsed) in ('TRUE', '1', 'YES') as biopsiado, coalesce(upper(substr(gender, 1, 1)), 'UNKNOWN') as sex,
 case when cast(age as int) < 18 then '0-17' when cast(age as int) < 40 then '18-39' when cast(age as int) < 60 then '40-59' when cast(age as int) < 75 then '60-74' else '75+' end as edad from ({META})""")
def metadata_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _meta(spark, sf_dir).select(
        "o_orderkey",
        scalars.patient_id(F.col("img_id")).alias("paciente"),
        scalars.binary_label(F.col("diagnostic")).alias("label"),
        scalars.biopsied(F.col("biopsed")).alias("biopsiado"),
        scalars.sex(F.col("gender")).alias("sex"),
        scalars.age_group(F.col("age")).alias("edad"),
    )
    return rounded(out)


@query(f"select upper(trim(diagnostic)) as diagnostico, count(*) as n from ({META}) where {LABEL} is null group by 1")
def unknown_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.unknown_diagnoses(_meta(spark, sf_dir))


@query("""select page_id, case when regexp_matches(lower(path), '\\.(png|jpg|jpeg)$') then 'https://x/' || ltrim(path, '/') end as url
 from (select page_id, case when page_id % 2 = 0 then '/' else '' end || 'p/' || page_id || case page_id % 5 when 0 then '.png' when 1 then '.JPG' when 2 then '.jpeg' when 3 then '.gif' else '' end as path from pages)""")
def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    suffix = F.when(k % 5 == 0, ".png").when(k % 5 == 1, ".JPG").when(k % 5 == 2, ".jpeg").when(k % 5 == 3, ".gif").otherwise("")
    path = F.concat(F.when(k % 2 == 0, "/").otherwise(""), F.lit("p/"), k.cast("string"), suffix)
    return A.table(spark, sf_dir, "pages").select("page_id", scalars.image_url("https://x/", path).alias("url"))


# --- joins and manifests ------------------------------------------------------------------------

INDEX = "select img_id as key, path from (select distinct img_id, '/fotos/' || img_id || ext as path, ext from (select distinct img_id, o_custkey from ({m})), (values ('.jpg'), ('.png')) e(ext) where o_custkey % 4 <> 0 and (ext = '.png' or o_custkey % 2 = 0))".format(m=META)
FILED = f"with idx as (select key, (list(path order by case when path like '%.jpg' then 1 else 2 end, path))[1] as image_path from ({INDEX}) group by key), filed as (select m.*, image_path from ({META}) m join idx on img_id = key)"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _meta(spark, sf_dir).select("img_id", "o_custkey").distinct().filter("o_custkey % 4 <> 0")
    names = names.withColumn("ext", F.explode(F.array(F.lit(".jpg"), F.lit(".png")))).filter("ext = '.png' or o_custkey % 2 = 0")
    return names.select(F.col("img_id").alias("key"), F.concat(F.lit("/fotos/"), "img_id", "ext").alias("path")).distinct()


@query(FILED + "select o_orderkey, img_id, image_path from filed")
def rows_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.with_files(_meta(spark, sf_dir), _index(spark, sf_dir), "img_id")[0].select("o_orderkey", "img_id", "image_path")


@query(FILED + f"select count(*) as n from ({META}) where img_id not in (select key from idx)")
def rows_without_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.with_files(_meta(spark, sf_dir), _index(spark, sf_dir), "img_id")[1].agg(F.count(F.lit(1)).alias("n"))


PHONE = FILED + f""", phone as (select image_path, {PATIENT} as patient_id, {LABEL} as label, 'pad_ufes_20' as source, 'UNKNOWN' as view, coalesce(upper(substr(gender, 1, 1)), 'UNKNOWN') as sex, cast(age as double) as age,
 'UNKNOWN' as fitzpatrick, upper(trim(diagnostic)) as diagnostico, biopsed as biopsiado from filed where {LABEL} is not null)
"""


def _phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.phone_manifest(_meta(spark, sf_dir), _index(spark, sf_dir))


@query(PHONE + "select image_path, patient_id, cast(label as bigint) as label, source, view, sex, age, fitzpatrick, diagnostico, biopsiado from phone")
def phone_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_phone(spark, sf_dir))


@query(PHONE + "select 'diagnostico' as columna, diagnostico as valor, count(*) as n from phone group by 2 union all select 'sex', sex, count(*) from phone group by 2")
def manifest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.profile(_phone(spark, sf_dir), ["diagnostico", "sex"])


@query(PHONE + ", people as (select patient_id, count(*) as n, sum(label) as y from phone group by 1) select cast(sum(n) as bigint) as filas, count(*) as pacientes, round(cast(sum(y) as double) / sum(n), 6) as positivos, round(avg(n), 6) as media, max(n) as maximo from people")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(manifest.totals(_phone(spark, sf_dir)))


@query(PHONE + "select diagnostico, count(*) filter (sex = 'F') as F, count(*) filter (sex = 'M') as M from phone where sex in ('F', 'M') group by 1")
def cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.cross_tab(_phone(spark, sf_dir), "diagnostico", "sex", ["F", "M"])


@query(f"select fitzpatrick, count(*) as n, cast(sum(label) as bigint) as malignos, round(avg(cast(label as double)), 6) as prevalencia from ({TEST}) group by 1")
def prevalence_on_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(manifest.prevalence(splits.only(A.predictions(spark, sf_dir), "test"), "fitzpatrick"))


@query("select c_custkey as case_id, c_name, c_acctbal, o_orderkey, o_totalprice, cast(c_nationkey as bigint) as clase, o_orderstatus as clase_lab from customer join orders on c_custkey = o_custkey")
def cases_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), "c_name", "c_acctbal", F.col("c_nationkey").cast("long").alias("clase"))
    labels = A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), "o_orderkey", "o_totalprice", F.col("o_orderstatus").alias("clase"))
    return manifest.cases_with_labels(cases, labels)


@query("select e.event_id, e.user_id, c_name as categoria from events e left join customer on user_id = c_custkey")
def attach_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = A.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("categoria"))
    return metrics.attach_category(A.table(spark, sf_dir, "events").select("event_id", "user_id"), names, "user_id")


@query("select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem)")
def pending_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return source.pending(A.table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


# --- splits and samples -------------------------------------------------------------------------


def _deal(rows: str, k: int, seed: int) -> str:
    return f"""select p.*, cast((row_number() over (partition by positivos, n order by md5('{seed}:' || cast(patient_id as varchar)), patient_id) - 1 + off) % {k} as int) as fold from ({rows}) p
 join (select positivos, n, coalesce(sum(c) over (order by positivos, n rows between unbounded preceding and 1 preceding), 0) as off from (select positivos, n, count(*) as c from ({rows}) group by all)) using (positivos, n)"""


ROWS = "select o_orderkey, o_custkey as patient_id, case when o_orderstatus = 'F' then 1 else 0 end as label from orders"
SPLIT = f"""with people as (select patient_id, count(*) as n, cast(sum(label) as bigint) as positivos from ({ROWS}) group by 1), a as ({_deal("select * from people", 5, 42)}),
rest as (select patient_id, n, positivos from a where fold <> 0), b as ({_deal("select * from rest", 5, 43)}),
named as (select patient_id, 'test' as split from a where fold = 0 union all select patient_id, case when fold = 0 then 'val' else 'train' end from b), done as (select r.*, split from ({ROWS}) r join named using (patient_id))
"""


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("patient_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"))
    return splits.grouped_split(rows)


@query(SPLIT + "select o_orderkey, patient_id, cast(label as bigint) as label, split from done")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_split(spark, sf_dir).select("o_orderkey", "patient_id", "label", "split"))


@query(SPLIT + "select split, count(*) as imagenes, count(distinct patient_id) as pacientes, cast(sum(label) as bigint) as positivos, round(avg(cast(label as double)), 4) as prevalencia from done group by 1")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(splits.split_summary(_split(spark, sf_dir)).drop("orden"))


@query(f"select patient_id from (select patient_id, case when l_quantity > 25 then 'a' else 'b' end as split from ({P})) group by 1 having count(distinct split) > 1")
def leaked_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.predictions(spark, sf_dir).withColumn("split", F.when(F.col("l_quantity") > 25, "a").otherwise("b"))
    return splits.leaked(df)


@query(f"select patient_id, count(*) as n from ({P}) where patient_id not in (select patient_id from ({TEST})) group by 1")
def without_test_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = A.predictions(spark, sf_dir)
    return splits.without_test_patients(df, splits.only(df, "test")).groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"select image_path, cast(label as bigint) as label from (select image_path, label, row_number() over (partition by label order by md5('42:' || image_path), image_path) as rn from ({P})) where rn <= 500")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(splits.balanced_sample(A.predictions(spark, sf_dir), 1000).select("image_path", "label"))


@query(f"select image_path from ({P}) order by md5('42:' || image_path), image_path limit 500")
def simple_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sample(A.predictions(spark, sf_dir).select("image_path"), 500)


def _split_sql(rows: str, taken: str) -> str:
    """CTEs that end in `done`: the rows of the named CTE (patient_id, label) with their split."""
    return f"""people as (select patient_id, count(*) as n, cast(sum(label) as bigint) as positivos from {rows} group by 1), a as ({_deal("select * from people", 5, 42)}),
rest as (select patient_id, n, positivos from a where fold <> 0), b as ({_deal("select * from rest", 5, 43)}),
named as (select patient_id, 'test' as split from a where fold = 0 union all select patient_id, case when fold = 0 then 'val' else 'train' end from b), {taken} as (select r.*, named.split from {rows} r join named using (patient_id))"""


@query(FILED + f""", parts as (select image_path, 's1_' || img_id as patient_id, {LABEL} as label, 's1' as source from filed where {LABEL} is not null union all select image_path || '#2', 's2_' || img_id, {LABEL}, 's2' from filed where {LABEL} is not null),
{_split_sql("parts", "done")} select image_path, patient_id, cast(label as bigint) as label, source, split from done""")
def combined_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _phone(spark, sf_dir).withColumn("source", F.lit("s1"))
    one = one.withColumn("patient_id", F.regexp_extract("image_path", r"/fotos/(.*)\.[^.]+$", 1))
    two = one.withColumns({"source": F.lit("s2"), "image_path": F.concat("image_path", F.lit("#2"))})
    return rounded(manifest.combine([one, two]).select("image_path", "patient_id", "label", "source", "split"))


# --- several photos of one subject --------------------------------------------------------------

VIEWS = "select user_id as group_id, event_id as photo_id, event_type as view, cast(floor(value) as bigint) % 100 / 100e0 as prob from events"


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select(F.col("user_id").alias("group_id"), F.col("event_id").alias("photo_id"), F.col("event_type").alias("view"), ((F.floor("value").cast("long") % 100) / 100.0).alias("prob"))


@query(f"select group_id, n, round(m, 4) as media, round(s, 4) as desviacion, round(r, 4) as rango, s <= 0.15e0 and r <= 0.3e0 as coherente, case when n = 1 then '{concordance.ONE}' when s <= 0.15e0 and r <= 0.3e0 then '{concordance.AGREE}' else '{concordance.DISAGREE}' end as mensaje from (select group_id, count(*) as n, avg(prob) as m, coalesce(stddev_samp(prob), 0) as s, max(prob) - min(prob) as r from ({VIEWS}) group by 1)")
def concordance_of_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concordance.predictions(_views(spark, sf_dir))


# Every ninth photo has no histogram, and every 25th a flat one.
HISTS = "select vec_id // 4 as group_id, vec_id % 4 as pos, case when vec_id % 9 = 4 then null when vec_id % 25 = 7 then list_transform(embedding, lambda x: 1e0) else list_transform(embedding, lambda x: cast(x as double)) end as h from embeddings"


@query(f"""with h as ({HISTS}), c as (select a.group_id, case when s11 - s1 * s1 / 64 < 1e-9 or s22 - s2 * s2 / 64 < 1e-9 then 1 else (s12 - s1 * s2 / 64) / sqrt((s11 - s1 * s1 / 64) * (s22 - s2 * s2 / 64)) end as c from (select a.group_id, a.pos, b.pos as bpos, list_sum(a.h) as s1, list_sum(b.h) as s2, list_inner_product(a.h, b.h) as s12, list_inner_product(a.h, a.h) as s11, list_inner_product(b.h, b.h) as s22 from h a join h b on a.group_id = b.group_id and a.pos < b.pos where a.h is not null and b.h is not null) a)
select group_id, n, comparadas, round(coalesce(lo, 1), 4) as similitud_minima, round(mean, 4) as similitud_media, coalesce(lo, 1) >= 0.55e0 as coherente,
 case when comparadas <= 1 then '{concordance.ONE}' when coalesce(lo, 1) >= 0.55e0 then '{concordance.SAME}' else '{concordance.OTHER}' end as mensaje from (select group_id, count(*) as n, count(h) as comparadas from h group by 1) left join (select group_id, min(c) as lo, avg(c) as mean from c group by 1) using (group_id)""")
def same_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.col("embedding").cast("array<double>")
    hist = F.when(F.col("vec_id") % 9 == 4, None).when(F.col("vec_id") % 25 == 7, F.transform(own, lambda x: F.lit(1.0))).otherwise(own)
    df = A.table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("group_id"), (F.col("vec_id") % 4).alias("pos"), hist.alias("hist"))
    return concordance.same_subject(df)


@query(f"select group_id, round(avg(prob), 6) as prob from ({VIEWS}) group by 1")
def mean_of_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ensembles.mean_score(_views(spark, sf_dir), "group_id"))


@query(f"select group_id, max(prob) as prob_max, count(*) as n_recortes, round(avg(prob) filter (rn <= 3), 6) as prob_top3, round(avg(prob) filter (rn <= 3), 6) as prob from (select *, row_number() over (partition by group_id order by prob desc) as rn from ({VIEWS})) group by 1")
def crop_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ensembles.crop_scores(_views(spark, sf_dir), "group_id", choose="top3"))


@query(f"select group_id, photo_id, prob, rn as rank from (select *, row_number() over (partition by group_id order by prob desc, photo_id) as rn from ({VIEWS})) where rn <= 3")
def top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ensembles.top_scores(_views(spark, sf_dir), "group_id", tie="photo_id").select("group_id", "photo_id", "prob", "rank"))


SHOWN = "string_agg(cast(cast(round({0}, 6) as decimal(18, 6)) as varchar), ' ' order by seed)"


@query(f"with s as (select seed, avg(prob) as a, avg(cast(label as double)) as b from ({P}) group by 1) select 'a' as metrica, round(avg(a), 6) as media, round(stddev_samp(a), 6) as std, {SHOWN.format("a")} as valores from s union all select 'b', round(avg(b), 6), round(stddev_samp(b), 6), {SHOWN.format("b")} from s")
def seed_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = A.predictions(spark, sf_dir).groupBy("seed").agg(F.avg("prob").alias("a"), F.avg("label").alias("b"))
    out = ensembles.seed_spread(one, ["a", "b"])
    shown = F.array_join(F.transform("valores", lambda v: F.round(v, 6).cast("decimal(18,6)").cast("string")), " ")
    return rounded(out.select("metrica", "media", "std", shown.alias("valores")))


SEEDED = f"""with f as (select seed, source as estrategia, grupo, cast(count(*) filter (label = 1 and prob < 0.5e0) as double) / count(*) filter (label = 1) as fnr from ({P}) group by all),
gaps as (select seed, estrategia, max(fnr) - min(fnr) as brecha_fnr, max(case when grupo = 'O1' then fnr end) as banda from f group by all)
"""


def _gaps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    each = metrics.binary_metrics(A.predictions(spark, sf_dir), 0.5, by=["seed", "source", "grupo"]).withColumnRenamed("source", "estrategia")
    return each.groupBy("seed", "estrategia").agg((F.max("fnr") - F.min("fnr")).alias("brecha_fnr")), each.filter("grupo = 'O1'").select("estrategia", "seed", "fnr")


@query(SEEDED + "select estrategia, round(avg(brecha_fnr), 6) as brecha_media, round(stddev_samp(brecha_fnr), 6) as brecha_std, count(*) as semillas, round(avg(banda), 6) as fnr_medio_banda from gaps group by 1")
def strategies_over_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(thresholds.over_seeds(*_gaps(spark, sf_dir)))


CONFIGURED = f"select seed as orden, 'c' || seed as configuracion, round(avg(abs(prob - label)), 3) as error, seed % 3 <> 0 as desplegable from ({P}) group by seed"


@query(f"select (list(configuracion order by error desc, orden))[1] as mejor, (list(configuracion order by error desc, orden) filter (desplegable))[1] as mejor_desplegable from ({CONFIGURED})")
def best_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = A.predictions(spark, sf_dir).groupBy(F.col("seed").alias("orden")).agg(F.round(F.avg(F.abs(F.col("prob") - F.col("label"))), 3).alias("error"))
    table = table.withColumns({"configuracion": F.concat(F.lit("c"), F.col("orden").cast("string")), "desplegable": F.col("orden") % 3 != 0})
    return thresholds.best_configuration(table, "error")


HISTORY = "select o_custkey as run, row_number() over (partition by o_custkey order by o_orderkey) as epoch, cast(cast(floor(o_totalprice) as bigint) % 100 as double) / 100e0 as val_auroc, cast(o_orderkey % 100 as double) / 100e0 as train_auroc from orders"


@query(f"with h as ({HISTORY}) select run, (list(epoch order by val_auroc desc, epoch))[1] as mejor_epoca, max(val_auroc) as mejor_val_auroc, max(epoch) as ultima_epoca, round((list(train_auroc - val_auroc order by epoch desc))[1], 6) as brecha_final from h group by run")
def training_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    epoch = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    history = A.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), epoch.alias("epoch"), ((F.floor("o_totalprice").cast("long") % 100).cast("double") / 100.0).alias("val_auroc"), ((F.col("o_orderkey") % 100).cast("double") / 100.0).alias("train_auroc")
    )
    return rounded(ensembles.training_report(history))


# --- pixels -------------------------------------------------------------------------------------


@query(f"select cast(vec_id as varchar) as photo_id, round_even(avg(g) / 255e0, 4) as brillo_medio, round_even(avg(case when g >= 250 then 1e0 else 0e0 end), 4) as fraccion_quemada, round_even(avg(case when g <= 5 then 1e0 else 0e0 end), 4) as fraccion_apagada, round_even((quantile_cont(g, 0.99) - quantile_cont(g, 0.01)) / 255e0, 4) as rango_dinamico from ({A.GRAY}) group by 1")
def photo_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.measure(A.photos(spark, sf_dir), 8).select("photo_id", "brillo_medio", "fraccion_quemada", "fraccion_apagada", "rango_dinamico")


FLIPPED = {"original": "i - 1", "horizontal": "(i - 1) // 8 * 8 + 7 - (i - 1) % 8", "vertical": "(7 - (i - 1) // 8) * 8 + (i - 1) % 8", "ambos": "64 - i"}


@query(" union all ".join(f"select cast(vec_id as varchar) as photo_id, '{v}' as view, string_agg(printf('%02X', g), '' order by {at}) as datos from ({A.GRAY}) group by vec_id" for v, at in FLIPPED.items()))
def flip_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.flip_views(A.photos(spark, sf_dir)).select("photo_id", "view", F.hex("data").alias("datos"))


@query("""with s as (select p_partkey, 40 + p_size * 10 as width, 30 + p_size * 7 as height from part), d as (select distinct p_partkey, width, height, cast(floor(least(width, height) * k) as int) as side from s, (values (1e0), (0.6e0), (0.4e0)) t(k)),
k as (select * from d where side >= 64)
select cast(p_partkey as varchar) as photo_id, 0 as x, 0 as y, null as side from s where least(width, height) < 64 union all
select cast(p_partkey as varchar) as photo_id, cast(x as bigint) as x, cast(y as bigint) as y, cast(side as bigint) as side from (select *, unnest(generate_series(0, width - side, greatest(1, side // 2))) as x from k) a, lateral (select unnest(generate_series(0, height - side, greatest(1, side // 2))) as y)""")
def crop_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = A.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("photo_id"), (40 + F.col("p_size") * 10).alias("width"), (30 + F.col("p_size") * 7).alias("height"))
    return rounded(measures.crops(size))


@query(f"""with g as (select vec_id, i, g, min(g) over (partition by vec_id) as lo from ({A.GRAY})), e as (select vec_id, sum(g - lo) as total, sum(case when ((i - 1) // 8) between 1 and 6 and ((i - 1) % 8) between 1 and 6 then g - lo else 0 end) as centre from g group by 1)
select cast(vec_id as varchar) as photo_id, round(1 - cast(centre as double) / total, 6) as energia, 1 - cast(centre as double) / total > 0.51e0 as borde from e""")
def attention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.photos(spark, sf_dir).select("photo_id", F.hex("data").alias("h"))
    values: Column = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substr("h", i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    energy = scalars.edge_energy(F.col("v"), 8)
    out = rows.select("photo_id", values.alias("v")).select("photo_id", energy.alias("energia"))
    return out.select("photo_id", F.round("energia", 6).alias("energia"), scalars.looks_at_edge(F.col("energia")).alias("borde"))
