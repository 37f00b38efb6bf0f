"""The given tables read as predictions, measures, photos and manifests, each with the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PREDICTIONS = """
  select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as image_path,
    case when l_returnflag = 'R' then 1 else 0 end as label,
    cast(cast(floor(l_extendedprice) as bigint) % 1000 as double) / cast(1000 as double) as prob,
    l_linestatus || cast(cast(floor((l_quantity - 1) / 17) as int) as varchar) as grupo,
    cast(1 + l_partkey % 6 as varchar) as fitzpatrick,
    case when l_linenumber % 2 = 0 then 'F' else 'M' end as sex,
    case when l_partkey % 3 = 0 then 'a' when l_partkey % 3 = 1 then 'b' else 'c' end as source,
    l_suppkey as patient_id,
    case when l_suppkey % 5 = 0 then 'test' when l_suppkey % 5 = 1 then 'val' else 'train' end as split,
    cast(l_linenumber as bigint) as seed, l_quantity
  from lineitem
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("image_path"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        ((F.floor("l_extendedprice").cast("long") % 1000).cast("double") / F.lit(1000.0)).alias("prob"),
        F.concat("l_linestatus", F.floor((F.col("l_quantity") - 1) / 17).cast("int").cast("string")).alias("grupo"),
        (1 + F.col("l_partkey") % 6).cast("string").alias("fitzpatrick"),
        F.when(F.col("l_linenumber") % 2 == 0, "F").otherwise("M").alias("sex"),
        F.when(F.col("l_partkey") % 3 == 0, "a").when(F.col("l_partkey") % 3 == 1, "b").otherwise("c").alias("source"),
        F.col("l_suppkey").alias("patient_id"),
        F.when(F.col("l_suppkey") % 5 == 0, "test").when(F.col("l_suppkey") % 5 == 1, "val").otherwise("train").alias("split"),
        F.col("l_linenumber").cast("long").alias("seed"),
        "l_quantity",
    )


MEASURES = """
  select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as photo_id,
    200 + l_partkey % 400 as lado_corto,
    case when l_linenumber = 7 then null else l_discount * 0.4e0 end as nitidez_normalizada,
    l_discount * 0.5e0 as nitidez_global,
    l_quantity / 50e0 as brillo_medio, l_tax * 1.5e0 as fraccion_quemada, l_discount * 1.2e0 as fraccion_apagada,
    cast(l_orderkey % 10 as double) / 10e0 as rango_dinamico, cast(l_partkey % 50 as double) / 1000e0 as fraccion_reflejo_mayor,
    cast(l_suppkey % 25 as double) / 100e0 as estructura, cast(l_orderkey % 20 as double) / 10e0 as ratio_centro_marco,
    cast(l_partkey % 60 as double) / 100e0 as tinte,
    cast(1 + l_partkey % 6 as varchar) as fitzpatrick,
    case when l_returnflag = 'R' then 1 else 0 end as no_evaluable
  from lineitem
"""


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")

    def part(column: str, modulus: int, scale: float):
        return (F.col(column) % modulus).cast("double") / F.lit(scale)

    return li.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("photo_id"),
        (200 + F.col("l_partkey") % 400).alias("lado_corto"),
        F.when(F.col("l_linenumber") == 7, float("nan")).otherwise(F.col("l_discount") * 0.4).alias("nitidez_normalizada"),
        (F.col("l_discount") * 0.5).alias("nitidez_global"),
        (F.col("l_quantity") / 50.0).alias("brillo_medio"),
        (F.col("l_tax") * 1.5).alias("fraccion_quemada"),
        (F.col("l_discount") * 1.2).alias("fraccion_apagada"),
        part("l_orderkey", 10, 10.0).alias("rango_dinamico"),
        part("l_partkey", 50, 1000.0).alias("fraccion_reflejo_mayor"),
        part("l_suppkey", 25, 100.0).alias("estructura"),
        part("l_orderkey", 20, 10.0).alias("ratio_centro_marco"),
        part("l_partkey", 60, 100.0).alias("tinte"),
        (1 + F.col("l_partkey") % 6).cast("string").alias("fitzpatrick"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("no_evaluable"),
    )


GRAY = """
  select vec_id, i, cast(floor(255e0 * (v - lo) / (hi - lo) + 0.5e0) as bigint) as g from (
    select vec_id, cast(i as bigint) as i, cast(embedding[i] as double) as v,
      min(cast(embedding[i] as double)) over (partition by vec_id) as lo, max(cast(embedding[i] as double)) over (partition by vec_id) as hi
    from embeddings, generate_series(1, 64) t(i)) where hi > lo
"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector of 64 numbers as a gray 8 x 8 photo, its least number black and its largest white."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    out = table(spark, sf_dir, "embeddings").withColumn("v", v).withColumn("lo", F.array_min("v")).withColumn("hi", F.array_max("v")).filter("hi > lo")
    gray = F.transform("v", lambda x: F.floor(F.lit(255.0) * (x - F.col("lo")) / (F.col("hi") - F.col("lo")) + 0.5).cast("int"))
    data = F.unhex(F.array_join(F.transform(gray, lambda g: F.lpad(F.hex(g), 2, "0")), ""))
    return out.select(F.col("vec_id").cast("string").alias("photo_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data"), "label")


RATERS = """
  select doc_id, quality as r1, toxic as r2, case when doc_id % 3 = 0 then null else cast(doc_id % 2 as int) end as r3 from labels
"""


def raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("r1"), F.col("toxic").alias("r2"), F.when(F.col("doc_id") % 3 == 0, None).otherwise((F.col("doc_id") % 2).cast("int")).alias("r3"))
