"""Manifests: metadata joined with files, filtered, normalised, combined, described."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .agreement import rater_agreement
from .splits import grouped_split

COMMON = ("image_path", "patient_id", "label", "source", "view", "sex", "age", "fitzpatrick")


def dedupe_index(index: DataFrame, prefer: Sequence[str] = ("jpg", "png")) -> DataFrame:
    """One path a key: by preferred extension, then path."""
    extension = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, prefer)), extension), F.lit(0)), F.lit(len(prefer) + 1))
    w = Window.partitionBy("key").orderBy(rank, "path")
    return index.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def with_files(meta: DataFrame, index: DataFrame, key: str, prefer: Sequence[str] = ("jpg", "png")) -> tuple[DataFrame, DataFrame]:
    """(rows with image_path, rows without a file)."""
    once = dedupe_index(index, prefer).select(F.col("key").alias(key), F.col("path").alias("image_path"))
    return meta.join(once, key), meta.join(once, key, "left_anti")


def cases_with_labels(cases: DataFrame, labels: DataFrame, key: str = "case_id") -> DataFrame:
    """Inner join; columns of labels that clash get the suffix _lab."""
    renamed = labels.select(key, *(F.col(c).alias(f"{c}_lab" if c in cases.columns else c) for c in labels.columns if c != key))
    return cases.join(renamed, key)


def fetched_only(manifest: DataFrame, files: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows whose photo has been fetched, with its path."""
    return manifest.join(dedupe_index(files).select(F.col("key").alias(key), F.col("path").alias("image_path")), key)


def phone_manifest(meta: DataFrame, index: DataFrame, biopsied_only: bool = False) -> DataFrame:
    """The phone-photo dataset's manifest from metadata with lower-case column names. Unknown diagnoses drop out."""
    columns = meta.columns
    image = next((c for c in columns if c in ("img_id", "image", "img")), None)
    if image is None:
        raise KeyError(f"no image column in {columns}")
    tone = next((c for c in columns if "fitspatrick" in c or "fitzpatrick" in c), None)
    patient = next((c for c in columns if c in ("patient_id", "patient")), None)
    rows, _ = with_files(meta, index, image)
    rows = rows.withColumn("label", S.binary_label(F.col("diagnostic"))).filter("label is not null")
    if biopsied_only and "biopsed" in columns:
        rows = rows.filter(S.biopsied(F.col("biopsed")))
    missing = F.lit(S.UNKNOWN)
    return rows.select(
        "image_path",
        (F.col(patient).cast("string") if patient else S.patient_id(F.col(image))).alias("patient_id"),
        "label",
        F.lit("pad_ufes_20").alias("source"),
        (S.known(F.col("region")) if "region" in columns else missing).alias("view"),
        (S.sex(F.col("gender")) if "gender" in columns else missing).alias("sex"),
        (S.age(F.col("age")) if "age" in columns else F.lit(None).cast("double")).alias("age"),
        (S.tone_code(F.col(tone)) if tone else missing).alias("fitzpatrick"),
        S.diagnosis(F.col("diagnostic")).alias("diagnostico"),
        (S.known(F.col("biopsed")) if "biopsed" in columns else missing).alias("biopsiado"),
    )


def atlas_manifest(meta: DataFrame, index: DataFrame) -> DataFrame:
    """The atlas dataset's manifest: neoplastic rows that are not marked wrong, tones as bands, one patient a photo."""
    rows = S.neoplastic(meta)
    if "qc" in meta.columns:
        rows = S.drop_mislabelled(rows)
    rows, _ = with_files(rows, index, "md5hash", ("png", "jpg"))
    missing = F.lit(S.UNKNOWN)
    return rows.select(
        "image_path",
        F.col("md5hash").alias("patient_id"),
        (F.col("three_partition_label") == "malignant").cast("int").alias("label"),
        F.lit("fitzpatrick17k").alias("source"),
        (S.known(F.col("nine_partition_label")) if "nine_partition_label" in meta.columns else missing).alias("view"),
        missing.alias("sex"),
        F.lit(None).cast("double").alias("age"),
        S.tone_band_of_integer(F.col("fitzpatrick_scale")).alias("fitzpatrick"),
        S.tone_exact(F.col("fitzpatrick_scale")).alias("fitzpatrick_exacto"),
        F.col("label").alias("diagnostico"),
    )


def gradability_manifest(cases: DataFrame, labels: DataFrame, base_url: str) -> DataFrame:
    """Volunteer cases with raters' answers: case_id, image_url, evaluable, n_valoraciones, unanime, tones, shot_type.

    Cases without a first rating or with another kind of file drop out.
    """
    answers = [f"dermatologist_gradable_for_skin_condition_{k}" for k in (1, 2, 3)]
    rows = cases_with_labels(cases, labels)
    rows = rows.withColumns({f"r{k}": S.gradable(F.col(a)) for k, a in enumerate(answers, 1)})
    rows = rater_agreement(rows, ["r1", "r2", "r3"])
    digit = lambda c: F.nullif(S.fst_digit(F.col(c)), F.lit(S.UNKNOWN))
    out = rows.select(
        F.col("case_id").cast("string").alias("case_id"),
        S.image_url(base_url, F.col("image_1_path")).alias("image_url"),
        F.col("r1").alias("evaluable"),
        "n_valoraciones",
        "unanime",
        digit("dermatologist_fitzpatrick_skin_type_label_1").alias("fitzpatrick_derm"),
        digit("fitzpatrick_skin_type").alias("fitzpatrick_self"),
        S.known(F.col("image_1_shot_type")).alias("shot_type"),
    )
    return out.filter("image_url is not null and evaluable is not null")


def not_gradable_manifest(gradability: DataFrame, files: DataFrame) -> DataFrame:
    """The common manifest of fetched photos, label 1 = not gradable, a case as patient."""
    missing = F.lit(S.UNKNOWN)
    return fetched_only(gradability, files).select(
        "image_path",
        F.col("case_id").alias("patient_id"),
        S.not_gradable(F.col("evaluable")).alias("label"),
        F.lit("scin").alias("source"),
        F.col("shot_type").alias("view"),
        missing.alias("sex"),
        F.lit(None).cast("double").alias("age"),
        F.coalesce("fitzpatrick_derm", missing).alias("fitzpatrick"),
    )


def unknown_diagnoses(meta: DataFrame, column: str = "diagnostic") -> DataFrame:
    """Diagnoses that are in neither list, with their counts."""
    return meta.groupBy(S.diagnosis(F.col(column)).alias("diagnostico")).agg(F.count(F.lit(1)).alias("n")).filter(~F.coalesce(F.col("diagnostico").isin(*S.MALIGNANT, *S.BENIGN), F.lit(False)))


def combine(manifests: Sequence[DataFrame], seed: int = 42) -> DataFrame:
    """The common columns of several manifests, tones as bands, patients named by source, split anew."""
    out = None
    for m in manifests:
        part = m.select(*COMMON).withColumns({"fitzpatrick": S.tone_band(F.col("fitzpatrick")), "patient_id": S.namespaced_patient(F.col("source"), F.col("patient_id"))})
        out = part if out is None else out.unionByName(part)
    return grouped_split(out, seed=seed)


def cross_tab(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of row by column; absent pairs are 0; rows without either drop out."""
    kept = df.filter(F.col(row).isNotNull() & F.col(column).isin(*values))
    return kept.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def profile(df: DataFrame, columns: Sequence[str] = ("diagnostico", "fitzpatrick")) -> DataFrame:
    """columna, valor, n: how often each value occurs, from one pass."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("columna"), F.col(c).cast("string").alias("valor")) for c in columns))).alias("x")).select("x.*")
    return long.filter("valor is not null").groupBy("columna", "valor").agg(F.count(F.lit(1)).alias("n"))


def totals(df: DataFrame, patient: str = "patient_id", label: str = "label") -> DataFrame:
    """filas, pacientes, positivos (share), and rows per patient: mean and most."""
    people = df.groupBy(patient).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("y"))
    return people.agg(
        F.sum("n").alias("filas"), F.count(patient).alias("pacientes"), (F.sum("y") / F.sum("n")).alias("positivos"), F.avg(F.when(F.col(patient).isNotNull(), F.col("n"))).alias("media"), F.max(F.when(F.col(patient).isNotNull(), F.col("n"))).alias("maximo")
    )


def prevalence(df: DataFrame, by: str, label: str = "label") -> DataFrame:
    y = F.col(label).cast("long")
    return df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("malignos"), F.avg(y).alias("prevalencia"))
