"""Whole jobs over photos: a folder measured and judged, and a measuring that goes on where it stopped."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gate, pixels
from ..sources import photos as source
from ..sources.scratch import deleted, fresh
from . import measures

REPORT = ("photo_id", "veredicto", "aceptable", "mensaje", "problemas")


def judge_folder(spark: SparkSession, path: str, out: str, u: gate.Thresholds | None = None, side: int = pixels.CANONICAL_SIDE) -> DataFrame:
    """Reads a folder of photos, measures and judges each once, and writes out/measures (CSV), out/reports (JSON) and out/unreadable (CSV).

    Returns one row: the counts of the verdicts, their total, the rejection rate and the number of unreadable files, read from what was written.
    """
    good, bad = source.split_unreadable(source.read_photos(spark, path))
    judged = measures.judged(good, u, side)
    judged.write.parquet(f"{out}/judged")  # photos are decoded once; the files below come from this table
    kept = spark.read.parquet(f"{out}/judged")
    source.write_measures(kept.drop("problemas"), f"{out}/measures")
    source.write_reports(kept.select(*REPORT), f"{out}/reports")
    bad.select("photo_id").write.option("header", True).csv(f"{out}/unreadable")
    unreadable = spark.read.schema("photo_id string").option("header", True).csv(f"{out}/unreadable").agg(F.count(F.lit(1)).alias("ilegibles"))
    return gate.verdict_counts(kept).withColumn("ilegibles", unreadable.scalar())


WAVE = 50_000  # photos of one durable step; so many paths are on the driver at a time
TASK_PHOTOS = 16  # at least, where a wave has them: small waves run at once, so none need be split further


def complete_runs(spark: SparkSession, done: str) -> list[str]:
    """The folders under `done` whose writing ended; what a killed run left unfinished is not among them."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{done}/run=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(f.getPath().getParent().toString() for f in found or ())


def measured(spark: SparkSession, done: str) -> DataFrame | None:
    """All rows of the complete runs; None before the first."""
    runs = complete_runs(spark, done)
    return spark.read.parquet(*runs) if runs else None


def measure_pending(spark: SparkSession, folder: str, done: str, u: gate.Thresholds | None = None, side: int = pixels.CANONICAL_SIDE, wave: int = WAVE) -> DataFrame:
    """Measures and judges the photos of a folder that `done` lacks, and returns all of it.

    Files are listed, not opened; the listing's keys meet the finished keys, and only files that are left are read and
    decoded, in waves of about `wave`. Paths come to the driver once, WAVE of them dealt by hash at a time, and what comes is cut into its waves, which run
    side by side, one a core. A wave is written to a folder of its own, which counts once it is
    complete, so a run that is cut short loses the waves that were running and the next goes on with what is missing. Files that do not decode
    are tried again each time.
    """
    listed = source.list_photos(spark, folder).select("photo_id", "path")
    before = measured(spark, done)
    todo = listed if before is None else source.pending(listed, before)
    with_wave = fresh(spark, "pending")
    todo.write.parquet(with_wave)  # what is left as of now
    todo = spark.read.parquet(with_wave)
    judged = measures.judging(u, side)
    run, rounds = uuid.uuid4().hex, -(-todo.count() // max(wave, WAVE))

    def measure_wave(name: str, paths: list[str]) -> None:
        good, _ = source.split_unreadable(source.read_listed(spark, paths).coalesce(max(1, len(paths) // TASK_PHOTOS)))
        judged(good).write.parquet(f"{done}/run={run}-{name}")

    for k in range(rounds):
        paths = [r.path for r in todo.filter(F.pmod(F.xxhash64("path"), F.lit(rounds)) == k).select("path").toLocalIterator()]
        n = max(1, round(len(paths) / wave))
        cuts = [j * len(paths) // n for j in range(n + 1)]
        waves = [(f"{k}-{j}", paths[cuts[j] : cuts[j + 1]]) for j in range(n) if cuts[j] < cuts[j + 1]]
        if waves:
            with ThreadPoolExecutor(min(len(waves), spark.sparkContext.defaultParallelism)) as pool:
                for _ in pool.map(inheritable_thread_target(spark)(lambda w: measure_wave(*w)), waves):
                    pass  # an error of one wave comes up here and those not begun are left
    deleted(spark, with_wave)
    found = measured(spark, done)
    return found if found is not None else judged(spark.createDataFrame([], source.PHOTO_SCHEMA))
