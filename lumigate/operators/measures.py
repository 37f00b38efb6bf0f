"""Measures of photos as Spark jobs: one pass over image rows, map only, pixels never shuffled.

Image rows are (photo_id, height, width, nChannels, mode, data) as Spark's image source gives them
(BGR, row by row); other columns are ignored. Rows that are not photos drop out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gate, pixels

PIXEL_MEASURES = (
    "varianza_laplaciano double, nitidez_global double, nitidez_normalizada double, brillo_medio double, fraccion_quemada double, fraccion_apagada double, "
    "rango_dinamico double, fraccion_reflejo_mayor double, n_manchas int, estructura double, bordes_centro double, ratio_centro_marco double, tinte double, medias_bgr array<double>"
)
MEASURES = "ancho int, alto int, megapixeles double, lado_corto int, " + PIXEL_MEASURES
PHOTO = ("photo_id", "height", "width", "nChannels", "data")


def resolution(photos: DataFrame) -> DataFrame:
    """photo_id, ancho, alto, megapixeles, lado_corto from the stored size alone: no pixels are read."""
    return photos.select("photo_id", F.col("width").alias("ancho"), F.col("height").alias("alto"), F.round(F.col("width").cast("long") * F.col("height") / 1e6, 2).alias("megapixeles"), F.least("width", "height").alias("lado_corto"))


def image(row) -> np.ndarray:
    """The pixels of an image row; alpha is dropped."""
    flat = np.frombuffer(row.data, dtype=np.uint8)
    if row.nChannels == 1:
        return flat.reshape(row.height, row.width)
    return flat.reshape(row.height, row.width, row.nChannels)[:, :, :3]


def _each(photos: DataFrame, columns: tuple[str, ...], work: Callable, schema: str) -> DataFrame:
    """work(row) -> list of dicts, for each readable photo; the photo's bytes are let go after each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [d for row in batch.itertuples(index=False) for d in work(row)]
            names = [c.split(" ")[0] for c in schema.split(", ")]
            yield pd.DataFrame(out, columns=names)

    return photos.filter("height > 0 and width > 0").select(*columns).mapInPandas(run, schema)


def _whole(photos: DataFrame, side: int) -> DataFrame:
    """The measures before they are rounded."""
    return _each(photos, PHOTO, lambda row: [{"photo_id": row.photo_id} | pixels.measure(image(row), side)], "photo_id string, " + MEASURES)


def _shown() -> dict[str, Column]:
    """Measures to the digits of their reports; a half goes to the even digit."""

    def cut(value: Column, digits: int) -> Column:
        return F.rint(value * 10.0**digits) / 10.0**digits

    kept = {c: d for c, d in pixels.DIGITS.items() if c != "medias_bgr"}
    return {c: cut(F.col(c), d) for c, d in kept.items()} | {"medias_bgr": F.transform("medias_bgr", lambda v: cut(v, pixels.DIGITS["medias_bgr"]))}


def measure(photos: DataFrame, side: int = pixels.CANONICAL_SIDE) -> DataFrame:
    """photo_id and all measures, one flat row a photo."""
    return _whole(photos, side).withColumns(_shown())


def judging(u: gate.Thresholds | None = None, side: int = pixels.CANONICAL_SIDE) -> Callable[[DataFrame], DataFrame]:
    """`judged` for many tables, with columns that are made once: making them takes the driver longer than Spark takes for a few photos."""
    steps = [*gate.added(u), _shown()]
    return lambda photos: reduce(DataFrame.withColumns, steps, _whole(photos, side))


def judged(photos: DataFrame, u: gate.Thresholds | None = None, side: int = pixels.CANONICAL_SIDE) -> DataFrame:
    """The measures with their verdicts. Rules read the measures before they are rounded, so that none lands on a threshold by its last digit."""
    return judging(u, side)(photos)


def histograms(photos: DataFrame, side: int = pixels.HISTOGRAM_SIDE) -> DataFrame:
    """photo_id, hist: the hue-saturation histogram (1024 numbers), made once a photo."""
    return _each(photos, PHOTO, lambda row: [{"photo_id": row.photo_id, "hist": pixels.hue_saturation(image(row), side)}], "photo_id string, hist array<double>")


def _row(row, data: np.ndarray | None, **more) -> dict:
    return {"photo_id": row.photo_id, "height": row.height, "width": row.width, "nChannels": min(row.nChannels, 3), "data": None if data is None else np.ascontiguousarray(data).tobytes()} | more


BOXES = 200_000  # of 40 bytes each, broadcast at a time
_PIXELS = "photo_id string, height int, width int, nChannels int, data binary"


def gray_world(photos: DataFrame) -> DataFrame:
    return _each(photos, PHOTO, lambda row: [_row(row, pixels.gray_world(image(row)))], _PIXELS)


def neutral_reference(photos: DataFrame, boxes: DataFrame) -> DataFrame:
    """Photos balanced by their box (photo_id, x, y, w, h); a bad box gives no pixels and says so in `error`.

    Boxes go to the photos, never pixels to the boxes: they are counted, and broadcast in slices of at most about BOXES.
    """

    def work(row) -> list[dict]:
        try:
            return [_row(row, pixels.neutral_box(image(row), row.x, row.y, row.w, row.h), error=None)]
        except ValueError as e:
            return [_row(row, None, error=str(e))]

    n = boxes.count()
    slices = max(1, -(-n // BOXES))
    parts = [boxes] if slices == 1 else [boxes.filter(F.pmod(F.xxhash64("photo_id"), F.lit(slices)) == k) for k in range(slices)]
    met = [photos.join(F.broadcast(part.select("photo_id", "x", "y", "w", "h")), "photo_id") for part in parts]
    return reduce(DataFrame.unionByName, (_each(rows, (*PHOTO, "x", "y", "w", "h"), work, _PIXELS + ", error string") for rows in met))


def flip_views(photos: DataFrame) -> DataFrame:
    """Four rows a photo, keyed by (photo_id, view)."""
    return _each(photos, PHOTO, lambda row: [_row(row, v, view=k) for k, v in pixels.flips(image(row)).items()], _PIXELS + ", view string")


def crops(photos: DataFrame, scales: tuple[float, ...] = (1.0, 0.6, 0.4), step: float = 0.5, least: int = 64) -> DataFrame:
    """photo_id, x, y, side: squares at several scales of the short side, half overlapping; geometry only.

    A photo in which no square has the least side gives one row for the whole photo, with side null.
    """
    short = F.least("width", "height")

    def starts(length: Column, side: Column) -> Column:
        hop = F.greatest(F.lit(1), (side * step).cast("int"))
        return F.sequence(F.lit(0), length - side, hop)

    sides = F.filter(F.array_distinct(F.transform(F.array(*map(F.lit, scales)), lambda s: (short * s).cast("int"))), lambda s: s >= least)
    out = photos.filter("height > 0 and width > 0").select("photo_id", "width", "height", F.explode_outer(sides).alias("side"))
    places = lambda length: F.when(F.col("side").isNull(), F.array(F.lit(0))).otherwise(starts(F.col(length), F.col("side")))
    out = out.select("photo_id", "height", "side", F.explode(places("width")).alias("x"))
    return out.select("photo_id", "x", F.explode(places("height")).alias("y"), "side")
