"""Queries over photos made from the given vectors, on files and streams too, with the SQL that gives the same rows.

Twelve vectors make a colour photo of 16 x 16, so 500 vectors are 41 photos, and the 8 vectors left over are in none.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import gate, scalars
from ..functions.pixels import CUBIC
from ..operators import manifest, measures, photo_jobs
from ..sources import photos as source
from ..sources.scratch import deleted, fresh, held
from ..streaming import gate_stream
from . import adapters as A
from . import queries as Q
from .queries import query, rounded

SIDE = 16

# Twelve vectors in a row are a colour photo of 16 x 16: four tiles of 8 x 8 for each of blue, green, red, twice as bright.
PIXELS = f"""
  select t, y, x, c, least(255, 2 * g) as v from (select vec_id // 12 as t, (vec_id % 12) // 4 as c, ((vec_id % 4) // 2) * 8 + (i - 1) // 8 as y, ((vec_id % 4) % 2) * 8 + (i - 1) % 8 as x, g,
    count(*) over (partition by vec_id // 12) as held from ({A.GRAY})) where held = 768
"""
GRAY16 = f"select t, y, x, cast(round_even(0.114e0 * max(case when c = 0 then v end) + 0.587e0 * max(case when c = 1 then v end) + 0.299e0 * max(case when c = 2 then v end), 0) as bigint) as g from ({PIXELS}) group by t, y, x"


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = A.photos(spark, sf_dir).select(F.col("photo_id").cast("long").alias("vec_id"), F.hex("data").alias("h"))
    held = one.groupBy(F.floor(F.col("vec_id") / 12).alias("t")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "h"))).alias("v")).filter(F.size("v") == 12)

    def value(i):
        """Byte i of the photo, row by row, blue green red."""
        y, x, c = F.floor(i / 48), F.floor(i / 3) % 16, i % 3
        tile = F.element_at("v", (4 * c + 2 * F.floor(y / 8) + F.floor(x / 8) + 1).cast("int"))["h"]
        v = F.conv(F.substr(tile, (2 * (8 * (y % 8) + x % 8) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
        return F.lpad(F.hex(F.least(F.lit(255), 2 * v)), 2, "0")

    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(767)), value), ""))
    return held.select(F.col("t").cast("string").alias("photo_id"), F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), data.alias("data"))


def _mirrored(at: str, side: int) -> str:
    return f"case when {at} < 0 then -({at}) when {at} > {side - 1} then {2 * (side - 1)} - ({at}) else {at} end"


def measures_sql(gray: str, pixels: str, side: int) -> str:
    """CTEs that end in `m`: the measures of photos of side x side, from (t, y, x, g) and (t, c, v)."""
    margin = int(side * 0.2)
    inner = side - 2 * margin
    inside = f"y between {margin} and {side - margin - 1} and x between {margin} and {side - margin - 1}"

    def laplacian(name: str, rows: str, n: int) -> str:
        moved = " union all ".join(f"select t, {_mirrored(f'y + {dy}', n)} as y, {_mirrored(f'x + {dx}', n)} as x, y as cy, x as cx, {w} as w from {rows}" for dy, dx, w in ((-1, 0, 1), (1, 0, 1), (0, -1, 1), (0, 1, 1), (0, 0, -4)))
        return f"{name} as (select m.t, cy, cx, sum(w * g) as l from ({moved}) m join {rows} r on m.t = r.t and m.y = r.y and m.x = r.x group by m.t, cy, cx)"

    moved = " union all ".join(
        f"select t, {_mirrored(f'y + {dy}', side)} as y, {_mirrored(f'x + {dx}', side)} as x, y as cy, x as cx, {dx * (2 - abs(dy))} as wx, {dy * (2 - abs(dx))} as wy from pix" for dy in (-1, 0, 1) for dx in (-1, 0, 1)
    )
    centre = f"select t, y - {margin} as y, x - {margin} as x, g from pix where {inside}"
    sharp = "var_pop(l) / (any_value(vg) + 1e-6)"
    return f"""pix as ({gray}), cen as ({centre}), {laplacian("lap", "pix", side)}, {laplacian("lapc", "cen", inner)},
spread as (select t, var_pop(g) as vg, stddev_pop(g) as sg from pix group by t), spreadc as (select t, var_pop(g) as vg from cen group by t),
whole as (select t, var_pop(l) as vl, {sharp} as ng from lap join spread using (t) group by t), loc as (select t, {sharp} as nc from lapc join spreadc using (t) group by t),
sobel as (select m.t, cy as y, cx as x, sqrt(cast(sum(wx * g) as double) * sum(wx * g) + cast(sum(wy * g) as double) * sum(wy * g)) as s from ({moved}) m join pix r on m.t = r.t and m.y = r.y and m.x = r.x group by m.t, cy, cx),
frame as (select t, avg(s) filter ({inside}) as c, avg(s) filter (not ({inside})) as f from sobel group by t),
expo as (select t, avg(g) / 255e0 as brillo, count(*) filter (g >= 250) as quemados, count(*) filter (g <= 5) as apagados, (quantile_cont(g, 0.99) - quantile_cont(g, 0.01)) / 255e0 as rango from pix group by t),
bright as (select t, y * {side} + x as k, y, x from pix where g >= 250),
lab as (select t, k, k as l from bright union select b.t, b.k, lab.l from lab join bright a on a.t = lab.t and a.k = lab.k join bright b on b.t = a.t and abs(b.y - a.y) <= 1 and abs(b.x - a.x) <= 1 where lab.l < b.k),
spots as (select t, l, count(*) as area from (select t, k, min(l) as l from lab group by t, k) group by t, l), spot as (select t, max(area) as mayor, count(*) filter (area > {side * side} * 0.0005e0) as manchas from spots group by t),
means as (select t, avg(v) filter (c = 0) as mb, avg(v) filter (c = 1) as mg, avg(v) filter (c = 2) as mr, (avg(v) filter (c = 0) + avg(v) filter (c = 1) + avg(v) filter (c = 2)) / 3 + 1e-6 as mid from ({pixels}) group by t),
m as (select cast(t as varchar) as photo_id, vl, ng, {"nc" if inner * inner > 64 else "ng as nc"}, brillo, quemados, apagados, rango, coalesce(mayor, 0) as mayor, coalesce(manchas, 0) as manchas, sg / 255 as estructura, frame.c as bordes, frame.c / (f + 1e-6) as ratio,
  greatest(abs(mb - mid), abs(mg - mid), abs(mr - mid)) / mid as tinte, mb, mg, mr from whole join loc using (t) join spread using (t) join frame using (t) join expo using (t) join means using (t) left join spot using (t))"""


SHOWN = f"""photo_id, {SIDE} as ancho, {SIDE} as alto, {SIDE} as lado_corto, round_even(vl, 2) as varianza_laplaciano, round_even(ng, 5) as nitidez_global, round_even(nc, 5) as nitidez_normalizada, round_even(brillo, 4) as brillo_medio, quemados, apagados,
 round_even(rango, 4) as rango_dinamico, mayor, manchas as n_manchas, round_even(estructura, 4) as estructura, round_even(bordes, 3) as bordes_centro, round_even(ratio, 3) as ratio_centro_marco, round_even(tinte, 4) as tinte,
 round_even(mb, 2) as azul, round_even(mg, 2) as verde, round_even(mr, 2) as rojo from m"""


def _as_shown(df: DataFrame, side: int, *more: str) -> DataFrame:
    """Shares as whole numbers of pixels, the rest as measured."""
    pixels = lambda c: F.round(F.col(c) * side * side).cast("long")
    same = ("varianza_laplaciano", "nitidez_global", "nitidez_normalizada", "brillo_medio", "rango_dinamico", "estructura", "bordes_centro", "ratio_centro_marco", "tinte")
    whole = {k: F.get("medias_bgr", F.lit(i)).alias(k) for i, k in enumerate(("azul", "verde", "rojo"))}
    return df.select(
        "photo_id", *(F.col(c).cast("long").alias(c) for c in ("ancho", "alto", "lado_corto", "n_manchas")), *same,
        pixels("fraccion_quemada").alias("quemados"), pixels("fraccion_apagada").alias("apagados"), pixels("fraccion_reflejo_mayor").alias("mayor"), *whole.values(), *more,
    )


@query(f"with recursive {measures_sql(GRAY16, PIXELS, SIDE)} select {SHOWN}")
def photo_measures_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of colour photos at their own size: the central box, spots and colour cast."""
    return _as_shown(measures.measure(tiles(spark, sf_dir), SIDE), SIDE)


HALVED = f"select t, y // 2 as y, x // 2 as x, c, cast(round_even(avg(v), 0) as bigint) as v from ({PIXELS}) group by t, y // 2, x // 2, c"
GRAY8 = GRAY16.replace(PIXELS, HALVED)


@query(f"with recursive {measures_sql(GRAY8, HALVED, 8)} select {SHOWN}")
def photo_measures_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after the photos have shrunk to half their side."""
    return _as_shown(measures.measure(tiles(spark, sf_dir), 8), 8)


# From 16 to 12: in units of a 192nd of the side an old pixel has 12 and a new one 16, and the overlaps are whole numbers.
OVERLAP = "select j, i, least(12 * (i + 1), 16 * (j + 1)) - greatest(12 * i, 16 * j) as o from range(12) a(j), range(16) b(i) where least(12 * (i + 1), 16 * (j + 1)) > greatest(12 * i, 16 * j)"
TWELVE = f"""select t, a.j as y, b.j as x, c, cast(round_even(sum(a.o * b.o * v) / 256e0, 0) as bigint) as v from ({PIXELS}) p join ({OVERLAP}) a on p.y = a.i join ({OVERLAP}) b on p.x = b.i group by all"""
GRAY12 = GRAY16.replace(PIXELS, TWELVE)


@query(f"with recursive {measures_sql(GRAY12, TWELVE, 12)} select {SHOWN}")
def photo_measures_fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after the photos have shrunk by a ratio of 4 to 3."""
    return _as_shown(measures.measure(tiles(spark, sf_dir), 12), 12)


# From 8 to 64 by the bicubic kernel: four old pixels a new one, at 16ths of a pixel, so that all products are exact.
TAPS = f"""select j, least(7, greatest(0, b + k)) as i, case when d <= 1 then (({CUBIC} + 2) * d - ({CUBIC} + 3)) * d * d + 1 when d < 2 then (({CUBIC} * d - 5 * {CUBIC}) * d + 8 * {CUBIC}) * d - 4 * {CUBIC} else 0e0 end as w
  from (select j, k, b, abs(c - (b + k)) as d from (select j, (j + 0.5e0) / 8 - 0.5e0 as c, cast(floor((j + 0.5e0) / 8 - 0.5e0) as bigint) as b from range(64) r(j)), range(-1, 3) s(k))"""
GRAY64 = f"""select t, y, j as x, cast(least(255, greatest(0, round_even(sum(w * g), 0))) as bigint) as g from
  (select vec_id as t, j as y, (i - 1) % 8 as sx, sum(w * g) as g from (select *, (i - 1) // 8 as sy from ({A.GRAY})) join (select j, i as ti, w from ({TAPS})) on sy = ti group by all) join ({TAPS}) k on sx = k.i group by all"""
ENLARGED = measures_sql(GRAY64, f"select t, 0 as c, g as v from ({GRAY64})", 64)
LARGE_RULES = {
    "resolucion": "true", "nitidez": "nc < 0.01e0", "oscura": "brillo < 0.18e0 or apagados / 4096e0 > 0.1e0", "quemada": "brillo > 0.88e0 or quemados / 4096e0 > 0.1e0", "reflejo": "mayor / 4096e0 > 0.04e0",
    "plana": "rango < 0.25e0 or estructura < 0.04e0", "nitidez_justa": "nc >= 0.01e0 and nc < 0.02e0", "descentrada": "ratio < 0.55e0",
}
LARGE_REGLAS = f"array_to_string(list_filter([{', '.join(f'case when {c} then {r!r} end' for r, c in LARGE_RULES.items())}], lambda x: x is not null), '|')"


@query(f"""with recursive {ENLARGED} select photo_id, 8 as ancho, 8 as alto, 8 as lado_corto, round_even(vl, 2) as varianza_laplaciano, round_even(ng, 5) as nitidez_global, round_even(nc, 5) as nitidez_normalizada, round_even(brillo, 4) as brillo_medio,
 quemados, apagados, round_even(rango, 4) as rango_dinamico, mayor, manchas as n_manchas, round_even(estructura, 4) as estructura, round_even(bordes, 3) as bordes_centro, round_even(ratio, 3) as ratio_centro_marco, 0e0 as tinte, 0e0 as azul, 0e0 as verde, 0e0 as rojo,
 'rechazada' as veredicto, {LARGE_REGLAS} as reglas from m""")
def photo_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures and the verdict of every gray photo, enlarged to the side of 64."""
    judged = measures.judged(A.photos(spark, sf_dir), side=64)
    return _as_shown(judged, 64, "veredicto", "reglas")


@query(f"select cast(t as varchar) as photo_id, {SIDE} as ancho, {SIDE} as alto, round({SIDE * SIDE} / 1e6, 2) as megapixeles, {SIDE} as lado_corto from ({PIXELS}) group by t")
def photo_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(measures.resolution(tiles(spark, sf_dir)))


@query(f"""with p as (select t, y, x, max(case when c = 0 then v end) as b, max(case when c = 1 then v end) as g, max(case when c = 2 then v end) as r from ({PIXELS}) group by t, y, x),
h as (select t, case when greatest(b, g, r) = least(b, g, r) then 0 else case when r = greatest(b, g, r) then cast(g - b as double) / (greatest(b, g, r) - least(b, g, r)) when g = greatest(b, g, r) then 2 + cast(b - r as double) / (greatest(b, g, r) - least(b, g, r))
   else 4 + cast(r - g as double) / (greatest(b, g, r) - least(b, g, r)) end * 30e0 end as hue, case when greatest(b, g, r) > 0 then round_even(255e0 * (greatest(b, g, r) - least(b, g, r)) / greatest(b, g, r), 0) else 0 end as s from p),
n as (select t, (cast(round_even(case when hue < 0 then hue + 180 else hue end, 0) as bigint) % 180) * 32 // 180 * 32 + cast(s as bigint) * 32 // 256 as bin, count(*) as n from h group by 1, 2)
select cast(t as varchar) as photo_id, bin, round(n / cast(max(n) over (partition by t) as double), 6) as valor from n""")
def photo_histograms_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of the hue-saturation histogram that are not 0."""
    found = measures.histograms(tiles(spark, sf_dir), SIDE).select("photo_id", F.posexplode("hist").alias("bin", "valor")).filter("valor > 0")
    return rounded(found)


def balanced_sql(means: str) -> str:
    return f"""with means as ({means}), r as (select t, (mb + mg + mr) / 3 as mid, mb, mg, mr from (select t, mb + 1e-6 as mb, mg + 1e-6 as mg, mr + 1e-6 as mr from means)),
done as (select p.t, y, x, c, cast(floor(least(255e0, v * (mid / case c when 0 then mb when 1 then mg else mr end))) as bigint) as v from ({PIXELS}) p join r using (t))
select cast(t as varchar) as photo_id, md5(string_agg(printf('%02X', v), '' order by y, x, c)) as datos from done group by t"""


def _channel_means(where: str) -> str:
    return f"select t, avg(v) filter (c = 0) as mb, avg(v) filter (c = 1) as mg, avg(v) filter (c = 2) as mr from ({PIXELS}) where {where} group by t"


@query(balanced_sql(_channel_means("true")))
def gray_world_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.gray_world(tiles(spark, sf_dir)).select("photo_id", F.md5(F.hex("data")).alias("datos"))


BOXED = balanced_sql(_channel_means("x between t % 8 and t % 8 + 4 and y between 2 and 7")).replace("select cast(t as varchar)", "select t, cast(t as varchar)")


@query(f"select photo_id, case when t % 5 <> 4 then datos end as datos, t % 5 = 4 as sin_caja from ({BOXED})")
def neutral_box_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos balanced by a box; every fifth box lies outside its photo."""
    found, t = tiles(spark, sf_dir), F.col("photo_id").cast("int")
    boxes = found.select("photo_id", F.when(t % 5 == 4, SIDE).otherwise(t % 8).alias("x"), F.lit(2).alias("y"), F.lit(5).alias("w"), F.lit(6).alias("h"))
    return measures.neutral_reference(found, boxes).select("photo_id", F.md5(F.hex("data")).alias("datos"), F.col("error").isNotNull().alias("sin_caja"))


# --- files --------------------------------------------------------------------------------------


def _bmp(width: int, height: int, data: bytes) -> bytes:
    """A 24-bit BMP; rows from the bottom, padded to four bytes."""
    step = 3 * width
    rows = b"".join(data[y * step : (y + 1) * step] + b"\0" * (-step % 4) for y in range(height - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def write_files(files: DataFrame, folder: str) -> str:
    """(name, data) as files of a folder that all tasks see; returns the folder."""
    place, base = fs.FileSystem.from_uri(folder)
    place.create_dir(base, recursive=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, at = fs.FileSystem.from_uri(folder)
        n = 0
        for batch in batches:
            for name, data in zip(batch["name"], batch["data"], strict=True):
                with out.open_output_stream(f"{at}/{name}") as f:
                    f.write(data)
                n += 1
        yield pd.DataFrame({"n": [n]})

    files.select("name", "data").mapInPandas(write, "n long").agg(F.sum("n")).first()
    return folder


def _bmp_files(photos: DataFrame, broken: int | None = None) -> DataFrame:
    """(name, data) of the photos as BMP files; of every seventh, those with the remainder `broken` do not decode."""

    @F.pandas_udf("binary")
    def encode(i: pd.Series, h: pd.Series, w: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([b"BMP broken" if k % 7 == broken else _bmp(x, y, bytes(z)) for k, y, x, z in zip(i, h, w, d, strict=True)])

    number = F.col("photo_id").cast("int")
    return photos.select(F.concat("photo_id", F.when(number % 2 == 0, ".bmp").otherwise(".BMP")).alias("name"), encode(number, "height", "width", "data").alias("data"))


def _photo_folder(spark: SparkSession, sf_dir: str) -> str:
    """The photos as BMP files, every seventh broken, and a text file that is no photo."""
    files = _bmp_files(tiles(spark, sf_dir), 3)
    return write_files(files.unionByName(spark.createDataFrame([("notes.txt", b"no photo")], "name string, data binary")), fresh(spark, "photos"))


def _number() -> Column:
    """The photo's number from where its file lies."""
    return F.regexp_extract("photo_id", r"([0-9]+)\.(?i:bmp)$", 1)


# Thresholds at which the given photos are accepted, in doubt and rejected, by several rules.
U = gate.thresholds(lado_corto_min=8, nitidez_min=16.0, nitidez_dudosa="18", apagada_max=0.3, quemada_max=0.23, estructura_min=0.15, brillo_max=0.9, reflejo_max=0.08, ratio_centro_marco_min=1)
RULES = {
    "nitidez": "nc < 16e0", "oscura": "brillo < 0.18e0 or apagados / 256e0 > 0.3e0", "quemada": "brillo > 0.9e0 or quemados / 256e0 > 0.23e0", "reflejo": "mayor / 256e0 > 0.08e0",
    "plana": "rango < 0.25e0 or estructura < 0.15e0", "tinte_extremo": "tinte > 0.45e0", "nitidez_justa": "nc >= 16e0 and nc < 18e0", "descentrada": "ratio < 1e0", "tinte_moderado": "tinte > 0.22e0 and tinte <= 0.45e0",
}
REGLAS = f"array_to_string(list_filter([{', '.join(f'case when {c} then {r!r} end' for r, c in RULES.items())}], lambda x: x is not null), '|')"
JUDGED = f"""with recursive {measures_sql(GRAY16, PIXELS, SIDE)}, named as (select *, {REGLAS} as reglas from m),
judged as (select *, case when {" or ".join(f"contains('|' || reglas || '|', '|{r}|')" for r in RULES if r not in Q.DOUBTS)} then 'rechazada' when reglas <> '' then 'dudosa' else 'aceptada' end as veredicto from named)
"""


@query(JUDGED + """select count(*) filter (veredicto = 'aceptada') as aceptada, count(*) filter (veredicto = 'dudosa') as dudosa, count(*) filter (veredicto = 'rechazada') as rechazada, count(*) as total,
 round(cast(count(*) filter (veredicto = 'rechazada') as double) / nullif(count(*), 0), 6) as tasa, (select count(*) from m where cast(photo_id as bigint) % 7 = 3) as ilegibles from judged where cast(photo_id as bigint) % 7 <> 3""")
def judged_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of photo files read, measured, judged and reported, with thresholds of its own."""
    folder = _photo_folder(spark, sf_dir)
    out = photo_jobs.judge_folder(spark, folder, fresh(spark, "job"), U, SIDE)
    deleted(spark, folder)  # what is returned reads the job's own files
    return rounded(out)


@query(JUDGED + "select photo_id, veredicto, reglas from judged where cast(photo_id as bigint) % 7 <> 3")
def judged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures file and the reports file of that job, read back and joined by photo."""
    folder, out = _photo_folder(spark, sf_dir), fresh(spark, "job")
    photo_jobs.judge_folder(spark, folder, out, U, SIDE)
    deleted(spark, folder)
    table = spark.read.option("header", True).csv(f"{out}/measures").select("photo_id", "reglas")
    reports = spark.read.schema("photo_id string, veredicto string").json(f"{out}/reports")
    return table.join(reports, "photo_id").select(_number().alias("photo_id"), "veredicto", F.coalesce("reglas", F.lit("")).alias("reglas"))


@query(JUDGED + "select photo_id, veredicto, reglas from judged")
def measured_in_two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder measured when half of its files are there and again when all are; the second run opens only the others, in waves."""
    found, folder, done = tiles(spark, sf_dir), fresh(spark, "photos"), fresh(spark, "measured")
    for part in (0, 1):
        write_files(_bmp_files(found.filter(F.col("photo_id").cast("int") % 2 == part)), folder)
        out = photo_jobs.measure_pending(spark, folder, done, U, SIDE, wave=16)
    deleted(spark, folder)
    return out.select(_number().alias("photo_id"), "veredicto", "reglas")


@query(JUDGED + "select photo_id, veredicto, reglas from judged")
def judged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos that arrive in two batches of files, each judged once by a stream that is started twice."""
    folder, out, checkpoint = (fresh(spark, n) for n in ("arriving", "judged", "progress"))
    found = tiles(spark, sf_dir)
    for part in (0, 1):
        found.filter(F.col("photo_id").cast("int") % 2 == part).write.mode("append").parquet(folder)
        gate_stream.judge_arrivals(gate_stream.arriving(spark, folder, 2), out, checkpoint, U, SIDE).awaitTermination()
    deleted(spark, folder)
    return spark.read.parquet(out).select("photo_id", "veredicto", "reglas")


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Photo files that arrive in two parts, judged and counted by streams that are started twice, and then once more without the last commit.

    Returns the folders of the verdicts and of the counts.
    """
    folder, out, counts, checkpoint = (fresh(spark, n) for n in ("arriving", "judged", "counts", "progress"))
    found = tiles(spark, sf_dir)

    def on() -> None:
        gate_stream.judge_arrivals(gate_stream.arriving_files(spark, folder, 16), out, f"{checkpoint}/judge", U, SIDE).awaitTermination()
        gate_stream.count_arrivals(spark, out, counts, f"{checkpoint}/count").awaitTermination()

    for part in (0, 1):
        write_files(_bmp_files(found.filter(F.col("photo_id").cast("int") % 2 == part), 3), folder)
        on()
    for stream in ("judge", "count"):  # as after a crash between a batch's writing and its commit
        system, base = fs.FileSystem.from_uri(f"{checkpoint}/{stream}/commits")
        last = max(int(f.base_name) for f in system.get_file_info(fs.FileSelector(base)) if f.base_name.isdigit())
        for name in (str(last), f".{last}.crc"):
            if system.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:
                system.delete_file(f"{base}/{name}")
    on()
    deleted(spark, folder)
    return out, counts


@query(JUDGED + "select photo_id, veredicto, reglas from judged where cast(photo_id as bigint) % 7 <> 3")
def judged_file_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of photo files that arrive, one batch of which is run twice."""
    out, _ = _streamed(spark, sf_dir)
    return spark.read.parquet(out).select(_number().alias("photo_id"), "veredicto", "reglas")


@query(JUDGED + "select veredicto, count(*) as n from judged where cast(photo_id as bigint) % 7 <> 3 group by 1")
def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts carried on over those batches."""
    _, counts = _streamed(spark, sf_dir)
    return gate_stream.running_counts(spark, counts)


@query(f"select 'stem' as clave, cast(t as varchar) as nombre from ({PIXELS}) group by t union all select 'name', cast(t as varchar) || case t % 2 when 0 then '.bmp' else '.BMP' end from ({PIXELS}) group by t")
def indexed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the photo folder by name and by name without extension."""
    folder = _photo_folder(spark, sf_dir)
    by = [source.image_index(spark, folder, k, ("bmp",)).select(F.lit(k).alias("clave"), F.col("key").alias("nombre")) for k in ("stem", "name")]
    return by[0].unionByName(by[1])


@query(f"select diagnostic, count(*) as n, count(distinct img_id) as fotos from ({Q.META}) group by 1")
def located_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several CSV files under a folder the one with diagnoses, read with its column names made plain."""
    root = fresh(spark, "metadata")
    meta = Q._meta(spark, sf_dir).select(F.col("img_id").alias(" Img_ID "), F.col("diagnostic").alias("Diagnostic"), F.col("o_orderkey").cast("string").alias("ORDER"))
    A.table(spark, sf_dir, "customer").select("c_custkey", "c_name").coalesce(1).write.option("header", True).csv(f"{root}/a")
    meta.coalesce(1).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/b")
    found = source.read_metadata(spark, source.locate_metadata(spark, root))
    return found.groupBy("diagnostic").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("img_id").alias("fotos"))


@query(Q.PHONE + "select case when label = 1 then 'test' else 'train' end as split, image_path, patient_id from phone")
def written_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written ordered by path, in folders by split, and read back from there."""
    out = fresh(spark, "manifest")
    source.write_manifest(Q._phone(spark, sf_dir).withColumn("split", F.when(F.col("label") == 1, "test").otherwise("train")), out, by_split=True)
    return spark.read.parquet(out).select("split", "image_path", "patient_id")


@query(Q.PHONE + "select count(*) as filas, count(*) > 0 as varios_ficheros, 0 as fuera_de_orden, 0 as solapes from phone")
def manifest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a manifest written as CSV, how many stand behind a later path of their file, and how many files begin before the one before them ends."""
    out = fresh(spark, "manifest")
    with held(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "4"}):
        source.write_manifest(Q._phone(spark, sf_dir), out, kind="csv")
    rows = spark.read.option("header", True).csv(out).withColumns({"file": F.regexp_extract("_metadata.file_name", r"^part-([0-9]+)", 1).cast("int"), "at": F.monotonically_increasing_id()})
    before = F.lag("image_path").over(Window.partitionBy("file").orderBy("at"))
    rows = rows.select("file", "image_path", (before > F.col("image_path")).alias("late"))
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.count_if("late").alias("late"), F.min("image_path").alias("low"), F.max("image_path").alias("high"))
    files = files.withColumn("over", F.lag("high").over(Window.orderBy("file")) > F.col("low"))  # a row a file
    return files.agg(F.sum("n").alias("filas"), (F.count(F.lit(1)) > 1).alias("varios_ficheros"), F.sum("late").alias("fuera_de_orden"), F.count_if("over").alias("solapes"))


# --- manifests of raters and atlas --------------------------------------------------------------

ANSWERS = ("DEFAULT_YES_IMAGE_QUALITY_SUFFICIENT", "NO_IMAGE_QUALITY_INSUFFICIENT", "YES_IMAGE_QUALITY_SUFFICIENT_NO_DISCERNIBLE_PATHOLOGY", "other", None)


def _answer(k: int) -> str:
    return "case (o_orderkey // {d}) % 5 when 0 then 1 when 1 then 0 when 2 then 1 end".format(d=(1, 3, 7)[k])


GRADED = f"""with rated as (select o_orderkey, {_answer(0)} as r1, {_answer(1)} as r2, {_answer(2)} as r3, 'https://x/img/' || o_orderkey || case o_orderkey % 3 when 0 then '.PNG' when 1 then '.jpg' end as image_url,
 case when o_custkey % 7 between 1 and 6 then cast(o_custkey % 7 as varchar) end as tono from orders),
listed as (select *, list_filter([r1, r2, r3], lambda x: x is not null) as v from rated where r1 is not null and image_url is not null)
"""


def _gradability(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = A.table(spark, sf_dir, "orders")
    answers = F.array(*map(F.lit, ANSWERS))
    suffix = F.when(k % 3 == 0, ".PNG").when(k % 3 == 1, ".jpg").otherwise(".gif")
    tone = F.when((F.col("o_custkey") % 7).between(1, 6), F.concat(F.lit("FST"), (F.col("o_custkey") % 7).cast("string")))
    cases = orders.select(k.alias("case_id"), F.concat(F.lit("img/"), k.cast("string"), suffix).alias("image_1_path"), tone.alias("fitzpatrick_skin_type"), F.lit("CLOSE_UP").alias("image_1_shot_type"))
    rated = {f"dermatologist_gradable_for_skin_condition_{j + 1}": F.get(answers, (F.floor(k / d) % 5).cast("int")) for j, d in enumerate((1, 3, 7))}
    labels = orders.select(k.alias("case_id"), *(c.alias(n) for n, c in rated.items()), tone.alias("dermatologist_fitzpatrick_skin_type_label_1"))
    return manifest.gradability_manifest(cases, labels, "https://x")


@query(GRADED + "select cast(o_orderkey as varchar) as case_id, image_url, cast(r1 as bigint) as evaluable, cast(len(v) as bigint) as n_valoraciones, len(v) > 1 and list_min(v) = list_max(v) as unanime, tono as fitzpatrick_derm from listed")
def gradability_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_gradability(spark, sf_dir).select("case_id", "image_url", "evaluable", "n_valoraciones", "unanime", "fitzpatrick_derm"))


@query(GRADED + "select cast(o_orderkey as varchar) as case_id, cast(r1 as bigint) as evaluable from listed where len(v) > 1 and list_min(v) = list_max(v)")
def unanimous_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.agreement import unanimous

    return rounded(unanimous(_gradability(spark, sf_dir)).select("case_id", "evaluable"))


@query(GRADED + "select '/fotos/' || o_orderkey || '.jpg' as image_path, cast(o_orderkey as varchar) as patient_id, cast(1 - r1 as bigint) as label, 'CLOSE_UP' as view, coalesce(tono, 'UNKNOWN') as fitzpatrick from listed where o_orderkey % 4 <> 2")
def not_gradable_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only cases whose photo has been fetched; label 1 is not gradable."""
    files = A.table(spark, sf_dir, "orders").filter("o_orderkey % 4 <> 2").select(F.col("o_orderkey").cast("string").alias("key"), F.explode(F.array(F.lit(".png"), F.lit(".jpg"))).alias("ext"))
    files = files.select("key", F.concat(F.lit("/fotos/"), "key", "ext").alias("path"))
    return rounded(manifest.not_gradable_manifest(_gradability(spark, sf_dir), files).select("image_path", "patient_id", "label", "view", "fitzpatrick"))


ATLAS = """select cast(p_partkey as varchar) as md5hash, case p_partkey % 4 when 0 then 'malignant' when 1 then 'benign' when 2 then 'non-neoplastic' end as three_partition_label,
 case p_partkey % 5 when 0 then '1 Diagnostic' when 1 then '3 Wrongly labelled' when 2 then 'WRONGLY labelled' end as qc, cast(p_size % 8 as varchar) as fitzpatrick_scale, p_type as label from part"""


@query(f"""select '/atlas/' || md5hash || '.png' as image_path, md5hash as patient_id, cast(case when three_partition_label = 'malignant' then 1 else 0 end as bigint) as label,
 case when cast(fitzpatrick_scale as int) between 1 and 2 then '1-2 clara' when cast(fitzpatrick_scale as int) between 3 and 4 then '3-4 media' when cast(fitzpatrick_scale as int) between 5 and 6 then '5-6 oscura' else 'UNKNOWN' end as fitzpatrick,
 fitzpatrick_scale as fitzpatrick_exacto, label as diagnostico from ({ATLAS}) where three_partition_label in ('malignant', 'benign') and not coalesce(contains(lower(qc), 'wrongly'), false)""")
def atlas_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    part = A.table(spark, sf_dir, "part").select(
        k.cast("string").alias("md5hash"),
        F.when(k % 4 == 0, "malignant").when(k % 4 == 1, "benign").when(k % 4 == 2, "non-neoplastic").alias("three_partition_label"),
        F.when(k % 5 == 0, "1 Diagnostic").when(k % 5 == 1, "3 Wrongly labelled").when(k % 5 == 2, "WRONGLY labelled").alias("qc"),
        (F.col("p_size") % 8).cast("string").alias("fitzpatrick_scale"),
        F.col("p_type").alias("label"),
    )
    index = part.select(F.col("md5hash").alias("key"), F.concat(F.lit("/atlas/"), "md5hash", F.lit(".png")).alias("path"))
    out = manifest.atlas_manifest(part, index).select("image_path", "patient_id", "label", "fitzpatrick", "fitzpatrick_exacto", "diagnostico")
    return rounded(out)
