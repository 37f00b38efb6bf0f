"""Column functions of manifests and scores.

Missing values are UNKNOWN (never the text "nan"); casts never throw; NaN counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the datasets.
MALIGNANT = ("BCC", "SCC", "MEL")
BENIGN = ("ACK", "NEV", "SEK")
YES = ("TRUE", "1", "YES")
NEOPLASTIC = ("malignant", "benign")
GRADABLE = {
    "DEFAULT_YES_IMAGE_QUALITY_SUFFICIENT": 1,
    "YES_IMAGE_QUALITY_SUFFICIENT_NO_DISCERNIBLE_PATHOLOGY": 1,
    "NO_IMAGE_QUALITY_INSUFFICIENT": 0,
}
TONE_BANDS = ("1-2 clara", "3-4 media", "5-6 oscura")
BAND_EDGES = (0.0, 0.05, 0.15, 0.35, 0.65, 1.01)
UNKNOWN = "UNKNOWN"


def number(col: Column) -> Column:
    """A double, or null for anything that is not one."""
    return F.nanvl(col.cast("string").try_cast("double"), F.lit(None).cast("double"))


def known(col: Column) -> Column:
    text = F.trim(col.cast("string"))
    return F.when(text.isNull() | (text == "") | (F.lower(text) == "nan"), F.lit(UNKNOWN)).otherwise(text)


def patient_id(name: Column) -> Column:
    """PAT_100_393_595.png -> PAT_100; the whole name where there is no such start."""
    found = F.regexp_extract(name, r"(?i)^(PAT_\d+)", 1)
    return F.when(found != "", F.upper(found)).otherwise(name)


def diagnosis(col: Column) -> Column:
    return F.upper(F.trim(col))


def binary_label(col: Column) -> Column:
    """1 malignant, 0 benign, null for any other diagnosis."""
    code = diagnosis(col)
    return F.when(code.isin(*MALIGNANT), 1).when(code.isin(*BENIGN), 0)


def biopsied(col: Column) -> Column:
    return F.coalesce(F.upper(F.trim(col.cast("string"))).isin(*YES), F.lit(False))


def tone_code(col: Column) -> Column:
    """'1' to '6'; a fraction in between is cut off; else UNKNOWN."""
    n = number(col)
    return F.when(n.between(1, 6), F.floor(n).cast("string")).otherwise(F.lit(UNKNOWN))


def tone_exact(col: Column) -> Column:
    """The whole-number tone as text; missing is -1."""
    return F.coalesce(F.floor(number(col)).cast("string"), F.lit("-1"))


def tone_band(col: Column) -> Column:
    """Three bands from whole numbers, numbers as text, or a band already given."""
    text = F.trim(col.cast("string"))
    n = F.floor(number(col))
    out = F
    for word, band in zip(("clara", "media", "oscura"), TONE_BANDS, strict=True):
        out = out.when(text.contains(word), band)
    for k, band in enumerate(TONE_BANDS):
        out = out.when(n.between(2 * k + 1, 2 * k + 2), band)
    return out.otherwise(F.lit(UNKNOWN))


def tone_band_of_integer(col: Column) -> Column:
    """As tone_band, but only exact whole numbers 1 to 6 count."""
    n = number(col)
    return F.when(n == F.floor(n), tone_band(col)).otherwise(F.lit(UNKNOWN))


def fst_digit(col: Column) -> Column:
    """The digit of an FSTn label, or UNKNOWN."""
    return F.coalesce(F.nullif(F.regexp_extract(col, r"FST(\d)", 1), F.lit("")), F.lit(UNKNOWN))


def gradable(col: Column) -> Column:
    """1 or 0 from a rater's answer, else null."""
    out = F
    for answer, value in GRADABLE.items():
        out = out.when(col == answer, value)
    return out


def not_gradable(col: Column) -> Column:
    return F.lit(1) - col


def sex(col: Column) -> Column:
    text = known(col)
    return F.when(text == UNKNOWN, text).otherwise(F.upper(F.substring(text, 1, 1)))


def age(col: Column) -> Column:
    return number(col)


def age_group(col: Column) -> Column:
    """Bands of the published subgroup tables; under 18 and missing are assumptions, not seen there."""
    n = number(col)
    return F.when(n.isNull() | (n < 0), F.lit(UNKNOWN)).when(n < 18, "0-17").when(n < 40, "18-39").when(n < 60, "40-59").when(n < 75, "60-74").otherwise("75+")


def neoplastic(df: DataFrame, column: str = "three_partition_label") -> DataFrame:
    return df.filter(F.col(column).isin(*NEOPLASTIC))


def drop_mislabelled(df: DataFrame, column: str = "qc") -> DataFrame:
    return df.filter(~F.coalesce(F.col(column).rlike("(?i)wrongly"), F.lit(False)))


def image_url(base: str, path: Column) -> Column:
    """base/path for png, jpg and jpeg, else null."""
    return F.when(F.lower(path).rlike(r"\.(png|jpg|jpeg)$"), F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(path, "^/+", "")))


def namespaced_patient(source: Column, patient: Column) -> Column:
    """source_patient; rows of a source without a patient become one patient, named as the source."""
    return F.concat_ws("_", source, patient)


def prior_correct(p: Column, origin: float, target: Column | float) -> Column:
    """A score learned at one prevalence, read at another (clamped to 0.01..0.99)."""
    target = F.greatest(F.lit(0.01), F.least(F.lit(0.99), target if isinstance(target, Column) else F.lit(target)))
    odds = p / (F.lit(1.0) - p) * (target / (F.lit(1.0) - target)) / F.lit(origin / (1 - origin))
    return F.when(p >= 1, F.lit(1.0)).otherwise(odds / (F.lit(1.0) + odds))


def score_band(p: Column) -> Column:
    """The number of the half-open band of a score, from 1; beyond all of them it is the last."""
    out = F
    for k in range(len(BAND_EDGES) - 1):
        out = out.when((p >= BAND_EDGES[k]) & (p < BAND_EDGES[k + 1]), k + 1)
    return F.when(p.isNotNull(), out.otherwise(len(BAND_EDGES) - 1))


def edge_energy(values: Column, side: int, margin: float = 0.15) -> Column:
    """1 - centre / total of an attention map less its minimum; null if nothing is left of it."""
    cells = max(1, int(side * margin))
    low = F.array_min(values).cast("double")
    lifted = F.transform(values, lambda v: v.cast("double") - low)
    inside = [r * side + c for r in range(cells, side - cells) for c in range(cells, side - cells)]
    zero = F.lit(0.0)
    total = F.aggregate(lifted, zero, lambda a, v: a + v)
    centre = F.aggregate(F.transform(F.array(*map(F.lit, inside)), lambda i: F.get(lifted, i)), zero, lambda a, v: a + v)
    return F.when(total > 0, F.lit(1.0) - centre / total)


EDGE_LIMIT = 1 - (1 - 0.30) ** 2


def looks_at_edge(energy: Column) -> Column:
    return F.coalesce(energy > EDGE_LIMIT, F.lit(False))
