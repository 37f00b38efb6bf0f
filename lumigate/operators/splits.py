"""Patient-grouped splits and samples. All choices are by hash, so they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def hash_order(seed: int, key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def folds(fraction: float) -> int:
    return max(2, round(1 / fraction))


HEAVY = 10  # a patient with more than one in so many of a fold's rows is placed by itself: fewer than HEAVY times the folds of them
DEAL = 1_000  # places in a round of dealing, where folds take unlike shares


def _quotas(heavy: list[int], total: int, k: int) -> tuple[list[int], list[float]]:
    """The fold of each heavy patient (rows each, the most first), and the share that each fold takes of all other rows.

    Longest first: each goes to the fold that has most room left; the others fill what room is left then.
    """
    room = [total / k] * k
    placed = []
    for n in heavy:
        fold = max(range(k), key=lambda f: (room[f], -f))
        placed.append(fold)
        room[fold] -= n
    left = [max(r, 0.0) for r in room]
    return placed, [r / sum(left) if sum(left) else 1 / k for r in left]


def _pattern(shares: list[float]) -> list[int]:
    """A round of dealing in which each fold comes as often as its share says, spread evenly; one turn each where the shares are alike."""
    k = len(shares)
    if max(shares) - min(shares) < 1e-12:
        return list(range(k))
    given, out = [0] * k, []
    for turn in range(1, DEAL + 1):
        fold = max(range(k), key=lambda f: (shares[f] * turn - given[f], -f))
        given[fold] += 1
        out.append(fold)
    return out


def patient_folds(patients: DataFrame, k: int, seed: int, key: str = "patient_id") -> DataFrame:
    """patients (key, n, positivos) with a fold: whales first, then patients of like counts dealt round in hash order.

    Patients with more than one in HEAVY of a fold's rows are placed one by one on the driver, the largest first, each where most
    room is; the others are dealt by what room is left (round robin where no fold holds a whale). A
    stratum is one pair of counts; strata start where the one before ended, so small ones do not all fill the
    first fold. Most patients may be in one stratum, so it is dealt by ranges of the hash: counts per range tell where each
    starts, and only a range is ordered. The table of strata is small (pairs of counts), that of ranges 4,096 a stratum.
    """
    total = patients.agg(F.sum("n").alias("n")).first()["n"] or 0
    whales = patients.filter(F.col("n") * (k * HEAVY) > F.lit(total)).orderBy(F.desc("n"), key).select(key, "n").collect()
    placed, shares = _quotas([w["n"] for w in whales], total, k)
    pattern = _pattern(shares)
    own = F.col(key).isin([w[key] for w in whales]) if whales else F.lit(False)
    hashed = patients.filter(~own).withColumn("__h", hash_order(seed, key)).withColumn("__r", F.substring("__h", 1, 3))
    nth = F.row_number().over(Window.partitionBy("positivos", "n", "__r").orderBy("__h", key))
    hashed = written(hashed.withColumn("__nth", nth), "dealt")
    ranges = hashed.groupBy("positivos", "n", "__r").agg(F.max("__nth").alias("__c"))
    first = Window.partitionBy("positivos", "n").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("__in", F.coalesce(F.sum("__c").over(first), F.lit(0)))
    strata = ranges.groupBy("positivos", "n").agg(F.sum("__c").alias("__s"))
    before = Window.orderBy("positivos", "n").rowsBetween(Window.unboundedPreceding, -1)
    strata = strata.select("positivos", "n", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__off"))
    start = ranges.join(strata, ["positivos", "n"]).select("positivos", "n", "__r", (F.col("__in") + F.col("__off")).alias("__start"))
    turn = F.pmod(F.col("__nth") - 1 + F.col("__start"), F.lit(len(pattern))).cast("int")
    fold = turn if pattern == list(range(k)) else F.element_at(F.expr(f"array({', '.join(map(str, pattern))})"), turn + 1)
    dealt = hashed.join(start, ["positivos", "n", "__r"]).select(*patients.columns, fold.alias("fold"))
    if not whales:
        return dealt
    place = F.create_map(*(x for w, f in zip(whales, placed, strict=True) for x in (F.lit(w[key]), F.lit(f))))
    return dealt.unionByName(patients.filter(own).withColumn("fold", place[F.col(key)]))


def grouped_split(df: DataFrame, patient: str = "patient_id", label: str = "label", test: float = 0.20, val: float = 0.15, seed: int = 42) -> DataFrame:
    """df with split (train, val, test): no patient crosses, classes are balanced.

    One of folds(test) folds is test; of the rest, one of folds(val / (1 - test)) is val, by seed + 1.
    Rows without a patient drop out. Patients are counted once; what is dealt are a few numbers each.
    """
    rows = df.filter(F.col(patient).isNotNull())
    people = written(rows.groupBy(patient).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("positivos")), "patients")
    first = written(patient_folds(people, folds(test), seed, patient), "folds")
    rest = patient_folds(first.filter("fold <> 0").drop("fold"), folds(val / (1 - test)), seed + 1, patient)
    named = first.filter("fold = 0").select(patient, F.lit("test").alias("split"))
    named = named.unionByName(rest.select(patient, F.when(F.col("fold") == 0, "val").otherwise("train").alias("split")))
    return rows.join(named, patient)


def without_test_patients(df: DataFrame, test: DataFrame, patient: str = "patient_id") -> DataFrame:
    return df.join(test.select(patient).distinct(), patient, "left_anti")


def leaked(df: DataFrame, patient: str = "patient_id", split: str = "split") -> DataFrame:
    """Patients in more than one split."""
    return df.filter(F.col(patient).isNotNull()).groupBy(patient).agg(F.min(split).alias("a"), F.max(split).alias("b")).filter("a <> b").select(patient)


def assert_no_leakage(df: DataFrame, patient: str = "patient_id", split: str = "split") -> None:
    bad = leaked(df, patient, split)
    if n := bad.count():
        raise AssertionError(f"{n} patients are in more than one split, among them {[r[0] for r in bad.limit(5).collect()]}")


def split_summary(df: DataFrame, patient: str = "patient_id", label: str = "label") -> DataFrame:
    order = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    y = F.col(label).cast("double")
    return df.groupBy("split", order.alias("orden")).agg(
        F.count(F.lit(1)).alias("imagenes"), F.countDistinct(patient).alias("pacientes"), F.sum(y).cast("long").alias("positivos"), F.round(F.avg(y), 4).alias("prevalencia")
    )


def only(df: DataFrame, split: str) -> DataFrame:
    return df if split == "all" else df.filter(F.col("split") == split)


def balanced_sample(df: DataFrame, n: int, label: str = "label", key: str = "image_path", seed: int = 42) -> DataFrame:
    """n / 2 rows of each class, first by hash, in hash order.

    A cut of the hash's first digits, taken from a sketch of the classes' counts of distinct hashes (rows that share a
    key share its hash) with room to spare for its error, thins the rows before the exact window, so that two classes
    do not mean two large tasks. A class that the cut leaves short all the same is not thinned.
    """
    half = n // 2
    order = hash_order(seed, key)
    share = F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
    counts = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.approx_count_distinct(order, 0.02).alias("about"), F.count(F.lit(1)).alias("n"))
    # 10 deviations of a binomial count above the wanted one, and a fifth for the sketch (10 of its deviations).
    bound = (F.lit(half) + 10 * F.sqrt(F.lit(float(half))) + 10) * 1.2 / F.greatest(F.col("about"), F.lit(1))
    marked = df.join(F.broadcast(counts.select(label, bound.alias("__bound"), "n")), label)  # a row a class
    short = marked.filter(share <= F.col("__bound")).groupBy(label).agg(F.count(F.lit(1)).alias("left"), F.max("n").alias("n")).filter(F.col("left") < F.least(F.lit(half), F.col("n")))
    whole = [r[0] for r in short.select(label).collect()]  # classes that the sketch misjudged: none but by a chance under 1e-20
    keep = share <= F.col("__bound") if not whole else (share <= F.col("__bound")) | F.col(label).isin(whole)
    thin = marked.filter(keep).drop("__bound", "n")
    nth = F.row_number().over(Window.partitionBy(label).orderBy(order, key))
    return thin.withColumn("__n", nth).filter(F.col("__n") <= half).drop("__n")


def sample(df: DataFrame, n: int, key: str = "image_path", seed: int = 42) -> DataFrame:
    """n rows, first by hash."""
    return df.orderBy(hash_order(seed, key), key).limit(n)
