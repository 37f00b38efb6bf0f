"""Cells in many buckets, bootstrap arrays and splits with heavy patients."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigate.operators import ranked, roc, splits


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows = []
    for k in range(3000):
        g = rng.choice("abbb")
        y = int(rng.random() < 0.3)
        s = round(1 - 0.01 * rng.random() ** (1 + y), 4) if rng.random() < 0.8 else round(rng.random(), 2)  # most crowd near 1
        rows.append((g, y, s))
    return spark.createDataFrame(rows, "grupo string, label int, prob double").cache()


def test_buckets_are_even_and_change_nothing(spark, scored):
    found = roc.cells(scored, "prob", "label", ["grupo"])
    many = ranked.settled(found, "score", 10)
    sizes = [r["count"] for r in many.groupBy("bucket").count().collect()]
    assert len(sizes) > 20 and max(sizes) <= 60
    ends = many.groupBy("bucket").agg(F.min("score").alias("a"), F.max("score").alias("b")).orderBy("bucket").collect()
    assert all(x.b < y.a for x, y in zip(ends, ends[1:]))
    whole, cut = ({r.grupo: r for r in roc.summary(found, ["grupo"], bucket_cells=n).collect()} for n in (10**6, 7))
    for g in "ab":
        assert (whole[g].p, whole[g].n) == (cut[g].p, cut[g].n) and whole[g].auroc == pytest.approx(cut[g].auroc, abs=1e-12)
    order = ["grupo", "score"]
    one, two = (sorted(tuple(r[c] for c in (*order, "tp", "fp", "p", "n", "next_pos", "next_neg")) for r in roc.curve(found, ["grupo"], n).collect()) for n in (10**6, 7))
    assert one == two


def test_bootstrap_does_not_depend_on_buckets(spark, scored, monkeypatch):
    out = []
    for n in (10**6, 20):
        monkeypatch.setattr(roc, "REPLICATED_CELLS", n)
        out.append({r.grupo: r for r in roc.bootstrap(scored, "prob", "label", 50, 3, ["grupo"]).collect()})
    for g in "ab":
        for c in ("auroc_lo", "auroc_hi", "auprc_lo", "auprc_hi"):
            assert out[0][g][c] == pytest.approx(out[1][g][c], abs=1e-12)
        assert out[0][g].auroc_lo < out[0][g].auroc_hi
    row = roc.bootstrap(scored, "prob", "label", 50, 3).first()
    auc = roc.auroc(scored, "prob", "label").first().auroc
    assert row.auroc_lo < auc < row.auroc_hi
    one_class = roc.bootstrap(scored.filter("label = 1"), "prob", "label", 20, 3).first()
    assert one_class.auroc_lo is None and one_class.auprc_lo == 1.0


def test_weights_are_poisson_and_repeat():
    for count in (0, 1, 7, 64, 1000, 70_000):
        w = roc.weights("x", count, 4000)
        assert abs(w.mean() - count) <= 5 * math.sqrt(count / 4000) + 1e-9 and (count == 0 or abs(w.var() / count - 1) < 0.15)
    assert (roc.weights("x", 5, 10) == roc.weights("x", 5, 12)[:10]).all()
    u = int(hashlib.md5(b"x:0:1").hexdigest()[8:16], 16)
    assert roc.weights("x", 1, 6)[5] == np.searchsorted(roc.poisson_cuts(1), u, side="right")


@pytest.mark.parametrize("sizes", [[1500], [1500, 1200, 900], [4000], []])
def test_heavy_patients_first(spark, sizes):
    rng = random.Random(4)
    people = [(f"w{k}", n, n // 5) for k, n in enumerate(sizes)]
    while sum(n for _, n, _ in people) < 10_000:
        n = rng.choice((1, 2, 2, 3, 5))
        people.append((f"p{len(people)}", n, rng.randrange(0, n + 1)))
    df = spark.createDataFrame(people, "patient_id string, n long, positivos long")
    out = splits.patient_folds(df, 5, 42).collect()
    assert sorted(r.patient_id for r in out) == sorted(p for p, _, _ in people)
    total = sum(n for _, n, _ in people)
    held = [sum(r.n for r in out if r.fold == f) for f in range(5)]
    if sizes == [4000]:  # larger than a fold: alone in it
        assert max(held) == 4000 and all(abs(h - (total - 4000) / 4) < total / 100 for h in held if h != 4000)
    else:
        assert all(abs(h - total / 5) < total / 100 for h in held)


def test_rows_of_a_whale_stay_together(spark):
    rows = [("w", k % 2, f"w{k}") for k in range(300)] + [(f"p{k % 500}", int(k % 3 == 0), f"p{k}") for k in range(1700)]
    out = splits.grouped_split(spark.createDataFrame(rows, "patient_id string, label int, image_path string"))
    assert out.count() == 2000 and splits.leaked(out).count() == 0
    shares = {r.split: r.n / 2000 for r in out.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert abs(shares["test"] - 0.2) < 0.02 and abs(shares["val"] - 0.16) < 0.03
