"""Queries against their SQL, published values, and properties."""

from __future__ import annotations

import decimal

import duckdb
import pyarrow.dataset as ds
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumigate.functions import scalars
from lumigate.operators import agreement, concordance, ensembles, fairness, manifest, measures, metrics, ranked, roc, splits, thresholds
from lumigate.plans import photo_queries  # noqa: F401  (fills the registry)
from lumigate.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float | decimal.Decimal):
        return None if v != v else round(float(v), 5) + 0.0
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.register(t, ds.dataset(f"{SF}/{t}.parquet").to_table())
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(Q.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = sorted(repr([norm(r[i]) for i in at]) for r in found.fetchall())
    assert sorted(repr([norm(r[c]) for c in columns]) for r in df.collect()) == want and want


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


# Published values: FPR of five tones and of UNKNOWN, and FNR of subgroups.
TONE_FPR = {"3": 0.5287, "4": 0.4946, "5": 0.3721, "2": 0.5, "UNKNOWN": 0.4074, "1": 0.4853}
FNR = {
    "fitzpatrick": {"1": 0.2174, "3": 0.1379, "2": 0.1},
    "sex": {"M": 0.1278, "F": 0.1071},
    "age_group": {"75+": 0.1778, "40-59": 0.1154, "60-74": 0.1059, "18-39": 0.0},
    "view": {"FOREARM": 0.2143, "BACK": 0.2083, "HAND": 0.0, "NECK": 0.0},
    "fitzpatrick x sex": {"3 | M": 0.2, "1 | M": 0.1667, "2 | M": 0.1059, "3 | F": 0.0909, "2 | F": 0.0889},
}
GAPS = {"fitzpatrick": (0.1174, "1"), "sex": (0.0207, "M"), "age_group": (0.1778, "75+"), "view": (0.2143, "FOREARM"), "fitzpatrick x sex": (0.1111, "3 | M")}


def test_published_bias_verdict(spark):
    rows = [("fitzpatrick", t, f) for t, f in TONE_FPR.items()]
    out = fairness.bias_verdict(spark.createDataFrame(rows, "atributo string, subgrupo string, fpr double")).first()
    assert round(out.correlacion, 3) == -0.607 and round(out.brecha, 4) == 0.1566 and out.veredicto == "CAUTELA" and out.tonos == 5


def test_published_gaps(spark):
    rows = [(a, s, f) for a, own in FNR.items() for s, f in own.items()]
    df = spark.createDataFrame(rows, "atributo string, subgrupo string, fnr_infradiagnostico double")
    assert {r.atributo: (round(r.brecha, 4), r.peor_subgrupo) for r in fairness.fnr_gaps(df).collect()} == GAPS


def test_published_gate_confusion(spark):
    rows = [(1, 1.0)] * 137 + [(0, 1.0)] * 105 + [(0, 0.0)] * 394 + [(1, 0.0)] * 363
    row = metrics.binary_metrics(spark.createDataFrame(rows, "label int, prob double"), 1.0).first()
    assert (row.n, round(row.sensibilidad, 3), round(row.especificidad, 4)) == (999, 0.274, 0.7896)


def predictions(spark, rows):
    return spark.createDataFrame(rows, "grupo string, label int, prob double")


def test_ties_and_one_class_groups(spark):
    df = predictions(spark, [("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("b", 1, 0.3), (None, 1, 0.2), ("a", 1, float("nan"))])
    out = {r.grupo: r.auroc for r in roc.auroc(df, "prob", "label", ["grupo"]).collect()}
    assert out == {"a": 0.75, "b": None}
    cut = {r.grupo: r.umbral for r in roc.sensitivity_threshold(df, "prob", "label", 1.0, ["grupo"]).collect()}
    assert cut == {"a": 0.5, "b": 0.5}


def test_buckets_do_not_change_the_curve(spark):
    df = predictions(spark, [("ab"[i % 2], (i * 7 % 5) // 3, (i * 37 % 50) / 50) for i in range(400)])
    cells = roc.cells(df, "prob", "label", ["grupo"])
    cells = cells.unionByName(cells.withColumn("score", -2 * F.col("score") - 0.001)).filter("score <> 0").unionByName(cells.filter("score = 0"))
    one, many = (sorted(map(tuple, roc.curve(cells, ["grupo"], k).select("grupo", "score", "tp", "fp", "p", "n").collect())) for k in (0, 16))
    assert one == many


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=4, max_size=30))
def test_auc_of_the_negated_score(spark, rows):
    if len({y for y, _ in rows}) < 2:
        return
    df = predictions(spark, [("a", y, p / 7) for y, p in rows]).withColumn("minus", -F.col("prob"))
    a, b = roc.auroc(df, "prob", "label").first()[0], roc.auroc(df, "minus", "label").first()[0]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    assert a == pytest.approx(sum((x > z) + 0.5 * (x == z) for x in pos for z in neg) / len(pos) / len(neg))
    assert a + b == pytest.approx(1)


def test_groups_absent_from_val_fall_back(spark):
    val = predictions(spark, [("a", i % 2, (i * 13 % 40) / 40) for i in range(60)] + [("few", 1, 0.5)])
    test = predictions(spark, [(g, i % 2, (i * 11 % 40) / 40) for i in range(60) for g in ("a", "few", "new")])
    single = roc.youden_threshold(val, "prob", "label").first()["umbral"]
    own = thresholds.strategies(val)
    cut = {r.grupo: (r.u_unico, r.u_grupo, r.u_sens) for r in thresholds.attach(test, own).select("grupo", "u_unico", "u_grupo", "u_sens").distinct().collect()}
    assert cut["few"] == cut["new"] == (single, single, single) and cut["a"][0] == single
    table = thresholds.evaluate(val, test)
    assert table.count() == 9 and thresholds.choose(thresholds.summary(table)).first().elegida
    none = thresholds.evaluate(val.filter("label = 0"), test)
    assert {r.umbral for r in none.collect()} == {0.5}
    both = thresholds.summary(table).withColumn("seed", F.lit(1)).unionByName(thresholds.summary(table).withColumn("seed", F.lit(2)))
    assert {r.semillas for r in thresholds.over_seeds(both).collect()} == {2}


def test_best_configuration(spark):
    df = spark.createDataFrame([(0, "x", 0.9, False), (1, "y", 0.9, True), (2, "z", 0.8, True)], "orden int, configuracion string, auroc double, desplegable boolean")
    assert tuple(thresholds.best_configuration(df, "auroc").first()) == ("x", "y")


def test_no_patient_crosses_and_whales_are_whole(spark):
    rows = [(f"p{i % 50}", i % 2, f"i{i}") for i in range(500)] + [("whale", 1, f"w{i}") for i in range(300)] + [(None, 1, "lost")]
    out = splits.grouped_split(spark.createDataFrame(rows, "patient_id string, label int, image_path string"))
    assert out.count() == 800
    splits.assert_no_leakage(out)
    assert splits.leaked(out).count() == 0
    with pytest.raises(AssertionError, match="more than one"):
        splits.assert_no_leakage(out.withColumn("split", F.when(F.col("image_path") < "i2", "a").otherwise("b")))


def test_balanced_sample_is_exact(spark):
    df = spark.range(5000).select((F.col("id") % 10 == 0).cast("int").alias("label"), F.col("id").cast("string").alias("image_path"))
    assert {(r.label, r["count"]) for r in splits.balanced_sample(df, 200).groupBy("label").count().collect()} == {(0, 100), (1, 100)}


def test_balanced_sample_is_exact_with_a_hot_key(spark):
    """Most rows of a class share a key that comes late in hash order."""
    keys = spark.range(50).select(F.concat(F.lit("hot"), "id").alias("k"))
    hot = keys.orderBy(splits.hash_order(42, "k").desc()).first()["k"]
    rows = spark.range(20_000).select(F.when(F.col("id") < 18_000, F.lit(hot)).otherwise(F.col("id").cast("string")).alias("image_path"), F.lit(0).alias("label"))
    assert splits.balanced_sample(rows, 200).count() == 100


def test_balanced_sample_is_exact_with_two_repeated_keys(spark):
    df = spark.range(10_000).select((F.col("id") % 2).cast("int").alias("label"), (F.floor(F.col("id") / 2) % 2).cast("string").alias("image_path"))
    assert {(r.label, r["count"]) for r in splits.balanced_sample(df, 100).groupBy("label").count().collect()} == {(0, 50), (1, 50)}


def test_folds_of_one_large_stratum_are_even(spark):
    people = spark.range(5000).select(F.col("id").cast("string").alias("patient_id"), F.lit(1).alias("n"), (F.col("id") % 2).alias("positivos"))
    out = {(r.positivos, r.fold): r["count"] for r in splits.patient_folds(people, 5, 42).groupBy("positivos", "fold").count().collect()}
    assert out == {(y, k): 500 for y in (0, 1) for k in range(5)}


def test_scalar_edges(spark):
    df = spark.createDataFrame([("2",), ("2.7",), ("0",), ("7",), ("nan",), (None,), (" media ",), ("6",)], "t string")
    c = F.col("t")
    out = df.select(scalars.tone_code(c).alias("code"), scalars.tone_band(c).alias("band"), scalars.tone_band_of_integer(c).alias("exact"), scalars.sex(c).alias("sex")).collect()
    assert [r.code for r in out] == ["2", "2", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "UNKNOWN", "6"]
    assert [r.band for r in out][-2:] == ["3-4 media", "5-6 oscura"] and out[1].exact == "UNKNOWN"
    assert out[5].sex == out[4].sex == "UNKNOWN"


def test_index_prefers_an_extension(spark):
    index = spark.createDataFrame([("a", "/x/a.png"), ("a", "/x/a.jpg"), ("a", "/y/a.jpg"), ("b", "/x/b.png")], "key string, path string")
    assert {(r.key, r.path) for r in manifest.dedupe_index(index).collect()} == {("a", "/x/a.jpg"), ("b", "/x/b.png")}


def test_atlas_manifest(spark):
    meta = spark.createDataFrame(
        [("h1", 2, "malignant", "Melanoma ", None), ("h2", -1, "benign", "nevus", "3 Wrongly labelled"), ("h3", 5, "non-neoplastic", "acne", None), ("h4", None, "benign", "nevus", "1 ok")],
        "md5hash string, fitzpatrick_scale int, three_partition_label string, label string, qc string",
    )
    index = spark.createDataFrame([(h, f"/x/{h}.jpg") for h in ("h1", "h2", "h3", "h4")], "key string, path string")
    out = {r.patient_id: r for r in manifest.atlas_manifest(meta, index).collect()}
    assert set(out) == {"h1", "h4"} and out["h1"].label == 1 and out["h1"].fitzpatrick == "1-2 clara" and out["h4"].fitzpatrick_exacto == "-1"


def test_gradability_manifest(spark):
    yes, no = "DEFAULT_YES_IMAGE_QUALITY_SUFFICIENT", "NO_IMAGE_QUALITY_INSUFFICIENT"
    cases = spark.createDataFrame([(k, p, "CLOSE_UP", "FST2") for k, p in enumerate(["a.png", "b.jpg", "c.png", "nan", "e.jpeg"])], "case_id long, image_1_path string, image_1_shot_type string, fitzpatrick_skin_type string")
    answers = [(0, yes, yes, None, "FST3"), (1, no, yes, no, None), (2, None, no, no, "FST1"), (3, yes, None, None, None), (4, no, None, None, "x")]
    names = [f"dermatologist_gradable_for_skin_condition_{k} string" for k in (1, 2, 3)]
    labels = spark.createDataFrame(answers, "case_id long, " + ", ".join(names) + ", dermatologist_fitzpatrick_skin_type_label_1 string")
    found = manifest.gradability_manifest(cases, labels, "https://x")
    out = {r.case_id: r for r in found.collect()}
    assert set(out) == {"0", "1", "4"}
    assert (out["0"].evaluable, out["0"].n_valoraciones, out["0"].unanime, out["0"].fitzpatrick_derm) == (1, 2, True, "3")
    assert (out["1"].unanime, out["1"].fitzpatrick_derm, out["1"].fitzpatrick_self) == (False, None, "2") and not out["4"].unanime
    files = spark.createDataFrame([("0", "/p/0.jpg"), ("4", "/p/4.jpg"), ("9", "/p/9.jpg")], "key string, path string")
    ready = {r.patient_id: (r.label, r.fitzpatrick) for r in manifest.not_gradable_manifest(found, files).collect()}
    assert ready == {"0": (0, "3"), "4": (1, "UNKNOWN")}


def test_one_class_and_constant_columns_are_no_errors(spark):
    df = predictions(spark, [("neg", 0, 0.4), ("neg", 0, 0.2), ("pos", 1, 0.3), ("both", 1, 0.8), ("both", 0, 0.1)])
    assert {r.grupo: r.umbral for r in roc.youden_threshold(df, "prob", "label", ["grupo"]).collect()} == {"neg": None, "pos": None, "both": 0.8}
    assert {r.grupo: r.umbral for r in roc.sensitivity_threshold(df, "prob", "label", 0.9, ["grupo"]).collect()} == {"neg": 0.5, "pos": 0.5, "both": 0.8}
    assert {r.grupo: r.auprc for r in roc.auprc(df, "prob", "label", ["grupo"]).collect()} == {"neg": None, "pos": 1.0, "both": 1.0}
    assert metrics.operating_points(df.filter("grupo = 'neg'"), ["prob"], [0.9]).count() == 0
    assert metrics.operating_points(df.filter("grupo = 'pos'"), ["prob"], [0.9]).first().especificidad is None
    same = spark.createDataFrame([("fitzpatrick", str(k), 0.2) for k in range(1, 6)], "atributo string, subgrupo string, fpr double")
    row = fairness.bias_verdict(same).first()
    assert (row.veredicto, row.correlacion, row.brecha) == ("LIMPIO", None, 0.0)
    flat = agreement.ordinal_agreement(spark.createDataFrame([(2, 1), (2, 3)], "a int, b int"), "a", "b").first()
    assert (flat.n, flat.exacto, flat.mas_menos_1, flat.corr) == (2, 0.0, 1.0, None)


def test_exact_quantiles(spark):
    values = [1 - (k % 97) ** 3 * 1e-9 for k in range(600)] + [0.5] * 300 + [float("nan"), None]
    df = spark.createDataFrame([("ab"[k % 2], v) for k, v in enumerate(values)] + [(None, 7.0)], "g string, x double")
    for share in (0.0, 0.37, 0.5, 0.995, 1.0):
        want = {r.g: (r.n, r.q) for r in df.filter("not isnan(x)").groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", F.lit(share)).alias("q")).collect()}
        for parts in (0, 4, 256):
            got = {r.g: (r.n, r.quantile) for r in ranked.exact_quantiles(df, "x", share, ["g"], parts).collect()}
            assert got.keys() == want.keys() and all(got[g][0] == want[g][0] and got[g][1] == pytest.approx(want[g][1], abs=1e-12) for g in want)


def test_photos_without_histograms_are_left_out(spark):
    rows = [("a", 0, [1.0, 2.0]), ("a", 1, None), ("b", 0, [1.0, 2.0]), ("b", 1, [2.0, 1.0]), ("b", 2, None), ("c", 0, None), ("d", 0, [1.0, 1.0]), ("d", 1, [3.0, 4.0])]
    out = {r.group_id: r for r in concordance.same_subject(spark.createDataFrame(rows, "group_id string, pos int, hist array<double>")).collect()}
    assert {g: (r.n, r.comparadas, r.similitud_minima, r.coherente) for g, r in out.items()} == {"a": (2, 1, 1.0, True), "b": (3, 2, -1.0, False), "c": (1, 0, 1.0, True), "d": (2, 2, 1.0, True)}


def test_photos_too_small_for_a_crop_give_one_row(spark):
    size = spark.createDataFrame([("wide", 200, 50), ("square", 64, 64)], "photo_id string, width int, height int")
    assert sorted(map(str, map(tuple, measures.crops(size).collect()))) == ["('square', 0, 0, 64)", "('wide', 0, 0, None)"]


def test_unanimous_needs_two_ratings(spark):
    df = spark.createDataFrame([(1, 1, 1, None), (2, 1, 0, 1), (3, 1, None, None), (4, None, None, None)], "k int, a int, b int, c int")
    assert [r.k for r in agreement.unanimous(agreement.rater_agreement(df, ["a", "b", "c"])).collect()] == [1]


def test_bootstrap_brackets_the_area(spark):
    df = predictions(spark, [("ab"[i % 2], int((i * 7919 % 100) < 30 + (i * 37 % 50)), (i * 37 % 50) / 50) for i in range(600)])
    found = {r.grupo: r for r in roc.bootstrap(df, "prob", "label", 60, 3, ["grupo"]).collect()}
    for r in roc.auroc(df, "prob", "label", ["grupo"]).collect():
        own = found[r.grupo]
        assert own.auroc_lo < r.auroc < own.auroc_hi and own.auroc_hi - own.auroc_lo < 0.25 and own.auprc_lo < own.auprc_hi


def test_pairs_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(concordance, "BLOCK", 3)
    df = spark.createDataFrame([("g", k, k) for k in range(11)] + [("h", 0, 0)], "group_id string, pos int, v int")
    out = sorted((r.a.v, r.b.v) for r in concordance.photo_pairs(df).collect())
    assert out == [(a, b) for a in range(11) for b in range(a + 1, 11)]


def test_training_report_takes_the_first_best(spark):
    df = spark.createDataFrame([("r", 1, 0.8, 0.9), ("r", 2, 0.9, 0.9), ("r", 3, 0.9, 0.95)], "run string, epoch int, val_auroc double, train_auroc double")
    out = ensembles.training_report(df).first()
    assert (out.mejor_epoca, out.ultima_epoca, round(out.brecha_final, 6)) == (2, 3, 0.05)


def test_metrics_without_a_class(spark):
    row = metrics.binary_metrics(predictions(spark, [("a", 1, 0.9), ("a", 1, 0.2)]), 0.5).first()
    assert row.sensibilidad == 0.5 and row.especificidad is None and row.fpr is None
