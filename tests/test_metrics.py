"""Metrics, drift and monitoring against numpy restatements."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapmart import schemas as S
from snapmart.functions import tails
from snapmart.operators import association as A
from snapmart.operators import metrics as K
from snapmart.operators import monitoring as G


def auc_of(y, p):
    pos, neg = [b for a, b in zip(y, p) if a], [b for a, b in zip(y, p) if not a]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


def scored(spark, rows):
    return spark.createDataFrame(rows, "g string, label int, model_predictions double")


def random_rows(n=400, seed=5, levels=None):
    r = random.Random(seed)
    score = (lambda: r.randrange(levels) / levels) if levels else r.random
    return [(r.choice(["a", "b"]), r.randrange(2), score()) for _ in range(n)]


@pytest.mark.parametrize("levels", [None, 5])
@pytest.mark.parametrize("cells", [2, 32])
def test_auc_by_group(spark, levels, cells):
    rows = random_rows(levels=levels)
    got = {r["g"]: r for r in K.evaluate(scored(spark, rows), by=["g"], n_cells=cells).collect()}
    for g in "ab":
        y, p = zip(*[(a, b) for k, a, b in rows if k == g])
        assert got[g]["auc"] == pytest.approx(auc_of(y, p), abs=1e-12)
        assert got[g]["brier"] == pytest.approx(np.mean((np.array(p) - np.array(y)) ** 2))
        assert got[g]["gini"] == pytest.approx(2 * got[g]["auc"] - 1)
        assert got[g]["tp"] == sum(a == 1 and b >= 0.5 for a, b in zip(y, p))


def test_auc_symmetry_and_ties(spark):
    rows = random_rows(seed=8)
    df = scored(spark, rows)
    a = K.evaluate(df).first()["auc"]
    b = K.evaluate(df.withColumn("model_predictions", -F.col("model_predictions"))).first()["auc"]
    assert a + b == pytest.approx(1.0)
    assert K.evaluate(scored(spark, [("x", 0, 0.5), ("x", 1, 0.5)])).first()["auc"] == 0.5


def test_one_class_has_no_auc(spark):
    row = K.evaluate(scored(spark, [("x", 0, 0.1), ("x", 0, 0.2)])).first()
    assert row["auc"] is None and row["gini"] is None
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    assert K.evaluate(scored(spark, [("x", None, 0.1)])).count() == 0


def test_hot_group_with_one_score(spark):
    rows = [("hot", i % 2, 0.3) for i in range(300)] + random_rows(100)
    got = {r["g"]: r["auc"] for r in K.evaluate(scored(spark, rows), by=["g"], n_cells=8).collect()}
    assert got["hot"] == 0.5


@pytest.mark.parametrize(
    "area, positives, negatives, want",
    [(0.8, 100.0, 300.0, 0.028321), (0.5, 10.0, 10.0, 0.132288), (1.0, 10.0, 10.0, 0.0)],
)
def test_area_error(spark, area, positives, negatives, want):
    """Known values of the published formula."""
    args = [F.lit(x) for x in (area, positives, negatives)]
    got = spark.range(1).select(K.auc_standard_error(*args)).first()[0]
    assert got == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(
    "old, new, want",
    [
        # Halves become a fifth and four fifths: 0.3 ln 2.5 + 0.3 ln 1.6.
        ([0.0] * 5 + [1.0] * 5, [0.0] * 2 + [1.0] * 8, 0.415888),
        # A fifth goes missing, against a floored share: + 0.1 ln 1.2 + 0.1999 ln 2000.
        ([0.0] * 5 + [1.0] * 5, [0.0] * 2 + [1.0] * 6 + [None] * 2, 1.812540),
        # A constant baseline leaves the missing bin alone: 0.2499 ln 2500.
        ([1.0] * 10, [1.0, 2.0, 1.0, None], 1.955229),
        ([0.0] * 5 + [1.0] * 5, [1.0] * 3 + [0.0] * 3, 0.0),
    ],
)
def test_psi_by_hand(spark, old, new, want):
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "x double")
    assert K.psi(frame(old), frame(new), ["x"]).first()["psi"] == pytest.approx(want, abs=1e-6)


def test_psi_without_baseline_or_current(spark):
    some = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    none = spark.createDataFrame([(None,), (None,)], "x double")
    assert K.psi(none, some, ["x"]).first()["psi"] is None
    assert K.psi(some, some.where("x > 9"), ["x"]).first()["psi"] is None
    assert K.psi(some, none, ["x"]).first()["psi"] > 5


@pytest.mark.parametrize(
    "name, value, want",
    [
        ("psi_score", 0.0999, "green"), ("psi_score", 0.10, "amber"), ("psi_score", 0.25, "amber"),
        ("psi_score", 0.2501, "red"), ("csi_Age", 0.3, "red"), ("auc", 0.75, "green"), ("auc", 0.70, "amber"),
        ("auc", 0.6999, "red"), ("gini", 0.5, "green"), ("bad_rate_gap", -0.06, "red"),
        ("bad_rate_gap", 0.029, "green"), ("auc", None, "n/a"), ("n_labels", 5.0, "n/a"),
    ],
)
def test_status(spark, name, value, want):
    df = spark.createDataFrame([(name, value)], "metric_name string, metric_value double")
    assert G.with_status(df).first()["status"] == want


def test_monitoring_dates_and_metrics(spark):
    jan, jul = dt.date(2024, 1, 1), dt.date(2024, 7, 1)
    r = random.Random(4)
    preds = [(f"l{i}", "c", jan if i < 60 else jul, "m1", r.random()) for i in range(100)]
    labels = [(f"l{i}", i % 2, jul) for i in range(60)] + [("l0", 1, jan)]
    p = spark.createDataFrame(preds, "loan_id string, Customer_ID string, snapshot_date date, model_name string, model_predictions double")
    lab = spark.createDataFrame(labels, "loan_id string, label int, snapshot_date date")
    feats = p.select("snapshot_date", (F.col("model_predictions") * 3).alias("f"))
    base = K.fit_baselines(p.withColumn("f", F.col("model_predictions") * 3), ["model_predictions", "f"])
    table = G.monitor(p, lab, feats, base["model_predictions"], {"f": base["f"]})
    rows = table.collect()
    assert table.columns == [
        "model_name", "monitoring_date", "prediction_month", "metric_type", "metric_name", "metric_value", "status",
    ]
    stability = {(x["prediction_month"], x["metric_name"]) for x in rows if x["metric_type"] == "stability"}
    assert stability == {(d, m) for d in (jan, jul) for m in ("n_predictions", "mean_pd", "psi_score", "csi_f")}
    perf = {x["metric_name"]: x for x in rows if x["metric_type"] == "performance"}
    assert set(perf) == set(G.PERFORMANCE_METRICS)
    assert all(x["monitoring_date"] == jul and x["prediction_month"] == jan for x in perf.values())
    y, s = [i % 2 for i in range(60)], [x[4] for x in preds[:60]]
    assert perf["auc"]["metric_value"] == pytest.approx(auc_of(y, s))
    assert perf["n_labels"]["metric_value"] == 60
    assert G.metric_series(table, "performance", "auc", as_of=jan).count() == 0


def test_tail_probabilities_against_known_values():
    assert tails.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-12)
    assert tails.chi2_tail(0.0, 3) == 1.0 and tails.chi2_tail(2.0, 0) == 1.0
    for t in (0.1, 1.0, 2.5, 30.0):  # closed forms for one and two degrees of freedom
        assert tails.t_two_sided(t, 1) == pytest.approx(1 - 2 / np.pi * np.arctan(t), abs=1e-12)
        assert tails.t_two_sided(t, 2) == pytest.approx(1 - t / np.sqrt(t * t + 2), abs=1e-12)
    assert tails.t_two_sided(1.959963984540054, 1e9) == pytest.approx(0.05, abs=1e-8)
    assert tails.t_two_sided(2.0, 99_999) == pytest.approx(tails.t_two_sided(2.0, 100_001), rel=1e-6)
    assert tails.chi2_tail(None, 1) is None


def test_chi_square_matches_spark_test_and_corrects_2x2(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    r = random.Random(9)
    rows = [(r.randrange(4), r.randrange(2), r.randrange(2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "a int, two int, label int")
    got = {x["column"]: x for x in A.with_p_value(A.chi_square(df, ["a", "two"], "label")).collect()}
    vectors = VectorAssembler(inputCols=["a"], outputCol="v").transform(df)
    ref = ChiSquareTest.test(vectors, "v", "label").first()
    assert got["a"]["chi2"] == pytest.approx(ref["statistics"][0])
    assert got["a"]["p_value"] == pytest.approx(ref["pValues"][0])
    table = np.zeros((2, 2))
    for _, two, label in rows:
        table[two, label] += 1
    e = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    gap = np.abs(table - e)
    assert got["two"]["chi2"] == pytest.approx(((gap - np.minimum(0.5, gap)) ** 2 / e).sum())


def test_chi_square_with_empty_cells_and_one_level(spark):
    df = spark.createDataFrame([(0, "x", 0), (0, "x", 0), (1, "x", 1), (2, "x", 1), (2, "x", 0)], "a int, one string, label int")
    got = {x["column"]: x for x in A.cramers_v(df, ["a", "one"], "label").collect()}
    table = np.array([[2, 0], [0, 1], [1, 1]], dtype=float)
    e = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    assert got["a"]["chi2"] == pytest.approx(((table - e) ** 2 / e).sum())
    assert got["one"]["cramers_v"] == 0.0


def test_correlation_skips_missing_pairs_and_constants(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, None, 1.0), (3.0, 5.0, 1.0), (4.0, 4.0, 1.0)], "a double, b double, c double")
    got = {(x["feature_1"], x["feature_2"]): x["correlation"] for x in A.correlations(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(np.corrcoef([1, 3, 4], [2, 5, 4])[0, 1])
    assert got[("a", "c")] is None


def test_all_pairs_come_from_one_scan(spark):
    df = spark.range(20).select(*[(F.col("id") % (i + 3)).alias(f"x{i}") for i in range(4)])
    found = A.correlations(df, [f"x{i}" for i in range(4)])
    assert found.count() == 6
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 20") == 1


def test_model_comparison_has_drift_per_model(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.randrange(2), r.random(), r.random() ** 3) for _ in range(200)]
    df = spark.createDataFrame(rows, "month string, label int, p1 double, p2 double")
    base = K.fit_baselines(df, ["p1", "p2"])
    got = G.compare_models(df, {"one": "p1", "two": "p2"}, {"one": base["p1"], "two": base["p2"]}).collect()
    assert {x["model"] for x in got} == {"one", "two"}
    assert all(x["psi"] == pytest.approx(0, abs=1e-12) for x in got)
    assert S.PSI_BINS == 10
