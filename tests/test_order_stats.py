"""Exact order statistics and profiles against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapmart.operators import order_stats as O
from snapmart.operators import profiling as P

PROBS = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]


def sample(kind, n=500, seed=3):
    r = random.Random(seed)
    make = {
        "continuous": lambda: r.gauss(0, 1),
        "ties": lambda: float(r.randrange(4)),
        "hot value": lambda: 7.0 if r.random() < 0.4 else r.uniform(0, 1e6),
        "skewed": lambda: r.lognormvariate(0, 3),
        "constant": lambda: 2.5,
    }[kind]
    return [None if r.random() < 0.1 else make() for _ in range(n)]


@pytest.mark.parametrize("kind", ["continuous", "ties", "hot value", "skewed", "constant"])
@pytest.mark.parametrize("cells", [2, 16])
def test_quantiles_equal_numpy(spark, kind, cells):
    values = sample(kind)
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = O.exact_quantiles(df, ["x"], PROBS, n_cells=cells).first()
    kept = [v for v in values if v is not None]
    assert got["n"] == len(kept)
    assert list(got["q"]) == list(np.quantile(kept, PROBS))


def test_quantiles_by_group_and_missing(spark):
    rows = [("a", 1.0, 1), ("a", 2.0, 2), ("a", float("nan"), 3), ("b", None, 4), (None, 9.0, 5)]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    got = {(r["g"], r["column"]): (r["n"], list(r["q"])) for r in O.exact_quantiles(df, ["x", "y"], [0.5], by=["g"]).collect()}
    assert got == {("a", "x"): (2, [1.5]), ("a", "y"): (3, [2.0]), ("b", "y"): (1, [4.0])}


def test_median_of_even_count_is_between(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (4.0, None)], "x double, e double")
    assert O.medians(df, ["x", "e"]) == {"x": 2.5, "e": None}


def test_cells_spread_the_values(spark):
    df = spark.range(10000).select((F.col("id") % 1000).cast("double").alias("x"))
    cuts = O.value_cuts(df, ["x"], 10)
    sizes = [r["count"] for r in O.bucketize(df, cuts, "c_").groupBy("c_x").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 2 * 1000


def test_buckets_are_left_closed_with_missing_null(spark):
    df = spark.createDataFrame([(-5.0,), (1.0,), (1.5,), (2.0,), (None,), (float("nan"),)], "x double")
    got = [r["b_x"] for r in O.bucketize(df, {"x": [1.0, 2.0]}, "b_").collect()]
    assert got == [0, 1, 1, 2, None, None]


def test_skewness_is_bias_corrected(spark):
    v = np.array([1.0, 2.0, 2.0, 3.0, 10.0, 11.0, 40.0])
    n, m = len(v), v - v.mean()
    g = (m**3).mean() / (m**2).mean() ** 1.5
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    row = P.skewness(df, ["x"]).first()
    assert row["skewness"] == pytest.approx(g * np.sqrt(n * (n - 1)) / (n - 2))


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.0, 9.0, 10.0], [3.0, 3.0]])
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([(x,) for x in values], "x double")
    want, edges = np.histogram(values, bins=4)
    got = {r["bin"]: (r["left_edge"], r["n"], r["density"]) for r in P.histogram(df, "x", 4).collect()}
    density = np.histogram(values, bins=4, density=True)[0]
    for i, n in enumerate(want):
        if n:
            assert got[i] == (pytest.approx(edges[i]), n, pytest.approx(density[i]))
        else:
            assert i not in got


def test_iqr_fences(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    row = P.iqr_outliers(spark.createDataFrame([(x,) for x in values], "x double"), ["x"]).first()
    assert (row["q1"], row["q3"], row["n_outliers"], row["pct_outliers"]) == (2.0, 4.0, 1, 20.0)


def test_approx_describe_has_same_shape(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    exact, approx = P.describe(df, ["x"]), P.describe(df, ["x"], approx=True)
    assert exact.columns == approx.columns
    assert abs(exact.first()["p50"] - approx.first()["p50"]) <= 1


def test_infinite_and_empty_columns(spark):
    from snapmart.operators.association import correlation_matrix
    from snapmart.operators.profiling import describe, iqr_outliers

    rows = [(float(i), None) for i in range(50)] + [(float("inf"), None), (float("-inf"), None)]
    df = spark.createDataFrame(rows, "x double, empty double")
    got = {r["column"]: r for r in describe(df, ["x", "empty"]).collect()}
    assert got["x"]["p50"] == 24.5 and got["x"]["max"] == float("inf")
    assert got["empty"]["count"] == 0 and got["empty"]["p50"] is None
    got = {r["column"]: r for r in iqr_outliers(df, ["x", "empty"]).collect()}
    assert got["x"]["n_outliers"] == 2
    assert got["empty"]["q1"] is None and got["empty"]["n_outliers"] == 0
    assert correlation_matrix(df, ["x"]).columns == ["feature", "x"]
