"""Profiles and associations against numpy."""

import numpy as np
import pytest

from snapmart.operators import association as A

# ----------------------------------------------------------------- co-moments


def test_one_scan_correlation_equals_numpy(spark):
    r = np.random.default_rng(5)
    n, k = 400, 103
    x = r.normal(0, 1, (n, k)) + 1e9 * (np.arange(k) % 3 == 0)
    x[:, 1] = x[:, 0] + r.normal(0, 0.1, n)
    x[:, 2] = 0.1
    x[r.random((n, k)) < 0.1] = np.nan
    x[:, 5] = np.nan
    names = [f"c{i}" for i in range(k)]
    rows = [[None if np.isnan(v) and i % 2 else float(v) for i, v in enumerate(row)] for row in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(7)
    found = A.correlations(df, names)
    got = {(r["feature_1"], r["feature_2"]): r["correlation"] for r in found.collect()}
    assert len(got) == k * (k - 1) // 2
    for i in range(k):
        for j in range(i + 1, k):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            a, b = x[both, i], x[both, j]
            if not both.any() or a.min() == a.max() or b.min() == b.max():
                assert got[names[i], names[j]] is None
            else:
                assert got[names[i], names[j]] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6)
    assert got["c0", "c1"] > 0.9
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_correlation_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, float("inf"), 2.0), (2.0, 1.0, None)], "a double, b double, c double")
    got = {(r["feature_1"], r["feature_2"]): r["correlation"] for r in A.correlations(df, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): None, ("a", "c"): None, ("b", "c"): None}
    assert {r["correlation"] for r in A.correlations(df.where("a > 9"), ["a", "b"]).collect()} == {None}
    assert A.correlations(df, ["a"]).count() == 0
