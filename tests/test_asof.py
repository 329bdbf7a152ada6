"""Point-in-time aggregates against a brute-force restatement."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from snapmart.operators.asof import asof_aggregate, cumulative_history
from snapmart.plans.features import feature_store

D0 = dt.date(2024, 1, 1)
SPINE = "loan_id string, k string, snapshot_date date"
FACTS = "k string, snapshot_date date, x double, y double"


def day(n):
    return D0 + dt.timedelta(days=n)


def data(seed=1, hot=True):
    r = random.Random(seed)
    keys = ["hot"] * 3 + [f"k{i}" for i in range(6)] if hot else [f"k{i}" for i in range(6)]
    facts = [
        (r.choice(keys), day(r.randrange(20)), 1e6 + r.random(), None if r.random() < 0.3 else r.uniform(-5, 5))
        for _ in range(300)
    ]
    spine = [(f"l{i}", r.choice([*keys, "absent"]), day(r.randrange(-2, 22))) for i in range(60)]
    return spine, facts


def brute(spine, facts):
    out = {}
    for loan, k, d in spine:
        rows = [f for f in facts if f[0] == k and f[1] <= d]
        stats = [len(rows) or None]
        for i in (2, 3):
            v = [f[i] for f in rows if f[i] is not None]
            stats += [
                np.mean(v) if v else None, np.std(v, ddof=1) if len(v) > 1 else None,
                min(v) if v else None, max(v) if v else None,
            ]
        out[loan] = stats
    return out


def test_all_statistics(spark):
    spine, facts = data()
    got = asof_aggregate(
        spark.createDataFrame(spine, SPINE), spark.createDataFrame(facts, FACTS), "k", ["x", "y"],
        stats=("mean", "std", "min", "max"),
    ).collect()
    want = brute(spine, facts)
    assert len(got) == len(spine)
    for r in got:
        mine = [r["clickstream_count"]] + [r[f"{c}_{s}"] for c in "xy" for s in ("mean", "std", "min", "max")]
        for a, b in zip(mine, want[r["loan_id"]]):
            assert (a is None) == (b is None)
            if a is not None:
                assert a == pytest.approx(b, rel=1e-7, abs=1e-9)


def test_future_facts_change_nothing(spark):
    spine, facts = data(2)
    s = spark.createDataFrame([x for x in spine if x[2] <= day(10)], SPINE)
    before = asof_aggregate(s, spark.createDataFrame(facts, FACTS).where(F.col("snapshot_date") <= day(10)), "k", ["x"])
    after = asof_aggregate(s, spark.createDataFrame(facts + [("hot", day(11), 9.0, 9.0)], FACTS), "k", ["x"])
    assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))


def test_history_has_one_row_per_key_and_date(spark):
    _, facts = data(3)
    rows = cumulative_history(spark.createDataFrame(facts, FACTS), "k", ["x"]).collect()
    assert len(rows) == len({(f[0], f[1]) for f in facts})
    for r in rows:
        assert r["history_count"] == sum(f[0] == r["k"] and f[1] <= r["snapshot_date"] for f in facts)


def test_unknown_statistic(spark):
    _, facts = data()
    f = spark.createDataFrame(facts, FACTS)
    with pytest.raises(ValueError):
        cumulative_history(f, "k", ["x"], stats=("mode",))


def test_feature_store_rows_and_flag(spark):
    loans = spark.createDataFrame(
        [("l1", "a", 0, day(5)), ("l1", "a", 1, day(9)), ("l2", "b", 0, day(5))],
        "loan_id string, Customer_ID string, mob int, snapshot_date date",
    )
    attributes = spark.createDataFrame(
        [("a", 30, "Pilot", day(5)), ("a", 31, "Teacher", day(5)), ("b", 40, "Doctor", day(5)), ("b", 41, "Doctor", day(9))],
        "Customer_ID string, Age int, Occupation string, snapshot_date date",
    )
    clicks = spark.createDataFrame(
        [("a", day(1), 10), ("a", day(5), 20), ("a", day(6), 1000)],
        "Customer_ID string, snapshot_date date, fe_1 int",
    )
    build = lambda: feature_store(loans, attributes, None, clicks, ["fe_1"]).collect()
    rows = {r["loan_id"]: r for r in build()}
    assert set(rows) == {"l1", "l2"}
    assert rows["l1"]["fe_1_mean"] == 15.0 and rows["l1"]["has_clickstream"] == 1
    assert rows["l2"]["fe_1_mean"] is None and rows["l2"]["has_clickstream"] == 0
    assert rows["l2"]["Occupation"] == 3 and rows["l2"]["Age"] == 40
    assert rows["l1"]["Occupation"] in (None, 13)
    assert {r["loan_id"]: r for r in build()}["l1"]["Age"] == rows["l1"]["Age"]
    assert feature_store(loans, attributes, None, None).select("has_clickstream").distinct().first()[0] == 0
