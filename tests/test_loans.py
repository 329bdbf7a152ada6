"""Days past due and labels."""

import datetime as dt

from pyspark.sql import functions as F

from snapmart.operators import loans as L

COLUMNS = (
    "loan_id string, Customer_ID string, loan_start_date date, tenure int, installment_num int, "
    "loan_amt double, due_amt double, paid_amt double, overdue_amt double, balance double, snapshot_date date"
)
START = dt.date(2023, 11, 1)


def panel(spark, rows):
    """rows: (loan, instalment, due, overdue, snapshot)"""
    full = [
        (loan, f"c{loan}", START, 10, i, 10000.0, due, None, overdue, 0.0, day)
        for loan, i, due, overdue, day in rows
    ]
    return L.augment_loans(spark.createDataFrame(full, COLUMNS))


def test_days_past_due_edges(spark):
    may = dt.date(2024, 5, 1)
    rows = panel(
        spark,
        [
            ("on time", 6, 1000.0, 0.0, may),
            ("three", 6, 1000.0, 2500.0, may),
            ("month end", 6, 1000.0, 3000.0, dt.date(2024, 5, 31)),
            ("no due", 6, 0.0, 500.0, may),
            ("missing", 6, None, None, may),
        ],
    )
    got = {r["loan_id"]: (r["installments_missed"], r["first_missed_date"], r["dpd"]) for r in rows.collect()}
    assert got["on time"] == (0, None, 0)
    assert got["three"] == (3, dt.date(2024, 2, 1), 90)
    assert got["month end"] == (3, dt.date(2024, 2, 29), 92)
    assert got["no due"] == (0, None, None)
    assert got["missing"] == (0, None, 0)
    labels = {r["loan_id"]: r["label"] for r in L.label_store(rows).collect()}
    assert labels == {"on time": 0, "three": 1, "month end": 1, "no due": 0, "missing": 0}


def test_numeric_nulls_become_zero_and_others_stay(spark):
    row = panel(spark, [("x", 3, None, None, None)]).first()
    assert row["due_amt"] == 0 and row["paid_amt"] == 0 and row["overdue_amt"] == 0
    assert row["snapshot_date"] is None and row["mob"] == 3


def test_label_boundary_and_name(spark):
    df = spark.createDataFrame(
        [("a", 29, 6), ("b", 30, 6), ("c", 90, 5)], "loan_id string, dpd int, mob int"
    ).select("*", F.lit("c").alias("Customer_ID"), F.current_date().alias("snapshot_date"))
    rows = {r["loan_id"]: (r["label"], r["label_def"]) for r in L.label_store(df).collect()}
    assert rows == {"a": (0, "30dpd_6mob"), "b": (1, "30dpd_6mob")}


def test_sweep_equals_single_definitions(spark, small):
    from snapmart.catalogue import roles as R

    loans = R.loans(spark, small)
    sweep = {r["label_def"]: r for r in L.label_sweep(loans, [(30, 6), (60, 3)]).collect()}
    for dpd, mob in [(30, 6), (60, 3)]:
        one = L.label_store(loans, dpd, mob).agg(F.count("label"), F.sum("label")).first()
        row = sweep[L.label_name(dpd, mob)]
        assert (row["n_total"], row["n_bad"], row["n_good"]) == (one[0], one[1], one[0] - one[1])


def test_maturity_and_first_miss(spark):
    rows = [
        ("l1", "a", 4, 0.0, 1000.0, 500.0), ("l1", "a", 7, 0.0, 1000.0, 500.0), ("l1", "a", 10, 0.0, 1000.0, 500.0),
        ("l2", "b", 2, 0.0, 1000.0, 0.0), ("l2", "b", 10, 1000.0, 1000.0, 0.0),
    ]
    df = spark.createDataFrame(
        rows, "loan_id string, Customer_ID string, installment_num int, paid_amt double, due_amt double, balance double"
    )
    assert {r["Customer_ID"]: r["default"] for r in L.maturity_target(df).collect()} == {"a": 1, "b": 0}
    assert [tuple(r) for r in L.first_missed_instalment(df).collect()] == [("a", 4)]
