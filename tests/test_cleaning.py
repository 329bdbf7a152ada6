"""Edge cases of the silver layer, one hand-made row each."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snapmart import schemas as S
from snapmart.functions import numbers as N
from snapmart.functions import text as X
from snapmart.operators import cleaning as C


def financial_rows(spark, **changes):
    base = {c: None for c in S.RAW_COLUMNS["financials"]}
    base.update(
        Customer_ID="c", Annual_Income="1200", Monthly_Inhand_Salary="100", Num_Bank_Accounts="2",
        Num_Credit_Card="3", Interest_Rate="5", Num_of_Loan="1", Delay_from_due_date="-3",
        Num_of_Delayed_Payment="4", Changed_Credit_Limit="0", Num_Credit_Inquiries="2",
        Outstanding_Debt="50", Credit_Utilization_Ratio="30", Total_EMI_per_month="10",
        Amount_invested_monthly="20", Monthly_Balance="5",
    )
    base.update(changes)
    schema = ", ".join(f"{c} string" for c in base)
    raw = spark.createDataFrame([tuple(base.values())], schema)
    return C.clean_financials(raw.withColumn("snapshot_date", F.lit("2024-01-01").cast("date"))).first()


@pytest.mark.parametrize(
    "age, want",
    [("23_", 23), ("-500", None), ("8698_", None), ("17", None), ("18", 18), ("100", 100),
     ("101", None), ("_23", None), ("abc", None), (None, None), ("24.0", 24)],
)
def test_age(spark, age, want):
    raw = spark.createDataFrame(
        [("c", "n", age, "s", "_______", "2024-01-01")],
        "Customer_ID string, Name string, Age string, SSN string, Occupation string, snapshot_date string",
    )
    row = C.clean_attributes(raw).first()
    assert row["Age"] == want
    assert row["Occupation"] is None
    assert "Name" not in row.asDict() and "SSN" not in row.asDict()


@pytest.mark.parametrize(
    "column, value, want",
    [
        ("Amount_invested_monthly", "__10000__", None),
        ("Amount_invested_monthly", "9999.5", 9999.5),
        ("Changed_Credit_Limit", "_", None),
        ("Monthly_Balance", "__-333333333333333333333333333__", None),
        ("Monthly_Balance", "-9999", -9999.0),
        ("Total_EMI_per_month", "-5", -5.0),
        ("Total_EMI_per_month", "600", 600.0),
        ("Total_EMI_per_month", "601", None),
        ("Num_of_Loan", "3_", 3),
        ("Num_of_Loan", "-100", None),
        ("Num_of_Delayed_Payment", "4000", 4000),
        ("Interest_Rate", "51", None),
        ("Delay_from_due_date", "-3", -3),
        ("Credit_Mix", "_", None),
        ("Credit_Mix", "Good", "Good"),
        ("Payment_of_Min_Amount", "NM", None),
        ("Credit_History_Age", "10 Years and 9 Months", 129),
        ("Credit_History_Age", "5 Years", None),
        ("Credit_History_Age", "1 Year and 1 Month", 13),
        ("Credit_History_Age", None, None),
    ],
)
def test_financial_rules(spark, column, value, want):
    assert financial_rows(spark, **{column: value})[column] == want


def test_behaviour_levels(spark):
    row = financial_rows(spark, Payment_Behaviour="High_spent_Medium_value_payments")
    assert (row["spending_level"], row["payment_value_level"]) == (1, 1)
    row = financial_rows(spark, Payment_Behaviour="!@9#%8")
    assert (row["spending_level"], row["payment_value_level"]) == (None, None)
    assert "Payment_Behaviour" not in row.asDict()


@pytest.mark.parametrize(
    "text, counts",
    [
        ("Auto Loan, Auto Loan, and Payday Loan", {"auto_loan": 2, "payday_loan": 1}),
        ("Auto Loan and Student Loan", {"auto_loan": 1, "student_loan": 1}),
        (None, {}),
        ("Not Specified", {"not_specified": 1}),
        ("  Mortgage Loan ,Credit-Builder Loan", {"mortgage_loan": 1, "credit_builder_loan": 1}),
    ],
)
def test_loan_type_counts(spark, text, counts):
    row = financial_rows(spark, Type_of_Loan=text)
    for column in S.LOAN_TYPE_COLUMNS.values():
        assert row[column] == counts.get(column.removeprefix("loan_type_"), 0), column


def test_ratios_of_zero_and_missing(spark):
    row = financial_rows(spark, Monthly_Inhand_Salary="0")
    assert row["emi_to_salary"] is None and row["debt_to_salary"] is None
    assert row["investment_rate"] is None and row["repayment_ability"] == -10.0
    assert row["has_credit_limit_change"] == 0
    row = financial_rows(spark, Changed_Credit_Limit="_", Annual_Income="-2")
    assert row["has_credit_limit_change"] is None and row["log_annual_income"] is None
    row = financial_rows(spark)
    assert row["num_fin_products"] == 6 and row["loans_per_credit_item"] == pytest.approx(1 / 6)
    assert row["inq_per_loan"] == 1.0


def test_schema_after_cleaning(spark):
    raw = spark.createDataFrame([], ", ".join(f"{c} string" for c in S.RAW_COLUMNS["financials"]))
    types = dict(C.clean_financials(raw).dtypes)
    for name, dtype in S.FINANCIAL_TYPES_OF_COLUMNS.items():
        assert types[name] == dtype
    assert {types[r] for r in S.RATIO_FEATURES} == {"int", "float"}


def test_pii_guard(spark):
    df = spark.createDataFrame([("a", "b")], "Customer_ID string, NAME string")
    assert C.drop_pii(df).columns == ["Customer_ID"]


def test_strict_duration(spark):
    df = spark.createDataFrame([("about 2 Years and 3 Months",), ("2 Years and 3 Months",)], "t string")
    rows = df.select(
        X.duration_months(F.col("t")).alias("a"), X.duration_months(F.col("t"), strict=True).alias("b")
    ).collect()
    assert [tuple(r) for r in rows] == [(27, None), (27, 27)]


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (2.5,), (None,)], "x double")
    rows = df.select(
        N.fixed_bin(F.col("x"), [0, 1, 2]).alias("f"), N.quantile_bin(F.col("x"), [0, 1, 2]).alias("q")
    ).collect()
    assert [tuple(r) for r in rows] == [(None, 0), (0, 0), (1, 1), (None, None), (None, None)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="_0123456789.-", max_size=8), min_size=1, max_size=30))
def test_cleaning_keeps_rules_and_is_idempotent(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rule = S.Range(0, 50)

    def clean(c):
        return N.keep_in_range(N.to_number(X.strip_padding(c), "float"), rule)

    rows = df.select(clean(F.col("v")).alias("once")).select(
        "once", clean(F.col("once").cast("string")).alias("twice")
    ).collect()
    for r in rows:
        assert r["once"] is None or 0 <= r["once"] <= 50
        assert r["once"] == r["twice"]
