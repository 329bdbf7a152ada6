"""The given tables in the roles of the use case.

Loans come from lineitem and orders, customer attributes and financial texts from
customer, clicks from events. Each role has a Spark frame and the same thing as
a SQL common table expression. Texts are made dirty from real columns in the
same way on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapmart.catalogue.registry import table
from snapmart.operators.loans import augment_loans, one_row_per_instalment

#: Line numbers run from 1 to 7, so the last instalment is 6.
LAST_INSTALMENT = 6
#: Events are from 2024, orders from 1995 on: events are moved 25 years back.
EVENT_SHIFT_MONTHS = 300
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
CLICKS = [f"fe_{i + 1}" for i in range(len(EVENT_TYPES))]


def raw_loans(spark: SparkSession, d: str) -> DataFrame:
    """Loan panel: one row per order line, as instalment of the order's loan."""
    lines = table(spark, d, "lineitem")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    due = F.col("l_extendedprice") * F.col("l_tax")
    overdue = F.col("l_extendedprice") * F.col("l_discount")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("loan_id"),
        F.col("o_custkey").cast("string").alias("Customer_ID"),
        F.col("o_orderdate").cast("date").alias("loan_start_date"),
        F.lit(LAST_INSTALMENT).alias("tenure"),
        (F.col("l_linenumber") - 1).cast("int").alias("installment_num"),
        F.col("o_totalprice").cast("float").alias("loan_amt"),
        due.cast("float").alias("due_amt"),
        F.when(F.col("l_returnflag") == "N", F.lit(0.0)).otherwise(due).cast("float").alias("paid_amt"),
        F.when(F.col("l_returnflag") == "R", overdue).otherwise(F.lit(0.0)).cast("float").alias("overdue_amt"),
        F.when(F.col("l_linestatus") == "O", F.col("l_extendedprice")).otherwise(F.lit(0.0)).cast("float").alias("balance"),
        F.col("l_shipdate").cast("date").alias("snapshot_date"),
    )


RAW_LOANS = f"""
raw_loans AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS loan_id,
         CAST(o_custkey AS VARCHAR) AS Customer_ID,
         CAST(o_orderdate AS DATE) AS loan_start_date,
         CAST({LAST_INSTALMENT} AS INTEGER) AS tenure,
         CAST(l_linenumber - 1 AS INTEGER) AS installment_num,
         CAST(o_totalprice AS FLOAT) AS loan_amt,
         CAST(l_extendedprice * l_tax AS FLOAT) AS due_amt,
         CAST(CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_extendedprice * l_tax END AS FLOAT) AS paid_amt,
         CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice * l_discount ELSE 0 END AS FLOAT) AS overdue_amt,
         CAST(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END AS FLOAT) AS balance,
         CAST(l_shipdate AS DATE) AS snapshot_date
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def panel(spark: SparkSession, d: str) -> DataFrame:
    """All loan rows with month on book, missed instalments and days past due."""
    return augment_loans(raw_loans(spark, d))


PANEL = f"""{RAW_LOANS},
counted AS (
  SELECT *, installment_num AS mob,
         coalesce(CAST(ceil(CAST(overdue_amt AS DOUBLE) / nullif(CAST(due_amt AS DOUBLE), 0)) AS INTEGER), 0)
           AS installments_missed
  FROM raw_loans
),
dated AS (
  SELECT *, CASE WHEN installments_missed > 0
            THEN CAST(snapshot_date - to_months(installments_missed) AS DATE) END AS first_missed_date
  FROM counted
),
panel AS (
  SELECT *, CASE WHEN overdue_amt > 0
            THEN CAST(datediff('day', first_missed_date, snapshot_date) AS INTEGER) ELSE 0 END AS dpd
  FROM dated
)"""


def loans(spark: SparkSession, d: str) -> DataFrame:
    """Loan panel with one row per (loan, month on book)."""
    return one_row_per_instalment(panel(spark, d))


_PANEL_COLUMNS = [
    "Customer_ID", "loan_start_date", "tenure", "installment_num", "loan_amt", "due_amt",
    "paid_amt", "overdue_amt", "balance", "installments_missed", "first_missed_date", "dpd",
]
LOANS = f"""{PANEL},
loans AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY loan_id, mob ORDER BY snapshot_date DESC NULLS LAST,
      {", ".join(c + " DESC NULLS LAST" for c in _PANEL_COLUMNS)}) AS rn
    FROM panel)
  WHERE rn = 1
)"""


def clicks(spark: SparkSession, d: str) -> DataFrame:
    """One row per event with its value in the column of its type."""
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("Customer_ID"),
        F.add_months(F.col("ts").cast("date"), -EVENT_SHIFT_MONTHS).alias("snapshot_date"),
        *[
            F.when(F.col("event_type") == t, F.col("value")).alias(c)
            for c, t in zip(CLICKS, EVENT_TYPES)
        ],
    )


CLICKS_SQL = f"""
clicks AS (
  SELECT CAST(user_id AS VARCHAR) AS Customer_ID,
         CAST(CAST(ts AS DATE) - to_months({EVENT_SHIFT_MONTHS}) AS DATE) AS snapshot_date,
         {", ".join(f"CASE WHEN event_type = '{t}' THEN value END AS {c}" for c, t in zip(CLICKS, EVENT_TYPES))}
  FROM events
)"""


def raw_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Customer attributes as dirty text, with personal columns."""
    key = F.col("c_custkey")
    age = (key % 110 - 5).cast("string")
    return table(spark, d, "customer").select(
        key.cast("string").alias("Customer_ID"),
        F.col("c_name").alias("Name"),
        F.when(key % 7 == 0, F.concat(age, F.lit("_")))
        .when(key % 11 == 0, F.concat(F.lit("_"), age))
        .otherwise(age)
        .alias("Age"),
        F.concat(F.lit("SSN-"), key.cast("string")).alias("SSN"),
        F.when(key % 13 == 0, F.lit("_______"))
        .when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("Mechanic"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit("Engineer"))
        .otherwise(F.col("c_mktsegment"))
        .alias("Occupation"),
        F.date_add(F.lit("1999-01-01").cast("date"), (key % 24).cast("int")).alias("snapshot_date"),
    )


RAW_ATTRIBUTES = """
raw_attributes AS (
  SELECT CAST(c_custkey AS VARCHAR) AS Customer_ID,
         c_name AS Name,
         CASE WHEN c_custkey % 7 = 0 THEN concat(CAST(c_custkey % 110 - 5 AS VARCHAR), '_')
              WHEN c_custkey % 11 = 0 THEN concat('_', CAST(c_custkey % 110 - 5 AS VARCHAR))
              ELSE CAST(c_custkey % 110 - 5 AS VARCHAR) END AS Age,
         concat('SSN-', CAST(c_custkey AS VARCHAR)) AS SSN,
         CASE WHEN c_custkey % 13 = 0 THEN '_______'
              WHEN c_mktsegment = 'AUTOMOBILE' THEN 'Mechanic'
              WHEN c_mktsegment = 'MACHINERY' THEN 'Engineer'
              ELSE c_mktsegment END AS Occupation,
         CAST(DATE '1999-01-01' + CAST(c_custkey % 24 AS INTEGER) AS DATE) AS snapshot_date
  FROM customer
)"""

#: Text variants the financial role picks from by customer key.
BEHAVIOURS = [
    "Low_spent_Small_value_payments", "High_spent_Medium_value_payments", "!@9#%8",
    "Low_spent_Large_value_payments",
]
LOAN_TEXTS = [
    "Auto Loan, Auto Loan, and Payday Loan", "Not Specified", "Mortgage Loan and Student Loan",
    "Credit-Builder Loan, Personal Loan, Home Equity Loan, and Debt Consolidation Loan",
]
CREDIT_MIXES = ["Bad", "Standard", "Good", "_"]
MIN_PAYMENTS = ["Yes", "No", "NM"]

_FINANCIAL_SQL = {
    "Customer_ID": "CAST(c_custkey AS {text})",
    "Annual_Income": "CASE WHEN c_custkey % 7 = 0 THEN concat(CAST(c_acctbal AS {text}), '_') "
    "WHEN c_custkey % 7 = 1 THEN concat('__', CAST(c_acctbal AS {text}), '_') "
    "ELSE CAST(c_acctbal AS {text}) END",
    "Monthly_Inhand_Salary": "CASE WHEN c_custkey % 5 = 0 THEN '0' WHEN c_custkey % 9 <> 0 "
    "THEN CAST(c_acctbal AS {text}) END",
    "Num_Bank_Accounts": "CAST(c_custkey % 25 - 2 AS {text})",
    "Num_Credit_Card": "CAST(c_custkey % 23 AS {text})",
    "Interest_Rate": "CAST(c_custkey % 60 AS {text})",
    "Num_of_Loan": "CASE WHEN c_custkey % 3 = 0 THEN concat(CAST(c_custkey % 13 - 1 AS {text}), '_') "
    "ELSE CAST(c_custkey % 13 - 1 AS {text}) END",
    "Type_of_Loan": "CASE "
    + " ".join(f"WHEN c_custkey % 5 = {i} THEN '{t}'" for i, t in enumerate(LOAN_TEXTS))
    + " END",
    "Delay_from_due_date": "CAST(c_custkey % 70 - 5 AS {text})",
    "Num_of_Delayed_Payment": "CASE WHEN c_custkey % 4 = 0 THEN concat(CAST(c_custkey % 30 - 3 AS {text}), '_') "
    "ELSE CAST(c_custkey % 30 - 3 AS {text}) END",
    "Changed_Credit_Limit": "CASE WHEN c_custkey % 6 = 0 THEN '_' WHEN c_custkey % 6 = 1 THEN '0' "
    "ELSE CAST(c_acctbal AS {text}) END",
    "Num_Credit_Inquiries": "CAST(c_custkey % 27 AS {text})",
    "Credit_Mix": "CASE "
    + " ".join(f"WHEN c_custkey % 4 = {i} THEN '{t}'" for i, t in enumerate(CREDIT_MIXES))
    + " END",
    "Outstanding_Debt": "CASE WHEN c_custkey % 8 = 0 THEN concat(CAST(c_acctbal AS {text}), '_') "
    "ELSE CAST(c_acctbal AS {text}) END",
    "Credit_Utilization_Ratio": "CAST(c_acctbal AS {text})",
    "Credit_History_Age": "CASE WHEN c_custkey % 10 = 0 THEN concat(CAST(c_custkey % 30 AS {text}), ' Years') "
    "WHEN c_custkey % 10 <> 1 THEN concat(CAST(c_custkey % 30 AS {text}), ' Years and ', "
    "CAST(c_custkey % 12 AS {text}), ' Months') END",
    "Payment_of_Min_Amount": "CASE "
    + " ".join(f"WHEN c_custkey % 3 = {i} THEN '{t}'" for i, t in enumerate(MIN_PAYMENTS))
    + " END",
    "Total_EMI_per_month": "CAST(c_acctbal AS {text})",
    "Amount_invested_monthly": "CASE WHEN c_custkey % 12 = 0 THEN '__10000__' ELSE CAST(c_acctbal AS {text}) END",
    "Payment_Behaviour": "CASE "
    + " ".join(f"WHEN c_custkey % 4 = {i} THEN '{t}'" for i, t in enumerate(BEHAVIOURS))
    + " END",
    "Monthly_Balance": "CASE WHEN c_custkey % 17 = 0 THEN '__-333333333333333333333333333__' "
    "ELSE CAST(c_acctbal AS {text}) END",
}


def raw_financials(spark: SparkSession, d: str) -> DataFrame:
    """Customer financials as dirty text."""
    return table(spark, d, "customer").select(
        *[F.expr(e.format(text="STRING")).alias(c) for c, e in _FINANCIAL_SQL.items()],
        F.date_add(F.lit("1999-01-01").cast("date"), (F.col("c_custkey") % 24).cast("int")).alias("snapshot_date"),
    )


RAW_FINANCIALS = f"""
raw_financials AS (
  SELECT {", ".join(f"{e.format(text='VARCHAR')} AS {c}" for c, e in _FINANCIAL_SQL.items())},
         CAST(DATE '1999-01-01' + CAST(c_custkey % 24 AS INTEGER) AS DATE) AS snapshot_date
  FROM customer
)"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """A score per order line with its label: (loan_id, month, model_name, ...)."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("loan_id"),
        F.trunc(F.col("l_shipdate").cast("date"), "year").alias("snapshot_date"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_discount") * 5 + F.col("l_tax")).alias("model_predictions"),
        (F.col("l_quantity") / 100).alias("challenger"),
    )


SCORES = """
scores AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS loan_id,
         CAST(date_trunc('year', CAST(l_shipdate AS DATE)) AS DATE) AS snapshot_date,
         CAST(l_returnflag = 'R' AS INTEGER) AS label,
         l_discount * 5 + l_tax AS model_predictions,
         l_quantity / 100 AS challenger
  FROM lineitem
)"""


def document_scores(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with their length as score."""
    return table(spark, d, "labels").join(
        table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id"
    ).select(
        "doc_id", "lang", "source", "quality", F.col("toxic").alias("label"),
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.col("n_chars") / 20000.0).alias("model_predictions"),
    )


DOCUMENT_SCORES = """
document_scores AS (
  SELECT doc_id, lang, source, quality, toxic AS label, CAST(n_chars AS DOUBLE) AS n_chars,
         n_chars / 20000.0 AS model_predictions
  FROM labels JOIN documents USING (doc_id)
)"""
