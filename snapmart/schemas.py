"""Column types, rule tables and code lists, as data.

Everything in this module is a fixed value of the use case: changing one
changes results. Logic lives in ``functions`` and ``operators``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------- raw sources
# Raw text is kept as text so that the bronze layer is a faithful copy.

CLICK_FEATURES = [f"fe_{i}" for i in range(1, 21)]

RAW_COLUMNS = {
    "loans": [
        "loan_id", "Customer_ID", "loan_start_date", "tenure", "installment_num",
        "loan_amt", "due_amt", "paid_amt", "overdue_amt", "balance", "snapshot_date",
    ],
    "attributes": ["Customer_ID", "Name", "Age", "SSN", "Occupation", "snapshot_date"],
    "financials": [
        "Customer_ID", "Annual_Income", "Monthly_Inhand_Salary", "Num_Bank_Accounts",
        "Num_Credit_Card", "Interest_Rate", "Num_of_Loan", "Type_of_Loan",
        "Delay_from_due_date", "Num_of_Delayed_Payment", "Changed_Credit_Limit",
        "Num_Credit_Inquiries", "Credit_Mix", "Outstanding_Debt",
        "Credit_Utilization_Ratio", "Credit_History_Age", "Payment_of_Min_Amount",
        "Total_EMI_per_month", "Amount_invested_monthly", "Payment_Behaviour",
        "Monthly_Balance", "snapshot_date",
    ],
    "clickstream": ["Customer_ID", *CLICK_FEATURES, "snapshot_date"],
}


def raw_schema(table: str) -> T.StructType:
    """All-text schema of one raw source, ``snapshot_date`` typed."""
    return T.StructType(
        [
            T.StructField(c, T.DateType() if c == "snapshot_date" else T.StringType())
            for c in RAW_COLUMNS[table]
        ]
    )


# ------------------------------------------------------- fixed values: types
LOAN_TYPES_OF_COLUMNS = {
    "loan_id": "string",
    "Customer_ID": "string",
    "loan_start_date": "date",
    "tenure": "int",
    "installment_num": "int",
    "loan_amt": "float",
    "due_amt": "float",
    "paid_amt": "float",
    "overdue_amt": "float",
    "balance": "float",
    "snapshot_date": "date",
}

ATTRIBUTE_TYPES_OF_COLUMNS = {
    "Customer_ID": "string",
    "Age": "int",
    "Occupation": "string",
    "snapshot_date": "date",
}

FINANCIAL_TYPES_OF_COLUMNS = {
    "Customer_ID": "string",
    "Annual_Income": "float",
    "Monthly_Inhand_Salary": "float",
    "Num_Bank_Accounts": "int",
    "Num_Credit_Card": "int",
    "Interest_Rate": "int",
    "Num_of_Loan": "int",
    "Delay_from_due_date": "int",
    "Num_of_Delayed_Payment": "int",
    "Changed_Credit_Limit": "float",
    "Num_Credit_Inquiries": "int",
    "Credit_Mix": "string",
    "Outstanding_Debt": "float",
    "Credit_Utilization_Ratio": "float",
    "Credit_History_Age": "int",
    "Payment_of_Min_Amount": "string",
    "Total_EMI_per_month": "float",
    "Amount_invested_monthly": "float",
    "Monthly_Balance": "float",
    "snapshot_date": "date",
}

CLICK_TYPES_OF_COLUMNS = {
    "Customer_ID": "string",
    **{c: "int" for c in CLICK_FEATURES},
    "snapshot_date": "date",
}

# ------------------------------------------------------ fixed values: cleaning
PII_COLUMNS = ["Name", "SSN"]

OCCUPATION_PLACEHOLDER = "_______"
CREDIT_MIX_PLACEHOLDER = "_"
MIN_PAYMENT_PLACEHOLDER = "NM"
BEHAVIOUR_PLACEHOLDER = "!@9#%8"

#: Text columns whose numbers come wrapped in underscores.
PADDED_NUMBERS = [
    "Annual_Income",
    "Num_of_Loan",
    "Num_of_Delayed_Payment",
    "Changed_Credit_Limit",
    "Outstanding_Debt",
    "Amount_invested_monthly",
    "Monthly_Balance",
]


@dataclass(frozen=True)
class Range:
    """Keep a value only inside the range; ``None`` leaves a side unchecked."""

    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False


AGE_RANGE = Range(18, 100)

FINANCIAL_RANGES = {
    "Num_Bank_Accounts": Range(0, 20),
    "Num_Credit_Card": Range(0, 20),
    "Interest_Rate": Range(0, 50),
    "Num_of_Loan": Range(0, 10),
    "Num_of_Delayed_Payment": Range(low=0),
    "Num_Credit_Inquiries": Range(0, 20),
    "Total_EMI_per_month": Range(high=600),
    "Amount_invested_monthly": Range(high=10000, high_open=True),
    "Monthly_Balance": Range(-10000, 10000, low_open=True, high_open=True),
}

# --------------------------------------------------- fixed values: text codes
SPENDING_LEVELS = [("Low_spent", 0), ("High_spent", 1)]
PAYMENT_VALUE_LEVELS = [("Small_value", 0), ("Medium_value", 1), ("Large_value", 2)]

# The loan types in the multi-valued text and their count columns.
LOAN_TYPE_COLUMNS = {
    "Auto Loan": "loan_type_auto_loan",
    "Credit-Builder Loan": "loan_type_credit_builder_loan",
    "Debt Consolidation Loan": "loan_type_debt_consolidation_loan",
    "Home Equity Loan": "loan_type_home_equity_loan",
    "Mortgage Loan": "loan_type_mortgage_loan",
    "Not Specified": "loan_type_not_specified",
    "Payday Loan": "loan_type_payday_loan",
    "Personal Loan": "loan_type_personal_loan",
    "Student Loan": "loan_type_student_loan",
}
LOAN_TYPES = list(LOAN_TYPE_COLUMNS)

OCCUPATIONS = [
    "Accountant", "Architect", "Developer", "Doctor", "Engineer", "Entrepreneur",
    "Journalist", "Lawyer", "Manager", "Mechanic", "Media_Manager", "Musician",
    "Scientist", "Teacher", "Writer",
]
OCCUPATION_CODES = {name: code for code, name in enumerate(OCCUPATIONS)}
CREDIT_MIX_CODES = {"Bad": 0, "Standard": 1, "Good": 2}
MIN_PAYMENT_CODES = {"No": 0, "Yes": 1}

RATIO_FEATURES = [
    "num_fin_products", "emi_to_salary", "debt_to_salary", "repayment_ability",
    "loans_per_credit_item", "debt_to_income", "log_annual_income",
    "investment_rate", "inq_per_loan", "has_credit_limit_change",
]

# ------------------------------------------------- fixed values: label, windows
LABEL_DPD = 30
LABEL_MOB = 6
LABEL_DEFINITIONS = [(30, 6), (30, 10), (60, 6), (60, 10)]
LABEL_DELAY_MONTHS = 6
TRAIN_TEST_MONTHS = 10
OOT_MONTHS = 2
TRAIN_SHARE = 0.8
SPLIT_SEED = 88
SEARCH_SEED = 42
ID_COLUMNS = ["Customer_ID", "loan_id", "snapshot_date", "label"]

# --------------------------------------------------- fixed values: monitoring
PSI_BINS = 10
SHARE_FLOOR = 1e-4
CSI_CHART_FLOOR = 1e-3
SCORE_CUTOFF = 0.5


@dataclass(frozen=True)
class Threshold:
    low: float
    high: float
    higher_is_better: bool = False


THRESHOLDS = {
    "psi_score": Threshold(0.10, 0.25),
    "csi": Threshold(0.10, 0.25),
    "auc": Threshold(0.70, 0.75, higher_is_better=True),
    "gini": Threshold(0.40, 0.50, higher_is_better=True),
    "bad_rate_gap": Threshold(0.03, 0.05),
}

# ------------------------------------------- fixed values: model search space
#: Random-search grid, named by the Spark estimator's parameters.
GBT_SEARCH_SPACE = {
    "maxIter": [25, 50],
    "maxDepth": [2, 3],
    "stepSize": [0.01, 0.1],
    "subsamplingRate": [0.6, 0.8],
    "featureSubsetStrategy": ["0.6", "0.8"],
    "minInfoGain": [0.0, 0.1],
    "minInstancesPerNode": [1, 3, 5],
}
SEARCH_DRAWS = 50
SEARCH_FOLDS = 3
