"""Silver cleaning of the four raw sources.

Every step is one ``select``, so a table is one projection over its scan
whatever the number of rules, and stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart import schemas as S
from snapmart.functions import numbers as N
from snapmart.functions import text as X


def replace_columns(df: DataFrame, new: Mapping[str, Column], drop: Iterable[str] = ()) -> DataFrame:
    """Replace or append columns in a single projection, dropping others."""
    gone = set(drop)
    kept = [
        (new[c].alias(c) if c in new else F.col(c)) for c in df.columns if c not in gone
    ]
    added = [e.alias(c) for c, e in new.items() if c not in df.columns]
    return df.select(*kept, *added)


def enforce_schema(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Cast the listed columns, bad values to NULL; other columns pass through."""
    present = dict(df.dtypes)
    casts = {}
    for name, dtype in types.items():
        if present[name] == dtype:
            continue
        if present[name] == "string" and dtype != "date":
            casts[name] = N.to_number(F.col(name), dtype)
        else:
            casts[name] = F.col(name).try_cast(dtype)
    return replace_columns(df, casts)


def drop_pii(df: DataFrame, columns: Sequence[str] = S.PII_COLUMNS) -> DataFrame:
    """Remove personal columns and refuse to go on if any is still there."""
    out = df.drop(*columns)
    left = [c for c in out.columns if c.lower() in {p.lower() for p in columns}]
    if left:
        raise ValueError(f"personal columns still present: {left}")
    return out


def apply_ranges(df: DataFrame, ranges: Mapping[str, S.Range]) -> DataFrame:
    """Range rules from a table of rules, values outside to NULL."""
    return replace_columns(df, {c: N.keep_in_range(F.col(c), r) for c, r in ranges.items()})


def fill_zero(df: DataFrame) -> DataFrame:
    """NULL to 0 in every numeric column; texts and dates stay as they are."""
    return df.fillna(0)


def clean_attributes(df: DataFrame) -> DataFrame:
    """Attributes: no personal data, a plausible age, no placeholder occupation."""
    age = N.to_number(X.strip_padding(F.col("Age"), "right"), "int")
    out = replace_columns(
        drop_pii(df),
        {
            "Age": N.keep_in_range(age, S.AGE_RANGE),
            "Occupation": X.null_if(F.col("Occupation"), S.OCCUPATION_PLACEHOLDER),
        },
    )
    return enforce_schema(out, S.ATTRIBUTE_TYPES_OF_COLUMNS)


def clean_clickstream(df: DataFrame) -> DataFrame:
    return enforce_schema(df, S.CLICK_TYPES_OF_COLUMNS)


def loan_type_counts(
    df: DataFrame,
    column: str = "Type_of_Loan",
    types: Mapping[str, str] = S.LOAN_TYPE_COLUMNS,
) -> DataFrame:
    """One count column per loan type in place of the multi-valued text."""
    split = df.withColumn(column, X.list_items(F.col(column)))
    counts = {
        name: X.item_count(F.col(column), t) for t, name in types.items()
    }
    return replace_columns(split, counts, drop=[column])


def ratio_features(df: DataFrame) -> DataFrame:
    """Ten row-wise features; division by zero or NULL gives NULL."""
    c = F.col
    products = c("Num_Bank_Accounts") + c("Num_Credit_Card")
    features = {
        "num_fin_products": products + c("Num_of_Loan"),
        "emi_to_salary": N.ratio(c("Total_EMI_per_month"), c("Monthly_Inhand_Salary")),
        "debt_to_salary": N.ratio(c("Outstanding_Debt"), c("Monthly_Inhand_Salary")),
        "repayment_ability": c("Monthly_Inhand_Salary") - c("Total_EMI_per_month"),
        "loans_per_credit_item": N.ratio(c("Num_of_Loan"), products + 1),
        "debt_to_income": N.ratio(c("Outstanding_Debt"), c("Annual_Income")),
        "log_annual_income": F.log1p(c("Annual_Income")),
        "investment_rate": N.ratio(c("Amount_invested_monthly"), c("Monthly_Inhand_Salary")),
        "inq_per_loan": N.ratio(c("Num_Credit_Inquiries"), c("Num_of_Loan") + 1),
        "has_credit_limit_change": (c("Changed_Credit_Limit") != 0).cast("int"),
    }
    whole = {"num_fin_products", "has_credit_limit_change"}
    return replace_columns(
        df, {k: v.cast("int" if k in whole else "float") for k, v in features.items()}
    )


def clean_financials(df: DataFrame) -> DataFrame:
    """Financials: numbers out of padded text, codes out of text, rules, features."""
    stripped = replace_columns(df, {c: X.strip_padding(F.col(c)) for c in S.PADDED_NUMBERS})
    coded = replace_columns(
        stripped,
        {
            "Credit_Mix": X.null_if(F.col("Credit_Mix"), S.CREDIT_MIX_PLACEHOLDER),
            "Payment_of_Min_Amount": X.null_if(
                F.col("Payment_of_Min_Amount"), S.MIN_PAYMENT_PLACEHOLDER
            ),
            "Credit_History_Age": X.duration_months(F.col("Credit_History_Age")),
            "spending_level": X.level_by_content(F.col("Payment_Behaviour"), S.SPENDING_LEVELS),
            "payment_value_level": X.level_by_content(
                F.col("Payment_Behaviour"), S.PAYMENT_VALUE_LEVELS
            ),
        },
        drop=["Payment_Behaviour"],
    )
    typed = enforce_schema(coded, S.FINANCIAL_TYPES_OF_COLUMNS)
    ruled = apply_ranges(typed, S.FINANCIAL_RANGES)
    return ratio_features(loan_type_counts(ruled))
