"""Gold feature table: one row per new loan, for all months in one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapmart import schemas as S
from snapmart.functions.encode import encode_map
from snapmart.operators.asof import asof_aggregate
from snapmart.operators.joins import flag_source
from snapmart.operators.ranking import first_per_key

GOLD_CODES = {
    "Occupation": S.OCCUPATION_CODES,
    "Credit_Mix": S.CREDIT_MIX_CODES,
    "Payment_of_Min_Amount": S.MIN_PAYMENT_CODES,
}


def encode_categories(df: DataFrame, codes: Mapping[str, Mapping] = GOLD_CODES) -> DataFrame:
    present = {c: encode_map(F.col(c), m) for c, m in codes.items() if c in df.columns}
    return df.withColumns(present) if present else df


def one_row_per_customer_month(df: DataFrame) -> DataFrame:
    """Customer and month identify a row; of repeated ones a fixed choice is kept."""
    return first_per_key(df, ["Customer_ID", "snapshot_date"], by_hash=True)


def feature_store(
    loans: DataFrame,
    attributes: DataFrame,
    financials: DataFrame | None,
    clicks: DataFrame | None,
    click_columns: Sequence[str] = tuple(S.CLICK_FEATURES),
    stats: Sequence[str] = ("mean",),
) -> DataFrame:
    """New loans with customer columns of the same month and click history up to it.

    Months without new loans have no rows, hence no partition when written.
    ``stats=("mean", "std", "min", "max")`` gives the wide variant.

    The sources are joined to the distinct (customer, month) pairs first, where
    every side has one row per key. Only the last join sees the loans, so a
    customer with very many loans skews one join, which adaptive execution splits.
    """
    spine = loans.where(F.col("mob") == 0).select("loan_id", "Customer_ID", "snapshot_date")
    keys = ["Customer_ID", "snapshot_date"]
    customers = spine.select(*keys).distinct()
    wide = customers.join(one_row_per_customer_month(attributes), keys, "left")
    if financials is not None:
        wide = wide.join(one_row_per_customer_month(financials), keys, "left")
    if clicks is not None:
        history = asof_aggregate(customers, clicks, "Customer_ID", click_columns, stats=stats)
        wide = flag_source(
            wide.join(history, keys, "left"), "clickstream_count", "has_clickstream"
        )
    else:
        wide = wide.withColumn("has_clickstream", F.lit(0))
    out = spine.join(encode_categories(wide), keys, "left")
    return out.fillna(0, subset=["has_clickstream"])
