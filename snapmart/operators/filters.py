"""Named predicates over snapshot tables.

All are plain column conditions, so they reach the partition filter or the
parquet scan when the column does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_date(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def at_snapshot(df: DataFrame, day, column: str = "snapshot_date") -> DataFrame:
    return df.where(F.col(column) == as_date(day))


def between_dates(df: DataFrame, start, end, column: str = "snapshot_date") -> DataFrame:
    """Closed range on both sides."""
    return df.where(F.col(column).between(as_date(start), as_date(end)))


def known_at(df: DataFrame, day, column: str = "snapshot_date") -> DataFrame:
    """Rows already known on a date."""
    return df.where(F.col(column) <= as_date(day))


def at_month_on_book(df: DataFrame, mob: int) -> DataFrame:
    return df.where(F.col("mob") == mob)


def started_before(df: DataFrame, cutoff, column: str = "loan_start_date") -> DataFrame:
    """Cohorts old enough to be complete."""
    return df.where(F.col(column) < as_date(cutoff))


def all_present(columns: Sequence[str]) -> Column:
    """Every column has a value, as plain conditions.

    ``na.drop`` hides them in one function. Stated plainly, Spark knows them:
    a later join on these columns adds no filter of its own, so both of its
    sides can share one exchange of the same frame.
    """
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull()
    return keep


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(all_present(columns))


def alerts(monitoring: DataFrame, statuses: Sequence[str] = ("amber", "red")) -> DataFrame:
    return monitoring.where(F.col("status").isin(*statuses))


def groups_of_at_least(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Group keys with their row count, small groups left out."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n)
