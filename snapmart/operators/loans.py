"""Loan panel derivations and default labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapmart import schemas as S
from snapmart.functions import dates as D
from snapmart.functions import numbers as N
from snapmart.operators.cleaning import enforce_schema, fill_zero, replace_columns
from snapmart.operators.filters import at_month_on_book, started_before
from snapmart.operators.ranking import first_per_key


def augment_loans(df: DataFrame) -> DataFrame:
    """Month on book, missed instalments, first missed date, days past due.

    All numeric NULLs become 0 after the missed instalments are counted. A
    positive overdue amount against a due amount of 0 has no first missed date,
    so its days past due are NULL.
    """
    typed = enforce_schema(df, S.LOAN_TYPES_OF_COLUMNS)
    missed = F.ceil(N.ratio(F.col("overdue_amt"), F.col("due_amt"))).try_cast("int")
    counted = fill_zero(
        replace_columns(
            typed, {"mob": F.col("installment_num"), "installments_missed": missed}
        )
    )
    first_missed = F.when(
        F.col("installments_missed") > 0,
        D.months_before(F.col("snapshot_date"), F.col("installments_missed")),
    )
    dated = replace_columns(counted, {"first_missed_date": first_missed})
    past_due = F.when(
        F.col("overdue_amt") > 0, F.datediff(F.col("snapshot_date"), F.col("first_missed_date"))
    ).otherwise(F.lit(0))
    return replace_columns(dated, {"dpd": past_due})


def one_row_per_instalment(loans: DataFrame) -> DataFrame:
    """Latest snapshot of each (loan, month on book)."""
    return first_per_key(loans, ["loan_id", "mob"], latest="snapshot_date")


def label_name(dpd: int, mob: int) -> str:
    return f"{dpd}dpd_{mob}mob"


def label_column(dpd: int):
    """1 when at least ``dpd`` days past due; NULL days past due count as good."""
    return F.when(F.col("dpd") >= dpd, 1).otherwise(0)


def label_store(loans: DataFrame, dpd: int = S.LABEL_DPD, mob: int = S.LABEL_MOB) -> DataFrame:
    """One label row per loan observed at the given month on book."""
    return at_month_on_book(loans, mob).select(
        "loan_id",
        "Customer_ID",
        label_column(dpd).alias("label"),
        F.lit(label_name(dpd, mob)).alias("label_def"),
        "snapshot_date",
    )


def label_sweep(
    loans: DataFrame, definitions: Sequence[tuple[int, int]] = tuple(S.LABEL_DEFINITIONS)
) -> DataFrame:
    """Counts and bad rate of several label definitions in one pass.

    ``loans`` holds one row per (loan, month on book). The definitions become
    conditional aggregates of a single global aggregate, so no row is copied
    per definition.
    """
    aggs = []
    for dpd, mob in definitions:
        here = F.col("mob") == mob
        aggs.append(F.count_if(here).alias(f"n_{dpd}_{mob}"))
        aggs.append(F.count_if(here & (F.col("dpd") >= dpd)).alias(f"b_{dpd}_{mob}"))
    wide = loans.where(F.col("mob").isin(*{m for _, m in definitions})).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(label_name(d, m)).alias("label_def"),
                F.lit(d).alias("dpd"),
                F.lit(m).alias("mob"),
                F.col(f"n_{d}_{m}").alias("n_total"),
                F.col(f"b_{d}_{m}").alias("n_bad"),
            )
            for d, m in definitions
        ]
    )
    return wide.select(F.inline(rows)).select(
        "*",
        (F.col("n_total") - F.col("n_bad")).alias("n_good"),
        N.ratio(F.col("n_bad") * 100, F.col("n_total")).alias("bad_rate_pct"),
    )


def maturity_target(loans: DataFrame, last_instalment: int = 10) -> DataFrame:
    """Default at maturity: something is still owed at the last instalment."""
    return loans.where(F.col("installment_num") == last_instalment).select(
        "loan_id", "Customer_ID", (F.col("balance") > 0).cast("int").alias("default")
    )


def first_missed_instalment(loans: DataFrame, last_instalment: int = 10) -> DataFrame:
    """First instalment a maturity defaulter did not pay, per customer.

    The defaulters' keys are made distinct first, so the semi join's right side
    carries one row per customer however often one repeats on the left.
    """
    defaulters = (
        maturity_target(loans, last_instalment)
        .where(F.col("default") == 1)
        .select("Customer_ID")
        .distinct()
    )
    missed = loans.where((F.col("paid_amt") == 0) & (F.col("due_amt") > 0))
    return (
        missed.groupBy("Customer_ID")
        .agg(F.min("installment_num").alias("first_miss"))
        .join(defaulters, "Customer_ID", "left_semi")
    )


def maturation_curve(loans: DataFrame, cutoff, dpd: int = S.LABEL_DPD) -> DataFrame:
    """Bad rate by month on book over completed cohorts, with the step between."""
    rates = (
        started_before(loans, cutoff)
        .groupBy("mob")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(label_column(dpd)).alias("bad_rate"))
    )
    # One row per month on book (the tenure), so the unpartitioned window is tiny.
    step = F.col("bad_rate") - F.lag("bad_rate").over(Window.orderBy("mob"))
    return rates.withColumn("step", step)


def cohort_bad_rates(
    loans: DataFrame,
    definitions: Sequence[tuple[int, int]] = tuple(S.LABEL_DEFINITIONS),
    min_loans: int = 0,
) -> DataFrame:
    """Bad rate and loan count by start month and label definition.

    Definitions are conditional aggregates of one ``groupBy(start month)``.
    """
    cohort = D.month_start(F.col("loan_start_date")).alias("cohort")
    aggs = []
    for dpd, mob in definitions:
        here = F.col("mob") == mob
        bad = F.count_if(here & (F.col("dpd") >= dpd))
        aggs.append(
            F.struct(
                F.lit(label_name(dpd, mob)).alias("label_def"),
                F.count_if(here).alias("n"),
                bad.alias("n_bad"),
            )
        )
    wide = (
        loans.where(F.col("mob").isin(*{m for _, m in definitions}))
        .groupBy(cohort)
        .agg(F.array(*aggs).alias("by_definition"))
    )
    long = wide.select("cohort", F.inline("by_definition"))
    return long.where((F.col("n") > 0) & (F.col("n") >= min_loans)).select(
        "cohort", "label_def", "n", N.ratio(F.col("n_bad") * 100, F.col("n")).alias("bad_rate_pct")
    )


def cohort_stability(cohorts: DataFrame) -> DataFrame:
    """Range and spread of the cohort bad rates per definition."""
    return cohorts.groupBy("label_def").agg(
        F.count(F.lit(1)).alias("cohorts"),
        F.min("bad_rate_pct").alias("min_bad_rate_pct"),
        F.max("bad_rate_pct").alias("max_bad_rate_pct"),
        F.stddev("bad_rate_pct").alias("stddev_bad_rate_pct"),
    )


def sample_payment_history(loans: DataFrame, overdue_more_than: int = 2) -> DataFrame:
    """Ordered instalments of the first customer overdue more often than given."""
    overdue = (
        loans.where(F.col("overdue_amt") > 0)
        .groupBy("Customer_ID")
        .count()
        .where(F.col("count") > overdue_more_than)
    )
    chosen = overdue.agg(F.min("Customer_ID").alias("chosen")).scalar()
    return loans.where(F.col("Customer_ID") == chosen).orderBy(
        "snapshot_date", "loan_id", "installment_num"
    )


def portfolio_constants(loans: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values, smallest and largest value of columns meant to be constant."""
    structs = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_distinct(c).alias("n_values"),
            F.min(F.col(c).cast("double")).alias("min_value"),
            F.max(F.col(c).cast("double")).alias("max_value"),
        )
        for c in columns
    ]
    return loans.agg(F.array(*structs).alias("rows")).select(F.inline("rows"))
