"""Loan panel derivations and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapmart.catalogue import roles as R
from snapmart.catalogue.registry import query
from snapmart.operators import loans as L
from snapmart.operators.profiling import bad_rate_by, describe

#: The stand-in panel ends at month on book 6.
DEFINITIONS = [(30, 6), (30, 3), (60, 6), (60, 3)]
CUTOFF = "1998-01-01"


@query("q_dpd", f"WITH {R.PANEL} SELECT * FROM panel")
def dpd(spark, d):
    return R.panel(spark, d)


@query(
    "q_dpd_summary",
    f"""
    WITH {R.PANEL}
    SELECT mob, count(*) AS n, count(dpd) AS n_dpd, CAST(sum(installments_missed) AS BIGINT) AS missed,
           max(dpd) AS max_dpd, CAST(sum(dpd) AS BIGINT) AS sum_dpd, min(first_missed_date) AS first_missed
    FROM panel GROUP BY mob
    """,
)
def dpd_summary(spark, d):
    return R.panel(spark, d).groupBy("mob").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("dpd").alias("n_dpd"),
        F.sum("installments_missed").alias("missed"),
        F.max("dpd").alias("max_dpd"),
        F.sum("dpd").alias("sum_dpd"),
        F.min("first_missed_date").alias("first_missed"),
    )


@query(
    "q_label_store",
    f"""
    WITH {R.PANEL}
    SELECT loan_id, Customer_ID, CASE WHEN dpd >= 30 THEN 1 ELSE 0 END AS label,
           '30dpd_6mob' AS label_def, snapshot_date
    FROM panel WHERE mob = 6
    """,
)
def label_store(spark, d):
    return L.label_store(R.panel(spark, d))


@query(
    "q_bad_rate_by_cohort",
    f"""
    WITH {R.PANEL}
    SELECT CAST(date_trunc('month', loan_start_date) AS DATE) AS start_month,
           avg(CASE WHEN dpd >= 30 THEN 1 ELSE 0 END) AS bad_rate, count(*) AS n
    FROM panel WHERE mob = 6 GROUP BY 1
    """,
)
def bad_rate_by_cohort(spark, d):
    observed = R.panel(spark, d).where(F.col("mob") == 6).select(
        F.trunc("loan_start_date", "month").alias("start_month"), L.label_column(30).alias("label")
    )
    return bad_rate_by(observed, ["start_month"])


_SWEEP = " UNION ALL ".join(
    f"SELECT '{x}dpd_{m}mob' AS label_def, {x} AS dpd, {m} AS mob, count(*) AS n_total, "
    f"count(*) FILTER (WHERE dpd >= {x}) AS n_bad, count(*) - count(*) FILTER (WHERE dpd >= {x}) AS n_good, "
    f"count(*) FILTER (WHERE dpd >= {x}) * 100 / CAST(count(*) AS DOUBLE) AS bad_rate_pct "
    f"FROM loans WHERE mob = {m}"
    for x, m in DEFINITIONS
)


@query("q_label_sweep", f"WITH {R.LOANS} {_SWEEP}")
def label_sweep(spark, d):
    return L.label_sweep(R.loans(spark, d), DEFINITIONS)


@query(
    "q_maturity_target",
    f"""
    WITH {R.LOANS}
    SELECT loan_id, Customer_ID, CAST(balance > 0 AS INTEGER) AS "default"
    FROM loans WHERE installment_num = {R.LAST_INSTALMENT}
    """,
)
def maturity_target(spark, d):
    return L.maturity_target(R.loans(spark, d), R.LAST_INSTALMENT)


_FIRST_MISS = f"""
WITH {R.LOANS},
first_miss AS (
  SELECT Customer_ID, min(installment_num) AS first_miss FROM loans
  WHERE paid_amt = 0 AND due_amt > 0 AND Customer_ID IN (
    SELECT Customer_ID FROM loans WHERE installment_num = {R.LAST_INSTALMENT} AND balance > 0)
  GROUP BY Customer_ID)
"""


@query("q_first_miss", f"{_FIRST_MISS} SELECT * FROM first_miss")
def first_miss(spark, d):
    return L.first_missed_instalment(R.loans(spark, d), R.LAST_INSTALMENT)


@query(
    "q_first_miss_distribution",
    f"""
    {_FIRST_MISS}
    SELECT 'first_miss' AS "column", count(*) AS count, round(avg(first_miss), 8) AS mean,
           round(stddev_samp(first_miss), 8) AS std, CAST(min(first_miss) AS DOUBLE) AS min,
           CAST(max(first_miss) AS DOUBLE) AS max,
           quantile_cont(CAST(first_miss AS DOUBLE), 0.25) AS p25, quantile_cont(CAST(first_miss AS DOUBLE), 0.5) AS p50,
           quantile_cont(CAST(first_miss AS DOUBLE), 0.75) AS p75
    FROM first_miss
    """,
)
def first_miss_distribution(spark, d):
    found = describe(L.first_missed_instalment(R.loans(spark, d), R.LAST_INSTALMENT), ["first_miss"])
    return found.select(
        "column", "count", F.round("mean", 8).alias("mean"), F.round("std", 8).alias("std"),
        "min", "max", "p25", "p50", "p75",
    )


@query(
    "q_maturation_curve",
    f"""
    WITH {R.PANEL},
    rates AS (SELECT mob, count(*) AS n, avg(CASE WHEN dpd >= 30 THEN 1 ELSE 0 END) AS bad_rate
              FROM panel WHERE loan_start_date < DATE '{CUTOFF}' GROUP BY mob)
    SELECT mob, n, bad_rate, bad_rate - lag(bad_rate) OVER (ORDER BY mob) AS step FROM rates
    """,
)
def maturation_curve(spark, d):
    return L.maturation_curve(R.panel(spark, d), CUTOFF)


_COHORTS = " UNION ALL ".join(
    f"SELECT CAST(date_trunc('month', loan_start_date) AS DATE) AS cohort, '{x}dpd_{m}mob' AS label_def, "
    f"count(*) AS n, count(*) FILTER (WHERE dpd >= {x}) * 100 / CAST(count(*) AS DOUBLE) AS bad_rate_pct "
    f"FROM loans WHERE mob = {m} GROUP BY 1 HAVING count(*) >= 30"
    for x, m in DEFINITIONS
)


@query("q_cohort_bad_rates", f"WITH {R.LOANS} {_COHORTS}")
def cohort_bad_rates(spark, d):
    return L.cohort_bad_rates(R.loans(spark, d), DEFINITIONS, min_loans=30)


@query(
    "q_cohort_stability",
    f"""
    WITH {R.LOANS}, cohorts AS ({_COHORTS})
    SELECT label_def, count(*) AS cohorts, min(bad_rate_pct) AS min_bad_rate_pct,
           max(bad_rate_pct) AS max_bad_rate_pct, round(stddev_samp(bad_rate_pct), 8) AS stddev_bad_rate_pct
    FROM cohorts GROUP BY label_def
    """,
)
def cohort_stability(spark, d):
    cohorts = L.cohort_bad_rates(R.loans(spark, d), DEFINITIONS, min_loans=30)
    return L.cohort_stability(cohorts).withColumn(
        "stddev_bad_rate_pct", F.round("stddev_bad_rate_pct", 8)
    )


@query(
    "q_cohort_pivot",
    f"""
    WITH {R.LOANS}, cohorts AS ({_COHORTS})
    SELECT cohort, {", ".join(f"max(CASE WHEN label_def = '{x}dpd_{m}mob' THEN bad_rate_pct END) AS d{x}_m{m}" for x, m in DEFINITIONS)}
    FROM cohorts GROUP BY cohort
    """,
)
def cohort_pivot(spark, d):
    names = [L.label_name(x, m) for x, m in DEFINITIONS]
    pivoted = (
        L.cohort_bad_rates(R.loans(spark, d), DEFINITIONS, min_loans=30)
        .groupBy("cohort")
        .pivot("label_def", names)
        .agg(F.max("bad_rate_pct"))
    )
    return pivoted.select(
        "cohort", *[F.col(L.label_name(x, m)).alias(f"d{x}_m{m}") for x, m in DEFINITIONS]
    )


@query(
    "q_payment_history",
    f"""
    WITH {R.LOANS},
    chosen AS (SELECT min(Customer_ID) AS c FROM (
      SELECT Customer_ID FROM loans WHERE overdue_amt > 0 GROUP BY Customer_ID HAVING count(*) > 2))
    SELECT loan_id, Customer_ID, installment_num, due_amt, paid_amt, overdue_amt, balance, snapshot_date
    FROM loans, chosen WHERE Customer_ID = c
    """,
)
def payment_history(spark, d):
    return L.sample_payment_history(R.loans(spark, d)).select(
        "loan_id", "Customer_ID", "installment_num", "due_amt", "paid_amt", "overdue_amt",
        "balance", "snapshot_date",
    )


@query(
    "q_constants",
    f"""
    WITH {R.PANEL}
    """
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_values, CAST(min({c}) AS DOUBLE) AS min_value, "
        f"CAST(max({c}) AS DOUBLE) AS max_value FROM panel"
        for c in ("tenure", "loan_amt", "due_amt")
    ),
)
def constants(spark, d):
    return L.portfolio_constants(R.panel(spark, d), ["tenure", "loan_amt", "due_amt"])
