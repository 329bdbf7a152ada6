"""Snapshot jobs and sources; what they write goes to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapmart.catalogue import roles as R
from snapmart.catalogue.registry import query, table
from snapmart.operators import loans as L
from snapmart.operators.cleaning import clean_attributes
from snapmart.plans import jobs as T
from snapmart.sources import tables as S
from snapmart.sources.scratch import new_path as work_path


def _monthly_orders(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("loan_id"), "o_totalprice", "o_orderstatus",
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("snapshot_date"),
    )


_MONTHLY = """
    monthly AS (SELECT CAST(o_orderkey AS VARCHAR) AS loan_id, o_totalprice, o_orderstatus,
                       CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS snapshot_date FROM orders)
"""


@query(
    "q_month_spine",
    """
    SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS DATE) AS snapshot_date
    FROM orders
    """,
)
def month_spine(spark, d):
    return T.month_spine_of(table(spark, d, "orders"), "o_orderdate")


@query("q_backfill", f"WITH {_MONTHLY} SELECT * FROM monthly")
def backfill(spark, d):
    """A whole layer written by month in one job, then read back."""
    path = work_path(spark, "backfill")
    T.backfill(_monthly_orders(spark, d), lambda df: df, path)
    return S.read_table(spark, path)


@query(
    "q_rerun_month",
    f"""
    WITH {_MONTHLY}
    SELECT loan_id, CASE WHEN snapshot_date = DATE '1997-03-01' THEN -o_totalprice ELSE o_totalprice END AS o_totalprice,
           o_orderstatus, snapshot_date FROM monthly WHERE snapshot_date <> DATE '1997-04-01'
    """,
)
def rerun_month(spark, d):
    """One month written again with a changed rule, one by nothing; the other months stay."""
    path = work_path(spark, "rerun")
    source = _monthly_orders(spark, d)
    T.backfill(source, lambda df: df, path)
    changed = {"o_totalprice": -F.col("o_totalprice")}
    T.rerun_month(source, lambda df: df.withColumns(changed), path, "1997-03-01")
    T.rerun_month(source, lambda df: df.where(F.lit(False)), path, "1997-04-01")
    return S.read_table(spark, path)


@query(
    "q_read_snapshot",
    f"WITH {_MONTHLY} SELECT * FROM monthly WHERE snapshot_date = DATE '1998-05-01'",
)
def read_snapshot(spark, d):
    path = work_path(spark, "snapshot")
    T.backfill(_monthly_orders(spark, d), lambda df: df, path)
    return S.read_snapshot(spark, path, "1998-05-01")


@query(
    "q_read_history",
    f"WITH {_MONTHLY} SELECT * FROM monthly WHERE snapshot_date <= DATE '1996-05-01'",
)
def read_history(spark, d):
    path = work_path(spark, "history")
    T.backfill(_monthly_orders(spark, d), lambda df: df, path)
    return S.read_history(spark, path, "1996-05-01")


@query("q_csv_roundtrip", f"WITH {R.RAW_ATTRIBUTES} SELECT * FROM raw_attributes")
def csv_roundtrip(spark, d):
    """Raw text out to CSV with a header and back in with the fixed schema."""
    from snapmart.schemas import raw_schema

    path = work_path(spark, "csv")
    R.raw_attributes(spark, d).write.option("header", True).csv(path)
    return S.read_csv(spark, path, raw_schema("attributes"))


@query(
    "q_bronze_to_silver",
    f"""
    WITH {R.RAW_ATTRIBUTES}
    SELECT Customer_ID, CASE WHEN TRY_CAST(rtrim(Age, '_') AS INTEGER) BETWEEN 18 AND 100
              THEN TRY_CAST(rtrim(Age, '_') AS INTEGER) END AS Age,
           nullif(Occupation, '_______') AS Occupation, snapshot_date FROM raw_attributes
    """,
)
def bronze_to_silver(spark, d):
    """Bronze keeps the raw text by month; silver is cleaned from it, all months at once."""
    bronze, silver = work_path(spark, "bronze"), work_path(spark, "silver")
    T.backfill(R.raw_attributes(spark, d), lambda df: df, bronze)
    T.backfill(S.read_table(spark, bronze), clean_attributes, silver)
    return S.read_table(spark, silver)


_AVAILABLE = """
    spine AS (SELECT CAST(unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)) AS DATE) AS snapshot_date FROM orders),
    f AS (SELECT DISTINCT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS m FROM orders WHERE o_orderstatus = 'F'),
    l AS (SELECT DISTINCT CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS m FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R'),
    available AS (SELECT snapshot_date, CAST(f.m IS NOT NULL AS INTEGER) AS features, CAST(l.m IS NOT NULL AS INTEGER) AS labels
                  FROM spine LEFT JOIN f ON f.m = snapshot_date LEFT JOIN l ON l.m = snapshot_date)
"""


def _availability(spark, d):
    """Months with finished orders, and with returned lines that are closed."""
    features = _monthly_orders(spark, d).where(F.col("o_orderstatus") == "F")
    labels = table(spark, d, "lineitem").where("l_linestatus = 'F' and l_returnflag = 'R'").select(
        F.trunc(F.col("l_shipdate").cast("date"), "month").alias("snapshot_date")
    )
    months = T.month_spine_of(table(spark, d, "orders"), "o_orderdate")
    return T.availability(months, {"features": features, "labels": labels})


@query("q_availability", f"WITH {_AVAILABLE} SELECT * FROM available")
def availability(spark, d):
    return _availability(spark, d)


@query(
    "q_gates",
    f"""
    WITH {_AVAILABLE}
    SELECT *, CAST(snapshot_date = DATE '1998-06-01' AS INTEGER) AS run_training,
           CAST(snapshot_date >= DATE '1998-06-01' AND features = 1 AS INTEGER) AS run_scoring,
           CAST(snapshot_date >= DATE '1998-06-01' AS INTEGER) AS run_monitoring
    FROM available
    """,
)
def gates(spark, d):
    return T.gate(_availability(spark, d), "1998-06-01")


@query(
    "q_load_audit",
    f"""
    WITH {_AVAILABLE}, {_MONTHLY}
    SELECT 'applications' AS "table", snapshot_date, CAST(count(loan_id) AS BIGINT) AS n
    FROM spine LEFT JOIN monthly USING (snapshot_date) GROUP BY snapshot_date
    UNION ALL
    SELECT 'finished', snapshot_date, count(loan_id)
    FROM spine LEFT JOIN (SELECT * FROM monthly WHERE o_orderstatus = 'F') USING (snapshot_date) GROUP BY snapshot_date
    """,
)
def load_audit(spark, d):
    orders = _monthly_orders(spark, d)
    months = T.month_spine_of(table(spark, d, "orders"), "o_orderdate")
    return S.load_audit(
        {"applications": orders, "finished": orders.where(F.col("o_orderstatus") == "F")}, months
    )


_ORDER_TYPES = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
_EVENT_TYPES = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query(
    "q_inspect",
    f"""
    SELECT 'orders' AS "table", count(*) AS n_rows, 6 AS n_columns, '{_ORDER_TYPES}' AS "schema" FROM orders
    UNION ALL SELECT 'events', count(*), 6, '{_EVENT_TYPES}' FROM events
    """,
)
def inspect(spark, d):
    out = None
    for name in ("orders", "events"):
        part = S.inspect(table(spark, d, name)).select(F.lit(name).alias("table"), "n_rows", "n_columns", "schema")
        out = part if out is None else out.unionByName(part)
    return out


@query("q_first_rows", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7")
def first_rows(spark, d):
    return S.first_rows(table(spark, d, "orders"), 7, [F.col("o_totalprice").desc(), "o_orderkey"])


@query(
    "q_dated_files",
    f"""
    WITH {_MONTHLY}
    SELECT loan_id, o_totalprice, o_orderstatus, snapshot_date, CAST(date_trunc('year', snapshot_date) AS DATE) AS file_date
    FROM monthly WHERE snapshot_date < DATE '1998-01-01'
    """,
)
def dated_files(spark, d):
    """Files that carry their date in the name, read up to a date."""
    root = work_path(spark, "dated")
    orders = _monthly_orders(spark, d)
    years = [r["y"] for r in orders.select(F.year("snapshot_date").alias("y")).distinct().collect()]
    for y in years:
        orders.where(F.year("snapshot_date") == y).write.parquet(f"{root}/orders_{y}_01_01.parquet")
    return S.read_dated_files(spark, f"{root}/*.parquet", "1997-12-31")


@query(
    "q_schema_drift",
    """
    WITH m AS (SELECT count(DISTINCT date_trunc('month', CAST(o_orderdate AS DATE))) AS n FROM orders)
    SELECT 'o_orderstatus' AS "column", 'string' AS types, n AS n_parts, 1 AS n_mixed FROM m
    UNION ALL SELECT 'o_totalprice', 'decimal(15,2),double', n, 1 FROM m
    """,
)
def schema_drift_stated(spark, d):
    return schema_drift(spark, d).select(
        "column", F.array_join("types", ",").alias("types"), "n_parts", F.col("n_mixed").cast("int").alias("n_mixed")
    )


def schema_drift(spark, d):
    """Differences between and within the months of a stored table; files of one month differ."""
    path = work_path(spark, "months")
    orders = _monthly_orders(spark, d)
    S.write_snapshots(orders, path)
    later = orders.where(F.col("snapshot_date") == "1997-03-01").drop("snapshot_date", "o_orderstatus")
    later = later.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(15,2)"))
    later.write.mode("append").parquet(f"{path}/snapshot_date=1997-03-01")
    return S.schema_drift(S.schema_report(S.data_files(spark, path)))


@query(
    "q_label_month_store",
    f"""
    WITH {R.LOANS}
    SELECT loan_id, Customer_ID, CASE WHEN dpd >= 30 THEN 1 ELSE 0 END AS label, '30dpd_6mob' AS label_def,
           CAST(date_trunc('month', snapshot_date) AS DATE) AS snapshot_date
    FROM loans WHERE mob = 6
    """,
)
def label_month_store(spark, d):
    """Gold label table written by month and read back."""
    path = work_path(spark, "labels")
    labels = L.label_store(R.loans(spark, d)).withColumn(
        "snapshot_date", F.trunc("snapshot_date", "month")
    )
    S.write_snapshots(labels, path)
    return S.read_table(spark, path)
