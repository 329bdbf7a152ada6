"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapmart.catalogue import roles as R
from snapmart.catalogue.registry import query, table
from snapmart.operators import filters as P


def _orders(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("snapshot_date")
    )


_ORDERS = "orders_d AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS snapshot_date FROM orders)"


@query("q_snapshot_filter", f"WITH {_ORDERS} SELECT * FROM orders_d WHERE snapshot_date = DATE '1997-03-01'")
def snapshot_filter(spark, d):
    return P.at_snapshot(_orders(spark, d), "1997-03-01")


@query(
    "q_between",
    f"WITH {_ORDERS} SELECT * FROM orders_d WHERE snapshot_date BETWEEN DATE '1997-01-01' AND DATE '1997-10-01'",
)
def between(spark, d):
    return P.between_dates(_orders(spark, d), "1997-01-01", "1997-10-01")


@query("q_asof_filter", f"WITH {_ORDERS} SELECT * FROM orders_d WHERE snapshot_date <= DATE '1996-06-01'")
def asof_filter(spark, d):
    return P.known_at(_orders(spark, d), "1996-06-01")


@query("q_mob_filter", f"WITH {R.PANEL} SELECT loan_id, mob, snapshot_date, dpd FROM panel WHERE mob = 6")
def mob_filter(spark, d):
    return P.at_month_on_book(R.panel(spark, d), 6).select("loan_id", "mob", "snapshot_date", "dpd")


@query(
    "q_completed_cohort",
    f"WITH {R.PANEL} SELECT loan_id, mob, loan_start_date FROM panel WHERE loan_start_date < DATE '1998-01-01'",
)
def completed_cohort(spark, d):
    return P.started_before(R.panel(spark, d), "1998-01-01").select("loan_id", "mob", "loan_start_date")


@query(
    "q_threshold_filter",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_tax, l_discount FROM lineitem
    WHERE (l_discount > 0.07 OR l_tax < 0.01) AND NOT (l_returnflag = 'R')
    """,
)
def threshold_filter(spark, d):
    c = F.col
    extreme = (c("l_discount") > 0.07) | (c("l_tax") < 0.01)
    return (
        table(spark, d, "lineitem")
        .where(extreme & ~(c("l_returnflag") == "R"))
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_discount")
    )


@query(
    "q_na_drop",
    """
    SELECT * FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price,
                          CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status FROM orders)
    WHERE price IS NOT NULL AND status IS NOT NULL
    """,
)
def na_drop(spark, d):
    k = F.col("o_orderkey")
    holes = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 5 != 0, F.col("o_totalprice")).alias("price"),
        F.when(k % 7 != 0, F.col("o_orderstatus")).alias("status"),
    )
    return P.complete_cases(holes, ["price", "status"])


@query(
    "q_contains",
    "SELECT doc_id, source FROM documents WHERE contains(text, 'th') AND starts_with(source, 'src')",
)
def contains(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(F.col("text").contains("th") & F.col("source").startswith("src")).select(
        "doc_id", "source"
    )


@query(
    "q_having",
    """
    SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders
    GROUP BY o_custkey, o_orderpriority HAVING count(*) >= 4
    """,
)
def having(spark, d):
    return P.groups_of_at_least(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], 4)
