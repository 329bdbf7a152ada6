"""Aggregates, windows, ordering and key sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapmart.catalogue import roles as R
from snapmart.catalogue.registry import query, table
from snapmart.operators import association as A
from snapmart.operators import keysets as U
from snapmart.operators import profiling as Q
from snapmart.operators import ranking as W


@query(
    "q_group_mean",
    f"""
    WITH {R.CLICKS_SQL}
    SELECT Customer_ID, {", ".join(f"round(avg({c}), 6) AS {c}_mean" for c in R.CLICKS)}, count(*) AS n
    FROM clicks GROUP BY Customer_ID
    """,
)
def group_mean(spark, d):
    return R.clicks(spark, d).groupBy("Customer_ID").agg(
        *[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in R.CLICKS], F.count(F.lit(1)).alias("n")
    )


@query(
    "q_group_multi",
    f"""
    WITH {R.CLICKS_SQL}
    SELECT Customer_ID, count(*) AS n, {", ".join(
        f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max"
        for c in R.CLICKS)}
    FROM clicks GROUP BY Customer_ID
    """,
)
def group_multi(spark, d):
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in R.CLICKS:
        aggs += [
            F.round(F.avg(c), 6).alias(f"{c}_mean"),
            F.round(F.stddev(c), 6).alias(f"{c}_std"),
            F.min(c).alias(f"{c}_min"),
            F.max(c).alias(f"{c}_max"),
        ]
    return R.clicks(spark, d).groupBy("Customer_ID").agg(*aggs)


@query(
    "q_group_bad_rate",
    """
    SELECT l_linenumber, l_linestatus, avg(CAST(l_returnflag = 'R' AS INTEGER)) AS bad_rate, count(*) AS n
    FROM lineitem GROUP BY ALL
    """,
)
def group_bad_rate(spark, d):
    lines = table(spark, d, "lineitem").withColumn("label", (F.col("l_returnflag") == "R").cast("int"))
    return Q.bad_rate_by(lines, ["l_linenumber", "l_linestatus"])


@query(
    "q_group_count",
    "SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1",
)
def group_count(spark, d):
    return (
        table(spark, d, "orders")
        .groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "q_count_distinct",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM orders"
        for c in ("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    ),
)
def count_distinct(spark, d):
    return Q.distinct_counts(
        table(spark, d, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
    )


@query(
    "q_value_counts",
    """
    WITH o AS (SELECT CASE WHEN o_orderkey % 6 <> 0 THEN o_orderpriority END AS priority FROM orders)
    SELECT priority, count(*) AS n, count(*) / CAST((SELECT count(*) FROM o) AS DOUBLE) AS share FROM o GROUP BY priority
    """,
)
def value_counts(spark, d):
    masked = table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority")).alias("priority")
    )
    return W.value_counts(masked, "priority").orderBy(F.col("n").desc(), "priority")


@query(
    "q_contingency",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL",
)
def contingency(spark, d):
    return A.contingency(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    "q_pivot",
    """
    SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS month,
           count(*) FILTER (WHERE o_orderstatus = 'F') AS F,
           count(*) FILTER (WHERE o_orderstatus = 'O') AS O,
           count(*) FILTER (WHERE o_orderstatus = 'P') AS P
    FROM orders GROUP BY 1
    """,
)
def pivot(spark, d):
    return (
        table(spark, d, "orders")
        .groupBy(F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"))
        .pivot("o_orderstatus", ["F", "O", "P"])
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


@query(
    "q_count_if",
    """
    SELECT l_linenumber, count(*) FILTER (WHERE l_tax = 0) AS no_tax, count(*) FILTER (WHERE l_discount > 0.05) AS discounted,
           count(*) FILTER (WHERE l_quantity >= 18 AND l_quantity <= 40) AS medium
    FROM lineitem GROUP BY l_linenumber
    """,
)
def count_if(spark, d):
    c = F.col
    return Q.conditional_counts(
        table(spark, d, "lineitem"),
        {
            "no_tax": c("l_tax") == 0,
            "discounted": c("l_discount") > 0.05,
            "medium": (c("l_quantity") >= 18) & (c("l_quantity") <= 40),
        },
        by=["l_linenumber"],
    )


@query(
    "q_scalar_aggregates",
    """
    SELECT count(*) AS n, round(avg(o_totalprice), 6) AS mean, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS low,
           max(o_totalprice) AS high, round(stddev_samp(o_totalprice), 6) AS std,
           quantile_cont(o_totalprice, 0.5) AS median
    FROM orders
    """,
)
def scalar_aggregates(spark, d):
    prices = table(spark, d, "orders").select("o_totalprice")
    found = Q.describe(prices, ["o_totalprice"])
    total = prices.agg(F.round(F.sum("o_totalprice"), 2).alias("t")).scalar()
    return found.select(
        F.col("count").alias("n"), F.round("mean", 6).alias("mean"), total.alias("total"),
        F.col("min").alias("low"), F.col("max").alias("high"), F.round("std", 6).alias("std"),
        F.col("p50").alias("median"),
    )


_HOLES = """
    holes AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price,
                     CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status FROM orders)
"""


@query(
    "q_null_rates",
    f"WITH {_HOLES} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, (count(*) - count({c})) / CAST(count(*) AS DOUBLE) AS null_rate FROM holes"
        for c in ("o_orderkey", "price", "status")
    ),
)
def null_rates(spark, d):
    k = F.col("o_orderkey")
    return Q.null_rates(
        table(spark, d, "orders").select(
            "o_orderkey",
            F.when(k % 5 != 0, F.col("o_totalprice")).alias("price"),
            F.when(k % 7 != 0, F.col("o_orderstatus")).alias("status"),
        )
    )


@query(
    "q_dedup",
    """
    SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC,
        l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn FROM lineitem)
    WHERE rn = 1
    """,
)
def dedup(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice",
    )
    return W.first_per_key(lines, ["l_orderkey", "l_linenumber"], latest="l_shipdate")


@query("q_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query(
    "q_distinct_values",
    "SELECT n AS rows_per_order, count(*) AS n_orders FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY n",
)
def distinct_values(spark, d):
    sizes = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rows_per_order"))
    return sizes.groupBy("rows_per_order").agg(F.count(F.lit(1)).alias("n_orders"))


@query(
    "q_best_per_group",
    """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
    WHERE rn = 1
    """,
)
def best_per_group(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return W.best_per_group(orders, ["o_custkey"], "o_totalprice", ["o_orderkey"])


_SHARES = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS level, count(*) AS n FROM lineitem GROUP BY {c}"
    for c in ("l_returnflag", "l_linestatus", "l_linenumber")
)


@query(
    "q_dominant_share",
    f"""
    WITH levels AS ({_SHARES})
    SELECT "column", max(n) / CAST(sum(n) AS DOUBLE) AS top_share,
           max(n) / CAST(sum(n) AS DOUBLE) > 0.4 AS near_constant
    FROM levels GROUP BY 1
    """,
)
def dominant_share(spark, d):
    return W.dominant_share(
        table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], limit=0.4
    )


@query(
    "q_latest_value",
    """
    SELECT user_id, event_type, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY ALL
    """,
)
def latest_value(spark, d):
    return W.latest_value(table(spark, d, "events"), ["user_id", "event_type"], "value", "ts")


@query(
    "q_top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15",
)
def top_k(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return W.top_k(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 15)


@query(
    "q_head_sample",
    "SELECT event_id, ts, user_id FROM events ORDER BY ts, event_id LIMIT 5",
)
def head_sample(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "user_id")
    return W.top_k(events, [F.col("ts"), F.col("event_id")], 5)


@query(
    "q_abs_sort",
    "SELECT c_custkey, c_acctbal - 4500 AS gap FROM customer ORDER BY abs(c_acctbal - 4500) DESC, c_custkey",
)
def abs_sort(spark, d):
    gaps = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") - 4500).alias("gap"))
    return W.sort_by_size(gaps, "gap", ["c_custkey"])


@query(
    "q_union_all",
    """
    SELECT 'order' AS kind, o_orderkey AS key, CAST(o_orderdate AS DATE) AS day FROM orders
    UNION ALL SELECT 'event', event_id, CAST(ts AS DATE) FROM events
    """,
)
def union_all(spark, d):
    orders = table(spark, d, "orders").select(
        F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"), F.col("o_orderdate").cast("date").alias("day")
    )
    events = table(spark, d, "events").select(
        F.lit("event").alias("kind"), F.col("event_id").alias("key"), F.col("ts").cast("date").alias("day")
    )
    return orders.unionByName(events)


def _key_tables(spark, d):
    return {
        "loans": table(spark, d, "orders").select(F.col("o_custkey").alias("k")),
        "attributes": table(spark, d, "customer").select(F.col("c_custkey").alias("k")),
        "clicks": table(spark, d, "events").select(F.col("user_id").alias("k")),
    }


_KEYS = """
    k AS (SELECT k, max(l) AS loans, max(a) AS attributes, max(c) AS clicks FROM (
      SELECT o_custkey AS k, 1 AS l, 0 AS a, 0 AS c FROM orders UNION ALL
      SELECT c_custkey, 0, 1, 0 FROM customer UNION ALL SELECT user_id, 0, 0, 1 FROM events) GROUP BY k)
"""


@query(
    "q_key_overlap",
    f"WITH {_KEYS} "
    + " UNION ALL ".join(
        f"SELECT '{t}' AS source, count(*) FILTER (WHERE {t} = 1) AS n_keys, "
        f"count(*) FILTER (WHERE {t} = 1 AND loans = 1) AS n_shared, "
        f"count(*) FILTER (WHERE {t} = 0 AND loans = 1) AS n_missing, "
        f"count(*) FILTER (WHERE loans = 1 AND attributes = 1 AND clicks = 1) AS n_everywhere FROM k"
        for t in ("loans", "attributes", "clicks")
    ),
)
def key_overlap(spark, d):
    return U.overlap_counts(_key_tables(spark, d), "k", base="loans")


@query(
    "q_key_difference",
    "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events)",
)
def key_difference(spark, d):
    t = _key_tables(spark, d)
    return t["loans"].subtract(t["clicks"]).agg(F.count(F.lit(1)).alias("n"))
