"""Joins, point-in-time aggregates and the gold feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapmart.catalogue import roles as R
from snapmart.catalogue.cleaning import _SILVER_ATTRIBUTES, _TYPED_FINANCIALS
from snapmart.catalogue.registry import query, table
from snapmart.functions import dates as D
from snapmart.operators import cleaning as C
from snapmart.operators import joins as J
from snapmart.operators import loans as L
from snapmart.operators.asof import asof_aggregate, cumulative_history
from snapmart.plans.features import feature_store


def _at_loan_days(rows, loans):
    """Customer rows dated at each of the customer's loan days."""
    days = loans.where(F.col("mob") == 0).select("Customer_ID", "snapshot_date").distinct()
    return rows.drop("snapshot_date").join(days, "Customer_ID")


_AS_OF = """
    SELECT s.Customer_ID, s.snapshot_date, count(*) AS clickstream_count, {aggs}
    FROM (SELECT DISTINCT Customer_ID, snapshot_date FROM spine) s
    JOIN clicks c ON c.Customer_ID = s.Customer_ID AND c.snapshot_date <= s.snapshot_date
    GROUP BY s.Customer_ID, s.snapshot_date
"""
_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}_mean" for c in R.CLICKS)
_FULL = ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std, "
    f"min({c}) AS {c}_min, max({c}) AS {c}_max"
    for c in R.CLICKS
)


@query(
    "q_feature_join",
    f"""
    {_TYPED_FINANCIALS},
    {_SILVER_ATTRIBUTES.strip().removeprefix('WITH')},
    {R.LOANS}, {R.CLICKS_SQL},
    spine AS (SELECT loan_id, Customer_ID, snapshot_date FROM loans WHERE mob = 0),
    history AS ({_AS_OF.format(aggs=_MEANS)})
    SELECT l.loan_id, l.Customer_ID, l.snapshot_date, a.Age,
           CASE a.Occupation WHEN 'Mechanic' THEN 9 WHEN 'Engineer' THEN 4 END AS Occupation,
           f.* EXCLUDE (Customer_ID, snapshot_date)
               REPLACE (CASE f.Credit_Mix WHEN 'Bad' THEN 0 WHEN 'Standard' THEN 1 WHEN 'Good' THEN 2 END AS Credit_Mix,
                        CASE f.Payment_of_Min_Amount WHEN 'No' THEN 0 WHEN 'Yes' THEN 1 END AS Payment_of_Min_Amount),
           {", ".join(f"h.{c}_mean" for c in R.CLICKS)},
           CASE WHEN h.clickstream_count IS NOT NULL THEN 1 ELSE 0 END AS has_clickstream
    FROM spine l
    LEFT JOIN attributes a USING (Customer_ID)
    LEFT JOIN featured f USING (Customer_ID)
    LEFT JOIN history h ON h.Customer_ID = l.Customer_ID AND h.snapshot_date = l.snapshot_date
    """,
)
def feature_join(spark, d):
    loans = R.loans(spark, d)
    # Cleaned once per customer row; only clean rows are copied to the days.
    attributes = _at_loan_days(C.clean_attributes(R.raw_attributes(spark, d)), loans)
    financials = _at_loan_days(C.clean_financials(R.raw_financials(spark, d)), loans)
    out = feature_store(loans, attributes, financials, R.clicks(spark, d), R.CLICKS)
    return out.withColumns({f"{c}_mean": F.round(f"{c}_mean", 6) for c in R.CLICKS})


@query(
    "q_versions_at",
    f"""
    WITH versions AS (SELECT o_custkey AS key, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS price
                      FROM orders GROUP BY 1, 2),
    days AS (SELECT DISTINCT user_id AS key, CAST(CAST(ts AS DATE) - to_months({R.EVENT_SHIFT_MONTHS}) AS DATE) AS day FROM events)
    SELECT d.key, d.day, v.day AS version_day, v.price
    FROM days d ASOF LEFT JOIN versions v ON d.key = v.key AND d.day >= v.day
    """,
)
def versions_at(spark, d):
    """Each customer's dearest order of the last order day up to each of the customer's event days."""
    day = F.col("o_orderdate").cast("date")
    versions = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key"), day.alias("day")).agg(
        F.max("o_totalprice").alias("price")
    )
    days = table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.add_months(F.col("ts").cast("date"), -R.EVENT_SHIFT_MONTHS).alias("day")
    ).distinct()
    return J.versions_at(days, versions, "key", "day")


@query(
    "q_pit_mean",
    f"""
    WITH {R.LOANS}, {R.CLICKS_SQL},
    spine AS (SELECT loan_id, Customer_ID, snapshot_date FROM loans WHERE mob = 0),
    history AS ({_AS_OF.format(aggs=_MEANS)})
    SELECT l.loan_id, l.Customer_ID, l.snapshot_date, h.clickstream_count,
           {", ".join(f"h.{c}_mean" for c in R.CLICKS)}
    FROM spine l LEFT JOIN history h ON h.Customer_ID = l.Customer_ID AND h.snapshot_date = l.snapshot_date
    """,
)
def pit_mean(spark, d):
    spine = R.loans(spark, d).where(F.col("mob") == 0).select("loan_id", "Customer_ID", "snapshot_date")
    out = asof_aggregate(spine, R.clicks(spark, d), "Customer_ID", R.CLICKS)
    return out.withColumns({f"{c}_mean": F.round(f"{c}_mean", 6) for c in R.CLICKS})


@query(
    "q_pit_full",
    f"""
    WITH {R.CLICKS_SQL},
    spine AS (SELECT CAST(user_id AS VARCHAR) AS Customer_ID,
                     min(CAST(CAST(ts AS DATE) - to_months({R.EVENT_SHIFT_MONTHS}) AS DATE)) AS snapshot_date
              FROM events WHERE event_type = 'signup' GROUP BY user_id)
    {_AS_OF.format(aggs=_FULL)}
    """,
)
def pit_full(spark, d):
    facts = R.clicks(spark, d)
    signups = facts.where(F.col("fe_4").isNotNull())
    spine = signups.groupBy("Customer_ID").agg(F.min("snapshot_date").alias("snapshot_date"))
    out = asof_aggregate(spine, facts, "Customer_ID", R.CLICKS, stats=("mean", "std", "min", "max"))
    return out.withColumns(
        {f"{c}_{s}": F.round(f"{c}_{s}", 6) for c in R.CLICKS for s in ("mean", "std")}
    )


@query(
    "q_pit_full_applications",
    f"""
    WITH {R.LOANS}, {R.CLICKS_SQL},
    spine AS (SELECT Customer_ID, snapshot_date FROM loans WHERE mob = 0)
    {_AS_OF.format(aggs=_FULL)}
    """,
)
def pit_full_applications(spark, d):
    """All statistics at every application day that has click history."""
    spine = R.loans(spark, d).where(F.col("mob") == 0).select("Customer_ID", "snapshot_date").distinct()
    out = asof_aggregate(spine, R.clicks(spark, d), "Customer_ID", R.CLICKS, stats=("mean", "std", "min", "max"))
    return out.where(F.col("clickstream_count").isNotNull()).withColumns(
        {f"{c}_{s}": F.round(f"{c}_{s}", 6) for c in R.CLICKS for s in ("mean", "std")}
    )


_HISTORY = """
    WITH {clicks},
    spine AS (SELECT Customer_ID, snapshot_date FROM clicks)
    SELECT Customer_ID, snapshot_date, clickstream_count AS history_count, * EXCLUDE (Customer_ID, snapshot_date, clickstream_count)
    FROM ({asof})
"""


@query("q_history_mean", _HISTORY.format(clicks=R.CLICKS_SQL, asof=_AS_OF.format(aggs=_MEANS)))
def history_mean(spark, d):
    out = cumulative_history(R.clicks(spark, d), "Customer_ID", R.CLICKS)
    return out.withColumns({f"{c}_mean": F.round(f"{c}_mean", 6) for c in R.CLICKS})


@query("q_history_full", _HISTORY.format(clicks=R.CLICKS_SQL, asof=_AS_OF.format(aggs=_FULL)))
def history_full(spark, d):
    out = cumulative_history(
        R.clicks(spark, d), "Customer_ID", R.CLICKS, stats=("mean", "std", "min", "max")
    )
    return out.withColumns(
        {f"{c}_{s}": F.round(f"{c}_{s}", 6) for c in R.CLICKS for s in ("mean", "std")}
    )


@query(
    "q_inner_join",
    f"""
    WITH {R.LOANS}
    SELECT a.loan_id, a.loan_amt, CASE WHEN b.dpd >= 30 THEN 1 ELSE 0 END AS label
    FROM (SELECT * FROM loans WHERE mob = 0) a JOIN (SELECT * FROM loans WHERE mob = 6) b USING (loan_id)
    """,
)
def inner_join(spark, d):
    panel = R.loans(spark, d)
    features = panel.where(F.col("mob") == 0).select("loan_id", "loan_amt")
    return J.features_with_labels(features, L.label_store(panel))


@query(
    "q_composite_join",
    """
    SELECT c.user_id, c.day, c.n_clicks, p.n_purchases
    FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_clicks FROM events WHERE event_type = 'click' GROUP BY 1, 2) c
    LEFT JOIN (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_purchases FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) p
      ON c.user_id = p.user_id AND c.day = p.day
    """,
)
def composite_join(spark, d):
    events = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))

    def per_day(kind: str, name: str):
        only = events.where(F.col("event_type") == kind)
        return only.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias(name))

    return per_day("click", "n_clicks").join(
        per_day("purchase", "n_purchases"), ["user_id", "day"], "left"
    )


@query(
    "q_delayed_label",
    """
    WITH p AS (SELECT o_orderkey, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS snapshot_date,
                      o_totalprice AS model_predictions FROM orders),
    l AS (SELECT l_orderkey, CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS label_date,
                 max(CAST(l_returnflag = 'R' AS INTEGER)) AS label FROM lineitem GROUP BY 1, 2)
    SELECT CAST(o_orderkey AS VARCHAR) AS loan_id, snapshot_date, model_predictions, label_date, label
    FROM p JOIN l ON l_orderkey = o_orderkey AND label_date = CAST(snapshot_date + INTERVAL 6 MONTH AS DATE)
    """,
)
def delayed_label(spark, d):
    predictions = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("loan_id"),
        D.month_start(F.col("o_orderdate")).alias("snapshot_date"),
        F.col("o_totalprice").alias("model_predictions"),
    )
    labels = (
        table(spark, d, "lineitem")
        .groupBy(
            F.col("l_orderkey").cast("string").alias("loan_id"),
            D.month_start(F.col("l_shipdate")).alias("snapshot_date"),
        )
        .agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"))
    )
    return J.delayed_labels(predictions, labels)


@query("q_semi", "SELECT * FROM customer WHERE c_custkey IN (SELECT user_id FROM events)")
def semi(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return J.present_in(table(spark, d, "customer"), users, "c_custkey")


@query("q_anti", "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def anti(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("c_custkey"))
    return J.absent_from(table(spark, d, "customer"), users, "c_custkey")


@query(
    "q_key_agreement",
    """
    SELECT count(*) AS n_rows, count(*) FILTER (WHERE o_orderdate = l_shipdate) AS n_equal,
           bool_and(o_orderdate = l_shipdate) AS all_equal
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    """,
)
def key_agreement(spark, d):
    return J.key_agreement(
        table(spark, d, "orders").withColumnRenamed("o_orderkey", "k"),
        table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k"),
        "k", "o_orderdate", "l_shipdate",
    )


@query(
    "q_side_by_side",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS loan_id, CAST(o_orderstatus = 'F' AS INTEGER) AS label,
           champion, challenger
    FROM orders
    JOIN (SELECT l_orderkey, max(l_discount) AS champion FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
    JOIN (SELECT l_orderkey AS k, min(l_tax) AS challenger FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) ON k = o_orderkey
    """,
)
def side_by_side(spark, d):
    lines = table(spark, d, "lineitem").withColumn("loan_id", F.col("l_orderkey").cast("string"))
    labels = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("loan_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )
    return J.scores_side_by_side(
        labels,
        champion=lines.groupBy("loan_id").agg(F.max("l_discount").alias("model_predictions")),
        challenger=lines.where(F.col("l_returnflag") != "N")
        .groupBy("loan_id")
        .agg(F.min("l_tax").alias("model_predictions")),
    )


