"""Statistical profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapmart.catalogue import roles as R
from snapmart.catalogue.registry import query, table
from snapmart.operators import profiling as Q
from snapmart.operators.order_stats import approx_quantiles, exact_quantiles

_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_P = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def _rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "q_describe",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 8) AS mean,
        round(stddev_samp({c}), 8) AS std, min({c}) AS min, max({c}) AS max,
        {", ".join(f"round(quantile_cont({c}, {p}), 8) AS {n}" for n, p in _P.items())} FROM lineitem"""
        for c in _NUMERIC
    ),
)
def describe(spark, d):
    return _rounded(Q.describe(table(spark, d, "lineitem"), _NUMERIC), 8, "mean", "std", *_P)


@query("q_describe_approx")
def describe_approx(spark, d):
    """Sketched percentiles: existing values, so only the row count is comparable."""
    return Q.describe(table(spark, d, "lineitem"), _NUMERIC, approx=True)


@query(
    "q_quantiles_by_group",
    """
    SELECT l_returnflag, l_linestatus, 'l_extendedprice' AS "column", count(*) AS n,
           round(quantile_cont(l_extendedprice, 0.1), 8) AS q10, round(quantile_cont(l_extendedprice, 0.5), 8) AS q50,
           round(quantile_cont(l_extendedprice, 0.9), 8) AS q90
    FROM lineitem GROUP BY ALL
    """,
)
def quantiles_by_group(spark, d):
    by = ["l_returnflag", "l_linestatus"]
    found = exact_quantiles(table(spark, d, "lineitem"), ["l_extendedprice"], [0.1, 0.5, 0.9], by=by)
    q = F.col("q")
    return found.select(
        *by, "column", "n",
        *[F.round(q[i], 8).alias(n) for i, n in enumerate(["q10", "q50", "q90"])],
    )


@query("q_quantiles_approx")
def quantiles_approx(spark, d):
    found = approx_quantiles(
        table(spark, d, "lineitem"), ["l_extendedprice"], [0.1, 0.5, 0.9], by=["l_returnflag"]
    )
    return found.select("l_returnflag", "column", "n", *[F.col("q")[i].alias(f"q{i}") for i in range(3)])


@query(
    "q_skewness",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(skewness({c}), 6) AS skewness, abs(skewness({c})) > 2 AS high_skew FROM {t}"
        for c, t in (("l_quantity", "lineitem"), ("l_extendedprice", "lineitem"), ("l_tax", "lineitem"))
    ),
)
def skewness(spark, d):
    found = Q.skewness(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return _rounded(found, 6, "skewness")


@query(
    "q_iqr_outliers",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
        round(q1 - 1.5 * (q3 - q1), 6) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 6) AS upper_bound,
        count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS n_outliers,
        count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) * 100 / CAST(count(x) AS DOUBLE) AS pct_outliers
        FROM (SELECT value AS x FROM events) , (SELECT quantile_cont({e}, 0.25) AS q1, quantile_cont({e}, 0.75) AS q3 FROM events)
        GROUP BY q1, q3"""
        for c, e in (("value", "value"),)
    ),
)
def iqr_outliers(spark, d):
    found = Q.iqr_outliers(table(spark, d, "events"), ["value"])
    return _rounded(found, 6, "q1", "q3", "iqr", "lower_bound", "upper_bound")


_TEXTS = ["Annual_Income", "Num_of_Loan", "Changed_Credit_Limit", "Credit_Utilization_Ratio"]


@query(
    "q_non_numeric",
    f"WITH {R.RAW_FINANCIALS} "
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL) AS n_bad,
        (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM raw_financials
          WHERE {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL ORDER BY 1 LIMIT 3)) AS samples
        FROM raw_financials"""
        for c in _TEXTS
    ),
)
def non_numeric(spark, d):
    return Q.non_numeric(R.raw_financials(spark, d), _TEXTS)


@query(
    "q_ranges",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value FROM part"
        for c in ("p_size", "p_retailprice")
    ),
)
def ranges(spark, d):
    return Q.ranges(table(spark, d, "part"), ["p_size", "p_retailprice"])


@query(
    "q_ratio_check",
    f"""
    WITH r AS (SELECT l_extendedprice / (o_totalprice / 12) AS ratio FROM lineitem JOIN orders ON l_orderkey = o_orderkey
               WHERE o_totalprice <> 0)
    SELECT 'ratio' AS "column", count(ratio) AS count, round(avg(ratio), 6) AS mean, round(stddev_samp(ratio), 6) AS std,
           round(min(ratio), 6) AS min, round(max(ratio), 6) AS max,
           {", ".join(f"round(quantile_cont(ratio, {p}), 6) AS {n}" for n, p in _P.items())}
    FROM r
    """,
)
def ratio_check(spark, d):
    joined = table(spark, d, "lineitem").join(
        table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    found = Q.ratio_check(joined, "l_extendedprice", "o_totalprice")
    return _rounded(found, 6, "mean", "std", "min", "max", *_P)


_LEVELS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS level, count(*) AS n FROM part GROUP BY {c}"
    for c in ("p_type", "p_brand", "p_size")
)


@query(
    "q_level_audit",
    f"""
    WITH levels AS ({_LEVELS})
    SELECT "column", level, n, n / CAST(sum(n) OVER (PARTITION BY "column") AS DOUBLE) AS share,
           n / CAST(sum(n) OVER (PARTITION BY "column") AS DOUBLE) < 0.05 AS rare
    FROM levels
    """,
)
def level_audit(spark, d):
    return Q.level_shares(table(spark, d, "part"), ["p_type", "p_brand", "p_size"])


@query(
    "q_discrete_audit",
    f"""
    WITH levels AS ({_LEVELS}),
    shares AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY "column") AS DOUBLE) < 0.05 AS rare FROM levels)
    SELECT "column", count(level) AS n_values, count(*) FILTER (WHERE rare) AS n_rare,
           CAST(coalesce(sum(n) FILTER (WHERE rare), 0) AS BIGINT) AS rows_in_rare
    FROM shares GROUP BY 1
    """,
)
def discrete_audit(spark, d):
    return Q.discrete_audit(table(spark, d, "part"), ["p_type", "p_brand", "p_size"])


_HIST = """
    WITH b AS (SELECT min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / 30 AS w FROM events),
    h AS (SELECT {by} CAST(least(floor((value - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM events, b GROUP BY ALL)
    SELECT {by} bin, round(lo + bin * w, 8) AS left_edge, n,
           round(n / (sum(n) OVER ({part}) * w), 12) AS density
    FROM h, b
"""


@query("q_histogram", _HIST.format(by="", part=""))
def histogram(spark, d):
    found = Q.histogram(table(spark, d, "events"), "value", 30)
    return _rounded(_rounded(found, 8, "left_edge"), 12, "density")


@query(
    "q_histogram_by_group", _HIST.format(by="event_type,", part="PARTITION BY event_type")
)
def histogram_by_group(spark, d):
    found = Q.histogram(table(spark, d, "events"), "value", 30, by=["event_type"])
    return _rounded(_rounded(found, 8, "left_edge"), 12, "density")


@query(
    "q_five_number",
    " UNION ALL ".join(
        f"""SELECT l_returnflag, '{c}' AS "column", count(*) AS n, min({c}) AS min,
        round(quantile_cont({c}, 0.25), 8) AS q1, round(quantile_cont({c}, 0.5), 8) AS median,
        round(quantile_cont({c}, 0.75), 8) AS q3, max({c}) AS max FROM lineitem GROUP BY 1"""
        for c in ("l_extendedprice", "l_quantity")
    ),
)
def five_number(spark, d):
    found = Q.five_numbers(
        table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"], by=["l_returnflag"]
    )
    return _rounded(found, 8, "q1", "median", "q3")


_DIRECTION = {
    "l_extendedprice": "quartile", "l_quantity": "quartile", "few": "value",
}


def _direction_sql(c: str) -> str:
    if _DIRECTION[c] == "value":
        group = f"CAST({c} AS DOUBLE)"
        source = "x"
        each = "concat(CAST(CAST(g AS BIGINT) AS VARCHAR), '=', CAST(CAST(round(rate * 100) AS BIGINT) AS VARCHAR), '%')"
        note = f"concat('by value: ', string_agg({each}, ', ' ORDER BY g))"
    else:
        note = f"printf('median %.2f', (SELECT quantile_cont({c}, 0.5) FROM x))"
        group = (
            f"CASE WHEN {c} <= e[2] THEN 0 WHEN {c} <= e[3] THEN 1 WHEN {c} <= e[4] THEN 2 ELSE 3 END"
        )
        source = f"x, (SELECT quantile_cont({c}, [0, 0.25, 0.5, 0.75, 1]) AS e FROM x)"
    return f"""
    SELECT '{c}' AS feature, arg_min(rate, g) AS default_rate_low, arg_max(rate, g) AS default_rate_high,
           count(*) AS n_groups,
           CASE WHEN arg_max(rate, g) > arg_min(rate, g) THEN 'higher risk' ELSE 'lower risk' END AS higher_value_means, {note} AS note
    FROM (SELECT {group} AS g, avg(label) AS rate FROM {source} GROUP BY 1)"""


@query(
    "q_quartile_direction",
    """
    WITH x AS (SELECT l_extendedprice, l_quantity, l_linenumber % 3 AS few, CAST(l_returnflag = 'R' AS INTEGER) AS label
               FROM lineitem)
    """
    + " UNION ALL ".join(_direction_sql(c) for c in _DIRECTION),
)
def quartile_direction(spark, d):
    lines = table(spark, d, "lineitem").select(
        "l_extendedprice", "l_quantity", (F.col("l_linenumber") % 3).alias("few"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
    return Q.quartile_direction(lines, list(_DIRECTION))


@query(
    "q_missingness",
    """
    SELECT has_events, avg(CAST(o_orderstatus = 'F' AS INTEGER)) AS bad_rate, count(*) AS n FROM (
      SELECT o_orderstatus, CASE WHEN o_custkey IN (SELECT user_id FROM events) THEN 1 ELSE 0 END AS has_events FROM orders)
    GROUP BY 1
    """,
)
def missingness(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("o_custkey")).distinct()
    flagged = table(spark, d, "orders").join(users.withColumn("seen", F.lit(1)), "o_custkey", "left")
    labelled = flagged.select(
        F.coalesce("seen", F.lit(0)).alias("has_events"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )
    return Q.bad_rate_by(labelled, ["has_events"])


@query(
    "q_missingness_distribution",
    """
    WITH x AS (SELECT o_totalprice AS v, CASE WHEN o_custkey IN (SELECT user_id FROM events) THEN 1 ELSE 0 END AS has_events FROM orders),
    b AS (SELECT min(v) AS lo, (max(v) - min(v)) / 25 AS w FROM x),
    h AS (SELECT has_events, CAST(least(floor((v - lo) / w), 24) AS INTEGER) AS bin, count(*) AS n FROM x, b GROUP BY ALL)
    SELECT has_events, bin, round(lo + bin * w, 6) AS left_edge, n,
           round(n / (sum(n) OVER (PARTITION BY has_events) * w), 14) AS density FROM h, b
    """,
)
def missingness_distribution(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("o_custkey")).distinct()
    flagged = table(spark, d, "orders").join(users.withColumn("seen", F.lit(1)), "o_custkey", "left")
    values = flagged.select(F.coalesce("seen", F.lit(0)).alias("has_events"), "o_totalprice")
    found = Q.histogram(values, "o_totalprice", 25, by=["has_events"])
    return _rounded(_rounded(found, 6, "left_edge"), 14, "density")
