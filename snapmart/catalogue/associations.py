"""Correlation, chi-square and association with a label."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from snapmart.catalogue import roles as R
from snapmart.catalogue.registry import query, table
from snapmart.operators import association as A

_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS correlation FROM x"
    for a, b in combinations([*_NUMERIC, "due"], 2)
)
_LINES = "x AS (SELECT *, l_extendedprice * l_tax AS due, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)"


def _lines(spark, d):
    return table(spark, d, "lineitem").withColumns(
        {
            "due": F.col("l_extendedprice") * F.col("l_tax"),
            "label": (F.col("l_returnflag") == "R").cast("int"),
        }
    )


@query(
    "q_corr_matrix",
    f"""
    WITH {_LINES}, r AS ({_CORR}),
    both_ways AS (SELECT * FROM r UNION ALL SELECT feature_2, feature_1, correlation FROM r)
    SELECT feature_1 AS feature, {", ".join(
        f"round(CASE WHEN feature_1 = '{c}' THEN 1.0 ELSE max(CASE WHEN feature_2 = '{c}' THEN correlation END) END, 8) AS {c}"
        for c in [*_NUMERIC, 'due'])}
    FROM both_ways GROUP BY feature_1
    """,
)
def corr_matrix(spark, d):
    columns = [*_NUMERIC, "due"]
    found = A.correlation_matrix(_lines(spark, d), columns)
    return found.withColumns({c: F.round(c, 8) for c in columns})


@query(
    "q_corr_pairs",
    f"""
    WITH {_LINES}, r AS ({_CORR})
    SELECT feature_1, feature_2, round(correlation, 8) AS correlation,
           CASE WHEN abs(correlation) > 0.65 THEN 'high' ELSE 'moderate' END AS level
    FROM r WHERE abs(correlation) > 0.5
    """,
)
def corr_pairs(spark, d):
    found = A.correlated_pairs(_lines(spark, d), [*_NUMERIC, "due"], high=0.65, moderate=0.5)
    return found.withColumn("correlation", F.round("correlation", 8))


_CATEGORIES = ["l_linestatus", "l_linenumber", "quantity_band"]


def _categories(spark, d):
    return _lines(spark, d).withColumn("quantity_band", F.floor(F.col("l_quantity") / 10).cast("int"))


def _chi2(c: str) -> str:
    return f"""
    SELECT '{c}' AS "column", CAST(max(total) AS BIGINT) AS n, count(DISTINCT a) AS n_rows, count(DISTINCT b) AS n_cols,
           (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS dof,
           CASE WHEN (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) = 1
                THEN sum(pow(abs(n - e) - least(0.5, abs(n - e)), 2) / e) ELSE sum(pow(n - e, 2) / e) END AS chi2
    FROM (SELECT a, b, n, total, sum(n) OVER (PARTITION BY a) * (sum(n) OVER (PARTITION BY b) / CAST(total AS DOUBLE)) AS e
          FROM (SELECT CAST({c} AS VARCHAR) AS a, label AS b, count(*) AS n, sum(count(*)) OVER () AS total
                FROM y GROUP BY 1, 2))
    """


_CATS = f"{_LINES}, y AS (SELECT *, CAST(floor(l_quantity / 10) AS INTEGER) AS quantity_band FROM x)"
_CHI2 = " UNION ALL ".join(_chi2(c) for c in _CATEGORIES)


@query(
    "q_chi2",
    f"WITH {_CATS}, t AS ({_CHI2}) SELECT * REPLACE (round(chi2, 8) AS chi2) FROM t",
)
def chi2(spark, d):
    return A.chi_square(_categories(spark, d), _CATEGORIES, "label").withColumn(
        "chi2", F.round("chi2", 8)
    )


@query(
    "q_cramers_v",
    f"""
    WITH {_CATS}, t AS ({_CHI2})
    SELECT * REPLACE (round(chi2, 8) AS chi2),
           round(sqrt(chi2 / (n * (least(n_rows, n_cols) - 1))), 8) AS cramers_v FROM t
    """,
)
def cramers_v(spark, d):
    return A.cramers_v(_categories(spark, d), _CATEGORIES, "label").withColumns(
        {c: F.round(c, 8) for c in ("chi2", "cramers_v")}
    )


@query("q_chi2_p_values")
def chi2_p_values(spark, d):
    """P-values have no SQL twin; unit tests hold them against known values."""
    return A.with_p_value(A.chi_square(_categories(spark, d), _CATEGORIES, "label"))


_PB = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS n, corr(label, {c}) AS r FROM y""" for c in _NUMERIC
)


@query(
    "q_point_biserial",
    f"""
    WITH {_CATS}, t AS ({_PB})
    SELECT "column", n, round(r, 8) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t,
           CASE WHEN r > 0 THEN 'higher in bad' ELSE 'higher in good' END AS direction FROM t
    """,
)
def point_biserial(spark, d):
    found = A.point_biserial(_categories(spark, d), _NUMERIC, "label")
    return found.withColumns({"r": F.round("r", 8), "t": F.round("t", 6)})


@query(
    "q_association_rank",
    f"""
    WITH {_CATS}, c AS ({_CHI2}), p AS ({_PB})
    SELECT "column" AS feature, 'numeric' AS type, round(abs(r), 8) AS association,
           CASE WHEN r > 0 THEN 'higher in bad' ELSE 'higher in good' END AS direction FROM p
    UNION ALL
    SELECT "column", 'categorical', round(sqrt(chi2 / (n * (least(n_rows, n_cols) - 1))), 8), 'varies by group' FROM c
    """,
)
def association_rank(spark, d):
    found = A.association_ranking(
        _categories(spark, d), _NUMERIC, _CATEGORIES, "label", p_values=False
    )
    return found.withColumn("association", F.round("association", 8))


@query("q_association_p_values")
def association_p_values(spark, d):
    return A.association_ranking(_categories(spark, d), _NUMERIC, _CATEGORIES, "label")


@query(
    "q_separation",
    f"""
    WITH {R.DOCUMENT_SCORES}, t AS ({" UNION ALL ".join(
        f'''SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS level, count(*) AS n,
            round(sum(label) * 100 / CAST(count(*) AS DOUBLE), 2) AS bad_rate_pct FROM document_scores GROUP BY {c}'''
        for c in ('lang', 'source', 'quality'))})
    SELECT *, CASE WHEN bad_rate_pct IN (0, 100) THEN 'complete'
                   WHEN bad_rate_pct < 2 OR bad_rate_pct > 98 THEN 'quasi-complete' ELSE 'none' END AS separation
    FROM t
    """,
)
def separation(spark, d):
    return A.separation(R.document_scores(spark, d), ["lang", "source", "quality"], "label")
