"""Association of features with each other and with a binary label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.functions.tails import chi2_p_value, t_p_value
from snapmart.operators import comoments
from snapmart.operators.filters import all_present, complete_cases
from snapmart.operators.order_stats import as_value
from snapmart.operators.profiling import per_column


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of two columns' value pairs, NULLs excluded."""
    return complete_cases(df, [a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def label_cells(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Contingency cells of several columns against one, in one pass: (column, a, b, n)."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(c).cast("string").alias("a"),
                F.col(label).cast("string").alias("b"),
            )
            for c in columns
        ]
    )
    return (
        df.select(F.inline(cells))
        .where(all_present(["column", "a", "b"]))
        .groupBy("column", "a", "b")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def chi_square_of_cells(cells: DataFrame) -> DataFrame:
    """Chi-square test per ``column`` from (column, a, b, n).

    Works on counts, without joins: the cells of a level ``a`` meet in one group, and the
    totals of each level ``b``, at most columns times levels of the label, come as a map
    in a scalar subquery. Value pairs that never occur add their expected count. A 2x2
    table gets the continuity correction.
    """
    totals = cells.groupBy("column", "b").agg(F.sum("n").alias("col_n")).groupBy("column").agg(
        F.struct(
            F.sum("col_n").alias("total"), F.count(F.lit(1)).alias("n_cols"), F.sum(1 / F.col("col_n")).alias("inv_cols"),
            F.map_from_entries(F.collect_list(F.struct("b", "col_n"))).alias("of"),
        ).alias("t")
    )
    known = totals.agg(F.map_from_entries(F.collect_list(F.struct("column", "t"))).alias("m")).scalar()
    rows = (
        cells.groupBy("column", "a")
        .agg(F.sum("n").alias("row_n"), F.collect_list(F.struct("b", "n")).alias("cells"))
        .withColumn("t", known[F.col("column")])
    )

    def expected(cell: Column) -> Column:
        return F.col("row_n") * (F.col("t")["of"][cell["b"]] / F.col("t")["total"])

    def gap(cell: Column) -> Column:
        return cell["n"] - expected(cell)

    zero = F.lit(0.0)
    per_row = rows.select(
        "column", "row_n", "t",
        F.aggregate("cells", zero, lambda s, x: s + gap(x) * gap(x) / expected(x)).alias("observed_part"),
        F.aggregate("cells", zero, lambda s, x: s + expected(x)).alias("expected_seen"),
        F.array_max(F.transform("cells", lambda x: F.abs(gap(x)))).alias("gap"),
    )
    joined = per_row.groupBy("column").agg(
        F.sum("observed_part").alias("observed_part"), F.sum("expected_seen").alias("expected_seen"),
        F.max("gap").alias("gap"), F.count(F.lit(1)).alias("n_rows"), F.sum(1 / F.col("row_n")).alias("inv_rows"),
        F.first("t").alias("t"),
    ).select("*", F.col("t")["total"].alias("total"), F.col("t")["n_cols"].alias("n_cols"), F.col("t")["inv_cols"].alias("inv_cols"))
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    plain = F.col("observed_part") + F.greatest(F.col("total") - F.col("expected_seen"), zero)
    corrected_gap = F.col("gap") - F.least(F.col("gap"), F.lit(0.5))
    corrected = (
        corrected_gap * corrected_gap * F.col("total") * F.col("inv_rows") * F.col("inv_cols")
    )
    return joined.select(
        "column",
        F.col("total").alias("n"),
        "n_rows",
        "n_cols",
        dof.alias("dof"),
        F.when(dof == 0, zero).when(dof == 1, corrected).otherwise(plain).alias("chi2"),
    )


def chi_square(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Chi-square statistic and degrees of freedom of each column against one."""
    return chi_square_of_cells(label_cells(df, columns, label))


def with_p_value(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p_value", chi2_p_value(F.col("chi2"), F.col("dof").cast("double")))


def cramers_v(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Strength of association in 0..1 from the chi-square statistic."""
    tests = chi_square(df, columns, label)
    k = F.least("n_rows", "n_cols") - 1
    v = F.when(k > 0, F.sqrt(F.col("chi2") / (F.col("n") * k))).otherwise(F.lit(0.0))
    return tests.withColumn("cramers_v", v)


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both exist; NULL when one is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def point_biserial(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Correlation of each numeric column with a 0/1 label, and its direction."""
    y = as_value(label)
    rows = per_column(
        df,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(as_value(c).isNotNull() & y.isNotNull()).alias("n"),
                pearson(as_value(c), y).alias("r"),
            )
            for c in columns
        ],
    )
    r, dof = F.col("r"), F.col("n") - 2
    t = F.when(
        (dof > 0) & (F.abs(r) < 1), r * F.sqrt(F.greatest(dof, F.lit(0)) / (1 - r * r))
    )
    return rows.select(
        "column",
        "n",
        "r",
        t.alias("t"),
        F.when(r > 0, "higher in bad").otherwise("higher in good").alias("direction"),
    )


def association_ranking(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str,
    p_values: bool = True,
) -> DataFrame:
    """Numeric and categorical features by strength of association with the label."""
    n = point_biserial(df, numeric, label)
    c = cramers_v(df, categorical, label)
    numbers = n.select(
        F.col("column").alias("feature"),
        F.lit("numeric").alias("type"),
        F.abs("r").alias("association"),
        *([t_p_value(F.col("t"), (F.col("n") - 2).cast("double")).alias("p_value")] if p_values else []),
        "direction",
    )
    classes = c.select(
        F.col("column").alias("feature"),
        F.lit("categorical").alias("type"),
        F.col("cramers_v").alias("association"),
        *([chi2_p_value(F.col("chi2"), F.col("dof").cast("double")).alias("p_value")] if p_values else []),
        F.lit("varies by group").alias("direction"),
    )
    return numbers.unionByName(classes).orderBy(F.col("association").desc(), "feature")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of every column pair (upper triangle), pairwise complete, in one scan.

    NULL where a pair shares no rows, one of its columns is constant on them, or infinite.
    """
    schema = "feature_1 string, feature_2 string, correlation double"
    names = list(columns)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], schema)
    states = comoments.states(df.select(*[as_value(c).alias(c) for c in names]), names)

    def ratios(state: comoments.State, i: int) -> dict[str, list]:
        r, at = state.correlations(), range(i + 1, len(names))
        return {
            "feature_1": [names[i] for _ in at], "feature_2": [names[j] for j in at],
            "correlation": [r[j] for j in at],
        }

    return comoments.finished(states, ratios, schema)


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Square matrix: one row per column, one column per column, 1 on the diagonal."""
    upper = correlations(df, columns)
    both = upper.unionByName(
        upper.select(
            F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), "correlation"
        )
    )
    square = both.groupBy("feature_1").pivot("feature_2", list(columns)).agg(F.max("correlation"))
    return square.select(
        F.col("feature_1").alias("feature"),
        *[
            F.when(F.col("feature_1") == c, F.lit(1.0)).otherwise(F.col(c)).alias(c)
            for c in columns
        ],
    )


def correlated_pairs(
    df: DataFrame, columns: Sequence[str], high: float = 0.7, moderate: float = 0.5
) -> DataFrame:
    """Pairs above the two limits, strongest first."""
    size = F.abs("correlation")
    level = F.when(size > high, "high").when(size > moderate, "moderate")
    return (
        correlations(df, columns)
        .withColumn("level", level)
        .where(F.col("level").isNotNull())
        .orderBy(size.desc(), "feature_1", "feature_2")
    )


def separation(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Levels whose bad rate is (almost) 0 or 100 percent."""
    cells = label_cells(df, columns, label)
    rates = cells.groupBy("column", "a").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("b") == "1", F.col("n")).otherwise(0)).alias("n_bad"),
    )
    pct = F.round(F.col("n_bad") * 100 / F.col("n"), 2)
    kind = (
        F.when(pct.isin(0.0, 100.0), "complete")
        .when((pct < 2) | (pct > 98), "quasi-complete")
        .otherwise("none")
    )
    return rates.select(
        "column", F.col("a").alias("level"), "n", pct.alias("bad_rate_pct"), kind.alias("separation")
    )
