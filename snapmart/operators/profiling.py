"""Table profiles: distributions, outliers, audits.

A profile of many columns is one aggregate over one scan; the per-column rows
are made from its single result row with ``inline``.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.functions import numbers as N
from snapmart.operators.filters import complete_cases
from snapmart.operators.order_stats import (
    approx_quantiles,
    as_value,
    exact_quantiles,
    quantile_table,
)
from snapmart.operators.ranking import level_counts, top_k_per_group

DESCRIBE_PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def per_column(df: DataFrame, rows: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """One output row per struct of aggregates."""
    return df.groupBy(*by).agg(F.array(*rows).alias("rows")).select(*by, F.inline("rows"))


def describe(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Count, mean, deviation, extremes and tail percentiles per column."""
    moments = per_column(
        df,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.count(as_value(c)).alias("count"),
                F.avg(as_value(c)).alias("mean"),
                F.stddev(as_value(c)).alias("std"),
                F.min(as_value(c)).alias("min"),
                F.max(as_value(c)).alias("max"),
            )
            for c in columns
        ],
    )
    find = approx_quantiles if approx else exact_quantiles
    tails = find(df, columns, DESCRIBE_PROBS).select(
        "column",
        *[F.col("q")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(DESCRIBE_PROBS)],
    )
    return moments.join(tails, "column", "left")


def skewness(df: DataFrame, columns: Sequence[str], limit: float = 2.0) -> DataFrame:
    """Bias-corrected skewness, flagged beyond the limit."""
    rows = per_column(
        df,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.count(as_value(c)).cast("double").alias("n"),
                F.skewness(as_value(c)).alias("g"),
            )
            for c in columns
        ],
    )
    n = F.col("n")
    corrected = F.when(n > 2, F.col("g") * F.sqrt(n * (n - 1)) / (n - 2))
    return rows.select(
        "column", corrected.alias("skewness"), (F.abs(corrected) > limit).alias("high_skew")
    )


def iqr_outliers(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartiles, fences and the rows beyond them, per column.

    A column without values has NULL quartiles and fences and no outliers.
    """
    quartiles = quantile_table(df, columns, [0.25, 0.75])
    rows = []
    for c, q in quartiles.items():
        x = as_value(c)
        if q:
            q1, q3 = q
            low, high = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
            step = q3 - q1
        else:
            q1 = q3 = low = high = step = None
        lit = [F.lit(v).cast("double") for v in (q1, q3, step, low, high)]
        out = F.count_if((x < lit[3]) | (x > lit[4]))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                lit[0].alias("q1"),
                lit[1].alias("q3"),
                lit[2].alias("iqr"),
                lit[3].alias("lower_bound"),
                lit[4].alias("upper_bound"),
                out.alias("n_outliers"),
                N.ratio(out * 100, F.count(x)).alias("pct_outliers"),
            )
        )
    return per_column(df, rows)


def non_numeric(df: DataFrame, columns: Sequence[str], samples: int = 3) -> DataFrame:
    """Texts that are no number, counted per column, with the first few distinct."""

    def bad(c: str) -> Column:
        return F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()

    counted = per_column(
        df,
        [F.struct(F.lit(c).alias("column"), F.count_if(bad(c)).alias("n_bad")) for c in columns],
    )
    texts = df.select(*[F.when(bad(c), F.col(c)).alias(c) for c in columns])
    distinct = level_counts(texts, columns).where(F.col("level").isNotNull())
    shown = (
        top_k_per_group(distinct, ["column"], [F.col("level").asc()], samples)
        .groupBy("column")
        .agg(F.concat_ws("|", F.sort_array(F.collect_list("level"))).alias("samples"))
    )
    return counted.join(shown, "column", "left")


def ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return per_column(
        df,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.min(as_value(c)).alias("min_value"),
                F.max(as_value(c)).alias("max_value"),
            )
            for c in columns
        ],
    )


def null_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL count and share of every column in one pass."""
    return per_column(
        df,
        [
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(F.col(c).isNull()).alias("n_null"),
                N.ratio(F.count_if(F.col(c).isNull()), F.count(F.lit(1))).alias("null_rate"),
            )
            for c in (columns or df.columns)
        ],
    )


def conditional_counts(
    df: DataFrame, conditions: Mapping[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Rows satisfying each named condition, all in one pass."""
    return df.groupBy(*by).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Levels per column, exact or sketched."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return per_column(
        df, [F.struct(F.lit(c).alias("column"), count(c).alias("n_distinct")) for c in columns]
    )


def level_shares(df: DataFrame, columns: Sequence[str], limit: float = 0.05) -> DataFrame:
    """Level sizes as shares of all rows, flagged below the limit; NULL is a level."""
    levels = level_counts(df, columns)
    totals = levels.groupBy("column").agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    return levels.join(totals, "column").select(
        "column", "level", "n", share.alias("share"), (share < limit).alias("rare")
    )


def discrete_audit(df: DataFrame, columns: Sequence[str], limit: float = 0.05) -> DataFrame:
    """Per column: how many values it has and how many of them are rare."""
    return (
        level_shares(df, columns, limit)
        .groupBy("column")
        .agg(
            F.count("level").alias("n_values"),
            F.count_if("rare").alias("n_rare"),
            F.sum(F.when(F.col("rare"), F.col("n")).otherwise(0)).alias("rows_in_rare"),
        )
    )


def histogram(
    df: DataFrame, column: str, bins: int, by: Sequence[str] = ()
) -> DataFrame:
    """Equal-width counts and density over the column's whole range.

    Smallest and largest value are scalar subqueries of the same plan. The last
    bin is closed on both sides; a constant column gets a bin range of 1 around
    it.
    """
    x = as_value(column)
    lowest = df.agg(F.min(x).alias("v")).scalar()
    highest = df.agg(F.max(x).alias("v")).scalar()
    flat = F.col("lowest") == F.col("highest")
    valued = df.where(x.isNotNull()).select(
        *by, x.alias("x"), lowest.alias("lowest"), highest.alias("highest")
    )
    ranged = valued.select(
        *by,
        "x",
        F.when(flat, F.col("lowest") - 0.5).otherwise(F.col("lowest")).alias("low"),
        F.when(flat, F.col("highest") + 0.5).otherwise(F.col("highest")).alias("high"),
    )
    width = (F.col("high") - F.col("low")) / bins
    number = F.least(F.floor((F.col("x") - F.col("low")) / width).cast("int"), F.lit(bins - 1))
    counts = ranged.groupBy(*by, number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.max("low").alias("low"), F.max(width).alias("width")
    )
    # Grouped totals come from the counts (bins x groups rows), not from the table.
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    joined = counts.join(totals, list(by)) if by else counts.withColumn(
        "total", totals.scalar()
    )
    left = F.col("low") + F.col("bin") * F.col("width")
    return joined.select(
        *by,
        "bin",
        left.alias("left_edge"),
        "n",
        (F.col("n") / (F.col("total") * F.col("width"))).alias("density"),
    )


def five_numbers(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Minimum, quartiles and maximum per group and column."""
    names = ["min", "q1", "median", "q3", "max"]
    found = exact_quantiles(df, columns, [0.0, 0.25, 0.5, 0.75, 1.0], by=by)
    return found.select(*by, "column", "n", *[F.col("q")[i].alias(s) for i, s in enumerate(names)])


def ratio_check(df: DataFrame, monthly: str, yearly: str) -> DataFrame:
    """Distribution of a monthly figure against a twelfth of the yearly one."""
    checked = df.select(N.ratio(F.col(monthly), F.col(yearly) / 12).alias("ratio"))
    return describe(checked, ["ratio"])


def bad_rate_by(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Bad rate and row count per group; NULL groups are left out."""
    return (
        complete_cases(df, keys)
        .groupBy(*keys)
        .agg(F.avg(label).alias("bad_rate"), F.count(F.lit(1)).alias("n"))
    )


def bounded_distinct(df: DataFrame, columns: Sequence[str], most: int) -> DataFrame:
    """Distinct values (column, value) of columns that have at most ``most``; of others more than that, not all.

    One scan: a task keeps up to ``most`` + 1 values per column, which is enough to know
    that a column has more, and sets of tasks merge by a distinct over these few rows.
    """
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[set[float]] = [set() for _ in names]
        for batch in batches:
            for i, found in enumerate(held):
                if len(found) <= most:
                    found.update(pc.unique(batch.column(i).drop_null()).to_pylist())
                    held[i] = set(sorted(found)[: most + 1])
        rows = [(name, value) for name, found in zip(names, held) for value in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())],
            names=["column", "value"],
        )

    values = df.select(*[as_value(c).alias(c) for c in names])
    return values.mapInArrow(run, "column string, value double").distinct()


def quartile_direction(
    df: DataFrame, columns: Sequence[str], label: str = "label", few_levels: int = 4
) -> DataFrame:
    """Bad rate in the lowest and highest quartile of each feature, and a note on its values.

    Features with few values are taken by value. Rows without a label count nowhere. The
    bin edges of each feature (five numbers) are the only data on the driver.
    """
    df = df.where(F.col(label).isNotNull())
    levels = bounded_distinct(df, columns, few_levels).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    few = {r["column"] for r in levels.where(F.col("n") <= few_levels).collect()}
    edges = quantile_table(df, columns, [0.0, 0.25, 0.5, 0.75, 1.0])
    groups = []
    for c in columns:
        x = as_value(c)
        group = x if c in few else N.quantile_bin(x, edges[c]).cast("double")
        groups.append(F.struct(F.lit(c).alias("feature"), group.alias("g"), F.col(label).alias("y")))
    rates = (
        df.select(F.inline(F.array(*groups)))
        .where(F.col("g").isNotNull())
        .groupBy("feature", "g")
        .agg(F.avg("y").alias("rate"))
    )
    ends = rates.groupBy("feature").agg(
        F.min_by("rate", "g").alias("default_rate_low"),
        F.max_by("rate", "g").alias("default_rate_high"),
        F.count(F.lit(1)).alias("n_groups"),
        F.array_sort(F.collect_list(F.struct("g", "rate"))).alias("groups"),  # at most four
    )
    risk = F.when(F.col("default_rate_high") > F.col("default_rate_low"), "higher risk")

    def by_value(x: Column) -> Column:
        whole = x["g"] == F.floor(x["g"])
        value = F.when(whole, x["g"].cast("long").cast("string")).otherwise(F.round(x["g"], 6).cast("string"))
        return F.concat(value, F.lit("="), F.round(x["rate"] * 100).cast("long").cast("string"), F.lit("%"))

    note = F.concat(F.lit("by value: "), F.array_join(F.transform("groups", by_value), ", "))
    for c in columns:
        if c not in few and edges[c]:
            note = F.when(F.col("feature") == c, f"median {edges[c][2]:.2f}").otherwise(note)
    return ends.select(
        "feature", "default_rate_low", "default_rate_high", "n_groups",
        risk.otherwise("lower risk").alias("higher_value_means"), note.alias("note"),
    )
