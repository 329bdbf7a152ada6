"""Snapshot jobs: month spine, layer backfill, single-month rerun, gates."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapmart.operators.filters import as_date, at_snapshot
from snapmart.sources.tables import read_table, replace_partition, write_snapshots

Transform = Callable[[DataFrame], DataFrame]


def month_sequence(start: Column, end: Column) -> Column:
    """First-of-month dates from the month of ``start`` that lie between both dates."""
    first = F.trunc(start, "month")
    months = F.sequence(first, F.trunc(end, "month"), F.expr("interval 1 month"))
    return F.filter(months, lambda d: (d >= start) & (d <= end))


def month_spine(
    spark: SparkSession, start, end, name: str = "snapshot_date"
) -> DataFrame:
    """First-of-month dates between two dates, both inclusive."""
    return spark.range(1).select(
        F.explode(month_sequence(as_date(start), as_date(end))).alias(name)
    )


def month_spine_of(df: DataFrame, column: str, name: str = "snapshot_date") -> DataFrame:
    """Every month a date column spans, without gaps."""
    bounds = df.agg(
        F.trunc(F.min(F.col(column)).cast("date"), "month").alias("a"),
        F.max(F.col(column)).cast("date").alias("b"),
    ).where(F.col("a").isNotNull())
    return bounds.select(F.explode(month_sequence(F.col("a"), F.col("b"))).alias(name))


def backfill(source: DataFrame, transform: Transform, path: str, key: str = "snapshot_date") -> None:
    """A whole layer in one job: one scan, one partitioned write.

    Months between the first and the last of the source that the result has no rows for
    get an empty folder, as they were run like the others.
    """
    result = transform(source)
    write_snapshots(result, path, (key,))
    if key not in source.columns:
        return
    month = F.trunc(F.col(key).cast("date"), "month").alias(key)
    written = read_table(source.sparkSession, path).select(month).distinct()
    missing = month_spine_of(source, key).join(written, key, "left_anti")
    for row in missing.collect():  # calendar months
        replace_partition(result.where(F.lit(False)), path, {key: row[key]})


def rerun_month(
    source: DataFrame, transform: Transform, path: str, day, key: str = "snapshot_date"
) -> None:
    """The same job for one month; the other months stay, and a result without rows empties the month."""
    replace_partition(transform(at_snapshot(source, day)), path, {key: day})


def availability(months: DataFrame, tables: Mapping[str, DataFrame], key: str = "snapshot_date") -> DataFrame:
    """Per month which tables have rows (0/1 columns)."""
    out = months.select(key)
    for name, df in tables.items():
        present = df.select(key).distinct().withColumn(name, F.lit(1))
        out = out.join(present, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def gate(months: DataFrame, train_date, key: str = "snapshot_date") -> DataFrame:
    """Which steps run in a month: training at the train date, scoring from then on.

    ``months`` may carry a ``features`` availability flag; scoring then also
    needs features in that month.
    """
    day = as_date(train_date)
    due = F.col(key) >= day
    if "features" in months.columns:
        due_scoring = due & (F.col("features") == 1)
    else:
        due_scoring = due
    return months.withColumns(
        {
            "run_training": (F.col(key) == day).cast("int"),
            "run_scoring": due_scoring.cast("int"),
            "run_monitoring": due.cast("int"),
        }
    )
