"""Row choice, ordering and shares.

``row_number() <= k`` filters are planned by Spark with a partial group limit
before the shuffle, so even a key that holds a third of all rows sends at most
``k`` rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(
    df: DataFrame, keys: Sequence[str], latest: str | None = None, by_hash: bool = False
) -> DataFrame:
    """One row per key: the latest, ties broken by all other columns descending.

    ``by_hash`` breaks ties by a hash of the whole row instead: as repeatable,
    and one sort key in place of many on wide tables.
    """
    rest = [c for c in df.columns if c not in {*keys, latest}]
    first = [F.col(latest).desc_nulls_last()] if latest else []
    tie = [F.xxhash64(*rest)] if by_hash else [F.col(c).desc_nulls_last() for c in rest]
    return top_k_per_group(df, keys, [*first, *tie], 1)


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int
) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")


def best_per_group(df: DataFrame, keys: Sequence[str], value: str, tie: Sequence[str]) -> DataFrame:
    """Row with the largest value per group, ties by the given columns ascending."""
    order = [F.col(value).desc_nulls_last(), *[F.col(c).asc() for c in tie]]
    return top_k_per_group(df, keys, order, 1)


def latest_value(df: DataFrame, keys: Sequence[str], value: str, when: str) -> DataFrame:
    """Last value of each series; an aggregate, so no sort."""
    return df.groupBy(*keys).agg(
        F.max(when).alias(when), F.max_by(value, when).alias(value)
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Largest rows overall (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def sort_by_size(df: DataFrame, value: str, tie: Sequence[str] = ()) -> DataFrame:
    """Order by absolute value, largest first."""
    return df.orderBy(F.abs(F.col(value)).desc(), *tie)


def value_counts(df: DataFrame, column: str, keep_null: bool = True) -> DataFrame:
    """Rows per value with their share of all rows.

    The total is a scalar subquery over the counts, not an unpartitioned window.
    """
    source = df if keep_null else df.where(F.col(column).isNotNull())
    counts = source.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def dominant_share(df: DataFrame, columns: Sequence[str], limit: float = 0.9) -> DataFrame:
    """Share of the most frequent level per column, flagged above the limit."""
    levels = level_counts(df, columns)
    return (
        levels.groupBy("column")
        .agg(
            F.max("n").alias("top_n"),
            F.sum("n").alias("total"),
        )
        .select(
            "column",
            (F.col("top_n") / F.col("total")).alias("top_share"),
            ((F.col("top_n") / F.col("total")) > limit).alias("near_constant"),
        )
    )


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long counts (column, level, n) of several columns, NULL a level of its own.

    The rows are exploded before the aggregate but combined on the map side, so
    the shuffle carries distinct levels only.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns]
    )
    return (
        df.select(F.inline(pairs))
        .groupBy("column", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )
