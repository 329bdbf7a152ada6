"""Point-in-time aggregates: what was known about a key on a date.

The facts are first reduced to one partial state per (key, date); the running
window then sees at most one row per key and calendar date, so its work per key
is bounded by the calendar even when one key holds a third of all facts. The
marks (key, date) of the spine travel through the same aggregate, which gives
one pass for all dates instead of a re-aggregation per month.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATS = ("mean", "std", "min", "max")


def asof_aggregate(
    spine: DataFrame,
    facts: DataFrame,
    key: str,
    columns: Sequence[str],
    spine_date: str = "snapshot_date",
    fact_date: str = "snapshot_date",
    stats: Sequence[str] = ("mean",),
    count_name: str = "clickstream_count",
) -> DataFrame:
    """Spine rows with aggregates over all fact rows dated up to the spine date.

    Adds ``<column>_<stat>`` and ``count_name`` (NULL when there is no fact).
    Facts on the spine date itself count. ``std`` is the sample deviation, NULL
    for a single value. Time of day is dropped: history is known by calendar date.
    """
    on = F.col(spine_date).cast("date").alias("__d")
    state = asof_state(facts, key, columns, fact_date, stats, marks=spine.select(key, on))
    values = state.where("__mark = 1").drop("__mark")
    keyed = spine.select("*", on)
    return (
        keyed.join(values.withColumnRenamed("__n", count_name), [key, "__d"], "left")
        .drop("__d")
    )


def cumulative_history(
    facts: DataFrame,
    key: str,
    columns: Sequence[str],
    date: str = "snapshot_date",
    stats: Sequence[str] = ("mean",),
    count_name: str = "history_count",
) -> DataFrame:
    """Expanding aggregates per key at each date that has facts."""
    state = asof_state(facts, key, columns, date, stats)
    return state.drop("__mark").withColumnRenamed("__d", date).withColumnRenamed("__n", count_name)


def asof_state(
    facts: DataFrame,
    key: str,
    columns: Sequence[str],
    date: str,
    stats: Sequence[str],
    marks: DataFrame | None = None,
) -> DataFrame:
    """Cumulative statistics per (key, ``__d``), ``__mark`` = 1 on spine dates."""
    unknown = set(stats) - set(STATS)
    if unknown:
        raise ValueError(f"unknown statistics: {sorted(unknown)}")
    rows = facts.select(
        key, F.col(date).cast("date").alias("__d"), *columns, F.lit(1).alias("__fact"), F.lit(0).alias("__mark")
    ).where(F.col(key).isNotNull() & F.col("__d").isNotNull())
    if marks is not None:
        marked = marks.where(F.col(key).isNotNull() & F.col("__d").isNotNull()).select(
            key, "__d", F.lit(0).alias("__fact"), F.lit(1).alias("__mark")
        )
        rows = rows.unionByName(marked, allowMissingColumns=True)

    partial = [F.sum("__fact").alias("__f"), F.max("__mark").alias("__mark")]
    for c in columns:
        partial.append(F.count(c).alias(f"n_{c}"))
        if "mean" in stats or "std" in stats:
            partial.append(F.sum(F.col(c).cast("double")).alias(f"s_{c}"))
        if "std" in stats:
            partial.append((F.var_pop(c) * F.count(c)).alias(f"q_{c}"))
        if "min" in stats:
            partial.append(F.min(c).alias(f"lo_{c}"))
        if "max" in stats:
            partial.append(F.max(c).alias(f"hi_{c}"))
    daily = rows.groupBy(key, "__d").agg(*partial)

    so_far = (
        Window.partitionBy(key)
        .orderBy("__d")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if "std" in stats:
        # Squares are taken around the key's first daily mean: the variance does
        # not change, and large values do not cancel.
        daily = daily.select(
            "*",
            *[
                F.first(F.try_divide(f"s_{c}", f"n_{c}"), ignorenulls=True).over(so_far).alias(f"m_{c}")
                for c in columns
            ],
        )
    running = [F.nullif(F.sum("__f").over(so_far), F.lit(0)).alias("__n")]
    for c in columns:
        n = F.sum(f"n_{c}").over(so_far)
        if "mean" in stats:
            running.append(F.try_divide(F.sum(f"s_{c}").over(so_far), n).alias(f"{c}_mean"))
        if "std" in stats:
            gap = F.col(f"s_{c}") - F.col(f"n_{c}") * F.col(f"m_{c}")
            between = F.try_divide(gap * gap, F.col(f"n_{c}"))
            spread = F.sum(F.coalesce(F.col(f"q_{c}"), F.lit(0.0)) + F.coalesce(between, F.lit(0.0)))
            total_gap = F.sum(gap).over(so_far)
            square = spread.over(so_far) - F.try_divide(total_gap * total_gap, n)
            running.append(
                F.when(n > 1, F.sqrt(F.greatest(square, F.lit(0.0)) / (n - 1))).alias(f"{c}_std")
            )
        if "min" in stats:
            running.append(F.min(f"lo_{c}").over(so_far).alias(f"{c}_min"))
        if "max" in stats:
            running.append(F.max(f"hi_{c}").over(so_far).alias(f"{c}_max"))
    return daily.select(key, "__d", "__mark", *running)
