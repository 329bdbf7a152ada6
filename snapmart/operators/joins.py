"""Equi, semi and anti joins on loan and customer keys.

No side is broadcast by hint: Spark broadcasts by its own size estimate, and
adaptive execution splits skewed sort-merge partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapmart import schemas as S
from snapmart.functions import dates as D
from snapmart.functions.encode import source_flag


def present_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_semi")


def absent_from(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def features_with_labels(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Application features joined to the label observed later, by loan only."""
    return features.join(labels.select("loan_id", "label"), "loan_id")


def delayed_labels(
    predictions: DataFrame, labels: DataFrame, delay: int = S.LABEL_DELAY_MONTHS
) -> DataFrame:
    """Predictions of month m with the labels that arrive ``delay`` months later."""
    arriving = labels.select(
        "loan_id",
        "label",
        F.col("snapshot_date").alias("label_date"),
    )
    due = predictions.withColumn("label_date", F.add_months("snapshot_date", delay))
    return due.join(arriving, ["loan_id", "label_date"])


def scores_side_by_side(labels: DataFrame, **scores: DataFrame) -> DataFrame:
    """Labels with one score column per model, loans scored by all of them."""
    out = labels
    for name, df in scores.items():
        out = out.join(df.select("loan_id", F.col("model_predictions").alias(name)), "loan_id")
    return out


def versions_at(days: DataFrame, versions: DataFrame, key: str, day: str) -> DataFrame:
    """For each (key, day) the version that is valid then: the latest dated at or before it.

    A version is valid until the key's next one, so the sides meet in one join on the key
    and an interval; the versions' columns are NULL where none is valid yet. ``versions``
    holds one row per key and date, which becomes ``version_<day>``.
    """
    dated = f"version_{day}"
    until = F.lead(day).over(Window.partitionBy(key).orderBy(day))
    spans = versions.withColumn("__until", until).withColumnRenamed(day, dated).withColumnRenamed(key, "__key")
    valid = (
        (F.col(key) == F.col("__key")) & (F.col(day) >= F.col(dated))
        & (F.col("__until").isNull() | (F.col(day) < F.col("__until")))
    )
    return days.join(spans, valid, "left").drop("__key", "__until")


def key_agreement(
    left: DataFrame, right: DataFrame, key: str, a: str, b: str
) -> DataFrame:
    """After a join, how many rows have ``a`` equal to ``b`` and whether all have."""
    pairs = left.select(key, F.col(a).alias("a")).join(right.select(key, F.col(b).alias("b")), key)
    same = F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    return pairs.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(same).alias("n_equal"),
        F.coalesce(F.bool_and(same), F.lit(True)).alias("all_equal"),
    )


def flag_source(df: DataFrame, count_column: str, flag: str) -> DataFrame:
    """Replace a joined count by a has-rows flag."""
    return df.withColumn(flag, source_flag(F.col(count_column))).drop(count_column)


def month_key(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.withColumn(name, D.month_start(F.col(column)))
