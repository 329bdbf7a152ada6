"""Bounded, repeatable samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds))


def known_labels(labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """One row (doc_id, label) per usable document with a label.

    Rows without doc_id or label are left out; repeated labels of a document count
    once, the larger one.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )


def label_sample(labels: DataFrame, label: str, usable: Column, per_class: int) -> DataFrame:
    """At most ``per_class`` doc_ids of each class of ``known_labels``, those with the smallest hash."""
    known = known_labels(labels, label, usable)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def log_odds_of_sample(labels: DataFrame, label: str, usable: Column, per_class: int) -> float:
    """What ``label_sample`` adds to the log odds of class 1; 0 where no cap binds or a class is missing."""
    row = known_labels(labels, label, usable).agg(
        *[F.count_if(F.col("label") == k).alias(f"n{k}") for k in (0, 1)]
    ).first()
    clean, positive = row["n0"], row["n1"]
    if not clean or not positive:
        return 0.0
    return log(min(positive, per_class) / positive) - log(min(clean, per_class) / clean)
