"""The stored monitoring table: months are added when due, and redone one at a time.

The table is partitioned by (model_name, monitoring_date). A run computes the metrics of
the months it has to write and no others; months that are stored stay as they are unless
they are named to be redone. A redone month is replaced as a whole, also where its new
result has no rows. Readers filter on the partition columns, so a series up to a date or
one model's months do not read the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapmart.operators.filters import as_date, between_dates
from snapmart.sources.scratch import materialise
from snapmart.sources.tables import read_table, replace_partition, write_monitoring

#: Metrics of a closed range of months, or of all months for None.
Compute = Callable[[tuple | None], DataFrame]


def stored_partitions(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(model_name, monitoring_date) that the table holds; read from folder names and footers."""
    try:
        found = read_table(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    rows = found.select("model_name", F.col("monitoring_date").cast("string").alias("day")).distinct().collect()
    return sorted((r["model_name"], r["day"]) for r in rows)


def refresh(
    spark: SparkSession, path: str, compute: Compute, months: tuple | None = None, redo: Sequence[str] = (),
) -> int:
    """Write the months in ``months`` (None: all) that are not stored, and those of ``redo``; the rows written.

    ``compute`` is asked for the range the written months span.
    """
    held = stored_partitions(spark, path)
    again = {str(day) for day in redo}
    keep = sorted({day for _, day in held} - again)
    day = F.col("monitoring_date").cast("string")
    asked = (
        compute(months) if not redo
        else compute((min(again), max(again))).where(day.isin(sorted(again)))
    )
    due = materialise(asked.where(~day.isin(keep)) if keep else asked, "due-metrics")
    for model, old in held:
        if old in again:
            replace_partition(due, path, {"model_name": model, "monitoring_date": old})
    written = {pair for pair in held if pair[1] in again}
    fresh = due
    for model, old in written:
        fresh = fresh.where(~((F.col("model_name") == model) & (day == old)))
    write_monitoring(fresh, path)
    return due.count()


def read_metrics(
    spark: SparkSession, path: str, model: str | None = None, months: tuple | None = None, as_of=None
) -> DataFrame:
    """Stored metrics of a model, of a closed range of months, or up to a date, by partition pruning."""
    found = read_table(spark, path)
    if model is not None:
        found = found.where(F.col("model_name") == model)
    if months is not None:
        found = between_dates(found, *months, column="monitoring_date")
    if as_of is not None:
        found = found.where(F.col("monitoring_date") <= as_date(as_of))
    return found
