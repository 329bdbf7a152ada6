"""Gapless numbers inside groups, without gathering a group in one task.

Rows are range-partitioned by (group, order), sorted inside their partitions and
written; rows are then counted per (group, partition), and a row's number is the rows
of its group in earlier partitions plus its place in its own. A group that holds a
third of all rows is spread over a third of the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snapmart.llm.common import stored

#: Bits of ``monotonically_increasing_id`` below the partition's number.
_PART_BITS = 33


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``number`` (from 0, by ``order``) and ``n`` (rows of the group).

    ``group`` holds no NULL; NULLs of ``order`` come first. Rows that agree in
    ``order`` are numbered as they are read, so a run of them is spread as well.
    """
    keys = [group, *order, "__tie"]
    spread = (
        df.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    )
    placed = stored(spread.withColumn("__place", F.monotonically_increasing_id()), name)
    placed = placed.withColumn("__part", F.shiftright("__place", _PART_BITS))
    runs = placed.groupBy(group, "__part").agg(
        F.count("*").alias("__rows"), F.min("__place").alias("__first")
    )
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        group, "__part", "__first",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__rows").over(whole).alias("n"),
    )
    number = F.col("__before") + F.col("__place") - F.col("__first")
    return placed.join(runs, [group, "__part"]).select(*df.columns, number.alias("number"), "n")
