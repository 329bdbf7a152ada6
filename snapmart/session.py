"""Session defaults that every job relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that are part of the results' definition or of the scale plan.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even where that costs a shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Wide cleaning projections: HotSpot does not compile methods above 8000
    # bytes of bytecode, so Spark should split them instead of fusing them
    # (300,000 financial rows on one core: 18 s to 7 s).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(
    app_name: str = "snapmart",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **extra: str,
) -> SparkSession:
    """Build (or get) a session; leave ``master`` unset on a cluster."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
