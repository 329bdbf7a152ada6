"""Model artefacts as Spark ML directories and small parquet tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapmart.operators.metrics import Baseline
from snapmart.operators.modeling import Calibration, CreditModel


def save_model(spark: SparkSession, model: CreditModel, root: str) -> str:
    """Pipeline with its preprocessing, plus one row of scoring settings."""
    base = f"{root}/{model.version}"
    model.pipeline.write().overwrite().save(f"{base}/pipeline")
    settings = spark.createDataFrame(
        [
            (
                model.version,
                model.model_type,
                list(model.columns),
                model.calibration.slope,
                model.calibration.intercept,
                list(model.top_features),
            )
        ],
        "version string, model_type string, columns array<string>, slope double, "
        "intercept double, top_features array<string>",
    )
    settings.coalesce(1).write.mode("overwrite").parquet(f"{base}/settings")
    return base


def load_model(spark: SparkSession, root: str, version: str) -> CreditModel:
    base = f"{root}/{version}"
    row = spark.read.parquet(f"{base}/settings").first()
    return CreditModel(
        row["version"],
        row["model_type"],
        tuple(row["columns"]),
        PipelineModel.load(f"{base}/pipeline"),
        Calibration(row["slope"], row["intercept"]),
        list(row["top_features"]),
    )


def baselines_frame(
    spark: SparkSession, version: str, baselines: Mapping[str, Baseline]
) -> DataFrame:
    """Drift baselines as rows: (model_name, column, cuts, shares, value_bins)."""
    rows = [
        (version, c, list(b.cuts), list(b.shares) if b.shares is not None else None, b.value_bins)
        for c, b in baselines.items()
    ]
    return spark.createDataFrame(
        rows,
        "model_name string, column string, cuts array<double>, shares array<double>, value_bins int",
    )


def save_baselines(
    spark: SparkSession, version: str, baselines: Mapping[str, Baseline], root: str
) -> None:
    frame = baselines_frame(spark, version, baselines)
    frame.coalesce(1).write.mode("overwrite").parquet(f"{root}/{version}/baselines")


def load_baselines(spark: SparkSession, root: str, version: str) -> dict[str, Baseline]:
    rows = spark.read.parquet(f"{root}/{version}/baselines").collect()
    return {
        r["column"]: Baseline(
            tuple(r["cuts"]),
            tuple(r["shares"]) if r["shares"] is not None else None,
            r["value_bins"],
        )
        for r in rows
    }


def metadata_frame(spark: SparkSession, version: str, facts: Mapping[str, object]) -> DataFrame:
    """Windows, sizes, metrics and parameters: one (name, value) row per fact."""
    rows = [(version, k, None if v is None else str(v)) for k, v in facts.items()]
    return spark.createDataFrame(rows, "model_name string, name string, value string")


def save_metadata(
    spark: SparkSession, version: str, facts: Mapping[str, object], root: str
) -> None:
    frame = metadata_frame(spark, version, facts)
    frame.coalesce(1).write.mode("overwrite").parquet(f"{root}/{version}/metadata")


def load_metadata(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{version}/metadata").orderBy(F.col("name"))
