"""Monthly monitoring as one long table for all months and models at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart import schemas as S
from snapmart.functions.numbers import clip_low
from snapmart.operators.filters import as_date, between_dates, complete_cases, known_at
from snapmart.operators.joins import delayed_labels
from snapmart.operators.metrics import Baseline, evaluate, roc_auc, stability_index
from snapmart.operators.order_stats import value_cuts

PERFORMANCE_METRICS = [
    "n_labels", "bad_rate_actual", "bad_rate_predicted", "bad_rate_gap",
    "auc", "gini", "brier", "precision", "recall", "f1",
]


def traffic_light(value: Column, t: S.Threshold) -> Column:
    """Green, amber or red; ``n/a`` without a value."""
    if t.higher_is_better:
        light = F.when(value >= t.high, "green").when(value >= t.low, "amber")
    else:
        light = F.when(value < t.low, "green").when(value <= t.high, "amber")
    return F.when(value.isNull(), "n/a").otherwise(light.otherwise("red"))


def with_status(
    metrics: DataFrame,
    thresholds: Mapping[str, S.Threshold] = S.THRESHOLDS,
    name: str = "metric_name",
    value: str = "metric_value",
) -> DataFrame:
    """Status per metric row. Gaps count by size; metrics without a rule get ``n/a``."""
    v = F.col(value)
    status = F.lit("n/a")
    for metric, rule in thresholds.items():
        if metric == "csi":
            match = F.col(name).startswith("csi_")
        else:
            match = F.col(name) == metric
        status = F.when(match, traffic_light(F.abs(v), rule)).otherwise(status)
    return metrics.withColumn("status", status)


def to_long(df: DataFrame, keys: Sequence[str], names: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Metric columns to rows (metric_name, metric_value)."""
    pairs = names if isinstance(names, Mapping) else {n: n for n in names}
    rows = F.array(
        *[
            F.struct(
                F.lit(out).alias("metric_name"), F.col(c).cast("double").alias("metric_value")
            )
            for c, out in pairs.items()
        ]
    )
    return df.select(*keys, F.inline(rows))


def stability_rows(
    predictions: DataFrame,
    features: DataFrame | None,
    score_baseline: Baseline,
    feature_baselines: Mapping[str, Baseline],
) -> DataFrame:
    """Number of predictions, mean score, score and feature drift by month and model.

    With ``features`` None the feature columns are columns of ``predictions``, and score
    and features come out of one scan.
    """
    keys = ["model_name", "snapshot_date"]
    columns = {"model_predictions": score_baseline}
    if features is None:
        columns |= feature_baselines
    found = stability_index(predictions, columns, by=keys, also={"mean_pd": F.avg("model_predictions")})

    def metric(name: Column | str, value: Column) -> Column:
        name = F.lit(name) if isinstance(name, str) else name
        return F.struct(name.alias("metric_name"), value.cast("double").alias("metric_value"))

    of_score = F.array(
        metric("n_predictions", F.col("n")), metric("mean_pd", F.col("mean_pd")), metric("psi_score", F.col("psi"))
    )
    of_feature = F.array(metric(F.concat(F.lit("csi_"), "column"), F.col("psi")))
    is_score = F.col("column") == "model_predictions"
    rows = found.select(*keys, F.inline(F.when(is_score, of_score).otherwise(of_feature)))
    if features is not None and feature_baselines:
        # Feature drift depends on the month only; it is attached to the models
        # that scored the month (months x models rows).
        csi = stability_index(features, feature_baselines, by=["snapshot_date"]).select(
            "snapshot_date",
            F.concat(F.lit("csi_"), "column").alias("metric_name"),
            F.col("psi").alias("metric_value"),
        )
        scored = found.select(*keys)
        rows = rows.unionByName(scored.join(csi, "snapshot_date").select(*rows.columns))
    return rows.select(
        "model_name",
        F.col("snapshot_date").alias("monitoring_date"),
        F.col("snapshot_date").alias("prediction_month"),
        F.lit("stability").alias("metric_type"),
        "metric_name",
        "metric_value",
    )


def work_cells(score_baseline: Baseline, per_bin: int = 50) -> list[float]:
    """Cell edges for ranking scores, between the stored cuts: they spread work, not results."""
    edges = [0.0, *score_baseline.cuts, 1.0]
    return sorted({
        a + (b - a) * k / per_bin for a, b in zip(edges, edges[1:]) for k in range(per_bin)
    } - {0.0})


def performance_rows(
    predictions: DataFrame,
    labels: DataFrame,
    delay: int = S.LABEL_DELAY_MONTHS,
    cutoff: float = S.SCORE_CUTOFF,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Performance of month m, dated at month m + delay when its labels arrive.

    ``cuts`` are cell edges for the scores; without them the predictions are read once
    more to find some.
    """
    keys = ["model_name", "snapshot_date"]
    known = delayed_labels(predictions, labels, delay)
    if cuts is None:
        # Cell edges come from the predictions alone, so the join runs once.
        cuts = value_cuts(predictions, ["model_predictions"])["model_predictions"]
    metrics = evaluate(known, by=keys, cutoff=cutoff, cuts=cuts)
    return to_long(metrics, keys, PERFORMANCE_METRICS).select(
        "model_name",
        F.add_months("snapshot_date", delay).alias("monitoring_date"),
        F.col("snapshot_date").alias("prediction_month"),
        F.lit("performance").alias("metric_type"),
        "metric_name",
        "metric_value",
    )


def monitor(
    predictions: DataFrame,
    labels: DataFrame,
    features: DataFrame | None,
    score_baseline: Baseline,
    feature_baselines: Mapping[str, Baseline],
    delay: int = S.LABEL_DELAY_MONTHS,
    cutoff: float = S.SCORE_CUTOFF,
    months: tuple | None = None,
) -> DataFrame:
    """Long monitoring table; ``months`` limits it to a closed monitoring range.

    Baselines, as stored with the model, are all that is needed to plan this: no job runs
    before the result is asked for. With ``features`` None the predictions carry the
    feature columns, and are read once for stability and once for performance.
    The range is applied to the inputs: stability reads the predictions of those
    months, performance the predictions whose labels arrive in them.
    """
    recent, due = predictions, predictions
    if months:
        recent = between_dates(predictions, *months)
        features = None if features is None else between_dates(features, *months)
        labels = between_dates(labels, *months)
        first, last = [F.add_months(as_date(m), -delay) for m in months]
        due = between_dates(predictions, first, last)
    rows = stability_rows(recent, features, score_baseline, feature_baselines).unionByName(
        performance_rows(due, labels, delay, cutoff, work_cells(score_baseline))
    )
    return with_status(rows)


def metric_series(
    monitoring: DataFrame, metric_type: str, metric_name: str, as_of=None
) -> DataFrame:
    """One metric over prediction months, as known on a date."""
    known = known_at(monitoring, as_of, "monitoring_date") if as_of else monitoring
    return (
        known.where((F.col("metric_type") == metric_type) & (F.col("metric_name") == metric_name))
        .select("model_name", "prediction_month", "metric_value")
        .orderBy("model_name", "prediction_month")
    )


def csi_series(monitoring: DataFrame, floor: float = S.CSI_CHART_FLOOR) -> DataFrame:
    """Feature drift series with a lower bound for a logarithmic scale."""
    return monitoring.where(F.col("metric_name").startswith("csi_")).select(
        "model_name",
        "prediction_month",
        F.substr("metric_name", F.lit(5)).alias("feature"),
        clip_low(F.col("metric_value"), floor).alias("csi"),
    )


def metric_pivot(monitoring: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per model and prediction month, one column per metric."""
    return (
        monitoring.where(F.col("metric_name").isin(*names))
        .groupBy("model_name", "prediction_month")
        .pivot("metric_name", list(names))
        .agg(F.max("metric_value"))
    )


def split_summary(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    return (
        df.where(F.col(split).isNotNull())
        .groupBy(split)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("bad_rate"))
    )


def calibration_summary(df: DataFrame, label: str, raw: str, calibrated: str) -> DataFrame:
    """Bad rate against raw and calibrated scores, with the calibrated ranking."""
    y, p, q = (F.col(c).cast("double") for c in (label, raw, calibrated))
    auc = roc_auc(df, label=label, score=calibrated).select("auc").scalar()
    return complete_cases(df, [label, raw, calibrated]).agg(
        F.avg(y).alias("bad_rate"),
        F.avg(p).alias("mean_pred_raw"),
        F.avg(q).alias("mean_pred_calibrated"),
        F.avg((p - y) * (p - y)).alias("brier_raw"),
        F.avg((q - y) * (q - y)).alias("brier_calibrated"),
    ).withColumn("auc_calibrated", auc)


def compare_models(
    scored: DataFrame,
    models: Mapping[str, str],
    baselines: Mapping[str, Baseline] | None = None,
    by: Sequence[str] = (),
    label: str = "label",
    cutoff: float = S.SCORE_CUTOFF,
) -> DataFrame:
    """Champion against challengers: metrics per (by..., model) from score columns.

    ``models`` maps a model name to its score column; ``baselines`` adds drift
    against each model's own training scores.
    """
    long = scored.select(
        *by,
        label,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("model"), F.col(c).alias("model_predictions"))
                    for m, c in models.items()
                ]
            )
        ),
    )
    keys = [*by, "model"]
    out = evaluate(long, by=keys, label=label, cutoff=cutoff).select(
        *keys, "n_labels", "auc", "auc_se", "bad_rate_actual", "bad_rate_predicted",
        "bad_rate_gap", "recall",
    )
    if baselines:
        drift = stability_index(
            scored, {models[m]: b for m, b in baselines.items()}, by=by
        ).select(*by, "column", "psi")
        names = {c: m for m, c in models.items()}
        model = F.lit(None).cast("string")
        for column, name in names.items():
            model = F.when(F.col("column") == column, name).otherwise(model)
        out = out.join(drift.withColumn("model", model).drop("column"), keys, "left")
    return out
