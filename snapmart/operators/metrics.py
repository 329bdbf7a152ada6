"""Scores against labels: ranking, calibration and drift metrics, grouped.

The area under the curve needs an order over all scores of a group. Scores are
counted per distinct value first; the order is then taken in two levels: inside
cells of about equal weight, and over the cell totals (at most ``MAX_CELLS``
rows per group). No task sees more than a cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapmart import schemas as S
from snapmart.functions.numbers import ratio
from snapmart.operators.filters import complete_cases
from snapmart.operators.order_stats import as_value, bucketize, quantile_table, value_cuts
from snapmart.operators.profiling import per_column


def auc_standard_error(auc: Column, n_pos: Column, n_neg: Column) -> Column:
    """Hanley and McNeil (1982)."""
    n1, n0 = n_pos.cast("double"), n_neg.cast("double")
    q1 = auc / (2 - auc)
    q2 = 2 * auc * auc / (1 + auc)
    spread = auc * (1 - auc) + (n1 - 1) * (q1 - auc * auc) + (n0 - 1) * (q2 - auc * auc)
    return F.sqrt(F.greatest(F.try_divide(spread, n1 * n0), F.lit(0.0)))


def evaluate(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    score: str = "model_predictions",
    cutoff: float = S.SCORE_CUTOFF,
    n_cells: int | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """All performance metrics per group in one chain of aggregates.

    Ties count half. A group with one class only has a NULL area. Rows with a
    missing label or score are left out. ``cuts`` are cell edges for the scores
    (they spread the work and do not change results); without them ``df`` is read
    once more to find some.
    """
    by = list(by)
    edges = value_cuts(df, [score], n_cells) if cuts is None else {score: sorted(set(cuts))}
    celled = bucketize(df.select(*by, label, score), edges, "__cell_")
    p = F.col("p")
    counts = (
        celled.select(*by, F.col(f"__cell_{score}").alias("cell"), as_value(score).alias("p"), label)
        .where(p.isNotNull() & F.col(label).isNotNull())
        .groupBy(*by, "cell", "p")
        .agg(
            F.sum(F.col(label).cast("bigint")).alias("pos"),
            F.sum(1 - F.col(label).cast("bigint")).alias("neg"),
        )
    )
    pos, neg = F.col("pos"), F.col("neg")
    in_cell = (
        Window.partitionBy(*by, "cell")
        .orderBy("p")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    below = F.sum("neg").over(in_cell) - neg
    cells = (
        counts.select(*by, "cell", "p", "pos", "neg", (pos * (below + neg / 2.0)).alias("wins"))
        .groupBy(*by, "cell")
        .agg(
            F.sum("pos").alias("pos"),
            F.sum("neg").alias("neg"),
            F.sum("wins").alias("wins"),
            F.sum(pos * (1 - p) * (1 - p) + neg * p * p).alias("squares"),
            F.sum(p * (pos + neg)).alias("sum_p"),
            F.sum(F.when(p >= cutoff, pos).otherwise(0)).alias("tp"),
            F.sum(F.when(p >= cutoff, neg).otherwise(0)).alias("fp"),
        )
    )
    over_cells = (
        Window.partitionBy(*by)
        .orderBy("cell")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = F.sum("neg").over(over_cells) - neg
    total = (
        cells.withColumn("wins", F.col("wins") + pos.cast("double") * earlier)
        .groupBy(*by)
        .agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "wins", "squares", "sum_p", "tp", "fp")])
        .where(pos + neg > 0)
    )
    n = pos + neg
    auc = F.try_divide(F.col("wins"), pos.cast("double") * neg)
    actual, predicted = pos / n, F.col("sum_p") / n
    tp, fp = F.col("tp"), F.col("fp")
    zero = F.lit(0.0)
    return total.select(
        *by,
        n.alias("n_labels"),
        pos.alias("n_bad"),
        neg.alias("n_good"),
        actual.alias("bad_rate_actual"),
        predicted.alias("bad_rate_predicted"),
        (predicted - actual).alias("bad_rate_gap"),
        auc.alias("auc"),
        (2 * auc - 1).alias("gini"),
        auc_standard_error(auc, pos, neg).alias("auc_se"),
        (F.col("squares") / n).alias("brier"),
        F.coalesce(ratio(tp, tp + fp), zero).alias("precision"),
        F.coalesce(ratio(tp, pos), zero).alias("recall"),
        F.coalesce(ratio(2 * tp, pos + tp + fp), zero).alias("f1"),
        tp.alias("tp"),
        fp.alias("fp"),
        (pos - tp).alias("fn"),
        (neg - fp).alias("tn"),
    )


def roc_auc(df: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    return evaluate(df, by, **options).select(*by, "n_labels", "n_bad", "auc", "gini", "auc_se")


def calibration_gap(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "model_predictions"
) -> DataFrame:
    """Actual and predicted bad rate, their gap and the Brier score: plain means."""
    y, p = F.col(label).cast("double"), F.col(score)
    return (
        complete_cases(df, [label, score])
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n_labels"),
            F.avg(y).alias("bad_rate_actual"),
            F.avg(p).alias("bad_rate_predicted"),
            (F.avg(p) - F.avg(y)).alias("bad_rate_gap"),
            F.avg((p - y) * (p - y)).alias("brier"),
        )
    )


def confusion(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    score: str = "model_predictions",
    cutoff: float = S.SCORE_CUTOFF,
) -> DataFrame:
    """Counts of actual against predicted class at the cutoff."""
    return (
        complete_cases(df, [label, score])
        .groupBy(*by, F.col(label).alias("actual"), (F.col(score) >= cutoff).cast("int").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_row(
    df: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    score: str = "model_predictions",
    cutoff: float = S.SCORE_CUTOFF,
) -> DataFrame:
    """The four counts of the confusion matrix as columns of one row per group."""
    bad, hit = F.col(label) == 1, F.col(score) >= cutoff
    return (
        complete_cases(df, [label, score])
        .groupBy(*by)
        .agg(
            F.count_if(bad & hit).alias("tp"),
            F.count_if(~bad & hit).alias("fp"),
            F.count_if(bad & ~hit).alias("fn"),
            F.count_if(~bad & ~hit).alias("tn"),
        )
    )


def precision_recall_f1(df: DataFrame, by: Sequence[str] = (), **options) -> DataFrame:
    """Zero when a denominator is zero."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0.0)
    return confusion_row(df, by, **options).select(
        *by,
        F.coalesce(ratio(tp, tp + fp), zero).alias("precision"),
        F.coalesce(ratio(tp, tp + fn), zero).alias("recall"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero).alias("f1"),
    )


def classification_report(df: DataFrame, **options) -> DataFrame:
    """Precision, recall, f1 and support per class with accuracy and averages."""
    c = {k: F.col(k) for k in ("tp", "fp", "fn", "tn")}
    n = c["tp"] + c["fp"] + c["fn"] + c["tn"]
    zero = F.lit(0.0)

    def scores(hit: Column, false_hit: Column, missed: Column) -> tuple[Column, Column, Column]:
        return (
            F.coalesce(ratio(hit, hit + false_hit), zero),
            F.coalesce(ratio(hit, hit + missed), zero),
            F.coalesce(ratio(2 * hit, 2 * hit + false_hit + missed), zero),
        )

    good = scores(c["tn"], c["fn"], c["fp"])
    bad = scores(c["tp"], c["fp"], c["fn"])
    n_good, n_bad = c["tn"] + c["fp"], c["tp"] + c["fn"]
    macro = [(g + b) / 2 for g, b in zip(good, bad)]
    weighted = [ratio(g * n_good + b * n_bad, n) for g, b in zip(good, bad)]
    accuracy = ratio(c["tp"] + c["tn"], n)

    def line(name, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.alias("support"),
        )

    rows = F.array(
        line("0", *good, n_good),
        line("1", *bad, n_bad),
        line("accuracy", accuracy, accuracy, accuracy, n),
        line("macro avg", *macro, n),
        line("weighted avg", *weighted, n),
    )
    return confusion_row(df, **options).select(F.inline(rows))


# ------------------------------------------------------------------ stability


@dataclass(frozen=True)
class Baseline:
    """Bins of a baseline distribution and the share of rows in each.

    ``cuts`` are the inner edges. ``shares`` has one entry per value bin and a
    last one for missing values. ``shares`` is None when the baseline holds no
    value at all.
    """

    cuts: tuple[float, ...]
    shares: tuple[float, ...] | None
    value_bins: int


def decile_probs(bins: int) -> list[float]:
    """Evenly spaced probabilities, each a multiple of one step."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]


def bin_counts(columns: Mapping[str, Baseline]) -> list[Column]:
    """Per column an array of conditional counts: value bins, then missing."""
    out = []
    for c, base in columns.items():
        bucket = F.col(f"__bin_{c}")
        counts = [F.count_if(bucket == i) for i in range(base.value_bins)]
        out.append(F.array(*counts, F.count_if(bucket.isNull())).alias(c))
    return out


def fit_baselines(
    df: DataFrame, columns: Sequence[str], bins: int = S.PSI_BINS
) -> dict[str, Baseline]:
    """Decile bins and shares of each column.

    Equal edges collapse; the outer edges are infinite. A constant column keeps
    no value bin. What reaches the driver is ``bins`` numbers per column.
    """
    edges = quantile_table(df, columns, decile_probs(bins))
    shapes = {}
    for c in columns:
        unique = sorted(set(edges[c]))
        shapes[c] = Baseline(tuple(unique[1:-1]), None, max(len(unique) - 1, 0))
    binned = bucketize(df.select(*columns), {c: b.cuts for c, b in shapes.items()}, "__bin_")
    row = binned.agg(F.count(F.lit(1)).alias("__n"), *bin_counts(shapes)).first()
    out = {}
    for c, shape in shapes.items():
        shares = tuple(k / row["__n"] for k in row[c]) if edges[c] else None
        out[c] = Baseline(shape.cuts, shares, shape.value_bins)
    return out


def stability_index(
    current: DataFrame,
    baselines: Mapping[str, Baseline],
    by: Sequence[str] = (),
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Population stability index per group and column: (by..., column, n, psi).

    ``also`` adds named aggregates of the same scan as columns.

    One scan and one small aggregate: the baseline side is literal shares, so
    nothing is joined. Shares are floored, not renormalised; missing values are
    a bin. NULL when the baseline has no value or the group has no row.
    """
    binned = bucketize(
        current.select(*by, *baselines), {c: b.cuts for c, b in baselines.items()}, "__bin_"
    )
    extra = [c.alias(name) for name, c in (also or {}).items()]
    counted = binned.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), *bin_counts(baselines), *extra
    )
    rows = []
    for c, base in baselines.items():
        index = F.lit(None).cast("double")
        if base.shares is not None:
            index = F.lit(0.0)
            for i, share in enumerate(base.shares):
                expected = max(share, S.SHARE_FLOOR)
                actual = F.greatest(ratio(F.col(c)[i], F.col("__n")), F.lit(S.SHARE_FLOOR))
                index = index + (actual - expected) * F.log(actual / expected)
            index = F.when(F.col("__n") > 0, index)
        rows.append(
            F.struct(F.lit(c).alias("column"), F.col("__n").alias("n"), index.alias("psi"))
        )
    return counted.select(*by, *(also or {}), F.inline(F.array(*rows)))


def psi(
    baseline: DataFrame,
    current: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    bins: int = S.PSI_BINS,
) -> DataFrame:
    return stability_index(current, fit_baselines(baseline, columns, bins), by)


__all__ = [
    "Baseline", "auc_standard_error", "calibration_gap", "classification_report",
    "confusion", "confusion_row", "evaluate", "fit_baselines", "per_column",
    "precision_recall_f1", "psi", "roc_auc", "stability_index",
]
