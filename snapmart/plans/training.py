"""Training plan: windows, split, candidates, champion, calibration, artefacts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapmart import schemas as S
from snapmart.operators import modeling as M
from snapmart.operators.joins import features_with_labels
from snapmart.operators.metrics import Baseline, evaluate, fit_baselines
from snapmart.operators.monitoring import calibration_summary, split_summary
from snapmart.sources.scratch import materialise


@dataclass
class Trained:
    model: M.CreditModel
    results: DataFrame
    splits: DataFrame
    calibration: DataFrame
    importance: DataFrame
    score_baseline: Baseline
    feature_baselines: dict[str, Baseline]
    params: dict
    data: DataFrame


def training_frame(
    features: DataFrame,
    labels: DataFrame,
    train_date,
    delay: int = S.LABEL_DELAY_MONTHS,
    train_test_months: int = S.TRAIN_TEST_MONTHS,
    oot_months: int = S.OOT_MONTHS,
    ratio: float = S.TRAIN_SHARE,
) -> DataFrame:
    """Applications with a label known at the train date, tagged train/test/oot."""
    known = labels.where(F.col("snapshot_date") <= F.lit(str(train_date)).cast("date"))
    tagged = M.tag_windows(features, train_date, delay, train_test_months, oot_months)
    joined = features_with_labels(tagged.where(F.col("split").isin("train_test", "oot")), known)
    joined = materialise(joined, "joined")  # the split reads it several times
    mixed = joined.where(F.col("split") == "train_test").drop("split")
    return M.stratified_split(mixed, ratio=ratio).unionByName(joined.where(F.col("split") == "oot"))


def train_on(
    data: DataFrame,
    columns: Sequence[str],
    version: str,
    draws: int = S.SEARCH_DRAWS,
    space: Mapping[str, Sequence] = S.GBT_SEARCH_SPACE,
) -> Trained:
    """Fit both candidates on ``split`` = train, choose by oot, calibrate on test."""
    return compare_feature_sets(data, {version: columns}, draws, space)[version]


def compare_feature_sets(
    data: DataFrame, sets: Mapping[str, Sequence[str]], draws: int = S.SEARCH_DRAWS,
    space: Mapping[str, Sequence] = S.GBT_SEARCH_SPACE, parallelism: int = 4,
) -> dict[str, Trained]:
    """The same training for several column sets, which share rows, bins, folds and draws.

    ``data`` needs loan_id, label, split and the feature columns; it is written to the
    shared scratch folder once, since every fit reads it again. One search covers all
    sets; the last fits of the sets, which are Spark jobs over all train rows, run
    ``parallelism`` at a time.
    """
    kept = materialise(data, "training")
    train = kept.where(F.col("split") == "train")
    n = train.count()
    every = [c for c in kept.columns if any(c in columns for columns in sets.values())]
    prep = M.fit_preprocessing(train, every)
    found = M.random_search(train, prep, sets, n, draws=draws, space=space)
    with ThreadPoolExecutor(parallelism) as pool:
        jobs = {
            name: pool.submit(_finish, kept, n, prep.of(columns), name, found[name])
            for name, columns in sets.items()
        }
        return {name: job.result() for name, job in jobs.items()}


def _finish(kept: DataFrame, n: int, prep: M.Preprocessing, version: str, found: M.SearchResult) -> Trained:
    """Both candidates on all train rows, scored once; champion, calibration, baselines."""
    stages = prep.stages()
    prepare = PipelineModel(stages=stages)
    vectors = materialise(
        prepare.transform(kept.where(F.col("split") == "train")).select("loan_id", "label", "features"), "vectors"
    )
    candidates = {
        "logistic_regression": M.fit_logistic(vectors, n),
        "boosted_trees": M.fit_boosted(vectors, found.params),
    }
    scored = kept
    for name, model in candidates.items():
        pipeline = PipelineModel(stages=[*stages, model])
        scored = pipeline.transform(scored).select(*scored.columns, M.score_of(model).alias(f"score_{name}"))
    scored = materialise(scored, "scored")
    scores = {
        name: scored.select("split", "label", F.col(f"score_{name}").alias("model_predictions")) for name in candidates
    }
    results = materialise(M.compare_candidates(scores), "results")
    best = M.choose_champion(results)
    champion = M.CreditModel(
        version,
        best,
        prep.columns,
        PipelineModel(stages=[*stages, candidates[best]]),
        M.fit_platt(scores[best].where(F.col("split") == "test"), "model_predictions"),
    )
    importance = M.importances(kept, candidates[best], prep.columns)
    champion.top_features = [
        r["feature"]
        for r in importance.orderBy(F.col("importance").desc(), F.col("feature").desc()).limit(5).collect()
    ]
    raw = F.col(f"score_{best}")
    final = scored.withColumns({"raw_score": raw, "model_predictions": champion.calibration.apply(raw)})
    baselines = fit_baselines(
        final.where(F.col("split") == "train"), ["model_predictions", *champion.top_features]
    )
    return Trained(
        model=champion,
        results=results,
        splits=split_summary(kept),
        calibration=calibration_summary(
            final.where(F.col("split") == "oot"), "label", "raw_score", "model_predictions"
        ),
        importance=importance,
        score_baseline=baselines.pop("model_predictions"),
        feature_baselines=baselines,
        params=found.params if best == "boosted_trees" else {"regParam": "1/n"},
        data=kept,
    )


def resilience(trained: Mapping[str, Trained], period: DataFrame) -> DataFrame:
    """Each feature set's champion over a later period: area, score gap, recall."""
    long = None
    for name, t in trained.items():
        part = t.model.calibrated(period).select(
            F.lit(name).alias("feature_set"),
            F.lit(len(t.model.columns)).alias("n_features"),
            "label",
            "model_predictions",
        )
        long = part if long is None else long.unionByName(part)
    long = materialise(long, "period")
    return evaluate(long, by=["feature_set", "n_features"]).select(
        "feature_set",
        "n_features",
        "n_labels",
        F.col("bad_rate_actual").alias("bad_rate"),
        F.col("bad_rate_predicted").alias("mean_prediction"),
        F.col("auc").alias("auc_period"),
        F.col("bad_rate_gap").alias("pd_gap_period"),
        F.col("recall").alias("recall_period"),
    )
