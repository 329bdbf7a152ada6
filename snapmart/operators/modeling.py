"""Splits, preprocessing, fitting, calibration and scoring on Spark ML."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapmart import schemas as S
from snapmart.operators import search
from snapmart.operators.filters import complete_cases
from snapmart.operators.metrics import evaluate
from snapmart.operators.order_stats import as_value, medians
from snapmart.sources.scratch import materialise

#: Cells per hash digit of the stratified split (a power of two), and digits taken before ranking.
SPLIT_CELLS, SPLIT_DIGITS = 4096, 2


# ----------------------------------------------------------------- time windows


@dataclass(frozen=True)
class Windows:
    train_test_start: Column
    train_test_end: Column
    oot_start: Column
    oot_end: Column


def time_windows(
    train_date,
    delay: int = S.LABEL_DELAY_MONTHS,
    train_test_months: int = S.TRAIN_TEST_MONTHS,
    oot_months: int = S.OOT_MONTHS,
) -> Windows:
    """Window bounds as date columns, counted back from the train date.

    ``delay=1, train_test_months=12`` gives the windows without a label delay.
    """
    day = F.lit(str(train_date)).cast("date")
    oot_end = F.add_months(day, -delay)
    oot_start = F.add_months(oot_end, -(oot_months - 1))
    end = F.add_months(oot_start, -1)
    return Windows(F.add_months(end, -(train_test_months - 1)), end, oot_start, oot_end)


def tag_windows(
    df: DataFrame,
    train_date,
    delay: int = S.LABEL_DELAY_MONTHS,
    train_test_months: int = S.TRAIN_TEST_MONTHS,
    oot_months: int = S.OOT_MONTHS,
    column: str = "snapshot_date",
) -> DataFrame:
    """``split`` = train_test, oot, production (from the train date on) or NULL."""
    w = time_windows(train_date, delay, train_test_months, oot_months)
    d = F.col(column)
    tag = (
        F.when(d.between(w.train_test_start, w.train_test_end), "train_test")
        .when(d.between(w.oot_start, w.oot_end), "oot")
        .when(d >= F.lit(str(train_date)).cast("date"), "production")
    )
    return df.withColumn("split", tag)


def cut_split(df: DataFrame, cutoff, column: str = "snapshot_date") -> DataFrame:
    """Train up to the cutoff date, test after it."""
    up_to = F.col(column) <= F.lit(str(cutoff)).cast("date")
    return df.withColumn("split", F.when(up_to, "train").otherwise("test"))


def stratified_split(
    df: DataFrame,
    label: str = "label",
    key: str = "loan_id",
    ratio: float = S.TRAIN_SHARE,
    seed: int = S.SPLIT_SEED,
) -> DataFrame:
    """Seeded split with the exact share per label: ``split`` = train or test.

    Rows are ordered by the digits of their hash in base ``SPLIT_CELLS`` and by their
    key. Counts per first digit tell in which cell each label's cut falls; the rows of
    that cell alone are counted by the next digit, and so on for ``SPLIT_DIGITS`` digits.
    Only what shares all digits with the cut, one row in ``SPLIT_CELLS`` to that power,
    is ranked. Each step's cuts, one row per label, are found before the next step and
    come back as literals, so the table itself is neither shuffled nor joined, and no
    step's plan holds that of another. ``df`` is read once per step: hand on a stored one.
    Keys identify rows.
    """
    stratum = F.coalesce(F.col(label).cast("string"), F.lit(""))
    hashed = df.withColumns({"__h": F.xxhash64(F.col(key), F.lit(seed)), "__s": stratum})
    bits = SPLIT_CELLS.bit_length() - 1
    digits = [f"__d{i}" for i in range(SPLIT_DIGITS)]
    hashed = hashed.withColumns(
        {d: F.pmod(F.shiftrightunsigned("__h", bits * i), F.lit(SPLIT_CELLS)) for i, d in enumerate(digits)}
    )
    of_label = Window.partitionBy("__s")
    inside, take = hashed, None
    for digit in digits:
        counts = inside.groupBy("__s", digit).agg(F.count(F.lit(1)).alias("__n"))
        before = F.sum("__n").over(of_label.orderBy(digit)) - F.col("__n")
        wanted = take if take is not None else F.round(F.sum("__n").over(of_label) * F.lit(float(ratio))).cast("bigint")
        cut = counts.select("__s", digit, "__n", before.alias("__before"), wanted.alias("__wanted")).where(
            (F.col("__before") < F.col("__wanted")) & (F.col("__before") + F.col("__n") >= F.col("__wanted"))
        )
        left = (F.col("__wanted") - F.col("__before")).alias("__take")
        found = _of_label(cut.select("__s", F.col(digit).alias("__digit"), left))
        inside, take = inside.where(F.col(digit) == found["__digit"]), found["__take"]
    rank = F.row_number().over(of_label.orderBy("__h", key))
    last_rows = inside.withColumn("__rank", rank).where(F.col("__rank") == take)
    here = [*digits, "__h", F.col(key).alias("__k")]
    last = _of_label(last_rows.select("__s", *here))
    side = F.when(F.struct(*here) <= last, "train").otherwise("test")
    return hashed.select(*df.columns, side.alias("split"))


def _of_label(rows: DataFrame) -> Column:
    """The other columns of ``rows``, which holds one row per label, as a struct by the label ``__s``."""
    names = rows.columns[1:]
    kinds = {c: rows.schema[c].dataType for c in names}
    found = {
        r["__s"]: F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in names]) for r in rows.collect()
    }
    if not found:
        return F.struct(*[F.lit(None).cast(kinds[c]).alias(c) for c in names])
    return F.map_from_arrays(F.array(*map(F.lit, found)), F.array(*found.values()))[F.col("__s")]


# ---------------------------------------------------------------- preprocessing


@dataclass(frozen=True)
class Preprocessing:
    """Median, mean and population deviation of each feature on the train rows."""

    columns: tuple[str, ...]
    median: Mapping[str, float]
    mean: Mapping[str, float]
    std: Mapping[str, float]

    def imputed(self, c: str) -> Column:
        return F.coalesce(as_value(c), F.lit(self.median[c]))

    def scaled(self, c: str) -> Column:
        return (self.imputed(c) - F.lit(self.mean[c])) / F.lit(self.std[c])

    def of(self, columns: Sequence[str]) -> Preprocessing:
        """The same for some of the columns."""
        kept = tuple(c for c in columns if c in self.median)
        return Preprocessing(kept, self.median, self.mean, self.std)

    def apply(self, df: DataFrame) -> DataFrame:
        """Columns replaced by their imputed and scaled values."""
        return df.withColumns({c: self.scaled(c) for c in self.columns})

    def stages(self) -> list:
        """The same as savable pipeline stages ending in a ``features`` vector."""
        scaled = ", ".join(
            f"(coalesce(nanvl(cast(`{c}` as double), cast(null as double)), {self.median[c]!r}D)"
            f" - ({self.mean[c]!r}D)) / {self.std[c]!r}D AS `z_{c}`"
            for c in self.columns
        )
        return [
            SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
            VectorAssembler(inputCols=[f"z_{c}" for c in self.columns], outputCol="features"),
        ]


def fit_preprocessing(train: DataFrame, columns: Sequence[str]) -> Preprocessing:
    """Fit on train rows. Features without any value are left out; a constant
    feature is centred but not scaled."""
    found = medians(train, columns)
    kept = [c for c in columns if found[c] is not None]
    filled = [F.coalesce(as_value(c), F.lit(found[c])) for c in kept]
    row = train.agg(
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)],
        *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(filled)],
    ).first()
    return Preprocessing(
        tuple(kept),
        {c: float(found[c]) for c in kept},
        {c: float(row[f"m{i}"]) for i, c in enumerate(kept)},
        {c: float(row[f"s{i}"]) or 1.0 for i, c in enumerate(kept)},
    )


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL to the column's exact median over the whole frame."""
    found = medians(df, columns)
    return df.withColumns(
        {
            c: F.coalesce(as_value(c), F.lit(found[c])) if found[c] is not None else F.col(c)
            for c in columns
        }
    )


def feature_columns(
    df: DataFrame, ids: Sequence[str] = tuple(S.ID_COLUMNS), prefix: str | None = None,
    without: Sequence[str] = (),
) -> list[str]:
    """Column names by role: all but identifiers, by prefix, or a set difference."""
    names = [c for c in df.columns if c not in {*ids, *without}]
    return [c for c in names if prefix is None or c.startswith(prefix)]


# ------------------------------------------------------------------ candidates


def score_of(model: Model) -> Column:
    """Positive-class probability of a scored frame."""
    return vector_to_array("probability")[1]


def fit_logistic(train: DataFrame, n_rows: int, label: str = "label") -> LogisticRegressionModel:
    """L2 logistic regression with unit inverse penalty (penalty 1/n per row)."""
    return LogisticRegression(
        featuresCol="features",
        labelCol=label,
        regParam=1.0 / n_rows,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1000,
    ).fit(train)


def draw_parameters(
    space: Mapping[str, Sequence], n: int = S.SEARCH_DRAWS, seed: int = S.SEARCH_SEED
) -> list[dict]:
    """Seeded draws without repetition from a grid."""
    total = 1
    for values in space.values():
        total *= len(values)
    picks = random.Random(seed).sample(range(total), min(n, total))
    draws = []
    for index in picks:
        draw = {}
        for name, values in space.items():
            index, at = divmod(index, len(values))
            draw[name] = values[at]
        draws.append(draw)
    return draws


@dataclass(frozen=True)
class SearchResult:
    params: dict
    cv_auc: float | None
    trials: DataFrame


def random_search(
    train: DataFrame,
    prep: Preprocessing,
    sets: Mapping[str, Sequence[str]],
    n: int,
    key: str = "loan_id",
    label: str = "label",
    space: Mapping[str, Sequence] = S.GBT_SEARCH_SPACE,
    draws: int = S.SEARCH_DRAWS,
    folds: int = S.SEARCH_FOLDS,
    seed: int = S.SEARCH_SEED,
    rows: int | None = None,
) -> dict[str, SearchResult]:
    """Boosted trees by random search with hash folds, scored by area under the curve.

    All feature sets share the bins, the folds and the draws; see ``search``. ``n`` is the
    number of train rows, all of which the fits use unless ``rows`` asks for fewer.
    ``trials``: draw, cv_auc, n_held (rows held out over all folds), n_folds, chosen.
    """
    values = {c: prep.imputed(c) for c in prep.columns}
    cuts = search.bin_cuts(train.select([v.alias(c) for c, v in values.items()]), prep.columns)
    bins = search.fold_bins(train, values, cuts, n, key, label, folds, seed, rows)
    params = draw_parameters(space, draws, seed)
    trials = materialise(
        search.best_draws(search.fold_areas(bins, list(prep.columns), sets, params, folds, seed)), "trials"
    )
    return {
        r["feature_set"]: SearchResult(
            params[r["draw"]], r["cv_auc"],
            trials.where(F.col("feature_set") == r["feature_set"]).drop("feature_set"),
        )
        for r in trials.where("chosen").collect()
    }


def fit_boosted(train: DataFrame, params: Mapping, label: str = "label") -> GBTClassificationModel:
    """Boosted trees on all rows of ``train`` (label, features)."""
    return GBTClassifier(
        featuresCol="features", labelCol=label, seed=S.SPLIT_SEED, maxBins=search.BINS, **params
    ).fit(train)


def compare_candidates(
    scored: Mapping[str, DataFrame], label: str = "label", split: str = "split"
) -> DataFrame:
    """AUC and Gini of each candidate on each split, long: (model, split, ...)."""
    long = None
    for name, df in scored.items():
        part = df.select(F.lit(name).alias("model"), split, label, "model_predictions")
        long = part if long is None else long.unionByName(part)
    return evaluate(long, by=["model", split], label=label).select(
        "model", split, "n_labels", "auc", "gini"
    )


def choose_champion(results: DataFrame, on: str = "oot") -> str:
    """Name of the candidate with the highest area on one split."""
    row = (
        results.where(F.col("split") == on)
        .orderBy(F.col("auc").desc_nulls_last(), "model")
        .select("model")
        .first()
    )
    return row["model"]


# ------------------------------------------------------------------ calibration


@dataclass(frozen=True)
class Calibration:
    """Sigmoid from a raw score to a probability of default."""

    slope: float
    intercept: float

    def apply(self, raw: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.slope) * raw + F.lit(self.intercept))))


def fit_platt(df: DataFrame, score: str, label: str = "label") -> Calibration:
    """Platt (1999): unregularised logistic fit of smoothed targets on the score.

    Scores are first counted per (score, label); a smoothed target t becomes two
    weighted rows, (1, t) and (0, 1 - t).
    """
    counts = (
        complete_cases(df, [label, score])
        .groupBy(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"),
    ).first()
    high = (totals["pos"] + 1.0) / (totals["pos"] + 2.0)
    low = 1.0 / (totals["neg"] + 2.0)
    t = F.when(F.col("y") == 1, F.lit(high)).otherwise(F.lit(low))
    weighted = counts.select(
        "s",
        F.inline(
            F.array(
                F.struct(F.lit(1.0).alias("target"), (F.col("n") * t).alias("weight")),
                F.struct(F.lit(0.0).alias("target"), (F.col("n") * (1 - t)).alias("weight")),
            )
        ),
    )
    vectors = VectorAssembler(inputCols=["s"], outputCol="v").transform(weighted)
    fit = LogisticRegression(
        featuresCol="v", labelCol="target", weightCol="weight", regParam=0.0, maxIter=200, tol=1e-10
    ).fit(vectors)
    return Calibration(float(fit.coefficients[0]), float(fit.intercept))


# ------------------------------------------------------------------- importance


def importances(
    df: DataFrame, model: Model, columns: Sequence[str]
) -> DataFrame:
    """Tree importances or absolute coefficients as a frame (feature, importance)."""
    if isinstance(model, LogisticRegressionModel):
        values = [abs(float(x)) for x in model.coefficients.toArray()]
    else:
        values = [float(x) for x in model.featureImportances.toArray()]
    return df.sparkSession.createDataFrame(
        list(zip(columns, values)), "feature string, importance double"
    )


def importance_by_group(
    importance: DataFrame, groups: Mapping[str, Sequence[str]], other: str = "other"
) -> DataFrame:
    """Importance share per feature group; groups are lists of names or prefixes."""
    group = F.lit(other)
    for name, members in groups.items():
        match = F.lit(False)
        for m in members:
            match = match | (
                F.col("feature").startswith(m[:-1]) if m.endswith("*") else F.col("feature") == m
            )
        group = F.when(match, name).otherwise(group)
    total = importance.agg(F.sum("importance").alias("t")).scalar()
    return (
        importance.groupBy(group.alias("group"))
        .agg(F.count(F.lit(1)).alias("n_features"), F.sum("importance").alias("importance"))
        .withColumn("share", F.try_divide(F.col("importance"), total))
    )


# ----------------------------------------------------------------- trained model


@dataclass
class CreditModel:
    """Everything scoring needs, in savable form."""

    version: str
    model_type: str
    columns: tuple[str, ...]
    pipeline: PipelineModel
    calibration: Calibration
    top_features: list[str] = field(default_factory=list)

    def raw_scores(self, df: DataFrame) -> DataFrame:
        """Input columns plus ``raw_score``."""
        out = self.pipeline.transform(df)
        return out.select(*df.columns, score_of(self.pipeline.stages[-1]).alias("raw_score"))

    def calibrated(self, df: DataFrame) -> DataFrame:
        raw = self.raw_scores(df)
        return raw.withColumn("model_predictions", self.calibration.apply(F.col("raw_score")))


def score(df: DataFrame, model: CreditModel) -> DataFrame:
    """Prediction table rows; works for one month or for all months at once."""
    return model.calibrated(df).select(
        "loan_id",
        "Customer_ID",
        "snapshot_date",
        F.lit(model.version).alias("model_name"),
        "model_predictions",
    )
