"""Windows, split, preprocessing, fits and artefacts."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from snapmart.catalogue import models
from snapmart.catalogue.registry import QUERIES
from snapmart.operators import modeling as M
from snapmart.operators import search
from snapmart.operators.metrics import evaluate
from snapmart.plans import training as P
from snapmart.schemas import GBT_SEARCH_SPACE
from snapmart.sources import artefacts
from snapmart.sources.scratch import materialise, new_path

SPACE = {"maxIter": [4], "maxDepth": [2], "stepSize": [0.1]}


def test_windows_count_back_from_train_date(spark):
    months = [dt.date(2022 + (m // 12), m % 12 + 1, 1) for m in range(40)]
    df = spark.createDataFrame([(m,) for m in months], "snapshot_date date")
    tags = {r["snapshot_date"]: r["split"] for r in M.tag_windows(df, "2024-06-01").collect()}
    by = lambda tag: sorted(d for d, t in tags.items() if t == tag)
    assert (by("oot")[0], by("oot")[-1]) == (dt.date(2023, 11, 1), dt.date(2023, 12, 1))
    assert (by("train_test")[0], by("train_test")[-1]) == (dt.date(2023, 1, 1), dt.date(2023, 10, 1))
    assert by("production")[0] == dt.date(2024, 6, 1)
    assert tags[dt.date(2024, 3, 1)] is None
    lab = {r["snapshot_date"]: r["split"] for r in M.tag_windows(df, "2024-06-01", 1, 12).collect()}
    assert lab[dt.date(2024, 5, 1)] == "oot" and lab[dt.date(2024, 4, 1)] == "oot"
    assert lab[dt.date(2023, 4, 1)] == "train_test" and lab[dt.date(2023, 3, 1)] is None


@pytest.mark.parametrize("n", [3, 10, 1000])
def test_split_is_exact_disjoint_and_repeatable(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("loan_id"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    first = sorted(map(tuple, M.stratified_split(df).collect()))
    again = sorted(map(tuple, M.stratified_split(df.repartition(5)).collect()))
    assert first == again and len(first) == n == len({r[0] for r in first})
    for label in (0, 1):
        rows = [r for r in first if r[1] == label]
        assert sum(r[2] == "train" for r in rows) == int(len(rows) * 0.8 + 0.5)
    other = sorted(map(tuple, M.stratified_split(df, seed=1).collect()))
    assert n < 1000 or other != first


def test_preprocessing_uses_train_statistics(spark):
    df = spark.createDataFrame(
        [(1.0, 5.0, None), (2.0, 5.0, None), (4.0, 5.0, None), (None, 5.0, None)], "a double, c double, e double"
    )
    fit = M.fit_preprocessing(df, ["a", "c", "e"])
    assert fit.columns == ("a", "c")
    filled = np.array([1.0, 2.0, 4.0, 2.0])
    want = (filled - filled.mean()) / filled.std()
    rows = fit.apply(df).select("a", "c").collect()
    assert [r["a"] for r in rows] == pytest.approx(list(want))
    assert [r["c"] for r in rows] == [0.0] * 4
    vectors = PipelineModel(stages=fit.stages()).transform(df).select("features").collect()
    assert [v[0][0] for v in vectors] == pytest.approx(list(want))


def test_draws_are_seeded_and_distinct():
    space = {"a": [1, 2, 3], "b": [4, 5]}
    draws = M.draw_parameters(space, 4, seed=42)
    assert draws == M.draw_parameters(space, 4, seed=42)
    assert len({tuple(sorted(d.items())) for d in draws}) == 4
    assert len(M.draw_parameters(space, 100)) == 6


def platt_of(scores, y):
    """Newton steps on the smoothed targets."""
    pos, neg = sum(y), len(y) - sum(y)
    t = np.where(np.array(y) == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.column_stack([scores, np.ones(len(scores))])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (t - p))
    return w


def test_platt_equals_newton(spark):
    r = random.Random(1)
    rows = [(r.random(),) for _ in range(300)]
    rows = [(s, int(r.random() < 0.2 + 0.6 * s)) for (s,) in rows]
    fit = M.fit_platt(spark.createDataFrame(rows, "s double, label int"), "s")
    want = platt_of([a for a, _ in rows], [b for _, b in rows])
    assert (fit.slope, fit.intercept) == (pytest.approx(want[0], rel=1e-4), pytest.approx(want[1], rel=1e-4))


def test_importance_groups(spark):
    df = spark.createDataFrame([("fe_1_mean", 1.0), ("Age", 2.0), ("fe_2_mean", 1.0)], "feature string, importance double")
    got = {r["group"]: (r["n_features"], r["share"]) for r in M.importance_by_group(df, {"clicks": ["fe_*"]}).collect()}
    assert got == {"clicks": (2, 0.5), "other": (1, 0.5)}


def test_feature_columns_by_role(spark):
    df = spark.createDataFrame([], "loan_id string, Customer_ID string, snapshot_date date, label int, Age int, fe_1_mean double")
    assert M.feature_columns(df) == ["Age", "fe_1_mean"]
    assert M.feature_columns(df, prefix="fe_") == ["fe_1_mean"]
    assert M.feature_columns(df, without=["Age"]) == ["fe_1_mean"]


@pytest.fixture(scope="module")
def trained(spark):
    r = random.Random(6)
    rows = []
    for i in range(600):
        x, z = r.gauss(0, 1), r.gauss(0, 1)
        label = int(r.random() < 1 / (1 + np.exp(-2 * x)))
        rows.append((f"l{i}", f"c{i}", dt.date(2023, 1 + i % 12, 1), x, z if i % 5 else None, label))
    df = spark.createDataFrame(rows, "loan_id string, Customer_ID string, snapshot_date date, x double, z double, label int")
    features = materialise(df.drop("label"), "test")
    labels = df.select("loan_id", "label", F.add_months("snapshot_date", 6).alias("snapshot_date"))
    data = P.training_frame(features, labels, "2024-06-01")
    return P.train_on(data, ["x", "z"], "credit_model_test", draws=1, space=SPACE), features


def test_training_end_to_end(spark, trained):
    t, _ = trained
    splits = {r["split"]: r["n"] for r in t.splits.collect()}
    assert set(splits) == {"train", "test", "oot"} and sum(splits.values()) == 600
    results = t.results.collect()
    assert {(r["model"], r["split"]) for r in results} == {
        (m, s) for m in ("logistic_regression", "boosted_trees") for s in ("train", "test", "oot")
    }
    best = max((r for r in results if r["split"] == "oot"), key=lambda r: r["auc"])
    assert best["model"] == t.model.model_type and best["auc"] > 0.7
    assert t.model.top_features[0] == "x"
    row = t.calibration.first()
    assert row["brier_calibrated"] < 0.25 and abs(row["mean_pred_calibrated"] - row["bad_rate"]) < 0.15
    assert t.score_baseline.value_bins == 10


def test_scores_and_saved_model_agree(spark, trained):
    t, features = trained
    root = new_path(spark, "bank")
    artefacts.save_model(spark, t.model, root)
    base = {"model_predictions": t.score_baseline, **t.feature_baselines}
    artefacts.save_baselines(spark, t.model.version, base, root)
    artefacts.save_metadata(spark, t.model.version, {"train_date": "2024-06-01", "none": None}, root)
    loaded = artefacts.load_model(spark, root, t.model.version)
    a = M.score(features, t.model).orderBy("loan_id").collect()
    assert a == M.score(features, loaded).orderBy("loan_id").collect()
    assert set(a[0].asDict()) == {"loan_id", "Customer_ID", "snapshot_date", "model_name", "model_predictions"}
    assert all(0 < r["model_predictions"] < 1 for r in a)
    assert artefacts.load_baselines(spark, root, t.model.version) == base
    assert artefacts.load_metadata(spark, root, t.model.version).count() == 2


def test_calibration_keeps_the_ranking(trained):
    t, _ = trained
    final = t.model.calibrated(t.data)
    raw = evaluate(final, score="raw_score").first()["auc"]
    assert evaluate(final).first()["auc"] == pytest.approx(raw, abs=1e-6)


@pytest.mark.parametrize("name", ["q_gbt_search", "q_candidates", "q_feature_sets"])
def test_training_queries_search_the_full_grid(spark, small, monkeypatch, name):
    class Searched(Exception):
        pass

    def record(bins, columns, sets, params, folds, seed):
        raise Searched(len(params), folds, {frozenset(p) for p in params})

    monkeypatch.setattr(models, "_FITTED", {})
    monkeypatch.setattr(search, "fold_areas", record)
    with pytest.raises(Searched) as found:
        QUERIES[name](spark, small)
    assert found.value.args == (50, 3, {frozenset(GBT_SEARCH_SPACE)})


def test_applications_know_only_earlier_events(spark, small):
    rows = models.applications(spark, small).select("loan_id", "n_events").collect()
    orders = spark.read.parquet(f"{small}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate").collect()
    clicks = [(r["Customer_ID"], r["snapshot_date"]) for r in models.clicks(spark, small).collect()]
    want = {
        str(o["o_orderkey"]): sum(c == str(o["o_custkey"]) and day <= o["o_orderdate"].date() for c, day in clicks) or None
        for o in orders
    }
    assert {r["loan_id"]: r["n_events"] for r in rows} == {k: want[k] for k in (r["loan_id"] for r in rows)}
    assert len(set(want.values())) > 5


@pytest.mark.parametrize("name", ["q_gbt_search", "q_candidates", "q_resilience"])
def test_training_queries_take_labels_known_at_the_train_date(spark, small, monkeypatch, name):
    class Reached(Exception):
        pass

    def frame(features, labels, train_date):
        assert "label" not in features.columns
        dates = labels.join(features.select("loan_id", F.col("snapshot_date").alias("day")), "loan_id")
        assert dates.where(F.months_between("snapshot_date", "day") != 6).count() == 0 < dates.count()
        raise Reached(train_date)

    monkeypatch.setattr(models, "_FITTED", {})
    monkeypatch.setattr(P, "training_frame", frame)
    with pytest.raises(Reached, match=models.TRAIN_DATE):
        QUERIES[name](spark, small)


def test_resilience_compares_four_sets_over_an_outage(spark, small, monkeypatch):
    sets, draw = models._SETS, M.random_search
    clicks, borrowed = set(models.CLICKS), set(models.BORROWED)
    assert {(clicks <= set(c), borrowed <= set(c)) for c in sets.values()} == {(a, b) for a in (True, False) for b in (True, False)}
    assert all(not clicks & set(c) or clicks <= set(c) for c in sets.values())
    period = models.outage(spark, small)
    row = period.agg(F.min("snapshot_date"), F.max("snapshot_date"), *[F.count(c) for c in models.CLICKS]).first()
    assert tuple(row) == (dt.date(1999, 7, 1), dt.date(1999, 12, 1), *[0] * len(clicks))
    monkeypatch.setattr(models, "_FITTED", {})
    monkeypatch.setattr(M, "random_search", lambda *a, **_: draw(*a, draws=1, folds=2, space=SPACE))
    got = {r["feature_set"]: r for r in models.resilience(spark, small).collect()}
    assert {k: r["n_features"] for k, r in got.items()} == {k: len(c) for k, c in sets.items()}
    assert all(0 < r["auc_period"] < 1 and r["pd_gap_period"] is not None for r in got.values())
    # The other comparison reports on the same trainings.
    fitted = dict(models._FITTED)
    compared = {r["feature_set"]: r for r in models.feature_sets(spark, small).collect()}
    assert models._FITTED == fitted and set(compared) == set(sets)
    assert all(r["auc"] == r["best"] for r in compared.values())


# ------------------------------------------------------------------------- search


def plain_tree(x, target, rows, depth):
    """Least-variance tree by trying every cut; no samples."""
    if depth == 0 or len(rows) < 2:
        return {i: target[rows].mean() for i in rows}, lambda v: target[rows].mean()
    best = (1e-12, None)
    for f in range(x.shape[1]):
        for c in sorted(set(x[rows, f]))[:-1]:
            low, high = rows[x[rows, f] <= c], rows[x[rows, f] > c]
            gain = target[rows].var() - sum(len(p) * target[p].var() for p in (low, high)) / len(rows)
            if gain > best[0] + 1e-12:
                best = (gain, (f, c))
    if best[1] is None:
        return {i: target[rows].mean() for i in rows}, lambda v: target[rows].mean()
    f, c = best[1]
    (a, low), (b, high) = (
        plain_tree(x, target, rows[m], depth - 1) for m in (x[rows, f] <= c, x[rows, f] > c)
    )
    return {**a, **b}, lambda v: low(v) if v[f] <= c else high(v)


def test_shared_bin_trees_equal_plain_ones():
    r = np.random.default_rng(2)
    params = {"maxIter": 4, "maxDepth": 2, "stepSize": 0.1, "subsamplingRate": 1.0, "featureSubsetStrategy": "1.0",
              "minInfoGain": 0.0, "minInstancesPerNode": 1}
    x = r.integers(0, 9, (120, 3)).astype(np.uint8)
    y = np.where(x[:, 0] + r.normal(0, 3, 120) > 4, 1, -1)
    fitted = np.arange(120) % 3 != 0
    margin = np.zeros(120)
    for step in range(4):
        target = y.astype(float) if step == 0 else 4 * y / (1 + np.exp(2 * y * margin))
        _, predict = plain_tree(x, target, np.flatnonzero(fitted), 2)
        margin += (1.0 if step == 0 else 0.1) * np.array([predict(v) for v in x])
    got = search.boosted_scores(x, y, fitted, params, [1])
    assert np.allclose(got, margin)
    # A leaf's least size and least gain hold; a split that gains nothing is none.
    assert len(set(search.boosted_scores(x, y, fitted, {**params, "minInfoGain": 9.0}, [1]))) == 1
    assert len(set(search.boosted_scores(x, y, fitted, {**params, "minInstancesPerNode": 41}, [1]))) == 1


def test_area_counts_ties_half():
    score, positive = np.array([1, 2, 2, 3, 0]), np.array([True, True, False, False, False])
    assert search.area(score, positive) == pytest.approx((1 + 1.5) / 6)
    assert np.isnan(search.area(score, positive | True))


def test_search_shares_bins_and_covers_every_row(spark):
    r = random.Random(8)
    rows = [(f"l{i}", r.random(), None if i % 4 == 0 else r.random(), i % 3) for i in range(900)]
    rows = [(k, a, b, c, int(r.random() < a)) for k, a, b, c in rows]
    train = spark.createDataFrame(rows, "loan_id string, a double, b double, c int, label int")
    prep = M.fit_preprocessing(train, ["a", "b", "c"])
    sets = {"all": ["a", "b", "c"], "noise": ["b", "c"]}
    found = M.random_search(train, prep, sets, 900, draws=3, folds=3)
    assert set(found) == set(sets)
    for name, result in found.items():
        trials = result.trials.collect()
        assert [t["n_held"] for t in trials] == [900] * 3 and [t["n_folds"] for t in trials] == [3] * 3
        assert sum(t["chosen"] for t in trials) == 1
        assert max(t["cv_auc"] for t in trials) == result.cv_auc == next(t["cv_auc"] for t in trials if t["chosen"])
    assert found["all"].cv_auc > 0.7 > found["noise"].cv_auc
    again = M.random_search(train.repartition(3), prep, sets, 900, draws=3, folds=3)
    assert {k: v.cv_auc for k, v in again.items()} == pytest.approx({k: v.cv_auc for k, v in found.items()}, abs=0.02)


def test_the_search_sample_is_bounded(spark):
    train = spark.range(20_000).select(F.col("id").cast("string").alias("loan_id"), (F.col("id") % 2).alias("label"), F.col("id").alias("x"))
    bins = search.fold_bins(train, {"x": F.col("x").cast("double")}, [[5000.0, 10000.0]], 20_000, rows=1_000)
    held = bins.groupBy("bins").count().collect()
    assert sorted(r["bins"] for r in held) == [[0], [1], [2]] and 800 < sum(r["count"] for r in held) < 1_200


def test_the_search_takes_every_row(spark):
    train = spark.range(60_000).select(F.col("id").cast("string").alias("loan_id"), (F.col("id") % 2).alias("label"), F.col("id").alias("x"))
    bins = search.fold_bins(train, {"x": F.col("x").cast("double")}, [[5000.0, 10000.0]], 60_000)
    held = {r["bins"][0]: r["count"] for r in bins.groupBy("bins").count().collect()}
    assert held == {0: 5_001, 1: 5_000, 2: 49_999}


@pytest.mark.parametrize("short", [0, 1_000])
def test_search_areas_equal_those_of_plain_trees(spark, short):
    """Fits whose rows lie in many tasks, and fits that a task does whole, grow the same trees as plain ones."""
    r = np.random.default_rng(5)
    x = r.integers(0, 9, (400, 3))
    label = [None if i % 50 == 0 else int(v) for i, v in enumerate(x[:, 0] + r.normal(0, 3, 400) > 4)]
    fold = np.arange(400) % 4 % 3
    rows = [(v, int(f), i, [int(b) for b in xs]) for i, (v, f, xs) in enumerate(zip(label, fold, x))]
    bins = spark.createDataFrame(rows, "label tinyint, fold tinyint, salt int, bins array<tinyint>").repartition(5)
    sets, params = {"all": ["a", "b", "c"], "two": ["b", "a"]}, [{"maxIter": 4, "maxDepth": 2}, {"maxIter": 1, "maxDepth": 1}]
    found = search.fold_areas(bins, ["a", "b", "c"], sets, params, short=short).collect()
    assert len(found) == 12
    y = np.array([1 if v else -1 for v in label])
    for row in found:
        mine, p = x[:, : len(sets[row["feature_set"]])], params[row["draw"]]
        held, margin = fold == row["fold"], np.zeros(400)
        for step in range(p["maxIter"]):
            target = y.astype(float) if step == 0 else 4 * y / (1 + np.exp(2 * y * margin))
            _, predict = plain_tree(mine, target, np.flatnonzero(~held), p["maxDepth"])
            margin += (1.0 if step == 0 else 0.1) * np.array([predict(v) for v in mine])
        want = search.area(margin[held].round(6), y[held] > 0)
        assert (row["n_held"], row["auc"]) == (held.sum(), pytest.approx(want, abs=1e-9))


def test_a_search_does_not_depend_on_the_size_or_the_tasks(spark):
    """The same draws with samples of rows and columns: whole in a task, level by level, and dealt otherwise."""
    x = [F.pmod(F.xxhash64(F.lit(j), "id"), F.lit(20)) for j in range(3)]
    bins = materialise(spark.range(700).select(
        F.when(F.col("id") % 9 > 0, (x[0] + x[1] * x[1] / 20 + F.pmod(F.hash("id"), F.lit(9)) > 21).cast("tinyint")).alias("label"),
        F.pmod(F.xxhash64("id"), F.lit(3)).cast("tinyint").alias("fold"), F.hash("id").alias("salt"),
        F.array(*x).cast("array<tinyint>").alias("bins"),
    ), "bins")
    params = M.draw_parameters({**GBT_SEARCH_SPACE, "maxIter": [3, 5]}, 4)

    def areas(df, **how):
        found = search.fold_areas(df, ["a", "b", "c"], {"all": ["a", "b", "c"], "one": ["c"]}, params, **how).collect()
        return {(r["feature_set"], r["draw"], r["fold"]): (r["n_held"], r["auc"]) for r in found}

    whole = areas(bins)
    assert len(whole) == 24 and sum(n for n, _ in whole.values()) == 8 * 700 and len(set(whole.values())) > 12
    assert areas(bins, short=0) == whole == areas(bins.repartition(7), short=699)
    # A fold without rows, and a table without rows.
    none = areas(bins.where("fold < 2"), short=0)
    assert all((none[k] == (0, None)) == (k[2] == 2) for k in none)
    assert set(areas(bins.where("fold > 2")).values()) == set(areas(bins.where("fold > 2"), short=-1).values()) == {(0, None)}


@pytest.mark.parametrize("cells, digits", [(4, 1), (4, 3), (2, 5), (4096, 2)])
def test_split_is_exact_however_finely_cells_cut(spark, monkeypatch, cells, digits):
    monkeypatch.setattr(M, "SPLIT_CELLS", cells)
    monkeypatch.setattr(M, "SPLIT_DIGITS", digits)
    rows = [(f"k{i}", None if i % 10 == 0 else i % 3) for i in range(2_000)]
    found = M.stratified_split(spark.createDataFrame(rows, "loan_id string, label int"))
    counts = {(r["label"], r["split"]): r["count"] for r in found.groupBy("label", "split").count().collect()}
    for label in (None, 0, 1, 2):
        n = sum(x == label for _, x in rows)
        assert counts[label, "train"] == round(n * 0.8) and counts[label, "test"] == n - round(n * 0.8)


@pytest.mark.parametrize("name", ["q_split_sizes", "q_split"])
def test_split_of_tables_too_large_to_broadcast(spark, tmp_path, name):
    """The cuts of a split are known before the next step is planned, also where the tables meet by a shuffle."""
    orders = spark.range(1, 2001).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey"),
        F.lit(dt.datetime(1998, 3, 5)).alias("o_orderdate"),
    )
    flag = F.when(F.col("id") % 4 == 0, "R").otherwise("N")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1, 2001).select(F.col("id").alias("l_orderkey"), flag.alias("l_returnflag")).write.parquet(
        f"{tmp_path}/lineitem.parquet"
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = QUERIES[name](spark, str(tmp_path))
        # Nested subqueries of shuffled joins ended in "Subquery has not finished" on large tables.
        assert "scalar-subquery" not in found._jdf.queryExecution().optimizedPlan().toString()
        rows = found.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    if name == "q_split_sizes":
        assert {(r["label"], r["split"], r["n"]) for r in rows} == {
            (0, "train", 1200), (0, "test", 300), (1, "train", 400), (1, "test", 100)
        }
    else:
        assert len(rows) == 2000 and all(r["one_side"] for r in rows)
        assert {(r["label"], r["n_train"], r["n_test"]) for r in rows} == {(0, 1200, 300), (1, 400, 100)}
