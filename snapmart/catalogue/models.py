"""Splits, preprocessing, fitting, scoring. Fits have no SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from snapmart.catalogue import roles as R
from snapmart.catalogue.registry import query, table
from snapmart.operators import modeling as M
from snapmart.operators import ranking as W
from snapmart.operators.asof import asof_aggregate
from snapmart.operators.joins import features_with_labels
from snapmart.operators.metrics import evaluate
from snapmart.operators.monitoring import monitor
from snapmart.plans import metric_store as MS
from snapmart.plans import training as P
from snapmart.schemas import LABEL_DELAY_MONTHS
from snapmart.sources import artefacts
from snapmart.sources.scratch import kept, materialise
from snapmart.sources.scratch import new_path as work_path
from snapmart.sources.tables import read_table, write_predictions

TRAIN_DATE = "1999-06-01"
#: Click history starts here: the k-th day of the events' month is the k-th month from it.
CLICKS_FROM = "1997-07-01"
CLICKS = ["n_events", *[f"{c}_mean" for c in R.CLICKS]]
#: Ratios taken over from another feature table; what they are made of stays.
BORROWED = ["balance_to_price", "price_per_unit", "log_price"]
FEATURES = ["price", "balance", "segment", "lines", "quantity", "mean_discount", *BORROWED, *CLICKS]
#: Months of production in which no clicks arrive.
OUTAGE = ("1999-07-01", "1999-12-01")

_APPS = """
    ev AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1),
    ln AS (SELECT l_orderkey, max(CAST(l_returnflag = 'R' AS INTEGER)) AS label FROM lineitem GROUP BY 1),
    apps AS (SELECT CAST(o_orderkey AS VARCHAR) AS loan_id, CAST(o_custkey AS VARCHAR) AS Customer_ID, label,
                    CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS snapshot_date
             FROM orders JOIN ln ON o_orderkey = l_orderkey)
"""
#: Rows per label that the split takes for training, and the rest.
_SPLITS = """
    mixed AS (SELECT label, count(*) AS n, CAST(round(count(*) * 0.8) AS BIGINT) AS k FROM apps
              WHERE snapshot_date BETWEEN DATE '1998-01-01' AND DATE '1998-10-01' GROUP BY 1),
    splits AS (SELECT 'train' AS split, CAST(sum(k) AS BIGINT) AS n_labels FROM mixed
               UNION ALL SELECT 'test', CAST(sum(n - k) AS BIGINT) FROM mixed
               UNION ALL SELECT 'oot', count(*) FROM apps
               WHERE snapshot_date BETWEEN DATE '1998-11-01' AND DATE '1998-12-01')
"""


def clicks(spark, d):
    """The events as clicks, spread over the months of training and production."""
    month = F.add_months(F.lit(CLICKS_FROM).cast("date"), F.dayofmonth("ts") - 1)
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("Customer_ID"),
        month.alias("snapshot_date"),
        *[F.when(F.col("event_type") == t, F.col("value")).alias(c) for c, t in zip(R.CLICKS, R.EVENT_TYPES)],
    )


def features(spark, d):
    """One application per order: customer and line features, and the clicks up to its day."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("lines"),
        F.sum("l_quantity").alias("quantity"),
        F.avg("l_discount").alias("mean_discount"),
    )
    customers = table(spark, d, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("balance"), F.length("c_mktsegment").cast("double").alias("segment")
    )
    orders = table(spark, d, "orders").withColumns(
        {"Customer_ID": F.col("o_custkey").cast("string"), "day": F.col("o_orderdate").cast("date")}
    )
    days = orders.select("Customer_ID", "day").distinct()
    history = asof_aggregate(days, clicks(spark, d), "Customer_ID", R.CLICKS, spine_date="day")
    return (
        orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(history, ["Customer_ID", "day"], "left")
        .select(
            F.col("o_orderkey").cast("string").alias("loan_id"),
            "Customer_ID",
            F.trunc("day", "month").alias("snapshot_date"),
            F.col("o_totalprice").alias("price"),
            "balance", "segment", "lines", "quantity", "mean_discount",
            F.col("clickstream_count").cast("double").alias("n_events"),
            *CLICKS[1:],
        )
        .withColumns({
            "balance_to_price": F.try_divide("balance", "price"),
            "price_per_unit": F.try_divide("price", "quantity"),
            "log_price": F.log1p("price"),
        })
    )


def labels(spark, d):
    """Label of each application, dated when it is observed."""
    found = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("label")
    )
    month = F.trunc(F.col("o_orderdate").cast("date"), "month")
    return table(spark, d, "orders").join(found, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").cast("string").alias("loan_id"),
        "label",
        F.add_months(month, LABEL_DELAY_MONTHS).alias("snapshot_date"),
    )


def applications(spark, d):
    """Features with the label, whenever it is observed; for what is evaluated afterwards."""
    return features_with_labels(features(spark, d), labels(spark, d))


def training_data(spark, d):
    """Applications whose label is known at the train date, tagged train, test or oot."""
    return P.training_frame(features(spark, d), labels(spark, d), TRAIN_DATE)


#: Trainings of this session by (application, table folder, what), as several queries report on one.
_FITTED: dict = {}


def _fitted(spark, d, what, fit):
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _FITTED:
        with kept():
            _FITTED[key] = fit()
    return _FITTED[key]


def _training(spark, d):
    version = "credit_model_1999_06_01"
    return _fitted(spark, d, version, lambda: P.train_on(training_data(spark, d), FEATURES, version))


@query(
    "q_time_windows",
    """
    WITH o AS (SELECT o_orderkey, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS snapshot_date FROM orders)
    SELECT *, CASE WHEN snapshot_date BETWEEN DATE '1998-01-01' AND DATE '1998-10-01' THEN 'train_test'
                   WHEN snapshot_date BETWEEN DATE '1998-11-01' AND DATE '1998-12-01' THEN 'oot'
                   WHEN snapshot_date >= DATE '1999-06-01' THEN 'production' END AS split
    FROM o
    """,
)
def time_windows(spark, d):
    months = table(spark, d, "orders").select(
        "o_orderkey", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("snapshot_date")
    )
    return M.tag_windows(months, TRAIN_DATE)


@query(
    "q_time_windows_no_delay",
    """
    WITH o AS (SELECT o_orderkey, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS snapshot_date FROM orders)
    SELECT *, CASE WHEN snapshot_date BETWEEN DATE '1998-04-01' AND DATE '1999-03-01' THEN 'train_test'
                   WHEN snapshot_date BETWEEN DATE '1999-04-01' AND DATE '1999-05-01' THEN 'oot'
                   WHEN snapshot_date >= DATE '1999-06-01' THEN 'production' END AS split
    FROM o
    """,
)
def time_windows_no_delay(spark, d):
    months = table(spark, d, "orders").select(
        "o_orderkey", F.trunc(F.col("o_orderdate").cast("date"), "month").alias("snapshot_date")
    )
    return M.tag_windows(months, TRAIN_DATE, delay=1, train_test_months=12)


@query(
    "q_cut_split",
    """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS snapshot_date,
           CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1999-06-01' THEN 'train' ELSE 'test' END AS split FROM orders
    """,
)
def cut_split(spark, d):
    days = table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("snapshot_date")
    )
    return M.cut_split(days, TRAIN_DATE)


def _sides(spark, d):
    """All applications with their side; the labels are stored, as the split reads them several times."""
    return M.stratified_split(materialise(labels(spark, d).select("loan_id", "label"), "labels"))


@query(
    "q_split",
    f"""
    WITH {_APPS}, n AS (SELECT label, count(*) AS n, CAST(round(count(*) * 0.8) AS BIGINT) AS k FROM apps GROUP BY 1)
    SELECT loan_id, label, k AS n_train, n - k AS n_test, TRUE AS one_side FROM apps JOIN n USING (label)
    """,
)
def split(spark, d):
    """Every row on exactly one side, with the exact sizes of both sides of its label.

    Which rows are taken is a Spark hash, so the side itself has no SQL form.
    """
    rows = _sides(spark, d)
    sizes = rows.groupBy("label").agg(
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "test").alias("n_test"),
    )
    sided = rows.groupBy("loan_id", "label").agg(
        ((F.count_distinct("split") == 1) & F.bool_and(F.col("split").isin("train", "test"))).alias("one_side")
    )
    return sided.join(sizes, "label").select("loan_id", "label", "n_train", "n_test", "one_side")


@query(
    "q_split_sizes",
    """
    WITH a AS (SELECT o_orderkey, max(CAST(l_returnflag = 'R' AS INTEGER)) AS label
               FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
    n AS (SELECT label, count(*) AS n, CAST(round(count(*) * 0.8) AS BIGINT) AS k FROM a GROUP BY 1)
    SELECT label, 'train' AS split, k AS n FROM n UNION ALL SELECT label, 'test', n - k FROM n
    """,
)
def split_sizes(spark, d):
    return _sides(spark, d).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "q_impute_scale",
    """
    WITH a AS (SELECT o_orderkey, o_totalprice AS price, n FROM orders
               LEFT JOIN (SELECT user_id, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1) ON o_custkey = user_id),
    filled AS (SELECT o_orderkey, price, coalesce(n, (SELECT quantile_cont(n, 0.5) FROM a)) AS n FROM a)
    SELECT CAST(o_orderkey AS VARCHAR) AS loan_id,
           round((price - (SELECT avg(price) FROM filled)) / (SELECT stddev_pop(price) FROM filled), 8) AS price,
           round((n - (SELECT avg(n) FROM filled)) / (SELECT stddev_pop(n) FROM filled), 8) AS n_events
    FROM filled
    """,
)
def impute_scale(spark, d):
    events = table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).cast("double").alias("n_events")
    )
    frame = (
        table(spark, d, "orders")
        .join(events, F.col("o_custkey") == F.col("user_id"), "left")
        .select(F.col("o_orderkey").cast("string").alias("loan_id"), F.col("o_totalprice").alias("price"), "n_events")
    )
    fitted = M.fit_preprocessing(frame, ["price", "n_events"])
    return fitted.apply(frame).withColumns({c: F.round(c, 8) for c in ("price", "n_events")})


@query(
    "q_lr_scores",
    f"""
    WITH {_APPS}
    SELECT CAST(o_orderkey AS VARCHAR) AS loan_id, label, TRUE AS is_probability
    FROM orders JOIN ln ON o_orderkey = l_orderkey
    WHERE CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) > DATE '1999-06-01'
    """,
)
def lr_scores_stated(spark, d):
    """Which applications are scored, and that each has a probability; the values are tested."""
    return lr_scores(spark, d).select(
        "loan_id", "label", F.col("model_predictions").between(0, 1).alias("is_probability")
    )


def lr_scores(spark, d):
    """Logistic regression on applications up to the cut, scored after it."""
    data = materialise(M.cut_split(applications(spark, d), TRAIN_DATE), "applications")
    train = data.where(F.col("split") == "train")
    prepared = M.fit_preprocessing(train, FEATURES)
    pipeline = P.PipelineModel(stages=prepared.stages())
    vectors = pipeline.transform(train).select("loan_id", "label", "features")
    model = M.fit_logistic(vectors, vectors.count())
    scored = model.transform(pipeline.transform(data.where(F.col("split") == "test")))
    return scored.select("loan_id", "label", M.score_of(model).alias("model_predictions"))


@query(
    "q_gbt_search",
    f"""
    WITH {_APPS}, {_SPLITS}
    SELECT draw, n_labels AS n_held, 3 AS n_folds, TRUE AS is_area
    FROM splits, (SELECT unnest(range(50)) AS draw) WHERE split = 'train'
    """,
)
def gbt_search_stated(spark, d):
    """Every draw of the search: each train row was held out once; areas and the choice are tested."""
    return gbt_search(spark, d).select(
        F.col("draw").cast("long").alias("draw"), "n_held", F.col("n_folds").cast("int").alias("n_folds"),
        F.col("cv_auc").between(0, 1).alias("is_area"),
    )


def gbt_search(spark, d):
    """Random search over boosted trees: mean area of each draw, and the chosen one."""
    data = materialise(training_data(spark, d).where(F.col("split") == "train"), "search")
    prep = M.fit_preprocessing(data, FEATURES)
    return M.random_search(data, prep, {"all": FEATURES}, data.count())["all"].trials


@query(
    "q_candidates",
    f"""
    WITH {_APPS}, {_SPLITS}
    SELECT model, split, n_labels, TRUE AS is_area
    FROM splits, (SELECT unnest(['logistic_regression', 'boosted_trees']) AS model)
    """,
)
def candidates(spark, d):
    """Both candidates on train, test and oot: rows, and that the area is one; areas are tested."""
    return _training(spark, d).results.select(
        "model", "split", F.col("n_labels").cast("bigint").alias("n_labels"),
        ((F.col("auc") > 0) & (F.col("auc") < 1)).alias("is_area"),
    )


@query(
    "q_platt",
    "SELECT doc_id, toxic AS label, TRUE AS is_probability, TRUE AS order_kept "
    "FROM documents JOIN labels USING (doc_id)",
)
def platt_stated(spark, d):
    """Calibration gives probabilities and keeps (or wholly turns) the order of the scores."""
    scored = platt(spark, d).join(R.document_scores(spark, d).select("doc_id", "model_predictions"), "doc_id")
    # A sigmoid is strictly monotone: equal scores share a value, and ranks agree.
    bounds = scored.groupBy("model_predictions").agg(F.min("pd").alias("low"), F.max("pd").alias("high"))
    spread = bounds.agg(
        (F.max(F.col("high") - F.col("low")) == 0).alias("equal"),
        (F.abs(F.corr("model_predictions", F.log(F.col("low") / (1 - F.col("low"))))) > 0.999999).alias("straight"),
    )
    kept = spread.select((F.col("equal") & F.col("straight")).alias("ok")).scalar()
    return scored.select(
        "doc_id", "label", F.col("pd").between(0, 1).alias("is_probability"), kept.alias("order_kept")
    )


def platt(spark, d):
    """Calibrated scores of the documents' length score."""
    docs = R.document_scores(spark, d)
    fitted = M.fit_platt(docs, "model_predictions")
    return docs.select("doc_id", "label", fitted.apply(F.col("model_predictions")).alias("pd"))


@query(
    "q_calibration_of_champion",
    f"""
    WITH {_APPS}
    SELECT round(avg(label), 10) AS bad_rate, TRUE AS are_rates, TRUE AS are_errors FROM apps
    WHERE snapshot_date BETWEEN DATE '1998-11-01' AND DATE '1998-12-01'
    """,
)
def calibration_stated(spark, d):
    """The oot bad rate, and that the means and errors beside it are such; values are tested."""
    rates, errors = ["mean_pred_raw", "mean_pred_calibrated", "auc_calibrated"], ["brier_raw", "brier_calibrated"]
    inside = lambda names: F.forall(F.array(*names), lambda x: x.between(0, 1))
    return calibration_of_champion(spark, d).select(
        F.round("bad_rate", 10).alias("bad_rate"), inside(rates).alias("are_rates"), inside(errors).alias("are_errors")
    )


def calibration_of_champion(spark, d):
    return _training(spark, d).calibration


@query(
    "q_importance",
    """
    SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS place, TRUE AS is_feature, TRUE AS falls, TRUE AS is_share, TRUE AS whole
    """,
)
def importance_stated(spark, d):
    """Five places of known features, importance falling, groups' shares adding up to 1."""
    shares = _importance_groups(_training(spark, d))
    place = Window.orderBy(F.col("importance").desc(), "feature")  # five rows
    earlier = F.lag("importance").over(place)
    return importance(spark, d).select(
        F.row_number().over(place).alias("place"), F.col("feature").isin(FEATURES).alias("is_feature"),
        F.coalesce(earlier >= F.col("importance"), F.lit(True)).alias("falls"),
        F.col("group_share").between(0, 1 + 1e-9).alias("is_share"),
        shares.select(F.abs(F.sum("share") - 1) < 1e-9).scalar().alias("whole"),
    )


def _importance_groups(trained):
    groups = {"customer": ["balance", "segment"], "clicks": CLICKS, "order": ["price", "lines", "quantity", "mean_*", *BORROWED]}
    return M.importance_by_group(trained.importance, groups)


def importance(spark, d):
    """Top five features of the champion, with the share of their group."""
    trained = _training(spark, d)
    shares = _importance_groups(trained).select(F.col("group"), F.col("share").alias("group_share"))
    top = W.top_k(trained.importance, [F.col("importance").desc(), F.col("feature")], 5)
    group = F.when(F.col("feature").isin("balance", "segment"), "customer")
    group = group.when(F.col("feature").isin(CLICKS), "clicks").otherwise("order")
    return top.withColumn("group", group).join(shares, "group", "left")


_SETS = {
    "clicks + borrowed": FEATURES,
    "clicks, no borrowed": [c for c in FEATURES if c not in BORROWED],
    "no clicks + borrowed": [c for c in FEATURES if c not in CLICKS],
    "no clicks, no borrowed": [c for c in FEATURES if c not in BORROWED + CLICKS],
}


def _sets(spark, d):
    return _fitted(spark, d, "sets", lambda: P.compare_feature_sets(training_data(spark, d), _SETS))


def outage(spark, d):
    """Applications of the outage with their labels; their click features are missing."""
    rows = applications(spark, d).where(F.col("snapshot_date").between(*OUTAGE))
    return rows.withColumns({c: F.lit(None).cast("double") for c in CLICKS})


_SET_ROWS = ", ".join(f"('{name}', {len(columns)})" for name, columns in _SETS.items())


@query(
    "q_feature_sets",
    f"""
    WITH {_APPS}, {_SPLITS}
    SELECT feature_set, CAST(n_features AS INTEGER) AS n_features, n_labels, TRUE AS is_best, TRUE AS is_area
    FROM splits, (VALUES {_SET_ROWS}) AS v(feature_set, n_features) WHERE split = 'oot'
    """,
)
def feature_sets_stated(spark, d):
    """Which sets are compared on how many oot rows; the areas are tested."""
    return feature_sets(spark, d).select(
        "feature_set", F.col("n_features").cast("int").alias("n_features"),
        F.col("n_labels").cast("bigint").alias("n_labels"), F.col("auc").eqNullSafe(F.col("best")).alias("is_best"),
        ((F.col("auc") > 0) & (F.col("auc") < 1)).alias("is_area"),
    )


def feature_sets(spark, d):
    """Same training for four column sets: the champion of each, its oot area, and the best area of both candidates."""
    out = None
    for name, t in _sets(spark, d).items():
        oot = t.results.where(F.col("split") == "oot")
        best = W.best_per_group(oot, ["split"], "auc", ["model"]).select(
            F.lit(name).alias("feature_set"), F.lit(len(t.model.columns)).alias("n_features"),
            "model", "n_labels", "auc", oot.agg(F.max("auc")).scalar().alias("best"),
        )
        out = best if out is None else out.unionByName(best)
    return out


@query(
    "q_resilience",
    f"""
    SELECT feature_set, CAST(n_features AS INTEGER) AS n_features,
           n_labels, bad_rate, TRUE AS is_area, TRUE AS gap_is_mean, TRUE AS is_recall
    FROM (VALUES {_SET_ROWS}) AS v(feature_set, n_features), (
        SELECT count(*) AS n_labels, round(avg(label), 9) AS bad_rate FROM (
            WITH {_APPS} SELECT label FROM apps WHERE snapshot_date BETWEEN DATE '{OUTAGE[0]}' AND DATE '{OUTAGE[1]}'
        )
    )
    """,
)
def resilience_stated(spark, d):
    """Rows and bad rate of the outage period, and that each measure is one; values are tested."""
    return resilience(spark, d).select(
        "feature_set", F.col("n_features").cast("int").alias("n_features"),
        F.col("n_labels").cast("bigint").alias("n_labels"), F.round("bad_rate", 9).alias("bad_rate"),
        ((F.col("auc_period") > 0) & (F.col("auc_period") < 1)).alias("is_area"),
        (F.abs(F.col("mean_prediction") - F.col("bad_rate") - F.col("pd_gap_period")) < 1e-9).alias("gap_is_mean"),
        F.col("recall_period").between(0, 1).alias("is_recall"),
    )


def resilience(spark, d):
    """With and without clicks, with and without borrowed features, over an outage of the clicks."""
    return P.resilience(_sets(spark, d), outage(spark, d))


@query(
    "q_batch_score",
    f"""
    WITH {_APPS}
    SELECT loan_id, Customer_ID, snapshot_date, 'credit_model_1999_06_01' AS model_name, TRUE AS is_probability
    FROM apps WHERE snapshot_date >= DATE '1999-06-01'
    """,
)
def batch_score_stated(spark, d):
    """Which applications the stored scores hold, and that each is a probability; values are tested."""
    return batch_score(spark, d).select(
        "loan_id", "Customer_ID", "snapshot_date", "model_name",
        F.col("model_predictions").between(0, 1).alias("is_probability"),
    )


def batch_score(spark, d):
    """Scoring backfill: all production months in one job, written by month."""
    trained = _training(spark, d)
    apps = M.tag_windows(features(spark, d), TRAIN_DATE)
    path = work_path(spark, "predictions")
    write_predictions(M.score(apps.where(F.col("split") == "production"), trained.model), path)
    return read_table(spark, path)


@query(
    "q_artefact_roundtrip",
    f"""
    WITH {_APPS}
    SELECT count(*) AS n_labels, TRUE AS same_auc, TRUE AS same_brier,
           6 AS n_baselines, TRUE AS same_baselines, TRUE AS same_facts, TRUE AS dated FROM apps
    WHERE snapshot_date BETWEEN DATE '1998-11-01' AND DATE '1998-12-01'
    """,
)
def artefact_roundtrip_stated(spark, d):
    """The loaded model scores the oot rows as the one that was saved; baselines and facts come back."""
    rows = artefact_roundtrip(spark, d)
    return rows.agg(
        F.max("n_labels").cast("bigint").alias("n_labels"),
        (F.min("auc") == F.max("auc")).alias("same_auc"),
        (F.min("brier") == F.max("brier")).alias("same_brier"),
        F.max("n_baselines").alias("n_baselines"),
        F.bool_and("same_baselines").alias("same_baselines"),
        F.bool_and("same_facts").alias("same_facts"),
        F.bool_and(F.col("train_date") == TRAIN_DATE).alias("dated"),
    )


def _save(spark, trained, root):
    """Model, baselines and facts under the model's version."""
    version = trained.model.version
    artefacts.save_model(spark, trained.model, root)
    baselines = {"model_predictions": trained.score_baseline, **trained.feature_baselines}
    artefacts.save_baselines(spark, version, baselines, root)
    facts = {"train_date": TRAIN_DATE, "model_type": trained.model.model_type, **trained.params}
    artefacts.save_metadata(spark, version, facts, root)
    return baselines, facts


def artefact_roundtrip(spark, d):
    """Oot area before saving the artefacts and after loading them; what else was stored."""
    trained = _training(spark, d)
    root, version = work_path(spark, "models"), trained.model.version
    baselines, facts = _save(spark, trained, root)
    loaded = artefacts.load_model(spark, root, version)
    oot = trained.data.where(F.col("split") == "oot")
    out = None
    for name, model in (("before", trained.model), ("after", loaded)):
        part = evaluate(model.calibrated(oot)).select(F.lit(name).alias("stage"), "n_labels", "auc", "brier")
        out = part if out is None else out.unionByName(part)
    again = artefacts.load_baselines(spark, root, version)
    found = {r["name"]: r["value"] for r in artefacts.load_metadata(spark, root, version).collect()}
    return out.withColumns({
        "n_baselines": F.lit(len(again)), "n_facts": F.lit(len(found)), "train_date": F.lit(found["train_date"]),
        "same_baselines": F.lit(again == baselines), "same_facts": F.lit(found == {k: str(v) for k, v in facts.items()}),
    })


_PATH_SQL = f"""
    WITH {_APPS},
    scored AS (SELECT *, CAST(snapshot_date + INTERVAL 6 MONTH AS DATE) AS due FROM apps WHERE snapshot_date >= DATE '1999-06-01'),
    m AS (SELECT snapshot_date, due, count(*) AS n, avg(label) AS rate FROM scored GROUP BY 1, 2)
    SELECT 'credit_model_1999_06_01' AS model_name, monitoring_date, prediction_month, metric_type, metric, n_rows,
           round(stated, 9) AS stated, TRUE AS has_values
    FROM (
      SELECT snapshot_date AS monitoring_date, snapshot_date AS prediction_month, 'stability' AS metric_type,
             unnest(['n_predictions', 'mean_pd', 'psi_score', 'csi']) AS metric, unnest([1, 1, 1, 5]) AS n_rows,
             unnest([CAST(n AS DOUBLE), NULL, NULL, NULL]) AS stated FROM m
      UNION ALL
      SELECT due, snapshot_date, 'performance',
             unnest(['n_labels', 'bad_rate_actual', 'bad_rate_predicted', 'bad_rate_gap', 'auc', 'gini', 'brier', 'precision', 'recall', 'f1']),
             1, unnest([CAST(n AS DOUBLE), rate, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL]) FROM m
    )
"""


@query("q_monitored_model", _PATH_SQL)
def monitored_model_stated(spark, d):
    """Which metrics the stored monitoring table of the trained model holds; those that SQL can know with their values."""
    name = F.col("metric_name")
    metric = F.when(name.startswith("csi_"), "csi").otherwise(name)
    known = F.when(name.isin("n_predictions", "n_labels", "bad_rate_actual"), F.col("metric_value"))
    # The area needs both classes in a month.
    has_value = F.col("metric_value").isNotNull() | name.isin("auc", "gini")
    return (
        monitored_model(spark, d)
        .groupBy("model_name", "monitoring_date", "prediction_month", "metric_type", metric.alias("metric"))
        .agg(
            F.count(F.lit(1)).cast("int").alias("n_rows"), F.round(F.max(known), 9).alias("stated"),
            F.bool_and(has_value).alias("has_values"),
        )
    )


def monitored_model(spark, d):
    """The whole path: train, store the artefacts, load them, score and store all production months, monitor, store, read.

    Scoring and monitoring know the training by its artefacts only.
    """
    root, version = work_path(spark, "bank"), _training(spark, d).model.version
    _save(spark, _training(spark, d), root)
    model = artefacts.load_model(spark, root, version)
    baselines = artefacts.load_baselines(spark, root, version)
    score = baselines.pop("model_predictions")
    scores, metrics = work_path(spark, "scores"), work_path(spark, "metrics")
    apps = M.tag_windows(features(spark, d), TRAIN_DATE).where(F.col("split") == "production")
    columns = ["loan_id", "Customer_ID", "snapshot_date", "model_predictions", *baselines]
    scored = model.calibrated(apps).select(*columns, F.lit(version).alias("model_name"))
    write_predictions(scored, scores)
    stored = read_table(spark, scores)
    arrived = labels(spark, d)
    MS.refresh(spark, metrics, lambda months: monitor(stored, arrived, None, score, baselines, months=months))
    return MS.read_metrics(spark, metrics, model=version)
