"""Performance, drift and monitoring metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapmart import schemas as S
from snapmart.catalogue import roles as R
from snapmart.catalogue.registry import query, table
from snapmart.operators import filters as P
from snapmart.operators import metrics as K
from snapmart.operators import modeling as M
from snapmart.operators import monitoring as G
from snapmart.plans import metric_store as MS
from snapmart.sources import artefacts
from snapmart.sources.scratch import kept, new_path


def _round(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ------------------------------------------------------------- performance SQL


def auc_sql(source: str, by: str, label: str = "label", score: str = "model_predictions") -> str:
    """Rank statistic with ties counted half: (by, n_pos, n_neg, auc)."""
    cols = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    SELECT {cols} CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg,
           sum(pos * (below + neg / 2.0)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS auc
    FROM (SELECT *, sum(neg) OVER ({part} ORDER BY p) - neg AS below FROM (
      SELECT {cols} {score} AS p, sum({label}) AS pos, sum(1 - {label}) AS neg
      FROM {source} GROUP BY {cols} p))
    {group}"""


_SE = """sqrt((auc * (1 - auc) + (n_pos - 1) * (auc / (2 - auc) - auc * auc)
        + (n_neg - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (CAST(n_pos AS DOUBLE) * n_neg))"""


@query(
    "q_auc",
    f"""
    WITH {R.SCORES}, a AS ({auc_sql('scores', 'snapshot_date')})
    SELECT snapshot_date, n_pos + n_neg AS n_labels, n_pos AS n_bad, round(auc, 10) AS auc FROM a
    """,
)
def auc(spark, d):
    found = K.roc_auc(R.scores(spark, d), by=["snapshot_date"])
    return _round(found.select("snapshot_date", "n_labels", "n_bad", "auc"), 10, "auc")


@query(
    "q_auc_documents",
    f"""
    WITH {R.DOCUMENT_SCORES}, a AS ({auc_sql('document_scores', '')})
    SELECT n_pos + n_neg AS n_labels, n_pos AS n_bad, round(auc, 10) AS auc, round(2 * auc - 1, 10) AS gini FROM a
    """,
)
def auc_documents(spark, d):
    found = K.roc_auc(R.document_scores(spark, d))
    return _round(found.drop("auc_se"), 10, "auc", "gini")


@query(
    "q_gini_brier",
    f"""
    WITH {R.SCORES}, a AS ({auc_sql('scores', 'snapshot_date')})
    SELECT snapshot_date, round(2 * auc - 1, 10) AS gini, round(brier, 10) AS brier
    FROM a JOIN (SELECT snapshot_date, avg(pow(model_predictions - label, 2)) AS brier FROM scores GROUP BY 1) USING (snapshot_date)
    """,
)
def gini_brier(spark, d):
    found = K.evaluate(R.scores(spark, d), by=["snapshot_date"])
    return _round(found.select("snapshot_date", "gini", "brier"), 10, "gini", "brier")


@query(
    "q_confusion",
    f"""
    WITH {R.SCORES}
    SELECT snapshot_date, label AS actual, CAST(model_predictions >= 0.3 AS INTEGER) AS predicted, count(*) AS n
    FROM scores GROUP BY ALL
    """,
)
def confusion(spark, d):
    return K.confusion(R.scores(spark, d), by=["snapshot_date"], cutoff=0.3)


_COUNTS = """
    counts AS (SELECT {by} count(*) FILTER (WHERE label = 1 AND model_predictions >= {c}) AS tp,
                      count(*) FILTER (WHERE label = 0 AND model_predictions >= {c}) AS fp,
                      count(*) FILTER (WHERE label = 1 AND model_predictions < {c}) AS fn,
                      count(*) FILTER (WHERE label = 0 AND model_predictions < {c}) AS tn
               FROM {source} {group})
"""
_PRF = """coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision,
          coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall,
          coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0) AS f1"""


@query(
    "q_prf",
    f"""
    WITH {R.SCORES}, {_COUNTS.format(by='snapshot_date,', c=0.3, source='scores', group='GROUP BY snapshot_date')}
    SELECT snapshot_date, {_PRF} FROM counts
    """,
)
def prf(spark, d):
    return K.precision_recall_f1(R.scores(spark, d), by=["snapshot_date"], cutoff=0.3)


@query(
    "q_prf_no_positives",
    f"""
    WITH {R.SCORES}, {_COUNTS.format(by='', c=9.0, source='scores', group='')} SELECT {_PRF} FROM counts
    """,
)
def prf_no_positives(spark, d):
    return K.precision_recall_f1(R.scores(spark, d), cutoff=9.0)


@query(
    "q_report",
    f"""
    WITH {R.SCORES}, {_COUNTS.format(by='', c=0.3, source='scores', group='')},
    per AS (
      SELECT '0' AS class, tn / CAST(tn + fn AS DOUBLE) AS precision, tn / CAST(tn + fp AS DOUBLE) AS recall,
             2 * tn / CAST(2 * tn + fn + fp AS DOUBLE) AS f1, tn + fp AS support FROM counts
      UNION ALL
      SELECT '1', tp / CAST(tp + fp AS DOUBLE), tp / CAST(tp + fn AS DOUBLE),
             2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), tp + fn FROM counts),
    all_rows AS (
      SELECT * FROM per
      UNION ALL SELECT 'accuracy', (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE),
             (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE), tp + tn + fp + fn FROM counts
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
             sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per)
    SELECT class, round(precision, 10) AS precision, round(recall, 10) AS recall, round(f1, 10) AS f1, support FROM all_rows
    """,
)
def report(spark, d):
    found = K.classification_report(R.scores(spark, d), cutoff=0.3)
    return _round(found, 10, "precision", "recall", "f1")


@query(
    "q_bad_rate_gap",
    f"""
    WITH {R.SCORES}
    SELECT snapshot_date, count(*) AS n_labels, round(avg(label), 10) AS bad_rate_actual,
           round(avg(model_predictions), 10) AS bad_rate_predicted,
           round(avg(model_predictions) - avg(label), 10) AS bad_rate_gap,
           round(avg(pow(model_predictions - label, 2)), 10) AS brier
    FROM scores GROUP BY snapshot_date
    """,
)
def bad_rate_gap(spark, d):
    found = K.calibration_gap(R.scores(spark, d), by=["snapshot_date"])
    return _round(found, 10, "bad_rate_actual", "bad_rate_predicted", "bad_rate_gap", "brier")


@query(
    "q_auc_se",
    f"""
    WITH {R.SCORES}, a AS ({auc_sql('scores', 'snapshot_date')})
    SELECT snapshot_date, round({_SE}, 10) AS auc_se FROM a
    """,
)
def auc_se(spark, d):
    return _round(
        K.roc_auc(R.scores(spark, d), by=["snapshot_date"]).select("snapshot_date", "auc_se"), 10, "auc_se"
    )


# ------------------------------------------------------------------- drift SQL

_STEPS = ", ".join(f"{p!r}::DOUBLE" for p in K.decile_probs(S.PSI_BINS))


def psi_sql(baseline: str, current: str, column: str, by: str) -> str:
    """Decile index of one column of two relations, missing values a bin."""
    edge_bin = (
        f"CASE WHEN {column} IS NULL THEN -1 ELSE len(list_filter(inner_edges, lambda e: e <= {column})) END"
    )
    return f"""
    SELECT {by}, '{column}' AS "column", CAST(max(n) AS BIGINT) AS n,
           round(sum((greatest(a, 1e-4) - greatest(e, 1e-4)) * ln(greatest(a, 1e-4) / greatest(e, 1e-4))), 9) AS psi
    FROM (
      WITH edges AS (
        SELECT list_sort(list_distinct(quantile_cont({column}, [{_STEPS}]))) AS every FROM {baseline}),
      cut AS (SELECT every[2:-2] AS inner_edges, len(every) - 1 AS n_bins FROM edges),
      expected AS (SELECT {edge_bin} AS bin, count(*) / CAST((SELECT count(*) FROM {baseline}) AS DOUBLE) AS e
                   FROM {baseline}, cut GROUP BY 1),
      actual AS (SELECT {by}, {edge_bin} AS bin, count(*) AS k FROM {current}, cut GROUP BY 1, 2),
      totals AS (SELECT {by}, sum(k) AS n FROM actual GROUP BY 1),
      bins AS (SELECT unnest(range(-1, n_bins)) AS bin FROM cut)
      SELECT t.{by}, t.n, coalesce(a.k, 0) / CAST(t.n AS DOUBLE) AS a, coalesce(x.e, 0) AS e
      FROM totals t, bins b
      LEFT JOIN actual a ON a.{by} = t.{by} AND a.bin = b.bin
      LEFT JOIN expected x ON x.bin = b.bin)
    GROUP BY {by}"""


_DRIFT = """
    prices AS (SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS month,
                      CASE WHEN o_orderkey % 17 = 0 AND o_orderdate > DATE '1998-06-01' THEN NULL ELSE o_totalprice END AS price,
                      CAST(o_custkey % 7 AS DOUBLE) AS few
               FROM orders),
    old AS (SELECT * FROM prices WHERE month < DATE '1997-01-01'),
    new AS (SELECT * FROM prices WHERE month >= DATE '1997-01-01')
"""


def _drift(spark, d):
    day = F.col("o_orderdate").cast("date")
    late = (F.col("o_orderkey") % 17 == 0) & (day > F.lit("1998-06-01").cast("date"))
    cut = F.lit("1997-01-01").cast("date")

    def prices(orders):
        return orders.select(
            F.trunc(day, "month").alias("month"),
            F.when(~late, F.col("o_totalprice")).alias("price"),
            (F.col("o_custkey") % 7).cast("double").alias("few"),
        )

    # The cut is on the stored date, so it reaches the parquet scan.
    orders = table(spark, d, "orders")
    return prices(orders.where(day < cut)), prices(orders.where(day >= cut))


@query("q_psi", f"WITH {_DRIFT} {psi_sql('old', 'new', 'price', 'month')}")
def psi(spark, d):
    old, new = _drift(spark, d)
    return _round(K.psi(old, new, ["price"], by=["month"]), 9, "psi")


@query(
    "q_csi",
    f"WITH {_DRIFT} {psi_sql('old', 'new', 'price', 'month')} UNION ALL {psi_sql('old', 'new', 'few', 'month')}",
)
def csi(spark, d):
    old, new = _drift(spark, d)
    return _round(K.psi(old, new, ["price", "few"], by=["month"]), 9, "psi")


def _light(v: str, t: S.Threshold) -> str:
    if t.higher_is_better:
        ladder = f"WHEN {v} >= {t.high} THEN 'green' WHEN {v} >= {t.low} THEN 'amber'"
    else:
        ladder = f"WHEN {v} < {t.low} THEN 'green' WHEN {v} <= {t.high} THEN 'amber'"
    return f"CASE WHEN {v} IS NULL THEN 'n/a' {ladder} ELSE 'red' END"


def status_sql(name: str = "metric_name", value: str = "metric_value") -> str:
    cases = " ".join(
        (f"WHEN starts_with({name}, 'csi_')" if m == "csi" else f"WHEN {name} = '{m}'")
        + f" THEN {_light(f'abs({value})', t)}"
        for m, t in S.THRESHOLDS.items()
    )
    return f"CASE {cases} ELSE 'n/a' END"


_STATUS = f"""
    SELECT *, {status_sql()} AS status FROM (
      SELECT month, 'psi_score' AS metric_name, avg(o_totalprice) / 1e6 AS metric_value FROM m GROUP BY month
      UNION ALL SELECT month, 'csi_x', NULL FROM m GROUP BY month
      UNION ALL SELECT month, 'auc', 0.62 + count(*) / 1000.0 FROM m GROUP BY month
      UNION ALL SELECT month, 'gini', 0.3 + count(*) / 1000.0 FROM m GROUP BY month
      UNION ALL SELECT month, 'bad_rate_gap', -count(*) / 5000.0 FROM m GROUP BY month
      UNION ALL SELECT month, 'n_predictions', CAST(count(*) AS DOUBLE) FROM m GROUP BY month)
"""
_MONTHS = "m AS (SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS month, o_totalprice FROM orders)"


def _status_rows(spark, d):
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")
    wide = table(spark, d, "orders").groupBy(month).agg(
        (F.avg("o_totalprice") / 1e6).alias("psi_score"),
        F.lit(None).cast("double").alias("csi_x"),
        (0.62 + F.count(F.lit(1)) / 1000.0).alias("auc"),
        (0.3 + F.count(F.lit(1)) / 1000.0).alias("gini"),
        (-F.count(F.lit(1)) / 5000.0).alias("bad_rate_gap"),
        F.count(F.lit(1)).alias("n_predictions"),
    )
    names = ["psi_score", "csi_x", "auc", "gini", "bad_rate_gap", "n_predictions"]
    return G.with_status(G.to_long(wide, ["month"], names))


@query("q_status", f"WITH {_MONTHS}, s AS ({_STATUS}) SELECT * REPLACE (round(metric_value, 9) AS metric_value) FROM s")
def status(spark, d):
    return _round(_status_rows(spark, d), 9, "metric_value")


@query(
    "q_alert_filter",
    f"""
    WITH {_MONTHS}, s AS ({_STATUS})
    SELECT * REPLACE (round(metric_value, 9) AS metric_value) FROM s WHERE status IN ('amber', 'red')
    """,
)
def alert_filter(spark, d):
    return _round(P.alerts(_status_rows(spark, d)), 9, "metric_value")


# ------------------------------------------------------------------- monitoring
# Predictions: one per order, score from its price, by month of order. Labels
# arrive six months later: the order's lines shipped in that month.

_MONITOR = f"""
    predictions AS (
      SELECT CAST(o_orderkey AS VARCHAR) AS loan_id, CAST(o_custkey AS VARCHAR) AS Customer_ID,
             CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS snapshot_date,
             'price_model' AS model_name, o_totalprice / 700001 AS model_predictions,
             CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS DOUBLE) END AS customer_code
      FROM orders),
    labels_arrived AS (
      SELECT l_orderkey, CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS label_date,
             max(CAST(l_returnflag = 'R' AS INTEGER)) AS label FROM lineitem GROUP BY 1, 2),
    old AS (SELECT * FROM predictions WHERE snapshot_date < DATE '1996-01-01'),
    known AS (
      SELECT p.*, label FROM predictions p JOIN labels_arrived l
        ON CAST(l_orderkey AS VARCHAR) = loan_id AND label_date = CAST(snapshot_date + INTERVAL 6 MONTH AS DATE)),
    drift AS ({psi_sql('old', 'predictions', 'model_predictions', 'snapshot_date')}),
    drift_code AS ({psi_sql('old', 'predictions', 'customer_code', 'snapshot_date')}),
    a AS ({auc_sql('known', 'snapshot_date')}),
    g AS (SELECT snapshot_date, count(*) AS n, avg(label) AS y, avg(model_predictions) AS p,
                 avg(pow(model_predictions - label, 2)) AS brier,
                 count(*) FILTER (WHERE label = 1 AND model_predictions >= 0.5) AS tp,
                 count(*) FILTER (WHERE label = 0 AND model_predictions >= 0.5) AS fp,
                 count(*) FILTER (WHERE label = 1 AND model_predictions < 0.5) AS fn
          FROM known GROUP BY 1),
    perf AS (SELECT g.*, auc FROM g JOIN a USING (snapshot_date)),
    rows_ AS (
      SELECT snapshot_date AS monitoring_date, snapshot_date AS prediction_month, 'stability' AS metric_type,
             'n_predictions' AS metric_name, CAST(count(*) AS DOUBLE) AS metric_value FROM predictions GROUP BY 1
      UNION ALL SELECT snapshot_date, snapshot_date, 'stability', 'mean_pd', avg(model_predictions) FROM predictions GROUP BY 1
      UNION ALL SELECT snapshot_date, snapshot_date, 'stability', 'psi_score', psi FROM drift
      UNION ALL SELECT snapshot_date, snapshot_date, 'stability', 'csi_customer_code', psi FROM drift_code
      {" ".join(
        f"UNION ALL SELECT CAST(snapshot_date + INTERVAL 6 MONTH AS DATE), snapshot_date, 'performance', '{n}', {e} FROM perf"
        for n, e in {
            'n_labels': 'CAST(n AS DOUBLE)', 'bad_rate_actual': 'y', 'bad_rate_predicted': 'p', 'bad_rate_gap': 'p - y',
            'auc': 'auc', 'gini': '2 * auc - 1', 'brier': 'brier',
            'precision': 'coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0)',
            'recall': 'coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0)',
            'f1': 'coalesce(CAST(2 * tp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 0)'}.items())}
    ),
    monitoring AS (SELECT 'price_model' AS model_name, *, {status_sql()} AS status FROM rows_)
"""


def _scored(spark, d):
    """Predictions with their feature column, by month of order."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("loan_id"),
        F.col("o_custkey").cast("string").alias("Customer_ID"),
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("snapshot_date"),
        F.lit("price_model").alias("model_name"),
        (F.col("o_totalprice") / 700001).alias("model_predictions"),
        F.when(F.col("o_orderkey") % 19 != 0, (F.col("o_custkey") % 50).cast("double")).alias("customer_code"),
    )


#: What this session has stored, by (application, table folder, what): artefacts and tables that several queries read.
_STORED: dict = {}


def _stored(spark, d, what, write):
    key = (spark.sparkContext.applicationId, d, what)
    if key not in _STORED:
        with kept():
            path = new_path(spark, what)
            write(path)
        _STORED[key] = path
    return _STORED[key]


def _baselines(spark, d):
    """Drift baselines of the months before monitoring, fitted once and loaded as artefacts."""

    def fit(root):
        base = _scored(spark, d).where(F.col("snapshot_date") < F.lit("1996-01-01").cast("date"))
        found = K.fit_baselines(base, ["model_predictions", "customer_code"])
        artefacts.save_baselines(spark, "price_model", found, root)

    found = artefacts.load_baselines(spark, _stored(spark, d, "price-model", fit), "price_model")
    return found["model_predictions"], {"customer_code": found["customer_code"]}


def _monitoring(spark, d, months=None, predictions=None):
    labels = (
        table(spark, d, "lineitem")
        .groupBy(
            F.col("l_orderkey").cast("string").alias("loan_id"),
            F.trunc(F.col("l_shipdate").cast("date"), "month").alias("snapshot_date"),
        )
        .agg(F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"))
    )
    scored = _scored(spark, d) if predictions is None else predictions
    return G.monitor(scored, labels, None, *_baselines(spark, d), months=months)


def _metrics(spark, d, **which):
    """The stored monitoring table of all months."""
    path = _stored(spark, d, "monitoring", lambda p: MS.refresh(spark, p, lambda m: _monitoring(spark, d, m)))
    return MS.read_metrics(spark, path, **which)


@query(
    "q_monitoring_long",
    f"WITH {_MONITOR} SELECT * REPLACE (round(metric_value, 9) AS metric_value) FROM monitoring",
)
def monitoring_long(spark, d):
    return _round(_monitoring(spark, d), 9, "metric_value")


@query(
    "q_stability_rows",
    f"""
    WITH {_MONITOR} SELECT * EXCLUDE (status) REPLACE (round(metric_value, 9) AS metric_value)
    FROM monitoring WHERE metric_type = 'stability'
    """,
)
def stability_rows(spark, d):
    rows = _monitoring(spark, d).where(F.col("metric_type") == "stability").drop("status")
    return _round(rows, 9, "metric_value")


@query(
    "q_monitoring_backfill",
    f"""
    WITH {_MONITOR} SELECT * REPLACE (round(metric_value, 9) AS metric_value) FROM monitoring
    WHERE monitoring_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-01'
    """,
)
def monitoring_backfill(spark, d):
    return _round(_monitoring(spark, d, ("1997-01-01", "1998-12-01")), 9, "metric_value")


@query(
    "q_monitoring_sink",
    f"WITH {_MONITOR} SELECT * REPLACE (round(metric_value, 9) AS metric_value) FROM monitoring",
)
def monitoring_sink(spark, d):
    """A stored table: months up to a date, one of them from faulty predictions; it is redone; later months follow."""
    path = new_path(spark, "metrics")
    right = _scored(spark, d)
    may = F.col("snapshot_date") == F.lit("1997-05-01").cast("date")
    faulty = right.where(~may | (F.col("model_predictions") < 0.2))
    MS.refresh(spark, path, lambda m: _monitoring(spark, d, m, faulty), ("1900-01-01", "1998-12-01"))
    # The month's stability, and its performance six months on.
    MS.refresh(spark, path, lambda m: _monitoring(spark, d, m, right), redo=["1997-05-01", "1997-11-01"])
    MS.refresh(spark, path, lambda m: _monitoring(spark, d, m, right))
    columns = _monitoring(spark, d).columns
    return _round(MS.read_metrics(spark, path).select(*columns), 9, "metric_value")


@query(
    "q_stored_baselines",
    """SELECT 'price_model' AS model_name, unnest(['model_predictions', 'customer_code']) AS "column", TRUE AS same""",
)
def stored_baselines(spark, d):
    """Baselines that are loaded are those that were fitted."""
    score, features = _baselines(spark, d)
    loaded = {"model_predictions": score, **features}
    base = _scored(spark, d).where(F.col("snapshot_date") < F.lit("1996-01-01").cast("date"))
    fitted = K.fit_baselines(base, list(loaded))
    both = artefacts.baselines_frame(spark, "price_model", loaded).withColumnRenamed("cuts", "c").withColumnRenamed("shares", "s")
    return both.withColumnRenamed("value_bins", "v").join(
        artefacts.baselines_frame(spark, "price_model", fitted), ["model_name", "column"], "full"
    ).select(
        "model_name", "column",
        (F.col("c").eqNullSafe(F.col("cuts")) & F.col("s").eqNullSafe(F.col("shares")) & F.col("v").eqNullSafe(F.col("value_bins"))).alias("same"),
    )


@query(
    "q_series",
    f"""
    WITH {_MONITOR} SELECT model_name, prediction_month, round(metric_value, 9) AS metric_value FROM monitoring
    WHERE metric_type = 'performance' AND metric_name = 'auc' AND monitoring_date <= DATE '1999-06-01'
    """,
)
def series(spark, d):
    found = G.metric_series(_metrics(spark, d, as_of="1999-06-01"), "performance", "auc", as_of="1999-06-01")
    return _round(found, 9, "metric_value")


@query(
    "q_csi_series",
    f"""
    WITH {_MONITOR} SELECT model_name, prediction_month, substring(metric_name, 5) AS feature,
           round(greatest(metric_value, 1e-3), 9) AS csi
    FROM monitoring WHERE starts_with(metric_name, 'csi_')
    """,
)
def csi_series(spark, d):
    return _round(G.csi_series(_metrics(spark, d)), 9, "csi")


@query(
    "q_metric_pivot",
    f"""
    WITH {_MONITOR} SELECT model_name, prediction_month,
           round(max(CASE WHEN metric_name = 'auc' THEN metric_value END), 9) AS auc,
           round(max(CASE WHEN metric_name = 'psi_score' THEN metric_value END), 9) AS psi_score,
           round(max(CASE WHEN metric_name = 'bad_rate_gap' THEN metric_value END), 9) AS bad_rate_gap
    FROM monitoring WHERE metric_name IN ('auc', 'psi_score', 'bad_rate_gap') GROUP BY 1, 2
    """,
)
def metric_pivot(spark, d):
    names = ["auc", "psi_score", "bad_rate_gap"]
    return _round(G.metric_pivot(_metrics(spark, d, model="price_model"), names), 9, *names)


@query(
    "q_calibration_summary",
    f"""
    WITH {R.SCORES}, a AS ({auc_sql('scores', '', score='challenger')})
    SELECT round(avg(label), 10) AS bad_rate, round(avg(model_predictions), 10) AS mean_pred_raw,
           round(avg(challenger), 10) AS mean_pred_calibrated,
           round(avg(pow(model_predictions - label, 2)), 10) AS brier_raw,
           round(avg(pow(challenger - label, 2)), 10) AS brier_calibrated,
           round((SELECT auc FROM a), 10) AS auc_calibrated
    FROM scores
    """,
)
def calibration_summary(spark, d):
    found = G.calibration_summary(R.scores(spark, d), "label", "model_predictions", "challenger")
    return _round(found, 10, *found.columns)


@query(
    "q_split_summary",
    f"""
    WITH {R.SCORES}
    SELECT CASE WHEN snapshot_date <= DATE '1998-01-01' THEN 'train' ELSE 'test' END AS split,
           count(*) AS n, avg(label) AS bad_rate FROM scores GROUP BY 1
    """,
)
def split_summary(spark, d):
    return G.split_summary(M.cut_split(R.scores(spark, d), "1998-01-01"))


def _pair(by: str) -> str:
    cols = f"{by}, " if by else ""
    return f"""
    long AS (SELECT snapshot_date, label, 'champion' AS model, model_predictions FROM scores
             UNION ALL SELECT snapshot_date, label, 'challenger', challenger FROM scores),
    a AS ({auc_sql('long', cols + 'model')}),
    g AS (SELECT {cols} model, count(*) AS n_labels, avg(label) AS y, avg(model_predictions) AS p,
                 CAST(count(*) FILTER (WHERE label = 1 AND model_predictions >= 0.3) AS DOUBLE) / sum(label) AS recall
          FROM long GROUP BY ALL)
    SELECT {cols} model, n_labels, round(auc, 9) AS auc, round({_SE}, 9) AS auc_se, round(y, 9) AS bad_rate_actual,
           round(p, 9) AS bad_rate_predicted, round(p - y, 9) AS bad_rate_gap, round(recall, 9) AS recall
    FROM g JOIN a USING ({cols} model)"""


_MODELS = {"champion": "model_predictions", "challenger": "challenger"}
_VALUES = ["auc", "auc_se", "bad_rate_actual", "bad_rate_predicted", "bad_rate_gap", "recall"]


@query("q_champion_challenger", f"WITH {R.SCORES}, {_pair('snapshot_date')}")
def champion_challenger(spark, d):
    found = G.compare_models(R.scores(spark, d), _MODELS, by=["snapshot_date"], cutoff=0.3)
    return _round(found, 9, *_VALUES)


@query("q_champion_challenger_pooled", f"WITH {R.SCORES}, {_pair('')}")
def champion_challenger_pooled(spark, d):
    return _round(G.compare_models(R.scores(spark, d), _MODELS, cutoff=0.3), 9, *_VALUES)


@query(
    "q_champion_challenger_drift",
    f"""
    WITH {R.SCORES}, old AS (SELECT * FROM scores WHERE snapshot_date < DATE '1997-01-01'),
    drift AS ({psi_sql('old', 'scores', 'model_predictions', 'snapshot_date')}
              UNION ALL {psi_sql('old', 'scores', 'challenger', 'snapshot_date')})
    SELECT snapshot_date, CASE "column" WHEN 'challenger' THEN 'challenger' ELSE 'champion' END AS model, psi FROM drift
    """,
)
def champion_challenger_drift(spark, d):
    scored = R.scores(spark, d)
    base = scored.where(F.col("snapshot_date") < F.lit("1997-01-01").cast("date"))
    fitted = K.fit_baselines(base, list(_MODELS.values()))
    baselines = {m: fitted[c] for m, c in _MODELS.items()}
    found = G.compare_models(scored, _MODELS, baselines, by=["snapshot_date"], cutoff=0.3)
    return _round(found.select("snapshot_date", "model", "psi"), 9, "psi")
