"""Sources, writers, month jobs and the catalogue contract."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from snapmart.plans import jobs as T
from snapmart.schemas import raw_schema
from snapmart.plans import metric_store as MS
from snapmart.sources import scratch
from snapmart.sources import tables as S


def months_frame(spark):
    rows = [(f"l{i}", float(i), dt.date(2024, 1 + i % 3, 1)) for i in range(9)]
    return spark.createDataFrame(rows, "loan_id string, x double, snapshot_date date")


def test_rerun_replaces_one_month_only(spark):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    try:
        path = scratch.new_path(spark, "t")
        df = months_frame(spark)
        T.backfill(df, lambda d: d, path)
        T.rerun_month(df, lambda d: d.withColumn("x", F.lit(-1.0)), path, "2024-02-01")
        T.rerun_month(df, lambda d: d.withColumn("x", F.lit(-1.0)), path, "2024-02-01")
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    rows = S.read_table(spark, path).collect()
    assert len(rows) == 9
    for r in rows:
        assert (r["x"] == -1.0) == (r["snapshot_date"] == dt.date(2024, 2, 1))
    assert S.read_snapshot(spark, path, "2024-03-01").count() == 3
    assert S.read_history(spark, path, "2024-02-01").count() == 6
    plan = S.read_history(spark, path, "2024-02-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan


def test_csv_keeps_raw_text(spark):
    path = scratch.new_path(spark, "csv")
    raw = spark.createDataFrame(
        [("c1", "n", "23_", "s", "_______", dt.date(2024, 1, 1))], raw_schema("attributes")
    )
    raw.write.option("header", True).csv(path)
    assert S.read_csv(spark, path, raw_schema("attributes")).collect() == raw.collect()
    assert dict(S.read_csv(spark, path, infer=True).dtypes)["snapshot_date"] == "date"


def test_dated_files_skip_bad_names(spark):
    root = scratch.new_path(spark, "files")
    for name in ("silver_2024_01_01", "silver_2024_02_01", "silver_2024_99_01", "silver_latest"):
        spark.createDataFrame([(name,)], "name string").write.parquet(f"{root}/{name}.parquet")
    got = S.read_dated_files(spark, f"{root}/*.parquet", "2024-01-15").collect()
    assert [(r["name"], r["file_date"]) for r in got] == [("silver_2024_01_01", dt.date(2024, 1, 1))]
    assert S.read_dated_files(spark, f"{root}/*.parquet").count() == 2


def test_month_spine(spark):
    got = [r[0] for r in T.month_spine(spark, "2023-12-15", "2024-03-01").collect()]
    assert got == [dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 3, 1)]
    empty = months_frame(spark).where("x > 99")
    assert T.month_spine_of(empty, "snapshot_date").count() == 0


def test_audit_counts_empty_months(spark):
    months = T.month_spine(spark, "2024-01-01", "2024-04-01")
    got = {r["snapshot_date"].month: r["n"] for r in S.load_audit({"t": months_frame(spark)}, months).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 0}
    total = sum(got.values())
    assert total == months_frame(spark).count()


def test_schema_report_and_drift(spark):
    root = scratch.new_path(spark, "schema")
    months_frame(spark).write.parquet(f"{root}/a")
    months_frame(spark).withColumn("x", F.col("x").cast("int")).withColumn("y", F.lit(1)).write.parquet(f"{root}/b")
    a, b = (S.data_files(spark, f"{root}/{x}", x) for x in "ab")
    drift = S.schema_drift(S.schema_report(a.union(b)))
    assert {r["column"]: r["types"] for r in drift.collect()} == {"x": ["double", "int"], "y": ["int"]}
    assert S.schema_drift(S.schema_report(a.union(S.data_files(spark, f"{root}/a", "a2")))).count() == 0


def test_gates(spark):
    months = T.month_spine(spark, "2024-05-01", "2024-07-01").withColumn(
        "features", (F.month("snapshot_date") != 7).cast("int")
    )
    got = {r["snapshot_date"].month: (r["run_training"], r["run_scoring"], r["run_monitoring"]) for r in T.gate(months, "2024-06-01").collect()}
    assert got == {5: (0, 0, 0), 6: (1, 1, 1), 7: (0, 0, 1)}


def test_scratch_needs_a_shared_folder_off_local_mode():
    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default=None):
            return self.value or default

    class Session:
        def __init__(self, master, value=None):
            self.conf = Conf(value)
            self.sparkContext = type("C", (), {"master": master})

    with pytest.raises(ValueError):
        scratch.shared_folder(Session("spark://host:7077"))
    assert scratch.shared_folder(Session("spark://host:7077", "/shared/x/")) == "/shared/x"


def test_inspection(spark):
    row = S.inspect(months_frame(spark)).first()
    assert (row["n_rows"], row["n_columns"]) == (9, 3)


def test_catalogue_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 120
    assert entry.entry(spark).count() > 0


def test_rerun_without_rows_empties_the_month(spark):
    path = scratch.new_path(spark, "empty")
    df = months_frame(spark)
    T.backfill(df, lambda d: d, path)
    T.rerun_month(df, lambda d: d.where("x < 0"), path, "2024-02-01")
    assert S.read_snapshot(spark, path, "2024-02-01").count() == 0
    assert S.read_table(spark, path).count() == 6


def test_replace_partition_by_model_and_month(spark):
    path = scratch.new_path(spark, "predictions")
    rows = [(m, dt.date(2024, k, 1), float(k)) for m in ("a", "b c") for k in (1, 2)]
    df = spark.createDataFrame(rows, "model_name string, snapshot_date date, score double")
    S.write_predictions(df, path)
    S.replace_partition(df.where("score > 9"), path, {"model_name": "a", "snapshot_date": "2024-01-01"})
    got = {(r["model_name"], r["snapshot_date"].month) for r in S.read_table(spark, path).collect()}
    assert got == {("a", 2), ("b c", 1), ("b c", 2)}


def test_audit_counts_every_row(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 1, 1),), (None,), (dt.date(2030, 1, 1),)], "snapshot_date date"
    )
    months = T.month_spine(spark, "2024-01-01", "2024-02-01")
    got = {r["snapshot_date"]: r["n"] for r in S.load_audit({"t": df}, months).collect()}
    assert got == {dt.date(2024, 1, 1): 1, dt.date(2024, 2, 1): 0, None: 1, dt.date(2030, 1, 1): 1}


def test_schema_drift_within_a_partition(spark):
    path = scratch.new_path(spark, "mixed")
    S.write_snapshots(months_frame(spark), path)
    folder = f"{path}/snapshot_date=2024-02-01"
    spark.createDataFrame([("l9", 1)], "loan_id string, x int").write.mode("append").parquet(folder)
    spark.createDataFrame([("l9",)], "loan_id string").write.mode("append").parquet(folder)
    files = S.data_files(spark, path)
    assert sorted({r["part"] for r in files.collect()}) == [f"snapshot_date=2024-0{k}-01" for k in (1, 2, 3)]
    report = S.schema_report(files)
    got = {(r["part"][-5:], r["schema"]) for r in report.collect()}
    assert got == {("01-01", 1), ("02-01", 1), ("02-01", 2), ("02-01", 3), ("03-01", 1)}
    drift = S.schema_drift(report).collect()
    assert [(r["column"], r["types"], r["n_parts"], r["n_mixed"]) for r in drift] == [("x", ["double", "int"], 3, 1)]
    assert S.schema_drift(S.schema_report(S.data_files(spark, folder, "one"))).count() == 1


def test_schema_drift_query_reads_the_months(spark, small):
    got = {r["column"]: (r["types"].split(","), r["n_mixed"]) for r in entry.queries()["q_schema_drift"](spark, small).collect()}
    assert set(got) == {"o_totalprice", "o_orderstatus"}
    assert got["o_totalprice"] == (["decimal(15", "2)", "double"], 1) and got["o_orderstatus"][1] == 1


def test_footers_are_read_by_tasks(spark, monkeypatch):
    """Files of other writers, odd folder names, and no job of the driver's per file."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    root = scratch.new_path(spark, "foot ers")
    spark.createDataFrame([(1, "x")], "a int, b string").write.parquet(f"{root}/k=1 %2/")
    os.makedirs(f"{root}/k=2")
    pq.write_table(pa.table({"a": pa.array([1], pa.int64())}), f"{root}/k=2/other.parquet")
    report = S.schema_report(S.data_files(spark, root)).collect()
    assert len({r["part"] for r in report}) == 2
    assert {(r["column"], r["type"]) for r in report} == {("a", "int"), ("b", "string"), ("a", "bigint")}


def test_a_backfill_leaves_a_folder_for_every_month(spark):
    path = scratch.new_path(spark, "gaps")
    df = months_frame(spark)
    T.backfill(df, lambda d: d.where(F.month("snapshot_date") != 2), path)
    assert sorted(f for f in os.listdir(path) if "=" in f) == [f"snapshot_date=2024-0{k}-01" for k in (1, 2, 3)]
    assert S.read_table(spark, path).count() == 6
    assert S.read_snapshot(spark, path, "2024-02-01").count() == 0


def test_first_rows_by_columns(spark):
    assert [r["x"] for r in S.first_rows(months_frame(spark), 2, [F.col("x").desc()]).collect()] == sorted(
        (r["x"] for r in months_frame(spark).collect()), reverse=True)[:2]
    assert S.first_rows(months_frame(spark), 4).count() == 4


# ------------------------------------------------------------------ metric store


def metrics_of(spark, rows):
    return spark.createDataFrame(
        [(m, dt.date(2024, k, 1), v) for m, k, v in rows], "model_name string, monitoring_date date, metric_value double"
    )


def test_the_metric_store_writes_only_what_is_due(spark):
    path, asked = scratch.new_path(spark, "metrics"), []

    def compute(value, models=("a", "b")):
        def run(months):
            asked.append(months)
            all_rows = metrics_of(spark, [(m, k, value) for m in models for k in (1, 2, 3)])
            return all_rows if months is None else all_rows.where(F.col("monitoring_date").between(*months))
        return run

    assert MS.stored_partitions(spark, path) == []
    assert MS.refresh(spark, path, compute(1.0), ("2024-01-01", "2024-02-01")) == 4
    assert MS.refresh(spark, path, compute(2.0)) == 2  # March alone is due
    held = lambda: {(r["model_name"], r["monitoring_date"].month): r["metric_value"] for r in MS.read_metrics(spark, path).collect()}
    assert held() == {(m, k): 2.0 if k == 3 else 1.0 for m in "ab" for k in (1, 2, 3)}
    # A redone month is replaced, also where a model has no rows in it any more.
    assert MS.refresh(spark, path, compute(3.0, ("a",)), redo=["2024-02-01"]) == 1
    assert held() == {("a", 1): 1.0, ("a", 2): 3.0, ("a", 3): 2.0, ("b", 1): 1.0, ("b", 3): 2.0}
    assert asked[-1] == ("2024-02-01", "2024-02-01")
    assert MS.refresh(spark, path, compute(9.0, ("a",))) == 0
    plan = MS.read_metrics(spark, path, model="a", months=("2024-01-01", "2024-02-01"), as_of="2024-01-01")
    assert [r["metric_value"] for r in plan.collect()] == [1.0]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model_name" in text or "PartitionFilters: [isnotnull(monitoring_date" in text


def test_leased_tables_are_dropped_after_a_query(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_folder", lambda _: str(tmp_path))
    with scratch.leased(spark):
        with scratch.kept():
            shared = scratch.materialise(spark.range(3), "shared")
        assert entry.queries()["q_rerun_month"](spark, small).count() > 0
        with scratch.leased(spark):
            scratch.materialise(spark.range(2), "inner")
        assert not [f for f in os.listdir(tmp_path) if "inner" in f] and len(os.listdir(tmp_path)) > 1
    assert [f.split("-")[1] for f in os.listdir(tmp_path)] == ["shared"] and shared.count() == 3
