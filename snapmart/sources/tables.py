"""Snapshot tables on storage: one directory per table, partitioned by month."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapmart.functions.dates import date_in_name
from snapmart.operators.filters import as_date, at_snapshot, known_at


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, infer: bool = False
) -> DataFrame:
    """CSV with a header; a fixed schema spares the inference pass over the file."""
    reader = spark.read.option("header", True)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer).csv(path)


def read_table(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    """All partitions of a parquet table as one frame."""
    return spark.read.option("mergeSchema", merge_schema).parquet(path)


def read_snapshot(spark: SparkSession, path: str, day) -> DataFrame:
    """One month, by partition pruning."""
    return at_snapshot(read_table(spark, path), day)


def read_history(spark: SparkSession, path: str, as_of) -> DataFrame:
    """All months up to a date, by partition pruning."""
    return known_at(read_table(spark, path), as_of)


def read_dated_files(spark: SparkSession, pattern: str, as_of=None) -> DataFrame:
    """Parquet files named ``..._YYYY_MM_DD.parquet``, up to a date.

    Files whose name holds no valid date are skipped. The date is taken from the
    file's metadata column, so skipped files are not read.
    """
    df = spark.read.parquet(pattern)
    path = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?\.parquet)(?:/|$)", 1)
    dated = df.select(*df.columns, date_in_name(path).alias("file_date"))
    known = dated.where(F.col("file_date").isNotNull())
    return known.where(F.col("file_date") <= as_date(as_of)) if as_of else known


def write_snapshots(
    df: DataFrame, path: str, keys: Sequence[str] = ("snapshot_date",)
) -> None:
    """Overwrite exactly the partitions present in ``df``; see ``replace_partition`` for reruns.

    Rows are rebalanced on the partition keys: small months become one file, a
    large month is split over several tasks by adaptive execution.
    """
    (
        df.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def replace_partition(df: DataFrame, path: str, values: Mapping[str, object]) -> None:
    """Overwrite one partition by what ``df`` holds of it, also where that is nothing.

    ``values``: partition column to value, in the order of the table's folders. A
    partition without rows stays as an empty file with the table's columns.
    """
    folder = path
    part = df
    for key, value in values.items():
        part = part.where(F.col(key) == F.lit(value).cast(df.schema[key].dataType)).drop(key)
        folder = f"{folder}/{key}={quote(str(value), safe=' ')}"
    part.hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)


def write_predictions(predictions: DataFrame, path: str) -> None:
    write_snapshots(predictions, path, ("model_name", "snapshot_date"))


def write_monitoring(monitoring: DataFrame, path: str) -> None:
    write_snapshots(monitoring, path, ("model_name", "monitoring_date"))


def load_audit(
    layers: dict[str, DataFrame], months: DataFrame, key: str = "snapshot_date"
) -> DataFrame:
    """Rows per table and month, months without rows included as 0.

    ``months`` is a month spine with the column ``key``. Rows whose month is NULL or
    outside the spine are counted too, so the counts sum up to the tables' rows.
    """
    names = F.array(*[F.lit(n) for n in layers])
    counts = months.select(F.explode(names).alias("table"), key, F.lit(0).cast("long").alias("n"))
    for name, df in layers.items():
        part = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        counts = counts.unionByName(part.select(F.lit(name).alias("table"), key, "n"))
    return counts.groupBy("table", key).agg(F.sum("n").alias("n"))


def first_rows(df: DataFrame, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows by some columns; any, as they are read, without."""
    return df.orderBy(*by).limit(n) if by else df.limit(n)


def inspect(df: DataFrame) -> DataFrame:
    """Row count, column count and column types as one row."""
    types = ", ".join(f"{name} {dtype}" for name, dtype in df.dtypes)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(types).alias("schema"),
    )


def data_files(spark: SparkSession, path: str, part: str | None = None) -> DataFrame:
    """All data files below a folder, listed and not read: (part, file).

    ``part`` names them; otherwise it is the ``key=value`` part of their folder, or the
    folder where it has none.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    keys = F.regexp_extract(folder, r"((?:[^/=]+=[^/]*/)*[^/=]+=[^/]*)$", 1)
    name = F.when(keys == "", folder).otherwise(keys) if part is None else F.lit(part)
    return listed.select(name.alias("part"), F.col("path").alias("file"))


#: Where Spark's writer leaves its own schema in a parquet footer.
_SPARK_SCHEMA = b"org.apache.spark.sql.parquet.row.metadata"


def _columns_of(file: str) -> list[tuple[str, str]]:
    """Columns and Spark types by a parquet file's footer."""
    from pyarrow import fs, parquet
    from pyspark.sql.pandas.types import from_arrow_schema

    local = re.match(r"(?:file:/+)?(?=/)|file:/+", file)
    if local:
        system, path = None, "/" + file[local.end():].lstrip("/")
    else:
        system, path = fs.FileSystem.from_uri(quote(re.sub(r"^s3[an]:", "s3:", file), safe=":/@%"))
    arrow = parquet.read_schema(path, filesystem=system)
    own = (arrow.metadata or {}).get(_SPARK_SCHEMA)
    schema = T.StructType.fromJson(json.loads(own)) if own else from_arrow_schema(arrow)
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def schema_report(files: DataFrame) -> DataFrame:
    """Column types of each part by distinct schema: (part, schema, n_files, column, type).

    ``files`` (part, file) are dealt to tasks, which read their footers; what is left of
    a file is its list of columns, counted per part. ``schema`` numbers the distinct
    schemas of a part from 1, the most frequent first.
    """
    kind = "part string, columns array<struct<column:string,type:string>>"

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [[{"column": c, "type": t} for c, t in _columns_of(f)] for f in batch["file"]]
            yield pd.DataFrame({"part": batch["part"], "columns": found})

    counted = (
        files.repartition("file").mapInPandas(footers, kind)
        .groupBy("part", "columns").agg(F.count(F.lit(1)).alias("n_files"))
    )
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("n_files").desc(), F.to_json("columns")))
    return counted.withColumn("schema", rank).select("part", "schema", "n_files", F.inline("columns"))


def schema_drift(report: DataFrame) -> DataFrame:
    """Columns that differ between or within partitions: several types, or missing in some files.

    ``n_parts`` counts the partitions that have the column, ``n_mixed`` those of them in
    which it is missing in some files or has several types. Empty when all files share
    one schema.
    """
    total = report.agg(F.count_distinct("part", "schema").alias("n")).scalar()
    schemas = report.groupBy("part").agg(F.count_distinct("schema").alias("n_schemas"))
    by_part = report.groupBy("part", "column").agg(
        F.collect_set("type").alias("types"), F.count_distinct("schema").alias("n_with")
    ).join(schemas, "part")
    mixed = (F.size("types") > 1) | (F.col("n_with") < F.col("n_schemas"))
    return (
        by_part.groupBy("column")
        .agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))).alias("types"),
            F.count(F.lit(1)).alias("n_parts"),
            F.count_if(mixed).alias("n_mixed"),
            F.sum("n_with").alias("n_with"),
        )
        .where((F.size("types") > 1) | (F.col("n_with") < total))
        .drop("n_with")
    )
