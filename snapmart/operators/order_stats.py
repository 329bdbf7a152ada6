"""Exact order statistics without a single-task sort or a full shuffle.

Spark's exact percentile gathers every distinct value of a group in one task. Here
values fall into cells of about equal weight by cut points from a mergeable
quantile sketch. The sketch only decides *where* the work happens; ranks come from
exact counts, so the results are exact:

1. sketch of every column in one pass, merged in two levels; at most
   ``MAX_CELLS`` cut points per column reach the driver,
2. rows per (group, column, cell): a shuffle of counts, with running totals over
   the cells of a group,
3. only the rows of cells that hold a wanted rank (two per quantile, out of all
   cells) are counted by value, shuffled and sorted.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapmart.operators.filters import all_present

#: Bounds of the cells per column; the upper one bounds what the driver receives.
MIN_CELLS = 64
MAX_CELLS = 2000
SKETCH_ACCURACY_PER_CELL = 5


def default_cells(spark: SparkSession) -> int:
    """A few cells per shuffle partition, so cells grow with the cluster."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_CELLS, min(MAX_CELLS, 4 * partitions))


def as_value(name: str) -> Column:
    """Column as double, NaN counted as missing like NULL."""
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x), x)


def value_cuts(
    df: DataFrame, columns: Sequence[str], n_cells: int | None = None
) -> dict[str, list[float]]:
    """Sketched cut points per column: one pass, one bounded row to the driver.

    The map tasks' sketches are merged in as many groups as there are cells, so
    no task receives the sketches of all map tasks; the groups' quantiles (cells
    x cells numbers per column) are then reduced to one set of cuts.
    """
    n = n_cells or default_cells(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    accuracy = max(n * SKETCH_ACCURACY_PER_CELL, 100)

    def cuts(x: Column, name: str) -> Column:
        return F.percentile_approx(x, probs, accuracy).alias(name)

    values = [as_value(c).alias(f"v{i}") for i, c in enumerate(columns)]
    names = [f"v{i}" for i in range(len(columns))]
    group = F.pmod(F.spark_partition_id(), F.lit(n)).alias("g")
    partial = df.select(group, *values).groupBy("g").agg(*[cuts(F.col(v), v) for v in names])
    spread = partial.select(F.explode(F.arrays_zip(*names)).alias("z")).select("z.*")
    row = spread.agg(*[cuts(F.col(v), v) for v in names]).first()
    return {c: sorted(set(row[v] or [])) for c, v in zip(columns, names)}


def bucketize(df: DataFrame, splits: Mapping[str, Sequence[float]], prefix: str) -> DataFrame:
    """Left-closed bucket number of each column by binary search (JVM side).

    ``splits`` are inner cut points; the outer edges are infinite, so infinite
    values belong to the outer buckets. Missing values get NULL.
    """
    full = {
        c: [float("-inf"), *[x for x in cuts if math.isfinite(x)], float("inf")]
        for c, cuts in splits.items()
    }
    wide = [c for c, s in full.items() if len(s) > 2]
    out = df
    if wide:
        out = df.withColumns({f"__v_{c}": as_value(c) for c in wide})
        out = Bucketizer(
            inputCols=[f"__v_{c}" for c in wide],
            outputCols=[f"__b_{c}" for c in wide],
            splitsArray=[full[c] for c in wide],
            handleInvalid="keep",
        ).transform(out)
    named = {}
    for c in splits:
        bucket = F.col(f"__b_{c}").cast("int") if c in wide else F.lit(0)
        named[f"{prefix}{c}"] = F.when(as_value(c).isNotNull(), bucket)
    helpers = [f"__{k}_{c}" for k in "vb" for c in wide]
    return out.withColumns(named).drop(*helpers)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    n_cells: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles: (by..., column, n, q).

    ``q`` follows the order of ``probs``. Missing values and NULL groups are left
    out; a column without values gives no row.
    """
    by = list(by)
    keys = [*by, "column"]
    cuts = value_cuts(df, columns, n_cells)
    celled = bucketize(df.select(*by, *columns), cuts, "__cell_")
    triples = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"__cell_{c}").alias("cell"),
                as_value(c).alias("value"),
            )
            for c in columns
        ]
    )
    values = celled.select(*by, F.inline(triples)).where(all_present([*keys, "cell"]))

    over_cells = Window.partitionBy(*keys).orderBy("cell")
    cells = values.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("cell_n"))
    cells = cells.select(
        *keys,
        "cell",
        (F.sum("cell_n").over(over_cells) - F.col("cell_n")).alias("before"),
        "cell_n",
        F.sum("cell_n").over(Window.partitionBy(*keys)).alias("total"),
    )
    position = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array(*[f(h).cast("bigint") for h in position for f in (F.floor, F.ceil)])
    wanted = (
        cells.where(
            F.exists(
                ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("cell_n"))
            )
        ).drop("cell_n")
    )
    counts = (
        values.join(wanted, [*keys, "cell"])
        .groupBy(*keys, "cell", "value")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("before").alias("before"),
            F.max("total").alias("total"),
        )
    )

    in_cell = (
        Window.partitionBy(*keys, "cell")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = counts.withColumn("last", F.col("before") + F.sum("n").over(in_cell) - 1)
    first = F.col("last") - F.col("n") + 1

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank <= F.col("last")), F.col("value")))

    picks = []
    for i, h in enumerate(position):
        picks.append(value_at(F.floor(h)).alias(f"lo_{i}"))
        picks.append(value_at(F.ceil(h)).alias(f"hi_{i}"))
    picked = ranked.groupBy(*keys).agg(F.max("total").alias("n"), *picks)
    quantiles = []
    for i, p in enumerate(probs):
        lo, hi = F.col(f"lo_{i}"), F.col(f"hi_{i}")
        h = (F.col("n") - 1) * F.lit(float(p))
        t = h - F.floor(h)
        step = hi - lo
        quantiles.append(F.when(t < 0.5, lo + step * t).otherwise(hi - step * (1 - t)))
    return picked.select(*keys, "n", F.array(*quantiles).alias("q"))


def quantile_table(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], n_cells: int | None = None
) -> dict[str, list[float]]:
    """Quantiles of whole columns on the driver: one small row per column."""
    rows = exact_quantiles(df, columns, probs, n_cells=n_cells).collect()
    found = {r["column"]: list(r["q"]) for r in rows}
    return {c: found.get(c, []) for c in columns}


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians; ``None`` for a column without values."""
    return {c: (q[0] if q else None) for c, q in quantile_table(df, columns, [0.5]).items()}


def approx_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = 10000,
) -> DataFrame:
    """Sketched quantiles in the same shape: one pass, no sort, existing values."""
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count(as_value(c)).alias("n"),
                F.percentile_approx(as_value(c), list(probs), accuracy).alias("q"),
            )
            for c in columns
        ]
    )
    return df.groupBy(*by).agg(rows.alias("rows")).select(*by, F.inline("rows"))
