"""Co-moments of all column pairs in one scan, as states that merge.

For every pair of columns, over the rows in which both are present: the number of rows,
both means, both sums of squared deviations, and the sum of products of deviations. A
task reduces its rows to one such matrix by products of whole batches, each batch
centred on its own means; matrices are merged by the update of Chan, Golub and LeVeque
(1979), which never subtracts large sums from each other. A matrix travels as one row
per first column. Rows of one column meet in two steps, so that no task gets a state of
every task at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

#: Groups in which the states of a column meet first.
FAN_IN = 64

_PARTS = ("n", "mean_x", "mean_y", "square_x", "square_y", "product")
_SCHEMA = "i int, part int, " + ", ".join(f"{p} array<double>" for p in _PARTS)


@dataclass
class State:
    """One column against all (vectors), or all against all (matrices)."""

    n: np.ndarray
    mean_x: np.ndarray
    mean_y: np.ndarray
    square_x: np.ndarray
    square_y: np.ndarray
    product: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> State:
        """From rows of numbers, NaN where missing. Infinite values leave their pairs undefined."""
        there, infinite = ~np.isnan(values), np.isinf(values)
        x = np.where(there & ~infinite, values, 0.0)
        first = x[there.argmax(0), np.arange(x.shape[1])]
        shift = x - first
        shift[~there | infinite] = 0.0
        # The first value and then the mean: constant columns become exactly 0.
        centre = shift.sum(0) / np.maximum(there.sum(0), 1)
        x = np.where(there & ~infinite, shift - centre, 0.0)
        present = there.astype(float)
        n = present.T @ present
        some = np.maximum(n, 1)
        mean_x = (x.T @ present) / some
        square_x = np.maximum((x * x).T @ present - n * mean_x**2, 0.0)
        product = x.T @ x - n * mean_x * mean_x.T
        broken = infinite.astype(float).T @ present > 0
        product[broken | broken.T] = np.nan
        base = (first + centre)[:, None]
        return cls(n, mean_x + base, mean_x.T + base.T, square_x, square_x.T, product)

    def merged(self, other: State) -> State:
        n = self.n + other.n
        share = other.n / np.maximum(n, 1)  # exactly 1 where only the other has rows
        weight = self.n * share
        dx, dy = other.mean_x - self.mean_x, other.mean_y - self.mean_y
        return State(
            n, self.mean_x + dx * share, self.mean_y + dy * share,
            self.square_x + other.square_x + dx * dx * weight,
            self.square_y + other.square_y + dy * dy * weight,
            self.product + other.product + dx * dy * weight,
        )

    def correlations(self) -> list[float | None]:
        """None where a column is constant, a pair shares no rows, or values are infinite."""
        spread = np.sqrt(self.square_x) * np.sqrt(self.square_y)
        return [p / s if s and p == p else None for p, s in zip(self.product.tolist(), spread.tolist())]


def states(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One matrix per task, as rows (i, part, vectors); and one of no rows, so that none is missing."""
    names, k = list(columns), len(columns)
    nothing = State(*(np.zeros((k, k)) for _ in _PARTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = nothing
        for batch in batches:
            if batch.num_rows:
                values = [c.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for c in batch.columns]
                total = total.merged(State.of(np.column_stack(values)))
        ends = pa.array(np.arange(0, k * k + 1, k), pa.int32())
        vectors = [pa.ListArray.from_arrays(ends, pa.array(getattr(total, p).ravel())) for p in _PARTS]
        part = pa.array(np.full(k, TaskContext.get().partitionId()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), part, *vectors], names=["i", "part", *_PARTS])

    empty = [(i, -1, *[[0.0] * k for _ in _PARTS]) for i in range(k)]
    some = df.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(run, _SCHEMA)
    return some.unionByName(df.sparkSession.createDataFrame(empty, _SCHEMA))


def _merged(group: pa.Table) -> State:
    rows = [
        column.combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1)
        for column in (group.column(p) for p in _PARTS)
    ]
    found = [State(*(r[i] for r in rows)) for i in range(group.num_rows)]
    while len(found) > 1:
        found = [a.merged(b) for a, b in zip(found[::2], found[1::2])] + ([found[-1]] if len(found) % 2 else [])
    return found[0]


def finished(states: DataFrame, result: Callable[[State, int], dict[str, list]], schema: str) -> DataFrame:
    """``result(state, i)``, as columns, for each column's merged state."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def some(group: pa.Table) -> pa.Table:
        state = _merged(group)
        vectors = [pa.array([getattr(state, p)], pa.list_(pa.float64())) for p in _PARTS]
        ids = [pa.array([group.column("i")[0].as_py()], pa.int32()), pa.array([-1], pa.int32())]
        return pa.table([*ids, *vectors], names=["i", "part", *_PARTS])

    def last(group: pa.Table) -> pa.Table:
        return pa.table(result(_merged(group), group.column("i")[0].as_py()), schema=arrow)

    met = states.withColumn("part", F.pmod("part", F.lit(FAN_IN))).groupBy("i", "part").applyInArrow(some, _SCHEMA)
    return met.groupBy("i").applyInArrow(last, schema)
