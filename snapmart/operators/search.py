"""Random search over boosted trees: features are cut into bins once, all fits share the bins.

A search is many small fits: feature sets x draws x folds. Quantising the features,
tagging folds and imputing is the same for all of them, so it is done once, by one scan
into a stored table of small numbers. Every fit then grows its trees on all rows of that
table, and all fits grow together: one pass over the rows counts, for each fit, rows and
gradients per node, feature and bin; a grouped sum of these counts gives the splits of
one level. What the fits have learned so far stays with the rows, four bytes per row and
fit, and is written anew every ``STORED`` trees. Work grows with the rows, and what reaches
the driver or one task grows with the fits only.

The model that is kept is then fitted by Spark on the same rows with the parameters found.

A fit follows the boosting that Spark's classifier does, so that parameters mean the
same: labels -1 and 1, trees of least variance on the gradients of the logistic loss,
the first tree in full and later ones shrunk, row samples per tree and feature samples
per node. Row samples are drawn by a hash of the row's key and gradients are summed as
whole numbers, so a fit does not depend on how its rows are dealt to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapmart import schemas as S
from snapmart.operators.order_stats import as_value
from snapmart.sources.scratch import drop, materialise, new_path

#: Bins per feature.
BINS = 32
#: What a draw leaves open, as Spark's classifier has it.
DEFAULTS = {
    "maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 1.0, "featureSubsetStrategy": "1.0",
    "minInfoGain": 0.0, "minInstancesPerNode": 1,
}
#: Rows of a table that one task may hold; see ``fold_areas``.
SHORT = 1 << 17
#: Trees after which the margins are written again; in between they are taken from the trees.
STORED = 2
#: Parts of the hash range that a sample is cut from.
_PARTS = 1 << 20
#: A gradient (at most 4) is a whole number of 1 / _GRAIN, and a row adds _ROW to it, so that one sum
#: holds both: over _SLICE rows the gradients stay below _ROW / 2 and the sum below 2**53.
_SLICE, _GRAIN, _ROW = 1 << 13, 1 << 22, 1 << 39
#: Scores whose first bits agree are ordered together; 32 such cells between two powers of 2.
_CELL_BITS = 18
#: Scores that a task holds before it hands them on.
_SCORES = 4_000_000


def bin_cuts(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> list[list[float]]:
    """Distinct cut points of each column, about equally many rows apart; one scan for all."""
    shares = [k / bins for k in range(1, bins)]
    found = df.select([as_value(c).alias(c) for c in columns]).approxQuantile(list(columns), shares, 0.001)
    return [sorted(set(cuts)) for cuts in found]


def fold_bins(
    train: DataFrame, values: Mapping[str, Column], cuts: Sequence[Sequence[float]], n: int, key: str = "loan_id",
    label: str = "label", folds: int = S.SEARCH_FOLDS, seed: int = S.SEARCH_SEED, rows: int | None = None,
) -> DataFrame:
    """The shared table: label, fold, a hash, and one small number per feature, in the order of ``values``.

    ``values`` are the features without gaps; ``n`` is the number of rows of ``train``.
    All of them are taken. Only a caller who gives ``rows`` gets a sample of about so many.
    """
    hashed = F.xxhash64(F.col(key), F.lit(seed))
    taken = train
    if rows is not None and rows < n:
        taken = train.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(_PARTS)) < _PARTS * rows // n)

    def number(value: Column, at: Sequence[float]) -> Column:
        marks = F.array(*[F.lit(float(c)) for c in at]).cast("array<double>")
        return F.size(F.filter(marks, lambda c: c < value))

    numbers = [number(value, at) for value, at in zip(values.values(), cuts)]
    packed = F.array(*numbers).cast("array<tinyint>")
    return materialise(
        taken.select(
            F.col(label).cast("tinyint").alias("label"),
            F.pmod(hashed, F.lit(folds)).cast("tinyint").alias("fold"),
            F.shiftright(hashed, 32).cast("int").alias("salt"), packed.alias("bins"),
        ).repartition(train.sparkSession.sparkContext.defaultParallelism),  # every pass takes equal shares
        "bins",
    )


def _wins(score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Distinct scores with their rows of both classes, and the pairs in order, ties counted half."""
    values, at = np.unique(score, return_inverse=True)
    pos, neg = np.bincount(at, pos, len(values)), np.bincount(at, neg, len(values))
    return values, pos, neg, float((pos * (np.cumsum(neg) - neg / 2)).sum())


def area(score: np.ndarray, positive: np.ndarray) -> float:
    """Area under the curve, ties counted half; NaN where a class is missing."""
    _, pos, neg, wins = _wins(score, positive, ~positive)
    pairs = pos.sum() * neg.sum()
    return float(wins / pairs) if pairs else math.nan


# ------------------------------------------------------------------------- trees

#: Features and cuts of the nodes per level, and the values of the leaves.
Tree = tuple[list[tuple[list[int], list[int]]], np.ndarray]


@dataclass(frozen=True)
class _Slice:
    """Rows of one fold: bins by column, labels of -1 or 1, hashes; as read also margins by fit and the rows themselves."""

    fold: int
    x: np.ndarray
    y: np.ndarray
    salt: np.ndarray
    margins: np.ndarray | None = None
    rows: pa.RecordBatch | None = None


@dataclass(frozen=True)
class _Fit:
    """One fit: its columns, its parameters, where its random numbers start, and the fold it holds out."""

    columns: np.ndarray
    params: Mapping
    seed: Sequence[int]
    fold: int = 0

    def leaves(self, value: np.ndarray, step: int) -> np.ndarray:
        return value if step == 0 else value * self.params["stepSize"]

    def shown(self, step: int, level: int) -> np.ndarray:
        """The columns that each node of a level may look at."""
        k = len(self.columns)
        wanted = max(1, math.ceil(float(self.params["featureSubsetStrategy"]) * k))
        drawn = np.random.default_rng([*self.seed, step, level]).random((1 << level, k)).argsort(1)
        return self.columns[np.sort(drawn[:, :wanted], 1)]

    def mixer(self, step: int) -> np.ndarray:
        """What a tree mixes the rows' hashes with."""
        return np.random.default_rng([*self.seed, step]).integers(1 << 32, size=2, dtype=np.uint32)

    def weights(self, part: _Slice, margin: np.ndarray, step: int, mixer: np.ndarray) -> np.ndarray:
        """_ROW and the gradient in _GRAIN of the rows that a tree is grown on; 0 for the others."""
        with np.errstate(over="ignore"):
            target = part.y if step == 0 else 4 * part.y / (1 + np.exp(2 * part.y * margin))
        found = target.astype(float)
        found *= _GRAIN
        np.rint(found, out=found)
        found += _ROW
        rate = self.params["subsamplingRate"]
        if rate < 1:
            h = part.salt * (mixer[0] | np.uint32(1)) + mixer[1]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            found *= h < np.uint32(rate * (1 << 32))
        return found


def _down(node: np.ndarray, x: np.ndarray, feature: Sequence[int], cut: Sequence[int]) -> np.ndarray:
    """The nodes of the next level that rows reach; ``x`` has a row per column."""
    right = np.zeros(len(node), bool)
    for j, (f, c) in enumerate(zip(feature, cut)):
        if c < BINS:
            right |= (node == j) & (x[f] > c) if j or len(cut) > 1 else x[f] > c
    return node + node + right


def _root(part: _Slice, fit: _Fit) -> np.ndarray:
    return np.zeros(len(part.y), np.uint8 if fit.params["maxDepth"] <= 8 else np.int64)


def _add_trees(margin: np.ndarray, part: _Slice, fit: _Fit, trees: Sequence[Tree], first: int) -> None:
    for step, (levels, value) in enumerate(trees, first):
        node = _root(part, fit)
        for level in levels:
            node = _down(node, part.x, *level)
        margin += fit.leaves(value, step).astype(margin.dtype).take(node)


def _pairs(x: np.ndarray) -> np.ndarray:
    """Two columns' bins as one number: a table of both is counted at once and gives the counts of each."""
    even = np.concatenate([x, np.zeros((len(x) % 2, x.shape[1]), x.dtype)]).astype(np.int64)
    return even[::2] * BINS + even[1::2]


def _level_sums(pairs: np.ndarray, k: int, node: np.ndarray, weights: np.ndarray, nodes: int) -> np.ndarray:
    """Rows and gradients (in _GRAIN) by node, column and bin, of at most _SLICE rows."""
    cells = pairs + node * np.int64(BINS * BINS) if nodes > 1 else pairs
    tables = np.stack([np.bincount(c, weights, nodes * BINS * BINS) for c in cells])
    tables, one = tables.reshape(len(pairs), nodes, BINS, BINS), np.ones(BINS)
    out = np.stack([tables @ one, one @ tables], 1).reshape(-1, nodes, BINS)[:k].swapaxes(0, 1)
    count = np.rint(out / _ROW)
    return np.stack([count, out - count * _ROW], 1).astype(np.int64)


def _splits(sums: np.ndarray, fit: _Fit, shown: np.ndarray) -> tuple[list[int], list[int], np.ndarray]:
    """The best split of each node of a level, and the values of the nodes below."""
    nodes = np.arange(len(shown))
    seen = np.take_along_axis(sums, shown[:, None, :, None], 2)
    left_n, left = seen[:, 0].cumsum(2), seen[:, 1].cumsum(2) / _GRAIN
    all_n, all_ = left_n[:, :, -1:], left[:, :, -1:]
    right_n, right = all_n - left_n, all_ - left
    least = fit.params["minInstancesPerNode"]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left**2 / left_n + right**2 / right_n - all_**2 / all_n) / all_n
    gain[~((left_n >= least) & (right_n >= least))] = -np.inf
    flat = gain.reshape(len(nodes), -1)
    best = flat.argmax(1)
    most = flat[nodes, best]
    splits = (most > 0) & (most >= fit.params["minInfoGain"])
    column, bin_ = best // BINS, np.where(splits, best % BINS, BINS - 1)  # without a split all rows are left
    held = np.stack([left_n[nodes, column, bin_], right_n[nodes, column, bin_]], 1).ravel()
    total = np.stack([left[nodes, column, bin_], right[nodes, column, bin_]], 1).ravel()
    value = np.where(held > 0, total, 0) / np.maximum(held, 1)
    return shown[nodes, column].tolist(), np.where(splits, bin_, BINS).tolist(), value


def _boost(parts: Sequence[_Slice], fit: _Fit, k: int) -> list[Tree]:
    """The trees of one fit on the rows of ``parts``."""
    margins, pairs, trees = [np.zeros_like(p.y) for p in parts], [_pairs(p.x) for p in parts], []
    for step in range(fit.params["maxIter"]):
        levels, value, mixer = [], np.zeros(1), fit.mixer(step)
        weights = [fit.weights(p, margin, step, mixer) for p, margin in zip(parts, margins)]
        nodes = [_root(p, fit) for p in parts]
        for level in range(fit.params["maxDepth"]):
            sums = np.zeros((1 << level, 2, k, BINS), np.int64)
            for pair, node, weight in zip(pairs, nodes, weights):
                sums += _level_sums(pair, k, node, weight, 1 << level)
            feature, cut, value = _splits(sums, fit, fit.shown(step, level))
            levels.append((feature, cut))
            nodes = [_down(node, p.x, feature, cut) for node, p in zip(nodes, parts)]
        trees.append((levels, value))
        for margin, node in zip(margins, nodes):
            margin += fit.leaves(value, step).astype(margin.dtype).take(node)
    return trees


def _scores(part: _Slice, fit: _Fit, trees: Sequence[Tree]) -> np.ndarray:
    margin = np.zeros_like(part.y)
    _add_trees(margin, part, fit, trees, 0)
    return margin


def boosted_scores(x: np.ndarray, y: np.ndarray, fitted: np.ndarray, params: Mapping, seed: Sequence[int]) -> np.ndarray:
    """Margins of all rows by trees grown on the rows ``fitted``; ``y`` is -1 or 1."""
    fit = _Fit(np.arange(x.shape[1]), {**DEFAULTS, **params}, seed)
    salt = np.random.default_rng(seed).integers(1 << 32, size=len(y), dtype=np.uint32)

    def part(rows: np.ndarray) -> _Slice:
        return _Slice(0, np.ascontiguousarray(x[rows].T), y[rows].astype(float), salt[rows])

    grown = np.flatnonzero(fitted)
    trees = _boost([part(grown[i : i + _SLICE]) for i in range(0, len(grown), _SLICE)], fit, x.shape[1])
    return _scores(part(np.arange(len(y))), fit, trees)


# -------------------------------------------------------------------- all fits together


@dataclass(frozen=True)
class _Known:
    """What the fits have learned: whose margins the rows hold, after how many trees, and the trees since."""

    fits: Sequence[_Fit]
    stored: Sequence[int]
    first: int
    recent: Sequence[Sequence[Tree]]

    @property
    def width(self) -> int:
        """Margins that a row holds: those of the fits that do not hold it out, as many for each fold."""
        return sum(self.fits[i].fold != 0 for i in self.stored)

    def margins(self, part: _Slice, wanted: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The margins of a slice for those of the fits ``wanted`` that do not hold it out."""
        row = {i: r for r, i in enumerate(j for j in self.stored if self.fits[j].fold != part.fold)}
        for i in wanted:
            if self.fits[i].fold != part.fold:
                now = part.margins[row[i]] if i in row else np.zeros(len(part.y), np.float32)
                _add_trees(now, part, self.fits[i], self.recent[i], self.first)
                yield i, now


_TABLE = ["label", "fold", "salt", "bins"]


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at least so many rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _slices(batches: Iterator[pa.RecordBatch], k: int, width: int = 0) -> Iterator[_Slice]:
    """At most _SLICE rows of one fold at a time."""
    for batch in _gathered(batches, 3 * _SLICE):
        fold = batch.column("fold").to_numpy()
        for at in np.unique(fold).tolist():
            rows = np.flatnonzero(fold == at)
            for some in np.array_split(rows, -(-len(rows) // _SLICE)):
                part = batch.take(pa.array(some))
                m = part.num_rows
                x = part.column("bins").flatten().to_numpy().astype(np.uint8).reshape(m, k)
                y = np.where(part.column("label").fill_null(0).to_numpy() > 0, 1, -1)
                margins = np.zeros((0, m), np.float32)
                if width:
                    margins = np.frombuffer(part.column("margin").buffers()[2], np.float32, m * width).reshape(m, width).T
                yield _Slice(
                    at, np.ascontiguousarray(x.T), y.astype(np.float32), part.column("salt").to_numpy().view(np.uint32),
                    margins.copy(), part.select(_TABLE),
                )


def _with_margins(state: DataFrame, k: int, known: _Known, active: Sequence[int]) -> DataFrame:
    """The rows with the margins of the fits that go on."""

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, k, known.width):
            m, now = len(part.y), [margin for _, margin in known.margins(part, active)]
            data = np.stack(now, 1) if now else np.zeros((m, 0), np.float32)
            ends = np.arange(m + 1, dtype=np.int32) * np.int32(4 * data.shape[1])
            packed = pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([*part.rows.columns, packed], [*_TABLE, "margin"])

    return state.mapInArrow(advance, "label tinyint, fold tinyint, salt int, bins array<tinyint>, margin binary")


def _level(state: DataFrame, k: int, known: _Known, open_: Mapping[int, Sequence], step: int) -> DataFrame:
    """The splits of the next level of every tree that is ``open_``: (fit, feature, cut, value of the nodes below)."""
    fits = known.fits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        mixers = {i: fits[i].mixer(step) for i in open_}
        for part in _slices(batches, k, known.width):
            pairs = _pairs(part.x)
            for i, margin in known.margins(part, list(open_)):
                node = _root(part, fits[i])
                for level in open_[i]:
                    node = _down(node, part.x, *level)
                found = _level_sums(pairs, k, node, fits[i].weights(part, margin, step, mixers[i]), 1 << len(open_[i]))
                if i in sums:
                    sums[i] += found
                else:
                    sums[i] = found
        if sums:
            packed = pa.array([s.tobytes() for s in sums.values()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), packed], ["fit", "sums"])

    def split(table: pa.Table) -> pa.Table:
        i = table.column("fit")[0].as_py()
        total = sum(np.frombuffer(s.as_buffer(), np.int64) for s in table.column("sums"))
        shown = fits[i].shown(step, len(open_[i]))
        feature, cut, value = _splits(total.reshape(len(shown), 2, k, BINS), fits[i], shown)
        return pa.table({
            "fit": pa.array([i], pa.int32()), "feature": pa.array([feature], pa.list_(pa.int32())),
            "cut": pa.array([cut], pa.list_(pa.int32())), "value": pa.array([value.tolist()], pa.list_(pa.float64())),
        })

    counted = state.mapInArrow(count, "fit int, sums binary")
    return counted.groupBy("fit").applyInArrow(split, "fit int, feature array<int>, cut array<int>, value array<double>")


def _areas(bins: DataFrame, k: int, fits: Sequence[_Fit], trees: Sequence[Sequence[Tree]]) -> DataFrame:
    """Area of each fit on the fold it holds out: (fit, n_held, auc).

    Scores are counted per distinct value and ordered in two levels, inside cells and over the
    cells of a fit, as in ``metrics.evaluate``.
    """

    def counted(scores: Mapping[int, list], labels: Mapping[int, list]) -> pa.RecordBatch:
        columns: dict[str, list] = {name: [] for name in ("fit", "cell", "n", "score", "pos", "neg")}
        for i, found in scores.items():
            positive = np.concatenate(labels[fits[i].fold])
            values, pos, neg, _ = _wins(np.concatenate(found) + np.float32(0), positive, ~positive)
            bits = values.view(np.int32)
            cell = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits) >> _CELL_BITS  # in the order of the scores
            at = np.flatnonzero(np.diff(cell, prepend=cell[0] - 1))
            for name, part in (
                ("fit", np.full(len(at), i, np.int32)), ("cell", cell[at]), ("n", np.diff(at, append=len(cell))),
                ("score", values), ("pos", pos.astype(np.int64)), ("neg", neg.astype(np.int64)),
            ):
                columns[name].append(part)
        whole = {name: np.concatenate(parts) for name, parts in columns.items()}
        ends = pa.array(np.concatenate([[0], np.cumsum(whole.pop("n"))]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(whole[name])) for name in ("score", "pos", "neg")]
        return pa.RecordBatch.from_arrays(
            [pa.array(whole["fit"]), pa.array(whole["cell"], pa.int32()), *lists], ["fit", "cell", "score", "pos", "neg"]
        )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores: dict[int, list] = {}
        labels: dict[int, list] = {}
        held = 0
        for part in _slices(batches, k):
            labels.setdefault(part.fold, []).append(part.y > 0)
            for i, fit in enumerate(fits):
                if fit.fold == part.fold:
                    scores.setdefault(i, []).append(_scores(part, fit, trees[i]))
                    held += len(part.y)
            if held > _SCORES:
                yield counted(scores, labels)
                scores, labels, held = {}, {}, 0
        if scores:
            yield counted(scores, labels)

    def order(table: pa.Table) -> pa.Table:
        score, pos, neg = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("score", "pos", "neg"))
        _, pos, neg, wins = _wins(score, pos, neg)
        return pa.table({
            "fit": table.column("fit")[:1], "cell": table.column("cell")[:1],
            "pos": [int(pos.sum())], "neg": [int(neg.sum())], "wins": [wins],
        })

    found = bins.mapInArrow(score, "fit int, cell int, score array<float>, pos array<long>, neg array<long>")
    cells = found.groupBy("fit", "cell").applyInArrow(order, "fit int, cell int, pos long, neg long, wins double")
    earlier = Window.partitionBy("fit").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(earlier), F.lit(0))
    pos, neg = F.sum("pos"), F.sum("neg")
    return (
        cells.withColumn("wins", F.col("wins") + F.col("pos").cast("double") * below)
        .groupBy("fit")
        .agg((pos + neg).alias("n_held"), F.try_divide(F.sum("wins"), pos.cast("double") * neg).alias("auc"))
    )


def _grow(bins: DataFrame, k: int, fits: Sequence[_Fit]) -> list[list[Tree]]:
    """The trees of all fits, level by level."""
    trees: list[list[Tree]] = [[] for _ in fits]
    state, path, stored, first = bins, None, [], 0
    for step in range(max(fit.params["maxIter"] for fit in fits)):
        active = [i for i, fit in enumerate(fits) if fit.params["maxIter"] > step]
        known = _Known(fits, stored, first, [grown[first:] for grown in trees])
        if step and step % STORED == 0:
            before, path = path, new_path(bins.sparkSession, "margins")
            _with_margins(state, k, known, active).write.parquet(path)
            state, stored, first = bins.sparkSession.read.parquet(path), active, step
            known = _Known(fits, stored, first, [[] for _ in fits])
            if before:
                drop(bins.sparkSession, before)
        levels: dict[int, list] = {i: [] for i in active}
        value = {i: np.zeros(1) for i in active}
        for level in range(max(fits[i].params["maxDepth"] for i in active)):
            open_ = {i: levels[i] for i in active if fits[i].params["maxDepth"] > level}
            found = {r["fit"]: r for r in _level(state, k, known, open_, step).collect()}
            for i in open_:
                if i in found:
                    levels[i].append((found[i]["feature"], found[i]["cut"]))
                    value[i] = np.array(found[i]["value"])
                else:  # no row to grow on
                    levels[i].append(([0] * (1 << level), [BINS] * (1 << level)))
                    value[i] = np.zeros(2 << level)
        for i in active:
            trees[i].append((levels[i], value[i]))
    if path:
        drop(bins.sparkSession, path)
    return trees


def _short_table_areas(bins: DataFrame, k: int, fits: Sequence[_Fit]) -> DataFrame:
    """What ``_areas(_grow())`` finds, for a table that a task can hold: the fits are dealt to the tasks."""
    spark = bins.sparkSession
    table = bins.toArrow().combine_chunks().to_batches()
    shared = spark.sparkContext.broadcast([replace(p, rows=None) for p in _slices(table, k)])

    def areas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i in (i for batch in batches for i in batch.column("fit").to_pylist()):
            fit = fits[i]
            trees = _boost([p for p in shared.value if p.fold != fit.fold], fit, k)
            held = [p for p in shared.value if p.fold == fit.fold]
            if held:
                auc = area(np.concatenate([_scores(p, fit, trees) for p in held]), np.concatenate([p.y > 0 for p in held]))
                yield pa.RecordBatch.from_pylist([{
                    "fit": i, "n_held": sum(len(p.y) for p in held), "auc": None if math.isnan(auc) else auc
                }], pa.schema([("fit", pa.int32()), ("n_held", pa.int64()), ("auc", pa.float64())]))

    frame = spark.createDataFrame([(i,) for i in range(len(fits))], "fit int")
    tasks = min(len(fits), 4 * spark.sparkContext.defaultParallelism)
    return frame.repartition(tasks).mapInArrow(areas, "fit int, n_held long, auc double")


def fold_areas(
    bins: DataFrame, columns: Sequence[str], sets: Mapping[str, Sequence[str]], params: Sequence[Mapping],
    folds: int = S.SEARCH_FOLDS, seed: int = S.SEARCH_SEED, short: int = SHORT,
) -> DataFrame:
    """Every fit of every set: (feature_set, draw, fold, n_held, auc), each on all rows of ``bins``.

    ``short`` decides where the work is done and never what comes out: fits on a table of at
    most so many rows are dealt to the tasks whole, which saves the passes' fixed time.
    """
    k = len(columns)
    jobs = [(name, d, fold) for d in range(len(params)) for name in sets for fold in range(folds)]
    at = {name: np.array([i for i, c in enumerate(columns) if c in set(chosen)]) for name, chosen in sets.items()}
    fits = [_Fit(at[name], {**DEFAULTS, **params[d]}, [seed, d, fold], fold) for name, d, fold in jobs]
    if bins.count() <= short:
        areas = _short_table_areas(bins, k, fits)
    else:
        areas = _areas(bins, k, fits, _grow(bins, k, fits))
    frame = bins.sparkSession.createDataFrame(
        [(i, *job) for i, job in enumerate(jobs)], "fit int, feature_set string, draw int, fold int"
    )
    return frame.join(areas, "fit", "left").select(
        "feature_set", "draw", "fold", F.coalesce("n_held", F.lit(0)).cast("long").alias("n_held"), "auc"
    )


def best_draws(areas: DataFrame) -> DataFrame:
    """Mean area per draw, and which draw of each set is best (the earlier one of equals)."""
    means = areas.groupBy("feature_set", "draw").agg(
        F.avg("auc").alias("cv_auc"), F.sum("n_held").alias("n_held"), F.count("auc").alias("n_folds")
    )
    rank = F.row_number().over(Window.partitionBy("feature_set").orderBy(F.col("cv_auc").desc_nulls_last(), "draw"))
    return means.withColumn("chosen", rank == 1)
