"""Quality classifier: a sparse ensemble of rules over text statistics.

1. *Statistics* of whole texts are Spark expressions, computed once for all documents
   and written to the shared folder.
2. *Rules.* Shallow trees, each fitted to what the trees before it left, are grown on
   a bounded sample of labelled rows (at most ``per_class`` of each class, a documented
   bound). Every path from the root to a node is a rule: a conjunction of thresholds.
3. *Weights.* A logistic regression with an L1 term over the rules keeps few of them.
4. *Scores.* The rules that are left become one Spark column expression, so scoring
   is a projection of the statistics.

Defined cases: a NULL or empty text has zero statistics and is scored by them; rows
without label are not learned from; without labels of both classes every score is the
smoothed share of good labels; repeated rows get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.llm.common import stored
from snapmart.llm.labelled import fold, label_sample

#: Symbols whose share of the characters is a statistic.
SYMBOLS = {"percent": "%", "star": "*", "and_sign": "&", "dollar": "$", "hash_sign": "#", "bar": "|",
           "bang": "!", "stop": ".", "comma": ","}


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and one double per statistic."""
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).select(
        "doc_id", "text", F.char_length("text").alias("n"),
        F.array_remove(F.split("text", r"[ \t\n\r]+"), "").alias("words"),
        F.split("text", "\n").alias("lines"),
    )
    n, n_words = F.greatest(F.col("n"), F.lit(1)), F.greatest(F.size("words"), F.lit(1))
    symbols = [
        ((F.col("n") - F.char_length(F.replace("text", F.lit(s)))) / n).alias(f"share_{name}")
        for name, s in SYMBOLS.items()
    ]
    shouted = F.filter("words", lambda w: (w == F.upper(w)) & (w != F.lower(w)))
    return base.select(
        "doc_id",
        F.log1p(F.col("n")).alias("log_chars"),
        F.log1p(F.size("words").cast("double")).alias("log_words"),
        (F.col("n") / n_words).alias("chars_per_word"),
        (F.size(F.array_distinct("words")) / n_words).alias("distinct_words"),
        (F.size(F.array_distinct("lines")) / F.size("lines")).alias("distinct_lines"),
        (F.size("words") / F.size("lines")).alias("words_per_line"),
        (F.size(shouted) / n_words).alias("shouted"),
        *symbols,
    )


#: One condition: statistic, whether above the threshold, threshold.
Condition = tuple[str, bool, float]


@dataclass
class RuleModel:
    rules: list[tuple[Condition, ...]]
    weights: list[float]
    bias: float

    def score(self) -> Column:
        """The probability of label 1 as one column expression over the statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights):
            holds = reduce(
                lambda a, b: a & b,
                [F.col(c) > F.lit(t) if above else F.col(c) <= F.lit(t) for c, above, t in rule],
            )
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree_paths(
    x: np.ndarray, names: list[str], gap: np.ndarray, depth: int, least: int
) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """Paths of a least-squares tree on ``gap``, and its fitted values."""
    paths: list[tuple[Condition, ...]] = []
    fitted = np.zeros(len(gap))

    def grow(rows: np.ndarray, path: tuple[Condition, ...]) -> None:
        if path:
            paths.append(path)
        fitted[rows] = gap[rows].mean()
        if len(path) == depth or len(rows) < 2 * least:
            return
        best = (1e-9, -1, 0.0)
        total, count = gap[rows].sum(), len(rows)
        for f in range(x.shape[1]):
            order = np.argsort(x[rows, f], kind="stable")
            v, g = x[rows[order], f], np.cumsum(gap[rows[order]])
            k = np.arange(1, count)
            fine = (v[1:] > v[:-1]) & (k >= least) & (count - k >= least)
            if fine.any():
                left = g[:-1]
                gain = np.where(fine, left**2 / k + (total - left) ** 2 / (count - k) - total**2 / count, -1)
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), f, float((v[at] + v[at + 1]) / 2))
        _, f, cut = best
        if f >= 0:
            above = x[rows, f] > cut
            if above.any() and not above.all():
                grow(rows[~above], (*path, (names[f], False, cut)))
                grow(rows[above], (*path, (names[f], True, cut)))

    grow(np.arange(len(gap)), ())
    return paths, fitted


def fit_rules(
    x: np.ndarray, y: np.ndarray, names: list[str], weight: np.ndarray | None = None,
    trees: int = 20, depth: int = 3, l1: float = 0.001, steps: int = 1_500,
) -> RuleModel:
    """Rules from trees, weights from a lasso logistic regression (accelerated proximal steps)."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return RuleModel([], [], prior)
    weight = np.ones(len(y)) if weight is None else weight / weight.mean()
    rules: dict[tuple[Condition, ...], None] = {}
    margin = np.zeros(len(y))
    for _ in range(trees):
        p = _sigmoid(margin)
        paths, fitted = _tree_paths(x, names, y - p, depth, max(3, len(y) // 400))
        rules |= dict.fromkeys(paths)
        margin += 2 * fitted
    column = {n: x[:, i] for i, n in enumerate(names)}
    kept = list(rules)
    z = np.stack([
        np.all([(column[c] > t) == above for c, above, t in rule], axis=0) for rule in kept
    ], 1).astype(float)
    z = np.concatenate([np.ones((len(y), 1)), z], 1)
    scaled = z * weight[:, None] / len(y)
    top = np.linalg.norm(z * np.sqrt(weight / len(y))[:, None], 2) ** 2 / 4
    w = v = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(steps):
        new = v - scaled.T @ (_sigmoid(z @ v) - y) / top
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - l1 / top, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    on = np.flatnonzero(w[1:])
    return RuleModel([kept[i] for i in on], [float(w[1 + i]) for i in on], float(w[0]))


def quality(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, threshold: float = 0.3,
    label: str = "quality", per_class: int = 5_000,
) -> DataFrame:
    """Train outside the held-out fold, score everything: doc_id, held_out, score, predicted."""
    stats = stored(statistics(docs), "statistics")
    names = stats.columns[1:]
    usable = fold(F.col("doc_id"), folds) != held_fold
    sample = label_sample(labels, label, usable, per_class)
    # At most 2 * per_class rows of two numbers: small by definition.
    rows = stats.join(F.broadcast(sample), "doc_id").toPandas().sort_values(["doc_id", *names])
    # Each class weighs as much as it does among all labels.
    share = {
        r["k"]: r["n"]
        for r in labels.where(F.col("doc_id").isNotNull() & usable).where(F.col(label).isNotNull())
        .groupBy(F.col(label).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()
    }
    y = rows["label"].to_numpy(float)
    weight = np.array([share.get(int(k), 1) / max(1, (y == k).sum()) for k in y])
    model = fit_rules(rows[names].to_numpy(float), y, names, weight)
    score = model.score()
    return stats.select(
        "doc_id", (fold(F.col("doc_id"), folds) == held_fold).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
