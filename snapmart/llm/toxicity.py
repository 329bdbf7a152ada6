"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the hashes of its distinct words, word beginnings (inflected
forms share them), pairs of neighbours and pairs one word apart. FTRL-proximal keeps a
learning rate per coordinate and an L1 term, so that only few coordinates of the table
have a weight; these are what the scoring tasks get.

The model is fitted on at most ``per_class`` labelled documents of each class (those
with the smallest hash), a documented bound; their feature lists are the only rows
that reach the driver. Where a cap binds, the bias gives back the share of the classes
over all usable labels, so that a score means the same at every size. Every document is
scored whole, in one scan.

Defined cases: a NULL or empty text has the score of the bias alone; labels without a
document or without a value are left out; without labels every score is 0.5; repeated
rows get equal scores.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.llm.chunks import chunks_of
from snapmart.llm.labelled import fold, label_sample, log_odds_of_sample
from snapmart.llm.text_map import built, filter_texts, map_texts

#: Size of the hashed feature space, as a power of two; feature 0 is the bias.
BITS = 22
#: Word beginnings that are features of their own.
STEMS = (4, 6)
KNOWN, LONG = 150_000, 200
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SKIP = np.uint64(0xC2B2AE3D27D4EB4F)


class Features:
    """Hashed features of texts; hashes of known chunks are remembered."""

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def _hashes(self, chunk: str) -> bytes:
        """Per word of the chunk: its hash and those of its beginnings."""
        out = b""
        for word in _WORD.findall(chunk.lower()):
            for part in (word, *(f"{word[:k]}*{k}" for k in STEMS)):
                out += xxhash.xxh64_digest(part)
        return out

    def __call__(self, text: str) -> np.ndarray:
        """Coordinates of all features, repeated ones included, without the bias."""
        parts = chunks_of(text)
        known = self.known
        try:
            data = b"".join(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > KNOWN:
                known.clear()
            for c in set(parts):
                if c not in known:
                    known[c] = self._hashes(c)
            data = b"".join(map(known.__getitem__, parts))
            for c in [c for c in known if len(c) > LONG] if max(map(len, parts)) > LONG else ():
                del known[c]
        table = np.frombuffer(data, ">u8").astype(np.uint64).reshape(-1, 1 + len(STEMS))
        word = table[:, 0]
        near = (word[:-1] * _MIX) ^ word[1:]
        skip = (word[:-2] * _SKIP) ^ word[2:]
        every = np.concatenate([table.ravel(), near * _MIX, skip * _MIX])
        at = (every >> np.uint64(64 - BITS)).astype(np.int64)
        return np.where(at == 0, 1, at)


@dataclass
class Model:
    """Coordinates that have a weight, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float


def fit_ftrl(
    rows: list[tuple[np.ndarray, int]], alpha: float = 3.0, beta: float = 1.0,
    l1: float = 5.0, l2: float = 0.1, epochs: int = 5, least_docs: int = 3,
) -> Model:
    """FTRL-proximal, one document at a time; the bias has no L1 term.

    Features of fewer than ``least_docs`` documents could only be learned by heart and
    are left out.
    """
    if not rows:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0)
    seen = np.zeros(1 << BITS, np.int32)
    for at, _ in rows:
        seen[at] += 1
    seen[0] = least_docs
    used = np.flatnonzero(seen >= least_docs)  # the bias comes first
    number = np.full(1 << BITS, -1, np.int32)
    number[used] = np.arange(len(used))
    rows = [(k[k >= 0], y) for k, y in ((number[at], y) for at, y in rows)]
    del seen, number
    z, n = np.zeros(len(used)), np.zeros(len(used))
    order = np.random.default_rng(7)
    bound = np.full(len(used), l1)
    bound[0] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        over = np.abs(z[at]) - bound[at]
        return np.where(over > 0, -np.sign(z[at]) * over / ((beta + np.sqrt(n[at])) / alpha + l2), 0.0)

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, y = rows[i]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = p - y
            root = np.sqrt(n[at])
            z[at] += g - (np.sqrt(n[at] + g * g) - root) / alpha * w
            n[at] += g * g
    every = weights(np.arange(len(used)))
    bias = float(every[0])
    every[0] = 0
    on = np.flatnonzero(every)
    return Model(used[on], every[on].astype(np.float32), bias)


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic",
    per_class: int = 5_000, doc_id: str = "doc_id", text: str = "text",
) -> Model:
    """Fit on labelled documents for which ``usable`` (an expression on labels.doc_id) holds."""
    sample = label_sample(labels, label, usable, per_class)
    # At most 2 * per_class rows of two numbers: small by definition.
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(
        F.broadcast(sample), "doc_id"
    )

    def function(ids: list, texts: list) -> dict[str, list]:
        features = built(("toxicity features",), Features)
        found = [np.unique(np.append(features(t), 0)).astype(np.int32) for t in texts]
        return {"doc_id": ids, "at": found}

    rows = map_texts(texts, "doc_id", "text", "at array<int>", function).join(
        F.broadcast(sample), "doc_id"
    ).select("doc_id", "at", "label")
    table = rows.toArrow()
    order = np.argsort(np.array(table["doc_id"].to_pylist(), dtype=np.int64), kind="stable")
    at, y = table["at"].combine_chunks(), table["label"].to_pylist()
    model = fit_ftrl([(at[int(i)].values.to_numpy(), y[int(i)]) for i in order])
    if len(order):
        model.bias -= log_odds_of_sample(labels, label, usable, per_class)
    return model


def _scorer(model: Model) -> Callable[[list], list[float]]:
    def score(texts: list) -> list[float]:
        features = built(("toxicity features",), Features)

        def make() -> np.ndarray:
            dense = np.zeros(1 << BITS, np.float32)
            dense[model.index] = model.weight
            return dense

        dense = built(("toxicity weights", model.weight.tobytes(), model.index.tobytes()), make)
        out = []
        for t in texts:
            at = features(t)
            hit = np.unique(at[dense[at] != 0])
            total = model.bias + float(dense[hit].sum(dtype=np.float64))
            out.append(float(1 / (1 + np.exp(-np.clip(total, -30, 30)))))
        return out

    return score


def toxicity(
    docs: DataFrame, model: Model, threshold: float = 0.7, doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per document: doc_id, score, predicted (score at or above ``threshold``)."""
    score = _scorer(model)

    def function(ids: list, texts: list) -> dict[str, list]:
        scores = score(texts)
        return {"doc_id": ids, "score": scores, "predicted": [int(s >= threshold) for s in scores]}

    return map_texts(docs, doc_id, text, "score double, predicted int", function)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept."""
    score = _scorer(model)
    return filter_texts(docs, text, lambda texts: [s < threshold for s in score(texts)])


def scored_documents(
    docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1, threshold: float = 0.7,
    per_class: int = 5_000,
) -> DataFrame:
    """Train outside the held-out fold, score everything: doc_id, held_out, score, predicted."""
    model = train(docs, labels, fold(F.col("doc_id"), folds) != held_fold, per_class=per_class)
    return toxicity(docs, model, threshold).select(
        "doc_id", (fold(F.col("doc_id"), folds) == held_fold).alias("held_out"), "score", "predicted"
    )
