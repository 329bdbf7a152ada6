"""Rows without id, repeated rows and very long texts, through the operators; recall as shipped."""

import collections

import numpy as np
import pytest

from snapmart.llm.bpe_codec import bpe_round_trip
from snapmart.llm.embedding_dedup import embedding_dedup
from snapmart.llm.packing import pack
from snapmart.llm.pii import find_pii
from snapmart.llm.prefix_counts import token_counts
from snapmart.llm.queries import tokenizer_path

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
LONG = "some words, mail a@b.org and +44 20 7946 0958. " * 4_000
ROWS = [(None, "first text"), (None, "first text"), (None, None), (7, "same row"), (7, "same row"), (7, "another row, x@y.org"), (8, LONG), (9, "")]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(*r, 1, "k", 2.0) for r in ROWS], "doc_id long, text string, length int, kind string, score double")


@pytest.mark.parametrize("operator", [
    lambda f: bpe_round_trip(f, WORD), lambda f: token_counts(f, BYTE, limit=5), find_pii,
])
def test_every_row_has_its_own_result(frame, operator):
    got = operator(frame).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in ROWS)
    same = [r.asDict(recursive=True) for r in got if r["doc_id"] == 7]
    assert max(collections.Counter(map(str, same)).values()) == 2


def test_a_long_text_keeps_all_its_spans(frame):
    row = next(r for r in find_pii(frame).collect() if r["doc_id"] == 8)
    assert row["n_email"] == 4_000 and row["n_phone"] == 4_000


def test_packing_places_rows_without_id_and_repeated_ones(frame):
    got = pack(frame, WORD, size=64).collect()
    whole = [r for r in got if r["piece"] == 0]
    assert collections.Counter(r["doc_id"] for r in whole) == collections.Counter(i for i, _ in ROWS)
    places = collections.defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64


def test_recall_of_the_shipped_tables(spark):
    """Pairs at cosine 0.98 in 64 dimensions, by the tables and hashes that the query uses."""
    r = np.random.default_rng(7)
    rows = []
    for i in range(400):
        a = r.normal(size=64)
        a /= np.linalg.norm(a)
        b = r.normal(size=64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = 0.981
        for k, v in enumerate((a, c * a + np.sqrt(1 - c * c) * b)):
            rows.append((2 * i + k, v.tolist(), 1))
    found = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), threshold=0.98)
    linked = sum(x["n_links"] > 0 for x in found.collect())
    assert linked >= 0.9 * len(rows)
