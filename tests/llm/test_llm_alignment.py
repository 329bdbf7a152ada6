"""Alignment of tokenizers against whole-text libraries and brute force."""

import hashlib
import random
from collections import Counter

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from snapmart.llm import chunks
from snapmart.llm.alignment import Aligner, align_documents, aligned_buckets, packed, pair_counts, runs, unpacked
from snapmart.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ALPHABET = "abcdeghinorst aABC'’sßéüñΣİ123.,!?-_ \n\t  日本🙂́\x1c<|>&/w▁\xa0"
TEXTS = [
    None, "", " ", "   ", "\n", "plain words here", "plain words here", "it's <|endoftext|> and <s> </s> <unk>", "a  b   c",
    " leading", "trailing ", "tab\tand\nline \n x", "x" * 20_000, "word " * 3_000, "<0x41> ▁ ▁▁ a▁b", "naïve 日本語 🙂🙂",
    "aaaa" * 500, "1234567 89", "é ́x", "x  y", "ends.\n\nnew",
]


def texts(n=150):
    r = random.Random(11)
    return TEXTS + ["".join(r.choice(ALPHABET) for _ in range(r.randrange(90))) for _ in range(n)]


def brute(rows):
    """Whole texts by the libraries, all pairs of tokens compared by their ends."""
    a_side, b_side = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    helper = Aligner(A, B)
    out = []
    for text in rows:
        body = (" " + (text or "")).encode()
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        ends = []
        for ids, table in ((a, helper.bytes_a), (b, helper.bytes_b)):
            at, found = 0, []
            for i in ids:
                at += len(table[i])
                found.append(at)
            ends.append(found)
            if b"".join(table[i] for i in ids) != body:
                a = b = ()
        if not a:
            out.append(((), (), "", []))
            continue
        where = {e: k for k, e in enumerate(ends[1])}
        links = [(a[i], b[where[e]]) for i, e in enumerate(ends[0]) if e in where]
        groups, i, j = [], 0, 0
        for k, e in enumerate(ends[0]):
            if e in where:
                groups.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j : where[e] + 1])))
                i, j = k + 1, where[e] + 1
        out.append((a, b, ";".join(groups), links))
    return out


def test_alignment_equals_brute_force(spark):
    rows = texts()
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(rows)], "doc_id long, text string, bucket int, n int")
    want = brute(rows)
    # A text that holds the sign for a space is not given back, so it has no tokens.
    assert any(not w[0] and t for w, t in zip(want, rows))
    counts = Counter(link for w in want for link in w[3])
    best = Counter()
    for (a, b), n in counts.items():
        best[b] = max(best[b], n)
    # Small buckets: counts have to meet over many of them.
    got = {r["doc_id"]: r for r in align_documents(frame.repartition(3), A, B, keep_groups=True, bucket_chars=300).collect()}
    assert len(got) == len(rows)
    for i, (a, b, groups, links) in enumerate(want):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_links"], r["groups"]) == (len(a), len(b), len(links), groups), rows[i]
        assert r["n_groups"] == (groups.count(";") + 1 if groups else 0)
        assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        assert r["n_best"] == sum(counts[k] == best[k[1]] for k in links)
        assert r["count_sum"] == sum(counts[k] for k in links)


def test_runs_skip_stretches_and_follow_the_shift():
    r = random.Random(3)
    for _ in range(300):
        size = r.randrange(1, 60)
        a, b = (sorted({size, *r.sample(range(1, size + 1), r.randrange(size))}) for _ in "ab")
        both = sorted(set(a) & set(b))
        cuts = []
        for i, j, n, after_a, after_b in runs(a, b):
            assert a[i : i + n] == b[j : j + n]
            cuts += a[i : i + n]
            if i + n < after_a:
                assert a[after_a - 1] == b[after_b - 1]
                cuts.append(a[after_a - 1])
        assert cuts == both
    assert runs(list(range(1, 100)), list(range(1, 100))) == [(0, 0, 99, 99, 99)]


def test_places_are_packed_by_planes():
    import numpy as np

    for places in ([], [0], [1, 70_000, 5, 16_777_217]):
        assert unpacked(packed(np.array(places, np.int64))).tolist() == places


def test_known_chunks_are_bounded(monkeypatch):
    aligner = Aligner(A, B)
    rows = [t for t in texts(40) if t]
    whole = aligner.align(rows).groups
    monkeypatch.setattr(chunks, "TABLE", 5)
    assert [aligner.align([t]).groups[0] for t in rows] == whole
    fresh = Aligner(A, B)
    assert [fresh.align([t]).groups[0] for t in rows] == whole
    assert len(fresh.table.keys) <= 10 and all(len(c) <= chunks.LONG for c in fresh.table.keys.to_pylist())


@pytest.mark.parametrize("rows", [[], [(None, None)], [(None, "one text"), (None, "one text"), ("x", "")]])
def test_empty_null_and_repeated(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    got = align_documents(frame, A, B).collect()
    assert sorted((str(r["doc_id"]), r["n_links"], r["count_sum"]) for r in got) == sorted(
        (str(i), 2 * bool(t), 4 * bool(t)) for i, t in rows
    )


def test_pair_counts_are_the_dictionary(spark):
    frame = spark.createDataFrame([(1, "same words same"), (2, "same")], "doc_id int, text string")
    buckets = aligned_buckets(frame, A, B)
    n_b = SentencePieceProcessor(model_file=B).get_piece_size()
    got = {(r["a"], r["b"]): r["n"] for r in pair_counts(buckets, n_b).collect()}
    assert sum(got.values()) == 4 and max(got.values()) == 3
