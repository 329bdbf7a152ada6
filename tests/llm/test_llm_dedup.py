"""Deduplication operators against brute force on small tables."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest

from snapmart.llm import exact_dedup as X
from snapmart.llm.components import components
from snapmart.llm.embedding_dedup import embedding_dedup, hadamard, polytope_keys
from snapmart.llm.near_dedup import near_dedup, super_minhash
from snapmart.llm.suffix_dedup import suffix_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows):
    schema = "doc_id long, text string, key string, rep long, n int"
    return spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], schema)


def corpus():
    r = random.Random(8)
    rows = [None, "", "  ", "one", "One", "É", "é", "two words", "Two words", "a b c d", "x" * 20_000, "-" * 300]
    base = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(120)]
    for k in range(25):
        edited = list(base)
        for _ in range(k // 4):
            edited[r.randrange(len(edited))] = "edit" + str(r.randrange(99))
        rows.append(" ".join(edited))
    rows += [" ".join(r.choice(WORDS) for _ in range(r.randrange(3, 60))) for _ in range(25)]
    rows += [rows[14]] * 30 + [rows[40].upper()] * 2
    order = list(range(len(rows)))
    r.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("capacity, block", [(1_000_000, 2_000), (3, 4)])
def test_exact_dedup(spark, capacity, block):
    rows = corpus()
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    got = {r["doc_id"]: r for r in X.exact_dedup(frame(spark, rows), capacity=capacity, block=block).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        members = groups[lower(t)]
        assert (got[i]["keep_id"], got[i]["group_size"]) == (max(members), len(members))
        assert got[i]["kept"] == (i == max(members))
        assert got[i]["text_sha256"] == hashlib.sha256(lower(t).encode()).hexdigest()
    if capacity == 3:
        per_bucket = {}
        for t, members in groups.items():
            per_bucket.setdefault(got[members[0]]["bucket"], set()).add(t)
        assert max(map(len, per_bucket.values())) <= 3 and len(per_bucket) > 5


def test_chained_keys_are_told_apart_by_their_bytes(spark):
    found = spark.createDataFrame(
        [(1, 7, "d", 3, 3), (2, 7, "d", 3, 3), (3, 7, "d", 3, 3)],
        "doc_id long, key long, digest string, keep_id long, group_size long",
    )
    other = spark.createDataFrame(
        [(1, 7, "d", "x"), (2, 7, "d", "x")], "doc_id long, key long, digest string, body string"
    )
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in X._rechain(found, other).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 3: (3, 1)}


def test_exact_dedup_defined_cases(spark):
    rows = [(None, "a"), (None, "a"), (1, "a"), (2, "b"), (2, "b"), (None, "z")]
    got = sorted(map(str, ((r["doc_id"], r["keep_id"], r["group_size"], r["kept"])
                           for r in X.exact_dedup(frame(spark, rows)).collect())))
    assert got == sorted(map(str, [(None, 1, 3, False), (None, 1, 3, False), (1, 1, 3, True),
                                   (2, 2, 2, True), (2, 2, 2, True), (None, None, 1, True)]))
    assert X.exact_dedup(frame(spark, rows).where("n > 5")).count() == 0


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("words, block", [(4, 200), (5, 200), (4, 4)])
def test_near_dedup(spark, monkeypatch, words, block):
    monkeypatch.setattr("snapmart.llm.near_dedup.BLOCK", block)
    rows = corpus()
    sets = {i: shingles(t, words) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    want = roots(sets, links)
    got = {r["doc_id"]: r for r in near_dedup(frame(spark, rows), words=words).collect()}
    assert len(set(want.values())) < len(rows) - 30
    for i in sets:
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(sets[i]), want[i])
        assert got[i]["kept"] == (want[i] == i)


def test_near_dedup_defined_cases(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (6, None), (7, None)]
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in near_dedup(frame(spark, rows)).collect())
    assert got == [("5", "5", True), ("5", "5", True), ("6", "6", True), ("7", "7", True), ("None", "None", True)]
    assert near_dedup(frame(spark, rows).where("n > 5")).count() == 0


def test_super_minhash_estimates_similarity():
    r = np.random.default_rng(3)
    for size in (5, 40, 400, 3000):
        pool = r.integers(0, 2**63, 2 * size, dtype=np.uint64)
        sets = [np.unique(pool[:size]), np.unique(pool[size // 4 : size + size // 4])]
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        a, b = super_minhash(sets, 160)
        assert abs((a == b).mean() - true) < 0.2
        alone = super_minhash(sets[:1], 160)[0]
        assert (alone == a).all()


def test_components(spark):
    r = random.Random(9)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)]
    links += [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    r.shuffle(links)
    want = roots({x for link in links for x in link}, [x for x in links if x[0] != x[1]])
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert got == {n: root for n, root in want.items() if n != root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def without_repeats(rows, length=100):
    """Per (doc_id, text), by comparing all strings with those that start earlier."""
    rows = sorted(set(rows), key=lambda row: (row[0] is not None, row[0] or 0))
    first, out = {}, {}
    for i, t in rows:
        b, place = (t or "").encode(), (i is not None, i or 0)
        for k in range(len(b) - length + 1):
            first[b[k : k + length]] = min(first.get(b[k : k + length], (place, k)), (place, k))
    for i, t in rows:
        b, place = (t or "").encode(), (i is not None, i or 0)
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < (place, k):
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.setdefault(i, []).append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {i: sorted(x) for i, x in out.items()}


def suffix_results(df, **options):
    got = {}
    for row in suffix_dedup(df, **options).distinct().collect():
        got.setdefault(row[0], []).append(tuple(row)[1:])
    return {i: sorted(x) for i, x in got.items()}


def test_suffix_dedup_over_tasks_ids_and_lengths(spark):
    r = random.Random(11)
    passage = " ".join(r.choice(WORDS) + str(r.randrange(99)) for _ in range(90))
    rows = [(i, f"{r.random()} {passage[a : a + r.randrange(90, 260)]} {r.random()}")
            for i, a in enumerate(r.randrange(300) for _ in range(60))]
    rows += [(100, " " * 700 + passage), (101, "ab" * 150 + "x" + "abc" * 100), (102, passage), (103, passage)]
    rows += [(None, passage[50:300]), (7, passage[:200] + "other text"), (102, passage), (8, None), (200, "é" * 300)]
    r.shuffle(rows)
    df = frame(spark, rows).repartition(7)
    assert suffix_results(df) == without_repeats(rows)
    assert suffix_dedup(df).count() == len(rows)
    for length in (1, 5, 33, 150):
        assert suffix_results(df, length=length) == without_repeats(rows, length)


def test_suffix_dedup_of_a_text_longer_than_a_slab(spark):
    r = random.Random(12)
    text = "".join(r.choice("abcdefgh") for _ in range(150_000))
    rows = [(1, text), (2, text[60_000:70_000] + "-" + text[65_000:65_099]), (3, "z" * 130_000)]
    assert suffix_results(frame(spark, rows)) == without_repeats(rows)


def test_suffix_dedup_stores_less_than_its_texts(spark):
    r = random.Random(13)
    texts = ["".join(r.choice(WORDS) + r.choice("0123456789abcdef ") for _ in range(900)) for _ in range(100)]
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = size()
    assert suffix_dedup(frame(spark, list(enumerate(texts)))).count() == 100
    assert size() - before < sum(map(len, texts))


def test_suffix_dedup(spark):
    r = random.Random(10)
    passage = " ".join(r.choice(WORDS) for _ in range(60))
    rows = [(1, None), (2, ""), (3, passage), (4, "start " + passage + " end"), (5, passage[:250] + "é" * 60),
            (6, "ab" * 300), (7, passage[100:] + passage[:200]), (8, "short"), (9, "é" * 120), (10, passage)]
    seen, want = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        want[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    got = {x[0]: tuple(x)[1:] for x in suffix_dedup(frame(spark, rows)).collect()}
    assert got == want
    assert suffix_dedup(frame(spark, rows).where("n > 5")).count() == 0


def vectors():
    r = np.random.default_rng(12)
    rows = []
    for k in range(60):
        v = r.normal(size=16)
        rows.append((v, k % 3))
        for scale in (0.02, 0.1, 0.3):
            rows.append((v + scale * r.normal(size=16), k % 3))
    rows += [(rows[0][0], 0)] * 20 + [(rows[0][0], 1), (rows[0][0] * 2, 0), (rows[4][0], None)]
    rows = [([float(x) for x in v], label) for v, label in rows]
    rows += [([1.0, 2.0], 0), ([1.0, 2.01], 0), ([3.0, -1.0], 0)]
    rows += [(None, 0), ([0.0] * 16, 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0), ([1.0] + [None] * 15, 0), ([1.0, 0.0], 0)]
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


@pytest.mark.parametrize("block", [400, 3])
def test_embedding_dedup(spark, block):
    rows = vectors()
    fine = {
        i: np.array(v) / np.linalg.norm(v) for i, v, label in rows
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v)
    }
    label = {i: x for i, _, x in rows}
    links = [(a, b) for a in fine for b in fine if a < b and label[a] == label[b]
             and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= 0.98]
    count = {i: 0 for i, _, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    want = roots(count, links)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "vec_id long, embedding array<double>, label int, key string, size int")
    got = {r["vec_id"]: r for r in embedding_dedup(df, block=block).collect()}
    assert len(links) > 150
    for i in count:
        assert (got[i]["n_links"], got[i]["component_id"]) == (count[i], want[i]), i
        assert got[i]["kept"] == (want[i] == i)
    assert embedding_dedup(df.where("vec_id < 0")).count() == 0


def test_hashing_brings_close_vectors_together():
    r = np.random.default_rng(13)
    x = r.normal(size=(3000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = (polytope_keys(v, 8, 2) for v in (x, 0.98 * x + np.sqrt(1 - 0.98**2) * z))
    met = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3))
    assert met.mean() >= 0.99
    assert np.allclose(np.linalg.norm(hadamard(x[:, :32]), axis=1), np.linalg.norm(x[:, :32], axis=1))
