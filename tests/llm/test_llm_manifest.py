"""Merkle manifest and shards against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from snapmart.llm import merkle, sharding
from snapmart.llm.numbering import numbered
from snapmart.llm.queries import QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, number int, n int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def climb(level):
    """Root and, per place, the siblings (before, after) level by level."""
    paths, width = [[] for _ in level], 1
    while len(level) > 1:
        for at in range(len(paths)):
            here = at // width
            run = level[here // 8 * 8 : here // 8 * 8 + 8]
            paths[at].append(("".join(run[: here % 8]), "".join(run[here % 8 + 1 :])))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        width *= 8
    return level[0], paths


def brute(rows):
    """Per row (as a multiset): leaf, subroot, root, proof, in the contract's order."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g])]) for g in order}
    root, above = climb([trees[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        subroot, paths = trees[g]
        for (_, _, found), path in zip(sorted(groups[g]), paths):
            proof = sha("".join(a + b for a, b in [*path, *above[k]]))
            out.append((found, subroot, root, proof))
    return sorted(out)


def rows_of(n, langs=("en", "de", None, "zz", "é", ""), seed=1):
    r = random.Random(seed)
    weights = [n, 70, 9, 8, 1, 1]
    found = [(i, r.choice([None, "a", "ü"]), r.choices(langs, weights)[0], r.choice([None, 5]), r.choice([None, "", "Text ÀÉ A", "low"]))
             for i in range(n)]
    return [(*x, "d", 1, 2) for x in found]


@pytest.mark.parametrize("rows", [
    rows_of(700), rows_of(64, ("en",) * 6), rows_of(65, ("en",) * 6), rows_of(1), rows_of(9, ("a", "b", "c", "d", "e", "f")),
    [*rows_of(20), (None, "a", "en", 1, "x", "", 0, 0), (None, "b", "en", 1, "x", "", 0, 0), *rows_of(20)[:4] * 3],
])
def test_manifest_equals_plain_python(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.audit(frame, F.lit(None).cast("binary")).collect()
    assert sorted((r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == brute(rows)
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in got)


def test_empty_table(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA), F.lit(None).cast("binary")).collect() == []


def test_only_changed_rows_fail(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    rows = {r["doc_id"]: r for r in QUERIES["op13_merkle_manifest"](spark, small).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        lowered = "".join(c.lower() if c.isascii() else c for c in d["text"] or "")
        changed = zlib.crc32(str(d["doc_id"]).encode()) % 3 == 0 and lowered != (d["text"] or "")
        assert rows[d["doc_id"]]["verified"] == (not changed)


def test_single_requests_descend_alone(spark):
    rows = rows_of(300)
    manifest = merkle.build(spark.createDataFrame(rows, SCHEMA))
    everything = {(r["group"], r["number"]): r for r in merkle.paths(manifest).collect()}
    asked = [("=en", 0), ("=en", 77), ("=en", 77), ("", 0), ("=é", 0), ("=nowhere", 1)]
    requests = spark.createDataFrame([k for k in asked], "group string, number long")
    got = merkle.paths(manifest, requests).collect()
    assert {(r["group"], r["number"]) for r in got} == {k for k in asked if k in everything} and len(got) <= 4
    assert all(r["path"] == everything[r["group"], r["number"]]["path"] for r in got)


def test_records_are_addressed_by_content(spark):
    manifest = merkle.build(spark.createDataFrame(rows_of(200), SCHEMA))
    for records in manifest.levels:
        found = records.collect()
        assert len({bytes(r["digest"]) for r in found}) == len(found)
        assert all(sha(bytes(r["children"]).hex()) == bytes(r["digest"]).hex() for r in found)


def test_numbers_are_gapless_with_ties_and_hot_groups(spark):
    rows = [("a", None)] * 50 + [("a", i % 7) for i in range(100)] + [("b", 1)] * 30 + [("c", 5)]
    frame = spark.createDataFrame(rows, "g string, x int").repartition(4)
    got = numbered(frame, "g", ["x"], "numbers").collect()
    for g, n in (("a", 150), ("b", 30), ("c", 1)):
        mine = sorted((r["number"], r["x"] is not None, r["x"] or 0) for r in got if r["g"] == g)
        assert [m[0] for m in mine] == list(range(n)) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        assert {r["n"] for r in got if r["g"] == g} == {n}


# --------------------------------------------------------------------------- shards


def descend(key, tree):
    path = ""
    for nodes in sharding.levels(tree):
        path = min(
            (-math.log((int(hashlib.md5(f"{key}:{c}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13) / w, c)
            for c, w in nodes[path].items()
        )[1]
    return int(path.rsplit("/", 1)[1])


def test_shards_equal_plain_python(spark):
    rows = [(None, "x"), (None, "x"), (1, None), (2, ""), (3, "ü🙂"), *((i, "t" * i) for i in range(3, 150))]
    frame = spark.createDataFrame([(*r, 1, 2, "s") for r in rows], "doc_id long, text string, shard int, n int, size string")
    old, new = sharding.layout(40), sharding.layout(41)
    got = sharding.assign(frame, old, new).collect()
    want = Counter()
    for i, t in rows:
        body, key = (t or "").encode(), "" if i is None else i
        want[i, len(body) + 16, zlib.crc32(body), "key", descend(key, old), descend(key, new)] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(frame.where("false"), old).collect() == []


def keys(spark, n=20_000):
    return spark.range(n).withColumnRenamed("id", "doc_id")


def test_each_new_shard_takes_rows_only_into_itself(spark):
    for n in (40, 41, 44):
        moved = sharding.moves(keys(spark), sharding.layout(n), sharding.layout(n + 1)).collect()
        assert {r["to_shard"] for r in moved} == {n}
        assert 0.7 * 20_000 / (n + 1) < sum(r["rows"] for r in moved) < 1.3 * 20_000 / (n + 1)


def test_a_changed_weight_moves_rows_only_through_its_nodes(spark):
    old = sharding.layout(40)
    new = [(r, k, s, 3.0 if s == 13 else w) for r, k, s, w in old]
    region, rack = {s: r for r, _, s, _ in old}, {s: (r, k) for r, k, s, _ in old}
    for before, after in ((old, new), (new, old)):
        moved = sharding.moves(keys(spark), before, after).collect()
        assert moved
        for m in moved:
            a, b = m["from_shard"], m["to_shard"]
            if region[a] != region[b]:  # into or out of the changed region
                assert region[13] in (region[a], region[b])
            elif rack[a] != rack[b]:
                assert region[a] == region[13] and rack[13] in (rack[a], rack[b])
            else:
                assert 13 in (a, b)


def test_weights_are_shares(spark):
    tree = [(0, 0, 0, 1.0), (0, 1, 1, 2.0), (1, 0, 2, 5.0), (1, 0, 3, 0.0)]
    got = {r["shard"]: r["count"] for r in sharding.place(keys(spark), F.col("doc_id"), tree).groupBy("shard").count().collect()}
    assert set(got) == {0, 1, 2}
    assert all(abs(got[s] / 20_000 - w / 8) < 0.02 for s, w in ((0, 1), (1, 2), (2, 5)))


def test_shards_are_written_as_folders(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "out"), sharding.layout(8))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200 and back.select("__shard").distinct().count() == 8
