"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

1. *Signatures.* One scan hashes the distinct word shingles of every whole text. In
   round j every shingle puts the value j + r into the next place of its own random
   permutation of the slots; a slot keeps its smallest value, and a document stops as
   soon as no later round can change a slot. All documents of a slice go through the
   rounds together. Identical shingle sets are one class from here on.
2. *Banding.* ``bands`` groups of ``rows`` slots are hashed; classes that share a
   band's value are candidates. With 32 bands of 5 rows a pair at similarity 0.8 is
   missed with a chance of 3 in a million. A bucket is never expanded into pairs: its
   members are tied to its smallest one, and what hangs together is a family.
3. *Verification.* A family is compared in blocks, on full sets computed from the whole
   texts again. Families of up to ``BLOCK`` classes are one block. Larger ones are
   split by size class (two sets that are linked lie in the same or in neighbouring
   ones) and dealt into blocks, and pairs of blocks meet, so a text is copied once per
   ``BLOCK`` members and not per pair. A block pair hands on a spanning forest of its
   links, never the pairs.
4. *Grouping.* Components of the forest edges; the smallest doc_id stays.

Sets are compared as 64-bit hashes of shingles. Defined cases: NULL, empty and blank
texts have no shingles and stay alone; texts of fewer words than a shingle are one
shingle; copies and repeated rows share a component; a row without doc_id stays alone,
without component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.llm.common import stored
from snapmart.llm.components import UnionFind, components
from snapmart.llm.text_map import built, map_texts

KNOWN, LONG = 150_000, 200
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)
#: Classes that are compared with each other in one go.
BLOCK = 200
#: Shingles per step of the intersection counts.
COLUMNS = 4096


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text; A-Z lower-cased, ASCII white space splits."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, bytes] = {}

    def __call__(self, text: str) -> np.ndarray:
        parts = text.encode().lower().split()
        if not parts:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            data = b"".join(map(known.__getitem__, parts))
        except KeyError:
            if len(known) > KNOWN:
                known.clear()
            for w in set(parts):
                if w not in known:
                    known[w] = xxhash.xxh64_digest(w)
            data = b"".join(map(known.__getitem__, parts))
            if max(map(len, parts)) > LONG:
                for w in {w for w in parts if len(w) > LONG}:
                    del known[w]
        word = np.frombuffer(data, ">u8").astype(np.uint64)
        k = min(self.words, len(word))
        out = np.full(len(word) - k + 1, np.uint64(k))
        for i in range(k):
            out = mix(out * _A + word[i : len(word) - k + 1 + i])
        return np.unique(out)


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures (documents x slots, 32-bit) of non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    least = np.full(len(sets) * slots, np.inf)
    turn: np.ndarray | None = None
    for j in range(slots):
        u = mix(element + np.array([j + 1], np.uint64) * _A)
        value = j + (u >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = j + ((mix(u) >> np.uint64(32)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        if turn is None:
            place = pick
        else:
            rows = np.arange(len(element))
            place = turn[rows, pick].astype(np.int64)
            turn[rows, pick] = turn[:, j]
        np.minimum.at(least, owner * slots + place, value)
        # Later rounds only have larger values.
        open_ = least.reshape(-1, slots).max(axis=1) >= j + 1
        on = open_[owner]
        if not on.any():
            break
        if turn is None:
            element, owner, pick = element[on], owner[on], pick[on]
            turn = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(element), 1))
            turn[np.arange(len(element)), pick] = 0
        elif on.mean() < 0.8:
            element, owner, turn = element[on], owner[on], turn[on]
    bits = mix(least.view(np.uint64))
    return (bits >> np.uint64(32)).astype(np.uint32).reshape(-1, slots)


def signatures(
    docs: DataFrame, words: int, bands: int, rows: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, set_key, keys (one 64-bit value per band of the signature)."""

    def function(ids: list, texts: list) -> dict[str, list]:
        shingler = built(("shingles", words), lambda: Shingler(words))
        sets = [shingler(t) for t in texts]
        full = [i for i, s in enumerate(sets) if len(s)]
        out: dict[str, list] = {
            "doc_id": ids, "n_shingles": [len(s) for s in sets],
            "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "keys": [[]] * len(sets),
        }
        if full:
            found = super_minhash([sets[i] for i in full], bands * rows)
            key = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _A, (len(full), 1))
            for r in range(rows):
                key = mix(key * _A + found.reshape(len(full), bands, rows)[:, :, r].astype(np.uint64))
            key = key.view(np.int64)
            for k, i in enumerate(full):
                out["keys"][i] = key[k]
        return out

    schema = "n_shingles bigint, set_key binary, keys array<bigint>"
    return map_texts(docs, doc_id, text, schema, function)


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a block's sets."""
    n = len(sets)
    if n <= 6:
        out = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Shingles of one set alone can't be shared.
    often = count > 1
    number = np.cumsum(often) - 1
    keep = often[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int(often.sum())
    cuts = np.searchsorted(column, np.arange(0, total + COLUMNS, COLUMNS))
    out = np.zeros((n, n), np.float32)
    for k in range(len(cuts) - 1):
        part = slice(cuts[k], cuts[k + 1])
        held = np.zeros((n, COLUMNS), np.float32)
        held[owner[part], column[part] - k * COLUMNS] = 1
        out += held @ held.T
    return np.rint(out)


def block_links(
    ids: list[int], sides: list[int], sets: list[np.ndarray], percent: int
) -> list[tuple[int, int]]:
    """A spanning forest of the links in one block (one side), or between two blocks."""
    both = intersections(sets)
    size = np.array([len(s) for s in sets], np.float64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    side = np.array(sides)
    if len(set(sides)) > 1:
        linked &= side[:, None] != side[None, :]
    forest = UnionFind()
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        forest.union(ids[i], ids[j])
    return [(x, root) for x in forest.parent if (root := forest.find(x)) != x]


def _meetings(families: DataFrame) -> DataFrame:
    """Families (family, rep, n_shingles) to rows (pair, side, rep): which blocks meet.

    Blocks are (size class, number); a block meets itself, the others of its class and
    those of the next class. Families that fit into one block have one class.
    """
    total = families.groupBy("family").agg(F.count("*").alias("total"))
    classed = families.join(total, "family").withColumn(
        "size", F.when(F.col("total") > BLOCK, F.floor(F.log("n_shingles") / F.log(F.lit(1.25)))).otherwise(0).cast("int")
    )
    counts = classed.groupBy("family", "size").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = counts.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("size", "blocks"))).alias("sizes"))
    placed = classed.join(sizes, "family")

    def blocks(step: int) -> Column:
        return F.coalesce(F.try_element_at("sizes", F.col("size") + step), F.lit(0))

    def others(step: int) -> Column:
        n = blocks(step)
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    placed = placed.withColumn("at", F.pmod(F.xxhash64("rep"), blocks(0)).cast("int"))
    here, at = F.col("size"), F.col("at")

    def pair(c1: Column, a1: Column, c2: Column, a2: Column, side: Column) -> Column:
        return F.struct(
            c1.alias("c1"), a1.alias("a1"), c2.alias("c2"), a2.alias("a2"), side.cast("int").alias("side")
        )

    rows = F.concat(
        F.transform(others(0), lambda o: pair(here, F.least(at, o), here, F.greatest(at, o), at > o)),
        F.transform(others(1), lambda o: pair(here, at, here + 1, o, F.lit(0))),
        F.transform(others(-1), lambda o: pair(here - 1, o, here, at, F.lit(1))),
    )
    return placed.select("family", "rep", F.inline(rows))


def _confirmed(meetings: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Forest edges (a, b) of the links on full sets; texts travel to their blocks.

    Meetings grow with the corpus, so they meet their texts in a sorted join at every size.
    """
    keys = ["family", "c1", "a1", "c2", "a2"]
    texts = (
        docs.join(meetings.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id")
        .repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "side", "doc_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = built(("shingles", words), lambda: Shingler(words))
        current, ids, sides, sets = None, [], [], []

        def links() -> pa.RecordBatch:
            found = block_links(ids, sides, sets, percent) if len(ids) > 1 else []
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for *key, side, doc, text in zip(*(batch.column(c).to_pylist() for c in (*keys, "side", "doc_id", "text"))):
                if key != current:
                    if current is not None and len(ids) > 1:
                        yield links()
                    current, ids, sides, sets = key, [], [], []
                if not ids or ids[-1] != doc:
                    ids.append(doc)
                    sides.append(side)
                    sets.append(shingler(text or ""))
        yield links()

    return texts.select(*keys, "side", "doc_id", "text").mapInArrow(run, "a long, b long")


def near_dedup(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = stored(signatures(source, words, bands, rows), "signatures")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    member = stored(
        signed.select("doc_id", "n_shingles", "set_key").join(classes, "set_key", "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"),
        ),
        "members",
    )
    reps = (
        signed.where("n_shingles > 0")
        .join(classes.withColumnRenamed("rep", "doc_id"), ["set_key", "doc_id"], "left_semi")
        .dropDuplicates(["doc_id"])
        .withColumnRenamed("doc_id", "rep")
    )
    entries = reps.select("rep", F.explode("keys").alias("key"))
    buckets = entries.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1")
    ties = entries.join(buckets, "key").where("rep != head").select(
        F.col("rep").alias("a"), F.col("head").alias("b")
    )
    tied = components(ties)
    family = tied.select(F.col("node").alias("rep"), F.col("root").alias("family")).unionByName(
        tied.select(F.col("root").alias("rep"), F.col("root").alias("family")).distinct()
    )
    families = stored(
        family.join(reps.select("rep", "n_shingles"), "rep").select("family", "rep", "n_shingles"), "families"
    )
    found = components(_confirmed(_meetings(families), source, words, percent))
    return (
        member.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "rep").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
