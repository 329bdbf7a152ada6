"""A Merkle manifest of a dataset: one root for all rows, and a proof for every row.

A row's leaf is the SHA-256 of its fields, each written with its length, so no two
rows write the same bytes. Leaves are ordered inside their group (a language); every
eight neighbours become the digest of their digests, until one is left, the group's
subroot; subroots, ordered by group, give the root in the same way.

The manifest is a content-addressed graph: one record (digest, children) per node,
whatever its place. A proof is found by *descent*: requests start at the root, and the
digits of a leaf's number in base 8 name the child to go to on each level. The children
passed over are the proof. All requests below a node descend as one row, so a level
moves no more rows than it has wanted nodes, and a row meets its own path only on the
last step. The path is then turned round and folded from the leaf to the root.

Only DataFrame operations; texts never travel, only digests of 32 bytes. Numbers come
from ``numbering.numbered``, which spreads large groups; every task of a level holds
runs of eight rows. Levels are written to the shared folder.

Defined cases: a NULL field is written ``-``, which no value is; a NULL group is a
group of its own and comes first; NULL ``doc_id`` comes before others; rows repeated
with all fields are leaves of their own; an empty table has no root and no proofs;
columns that are not named as fields are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.llm.common import stored
from snapmart.llm.numbering import numbered

#: Neighbours that become one node: 2 to the power of these bits; bytes of a digest.
BITS, WIDTH = 3, 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass(frozen=True)
class Manifest:
    """``leaves``: group, number, n, leaf and payload; ``levels`` and ``top``: records, lowest first."""

    leaves: DataFrame
    levels: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: str | None


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of the fields: ``-`` where NULL, else UTF-8 byte count, ``:`` and the value."""
    texts = [f.cast("string") for f in fields]
    written = [
        F.when(t.isNull(), F.lit("-")).otherwise(
            F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)
        )
        for t in texts
    ]
    return F.unhex(F.sha2(F.concat(*written), 256))


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def _largest(nodes: DataFrame) -> int:
    return nodes.agg(F.max("n")).first()[0] or 0


def _grow(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels over ``leaves`` (group, number, n, digest), and each group's last digest (group, n, digest)."""
    largest = _largest(leaves)
    nodes = leaves.select("group", "number", "digest", F.col("n").alias("here"), "n")
    levels: list[DataFrame] = []
    done = nodes.where("here = 1")
    while largest > 1:
        pair = F.struct("number", "digest")
        nodes = stored(
            nodes.where("here > 1")
            .groupBy("group", F.shiftright("number", BITS).alias("number"))
            .agg(F.array_sort(F.collect_list(pair)).alias("run"), F.max("here").alias("here"), F.max("n").alias("n"))
            .withColumn("joined", F.array_join(F.transform("run", lambda x: _hex(x["digest"])), ""))
            .select(
                "group", "number", "n", F.ceil(F.col("here") / (1 << BITS)).cast("long").alias("here"),
                F.unhex(F.sha2("joined", 256)).alias("digest"), F.unhex("joined").alias("children"),
            ),
            f"{name}-{len(levels) + 1}",
        )
        levels.append(nodes)
        done = done.unionByName(nodes.where("here = 1").drop("children"))
        largest = -(-largest >> BITS)
    records = [level.select("digest", "children").dropDuplicates(["digest"]) for level in levels]
    return records, done.select("group", "n", "digest")


def build(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id",
    payload: dict[str, Column] | None = None,
) -> Manifest:
    """The manifest of ``docs``; ``payload`` are further columns to carry with the leaves."""
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    entries = docs.select(
        F.col(order).alias("id"), key.alias("group"),
        leaf_digest([F.col(f) for f in fields]).alias("digest"),
        *[c.alias(n) for n, c in (payload or {}).items()],
    )
    leaves = numbered(entries, "group", ["id", "digest"], "leaves")
    levels, subroots = _grow(leaves, "nodes")
    # The number of a subroot is its group's place; a group's name stays beside it.
    ordered = numbered(subroots.withColumnRenamed("n", "size").withColumn("all", F.lit(0)), "all", ["group"], "subroots")
    top, last = _grow(ordered.select(F.lit("").alias("group"), "number", "n", "digest"), "top")
    root = last.select(_hex(F.col("digest")).alias("root")).first()
    return Manifest(leaves, levels, ordered, top, root["root"] if root else None)


def _segment(slot: Column) -> Column:
    """The children beside the chosen one: those before it and those after it."""
    children = F.col("children")
    return F.struct(
        F.substring(children, F.lit(1), slot * WIDTH).alias("before"),
        F.substring(children, slot * WIDTH + (WIDTH + 1), F.length(children)).alias("after"),
    )


def _down(front: DataFrame, records: DataFrame) -> DataFrame:
    """From nodes to their children: ``number`` gets a digit, ``path`` the children beside."""
    slots = F.sequence(F.lit(0), (F.length("children") / WIDTH).cast("int") - 1)
    carried = [c for c in front.columns if c not in ("digest", "number", "path")]
    slot = F.col("slot")
    return (
        front.join(records, "digest")
        .select("*", F.explode(slots).alias("slot"))
        .select(
            *carried, (F.shiftleft("number", BITS) + slot).alias("number"),
            F.substring(F.col("children"), slot * WIDTH + 1, F.lit(WIDTH)).alias("digest"),
            F.concat("path", F.array(_segment(slot))).alias("path"),
        )
    )


def paths(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """For each requested leaf its row, its ``subroot`` and its ``path`` from the leaf up.

    ``requests``: group and number (repeated ones count once); NULL asks for all leaves.
    ``path`` holds a pair (before, after) of joined digests per level.
    """
    empty = F.array().cast("array<struct<before:binary,after:binary>>")
    top = manifest.leaves.sparkSession.createDataFrame([(manifest.root or "",)], "root string").select(
        F.unhex("root").alias("digest"), F.lit(0).cast("long").alias("number"), empty.alias("path")
    )
    for records in reversed(manifest.top):
        top = _down(top, records)
    starts = top.drop("digest").join(manifest.subroots, "number").select(
        "group", F.lit(0).cast("long").alias("number"), "digest", F.col("digest").alias("subroot"), "path", "size"
    )
    wanted = manifest.leaves
    if requests is not None:
        asked = requests.select("group", "number").dropDuplicates()
        wanted = wanted.join(asked, ["group", "number"], "left_semi")

    def asked_for(front: DataFrame, level: int) -> DataFrame:
        if requests is None:
            return front
        prefixes = asked.select("group", F.shiftright("number", BITS * level).alias("number")).dropDuplicates()
        return front.join(prefixes, ["group", "number"], "left_semi")

    front = None
    for level in range(len(manifest.levels), 0, -1):
        low, high = 1 << BITS * (level - 1), 1 << BITS * level
        here = starts.where((F.col("size") > low) & (F.col("size") <= high)).drop("size")
        front = asked_for(here if front is None else front.unionByName(here), level)
        if level > 1:
            front = _down(front, manifest.levels[level - 1])
    alone = starts.where("size = 1").withColumn("children", F.lit(None).cast("binary"))
    last = alone.select("group", F.col("number").alias("parent"), "subroot", "path", "children")
    if front is not None:
        met = front.join(manifest.levels[0], "digest")
        last = last.unionByName(met.select("group", F.col("number").alias("parent"), "subroot", "path", "children"))
    # The last step: each leaf takes its digit of its parent's children.
    slot = F.col("number").bitwiseAND((1 << BITS) - 1).cast("int")
    below = F.when(F.col("children").isNull(), empty).otherwise(F.array(_segment(slot)))
    return (
        wanted.withColumn("parent", F.shiftright("number", BITS))
        .join(last, ["group", "parent"])
        .select(*wanted.columns, "subroot", F.reverse(F.concat("path", below)).alias("path"))
    )


def fold(digest: Column, path: Column) -> Column:
    """The root (hex) that a leaf and its path give."""
    return F.aggregate(
        path, _hex(digest),
        lambda at, s: F.sha2(F.concat(_hex(s["before"]), at, _hex(s["after"])), 256),
    )


def proof_text(path: Column) -> Column:
    """All digests of a path in hex, level by level from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(_hex(s["before"]), _hex(s["after"]))), "")


def audit(docs: DataFrame, claimed: Column) -> DataFrame:
    """Every row's proof, and whether its ``claimed`` digest (NULL: the leaf itself) folds to the root."""
    manifest = build(docs, payload={"claimed": claimed})
    found = paths(manifest).withColumn("folded_root", fold(F.coalesce("claimed", "digest"), F.col("path")))
    root = F.lit(manifest.root).cast("string")
    return found.select(
        F.col("id").alias("doc_id"), _hex(F.col("digest")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
        root.alias("root"), F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == root).alias("verified"),
    )
