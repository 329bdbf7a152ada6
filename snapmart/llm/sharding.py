"""Shards by a weighted hash tree: region, rack, shard.

A document descends the tree. On each level every child draws a number from the hash of
(doc_id, child) and its weight, ``-ln(u) / weight``, and the smallest draw wins, so a
child is chosen in proportion to its weight, and the weight of a node is the sum of its
shards' weights. A draw depends on nothing but the document, the child and the child's
weight. Hence a changed weight moves documents only into or out of the nodes whose
weights change: outside the changed region nothing moves between its neighbours, and
within it nothing moves between the racks beside the changed one. A new shard opens a
region of its own (``layout``), which makes it the only node whose weight changes: it
takes rows, and no other shard does.

Only DataFrame operations: three draws over at most a few dozen children a row, no
shuffle, no state. Rows are then numbered inside their shards (``numbering.numbered``)
by their digests' columns alone; texts do not travel.

Defined cases: a NULL text has no bytes; a NULL ``doc_id`` draws like an empty one; rows
that share a ``doc_id`` share the shard and get slots of their own; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.llm.numbering import numbered

#: Shards of a rack, racks of a region in a regular layout; bytes a row takes beside its text.
PER_RACK, PER_REGION, ROW_BYTES = 4, 2, 16
#: Hex digits of a hash that make a draw (52 bits, exact in a double).
DIGITS = 13

#: (region, rack, shard, weight); a shard of weight 0 takes no rows.
Leaf = tuple[int, int, int, float]


def layout(shards: int, regular: int = 40) -> list[Leaf]:
    """Shards 0 .. n-1 of weight 1: ``regular`` ones fill racks and regions in order, each later one opens a region."""
    a_region = PER_RACK * PER_REGION
    first = -(-regular // a_region)
    return [
        (s // a_region, s // PER_RACK % PER_REGION, s, 1.0) if s < regular else (first + s - regular, 0, s, 1.0)
        for s in range(shards)
    ]


def levels(tree: Iterable[Leaf]) -> list[dict[str, dict[str, float]]]:
    """Per level, the children of each node with their weights; paths read ``region/rack/shard``."""
    out: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for region, rack, shard, weight in tree:
        steps = ["", f"{region}", f"{region}/{rack}", f"{region}/{rack}/{shard}"]
        for level, (parent, child) in enumerate(zip(steps, steps[1:])):
            children = out[level].setdefault(parent, {})
            children[child] = children.get(child, 0.0) + weight
    return [
        {parent: kept for parent, children in level.items() if (kept := {c: w for c, w in children.items() if w > 0})}
        for level in out
    ]


def unit(key: Column, path: Column) -> Column:
    """A number between 0 and 1 from the hash of a key and a path."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), path).cast("binary")), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def _chosen(key: Column, children: Column) -> Column:
    """The path of the child with the smallest draw."""
    draws = F.transform(
        children,
        lambda c: F.struct((-F.log(unit(key, c["path"])) / c["weight"]).alias("draw"), c["path"].alias("path")),
    )
    return F.array_min(draws)["path"]


def place(df: DataFrame, key: Column, tree: Iterable[Leaf], column: str = "shard") -> DataFrame:
    """``df`` with the shard that each row's key descends to."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    at: Column = F.lit("")
    out = df
    for level, nodes in enumerate(levels(tree)):
        table = F.create_map(*[
            part for parent, children in nodes.items()
            for part in (F.lit(parent), F.array(*[
                F.struct(F.lit(c).alias("path"), F.lit(w).alias("weight")) for c, w in children.items()
            ]))
        ])
        step = f"__{column}_{level}"
        out = out.withColumn(step, _chosen(text, table[at]))
        at = F.col(step)
    shard = F.substring_index(at, "/", -1).cast("int")
    return out.select(*df.columns, shard.alias(column))


def assign(
    docs: DataFrame, tree: Iterable[Leaf], grown: Iterable[Leaf] | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (from 0 in its shard), grown_shard."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    rows = place(rows, F.col("doc_id"), tree)
    if grown is None:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    else:
        rows = place(rows, F.col("doc_id"), grown, "grown_shard")
    return numbered(rows, "shard", ["doc_id", "text_crc32", "size"], "shards").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.col("number").alias("slot"), "grown_shard",
    )


def moves(docs: DataFrame, old: Iterable[Leaf], new: Iterable[Leaf], doc_id: str = "doc_id") -> DataFrame:
    """Rows per (from_shard, to_shard) that a change of the tree moves."""
    rows = docs.select(F.col(doc_id).alias("doc_id"))
    both = place(place(rows, F.col("doc_id"), old, "from_shard"), F.col("doc_id"), new, "to_shard")
    return both.where("from_shard <> to_shard").groupBy("from_shard", "to_shard").agg(F.count("*").alias("rows"))


def write_shards(docs: DataFrame, path: str, tree: Iterable[Leaf], doc_id: str = "doc_id") -> None:
    """Whole rows of ``docs`` as one folder per shard; large shards are several files."""
    placed = place(docs, F.col(doc_id), tree, "__shard")
    placed.hint("rebalance", "__shard").write.partitionBy("__shard").parquet(path)
