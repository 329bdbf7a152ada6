"""Connected components of a link table: local union-find, then alternating stars.

Each partition first reduces its links with a union-find to one edge per node. Then
large and small stars alternate (every node hands its larger, then its smaller
neighbours to its smallest neighbour) until nothing changes, which takes a number of
rounds logarithmic in the component's size. Neighbour lists are never gathered: only
the minimum per node is aggregated, with a map-side combine, and joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapmart.llm.common import stored


class UnionFind:
    """Smallest member is the root."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        low, high = (a, b) if a < b else (b, a)
        self.parent.setdefault(low, low)
        self.parent[high] = low


#: Nodes held by one union-find before its edges are handed on.
LOCAL_NODES = 200_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = UnionFind()

    def edges() -> pa.RecordBatch:
        pairs = [(x, found.find(x)) for x in found.parent if found.find(x) != x]
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if a != b:
                found.union(a, b)
        if len(found.parent) > LOCAL_NODES:
            yield edges()
            found = UnionFind()
    yield edges()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return (
        joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b long) to (node, root): every linked node but the roots, root the smallest."""
    state = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"))
    edges = stored(
        links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        .mapInArrow(_local, "a long, b long").distinct(),
        "edges",
    )
    before = edges.agg(state).first()[0]
    while before["n"]:
        edges = stored(_small_star(_large_star(edges)), "edges")
        now = edges.agg(state).first()[0]
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
