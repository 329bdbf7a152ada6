"""Exact deduplication over an extendible-hash index on shared files.

Only DataFrame operations. Texts are equal when identical after lower-casing A-Z.

1. *Entries.* One scan turns every document into (doc_id, 64-bit key, SHA-256)
   and writes them to the shared folder; texts do not travel.
2. *Directory.* Distinct keys are counted per leading bits of the key. Buckets
   above ``capacity`` keys are split by one more bit, which doubles the directory
   where its depth is exceeded; slots whose bits are used up are counted again by
   their next bits. The directory has about ``2 * keys / capacity`` rows.
3. *Index.* Every entry is sent to its bucket by the directory, and all that follows
   happens inside (bucket, key): entries become one row per text with the row that stays
   and the group's size (a map-side combine makes a group of copies few rows before
   they travel), texts that share the 64-bit key but not the digest are links of a chain
   there, and members look their group up there. The index is written by owners of key
   ranges.
4. *Bytes.* Each member of a group is compared with the text of the row that
   stays. The texts of large groups' representatives are replicated in
   proportion to the group (one copy per ``block`` members), so a group that
   holds a third of all rows is spread. Members that differ after all are
   chained: grouped again by their bytes.

Defined cases: a NULL text is an empty one; an empty table gives an empty result;
rows repeated with their doc_id are counted as members and share one decision; a
NULL doc_id loses against every other and equals another NULL.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapmart.llm.common import ascii_lower, stored

#: Keys that one bucket may hold.
CAPACITY = 50_000
#: Members compared with one copy of their representative's text.
BLOCK = 2_000
#: Key bits counted at a time while the directory grows.
STEP_BITS = 10


def _prefix(key: Column, bits: Column | int) -> Column:
    """The leading ``bits`` of a 64-bit key, as text of 0 and 1 (so that 0 bits work)."""
    return F.substring(F.lpad(F.bin(key), 64, "0"), 1, bits)


def grow_directory(keys: DataFrame, capacity: int = CAPACITY) -> list[str]:
    """Bucket prefixes that cover every key, none with more than ``capacity`` keys.

    ``keys``: distinct 64-bit ``key``. Each level counts only the keys below the
    buckets that are still overfull, by ``STEP_BITS`` more bits.
    """
    done: list[str] = []
    open_, depth = [""], 0
    while open_ and depth + STEP_BITS <= 64:
        below = keys
        if depth:
            schema = T.StructType([T.StructField("bucket", T.StringType())])
            overfull = keys.sparkSession.createDataFrame([(b,) for b in open_], schema)
            below = keys.join(overfull, _prefix(F.col("key"), depth) == F.col("bucket"), "left_semi")
        rows = (
            below.groupBy(_prefix(F.col("key"), depth + STEP_BITS).alias("slot"))
            .agg(F.count("*").alias("n")).collect()
        )
        held: Counter[str] = Counter()
        for r in rows:
            for bits in range(depth, depth + STEP_BITS + 1):
                held[r["slot"][:bits]] += r["n"]
        todo, open_ = list(open_), []
        while todo:
            bucket = todo.pop()
            if held[bucket] <= capacity:
                done.append(bucket)
            elif len(bucket) == depth + STEP_BITS:
                open_.append(bucket)
            else:
                todo += [bucket + "0", bucket + "1"]
        depth += STEP_BITS
    return sorted(done + open_)


def with_bucket(keys: DataFrame, directory: list[str]) -> DataFrame:
    """Add ``bucket``: the directory's prefix of each key (joined per bucket depth)."""
    if directory == [""]:
        return keys.withColumn("bucket", F.lit(""))
    depths = sorted({len(b) for b in directory})
    schema = T.StructType([T.StructField("bucket", T.StringType())])
    table = keys.sparkSession.createDataFrame([(b,) for b in directory], schema)
    candidates = keys.withColumn(
        "bucket", F.explode(F.array(*[_prefix(F.col("key"), d) for d in depths]))
    )
    return candidates.join(table, "bucket")


def exact_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, block: int = BLOCK,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    normal = source.select("doc_id", ascii_lower(F.col("text")).alias("body"))
    entries = stored(
        normal.select(
            "doc_id", F.xxhash64("body").alias("key"), F.unhex(F.sha2("body", 256)).alias("digest")
        ),
        "entries",
    )
    directory = grow_directory(entries.select("key").distinct(), capacity)
    placed = with_bucket(entries, directory)
    index = stored(
        placed.groupBy("bucket", "key", "digest")
        .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .repartitionByRange(F.col("bucket"), F.col("key"))
        .sortWithinPartitions("bucket", "key", "digest"),
        "index",
    )
    found = stored(placed.join(index, ["bucket", "key", "digest"]), "found")

    # Bytes of the members against the bytes of the row that stays.
    member = found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("doc_id").isNotNull())
    wanted = (
        member.select("doc_id", "key", "digest", "keep_id", "group_size", F.lit(False).alias("is_keep"))
        .unionByName(
            index.where("group_size > 1").select(
                F.col("keep_id").alias("doc_id"), "key", "digest", "keep_id", "group_size",
                F.lit(True).alias("is_keep"),
            )
        )
    )
    # A row repeated with its doc_id is asked for once and found as often as it occurs.
    texts = (
        wanted.dropDuplicates(["doc_id", "key", "digest", "is_keep"]).join(source, "doc_id")
        .withColumn("body", ascii_lower(F.col("text")))
        .where(F.xxhash64("body") == F.col("key"))
    )
    blocks = F.ceil(F.col("group_size") / F.lit(block)).cast("int")
    members = texts.where("not is_keep").select(
        "doc_id", "key", "digest", "body",
        F.pmod(F.hash("doc_id"), blocks).alias("part"),
    )
    keeps = (
        texts.where("is_keep")
        .dropDuplicates(["key", "digest", "doc_id"])
        .select(
            "key", "digest", F.col("body").alias("keep_body"),
            F.explode(F.sequence(F.lit(0), blocks - 1)).alias("part"),
        )
    )
    differing = stored(
        members.join(keeps, ["key", "digest", "part"])
        .where(F.col("body") != F.col("keep_body"))
        .select("doc_id", "key", "digest", "body"),
        "chained",
    )
    if not differing.isEmpty():
        found = _rechain(found, differing)
    return found.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "bucket",
    )


def _rechain(found: DataFrame, differing: DataFrame) -> DataFrame:
    """Members whose bytes differ form groups of their own, by their bytes."""
    chains = differing.groupBy("key", "digest", "body").agg(
        F.max("doc_id").alias("chain_keep"), F.count("*").alias("chain_size")
    )
    moved = differing.join(chains, ["key", "digest", "body"]).select(
        "doc_id", "key", "digest", "chain_keep", "chain_size"
    )
    lost = moved.groupBy("key", "digest").agg(F.count("*").alias("lost"))
    return (
        found.join(moved, ["doc_id", "key", "digest"], "left")
        .join(lost, ["key", "digest"], "left")
        .withColumn("keep_id", F.coalesce("chain_keep", "keep_id"))
        .withColumn(
            "group_size",
            F.coalesce("chain_size", F.col("group_size") - F.coalesce("lost", F.lit(0))),
        )
    )
