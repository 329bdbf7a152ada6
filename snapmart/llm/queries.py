"""The dealt operators on the given tables: one thin query each, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapmart.llm import merkle, oracle, sharding
from snapmart.llm.alignment import align_documents
from snapmart.llm.bpe_codec import bpe_round_trip
from snapmart.llm.common import ascii_lower
from snapmart.llm.embedding_dedup import embedding_dedup
from snapmart.llm.exact_dedup import exact_dedup
from snapmart.llm.near_dedup import near_dedup
from snapmart.llm.packing import pack
from snapmart.llm.pii import find_pii
from snapmart.llm.prefix_counts import token_counts
from snapmart.llm.quality import quality
from snapmart.llm.suffix_dedup import suffix_dedup
from snapmart.llm.toxicity import scored_documents as toxicity_scores

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, table_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{table_dir}/{name}.parquet")


@query("op2_exact_dedup", """
    WITH n AS (
        SELECT doc_id, translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
        FROM documents
    )
    SELECT doc_id,
        max(doc_id) OVER (PARTITION BY body) AS keep_id,
        count(*) OVER (PARTITION BY body) AS group_size,
        doc_id = max(doc_id) OVER (PARTITION BY body) AS kept,
        sha256(body) AS text_sha256
    FROM n
""")
def op2(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup(table(spark, d, "documents")).drop("bucket")


@query("op9_bpe_codec")
def op9(spark: SparkSession, d: str) -> DataFrame:
    return bpe_round_trip(table(spark, d, "documents"), tokenizer_path("word_bpe_49k.json"))


@query("op10_token_counts")
def op10(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(
        table(spark, d, "documents"), tokenizer_path("byte_bpe_50k.json"), limit=512
    )


@query("op6_best_fit_packing")
def op6(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), tokenizer_path("word_bpe_49k.json"), size=2048)


@query("op1_toxicity")
def op1(spark: SparkSession, d: str) -> DataFrame:
    return toxicity_scores(
        table(spark, d, "documents"), table(spark, d, "labels"), folds=3, held_fold=1, threshold=0.7
    )


@query("op3_minhash_near_dedup")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup(table(spark, d, "documents"), words=4, percent=80)


@query("op7_pii")
def op7(spark: SparkSession, d: str) -> DataFrame:
    return find_pii(table(spark, d, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"
    )


@query("op8_quality")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return quality(
        table(spark, d, "documents"), table(spark, d, "labels"), folds=5, held_fold=0, threshold=0.3
    )


@query("op5_embedding_near_dedup")
def op5(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dedup(table(spark, d, "embeddings"), threshold=0.98)


@query("op4_suffix_dedup")
def op4(spark: SparkSession, d: str) -> DataFrame:
    return suffix_dedup(table(spark, d, "documents"), length=100)


@query("op11_hash_tree_shards", oracle.shards(sharding.layout(40), sharding.layout(41)))
def op11(spark: SparkSession, d: str) -> DataFrame:
    return sharding.assign(table(spark, d, "documents"), sharding.layout(40), sharding.layout(41))


@query("op12_token_alignment")
def op12(spark: SparkSession, d: str) -> DataFrame:
    return align_documents(
        table(spark, d, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    )


@query("op13_merkle_manifest", oracle.merkle())
def op13(spark: SparkSession, d: str) -> DataFrame:
    """Every third row (by the checksum of its doc_id) claims a text in lower case."""
    fields = [F.when(F.col(f).isNotNull(), ascii_lower(F.col(f))) if f == "text" else F.col(f) for f in merkle.FIELDS]
    every_third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.audit(table(spark, d, "documents"), F.when(every_third, merkle.leaf_digest(fields)))
