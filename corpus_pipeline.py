"""A corpus pipeline: reject toxic documents, drop copies and near copies, mask personal data, pack.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame that is written to the
shared folder and read again as the next stage's documents. All but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapmart.llm.common import ascii_lower, stored
from snapmart.llm.exact_dedup import exact_dedup
from snapmart.llm.labelled import fold
from snapmart.llm.near_dedup import near_dedup
from snapmart.llm.packing import pack
from snapmart.llm.pii import mask_pii
from snapmart.llm.queries import tokenizer_path
from snapmart.llm.toxicity import drop_toxic, train

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: BPE and trained models have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7, by a model learned outside the held-out fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, train(docs, labels, fold(F.col("doc_id"), 3) != 1), threshold=0.7)


def _staying(docs: DataFrame, decided: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key, which identifies rows, is kept."""
    kept = decided.where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs[key] == kept["kept_id"], "left_semi")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id, one where it is repeated; NULL comes last."""
    kept = stored(
        exact_dedup(docs).where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n"))
        .select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"), "n"),
        "kept",
    )
    hashed = docs.withColumn("__sha", F.sha2(ascii_lower(F.col("text")), 256))

    def meeting(part: DataFrame) -> DataFrame:
        same = hashed["doc_id"].eqNullSafe(part["kept_id"]) & (hashed["__sha"] == part["kept_sha"])
        return hashed.join(part, same, "left_semi")

    once, repeated = meeting(kept.where("n = 1")).drop("__sha"), kept.where("n > 1")
    if repeated.isEmpty():
        return once
    rank = F.row_number().over(Window.partitionBy("doc_id", "__sha").orderBy("text"))
    first = meeting(repeated).withColumn("__rank", rank).where("__rank = 1")
    return once.unionByName(first.drop("__sha", "__rank"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group linked at five words and 0.8.

    Rows after the first of a doc_id, and those without one, come after all others.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        return _staying(docs, near_dedup(docs, words=5, percent=80))
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    first = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min("__row").alias("__row"))
    first = first.select("__row", F.col("doc_id").cast("long").alias("__first"))
    top = rows.agg(F.coalesce(F.max(F.col("doc_id").cast("long")), F.lit(0))).first()[0]
    keyed = stored(
        rows.join(first, "__row", "left")
        .withColumn("__key", F.coalesce("__first", F.col("__row") + F.lit(top + 1)))
        .select(*docs.columns, "__key"),
        "keyed",
    )
    return _staying(keyed, near_dedup(keyed, words=5, percent=80, doc_id="__key"), "__key").drop("__key")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the text."""
    masked = mask_pii(docs)
    if "n_chars" not in docs.columns:
        return masked
    size = F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars"))
    return masked.withColumn("n_chars", size)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), size=2048)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
