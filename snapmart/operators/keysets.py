"""Overlap of key sets between tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_presence(tables: Mapping[str, DataFrame], key: str) -> DataFrame:
    """One row per key with a 0/1 column per table, NULL keys left out.

    One aggregate over the union in place of a chain of joins; the map-side
    combine removes repeated keys before the shuffle.
    """
    tagged = None
    for name, df in tables.items():
        part = df.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.lit(name).alias("src"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("key").agg(
        *[F.max((F.col("src") == name).cast("int")).alias(name) for name in tables]
    )


def overlap_counts(tables: Mapping[str, DataFrame], key: str, base: str) -> DataFrame:
    """Keys per table, shared with the base table, in all tables, missing from each."""
    seen = key_presence(tables, key)
    in_base = F.col(base) == 1
    everywhere = F.lit(True)
    for name in tables:
        everywhere = everywhere & (F.col(name) == 1)
    rows = []
    for name in tables:
        here = F.col(name) == 1
        rows.append(
            F.struct(
                F.lit(name).alias("source"),
                F.count_if(here).alias("n_keys"),
                F.count_if(here & in_base).alias("n_shared"),
                F.count_if(in_base & ~here).alias("n_missing"),
                F.count_if(everywhere).alias("n_everywhere"),
            )
        )
    return seen.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
