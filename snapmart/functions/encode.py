"""Fixed-list encodings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_map(c: Column, codes: Mapping) -> Column:
    """Code of a value from a fixed list, NULL for an unknown value."""
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.create_map(*pairs)[c]


def relabel(c: Column, labels: Mapping) -> Column:
    """Readable text for a code."""
    return encode_map(c, labels)


def source_flag(count: Column) -> Column:
    """1 when the joined source had rows for this key, else 0."""
    return F.when(count.isNotNull(), F.lit(1)).otherwise(F.lit(0))
