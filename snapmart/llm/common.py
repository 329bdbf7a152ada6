"""Small shared pieces: shared-folder tables, text normalisation, hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapmart.sources.scratch import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends, executors may be lost."""
    return materialise(df, f"llm-{name}")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; NULL becomes empty. Pure ASCII texts take the fast form."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(
        F.translate(whole, UPPER, LOWER)
    )
