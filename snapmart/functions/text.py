"""Text cleaning columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of the credit-history text.
YEARS_PATTERN = r"(\d+)\s+Years?"
MONTHS_PATTERN = r"(\d+)\s+Months?"
YEARS_AND_MONTHS_PATTERN = r"^(\d+)\s+Years?\s+and\s+(\d+)\s+Months?"


def strip_padding(c: Column, sides: str = "both", pad: str = "_") -> Column:
    """Remove padding characters at the end (``right``) or at both ends."""
    text = c.cast("string")
    return F.rtrim(text, F.lit(pad)) if sides == "right" else F.btrim(text, F.lit(pad))


def null_if(c: Column, *placeholders: str) -> Column:
    """Exact placeholder values become NULL."""
    return F.when(~c.isin(*placeholders), c)


def duration_months(c: Column, strict: bool = False) -> Column:
    """``X Years and Y Months`` as months.

    The default reads the two parts wherever they stand and needs both; strict
    needs the whole phrase at the start of the text.
    """
    if strict:
        years = F.regexp_extract(c, YEARS_AND_MONTHS_PATTERN, 1)
        months = F.regexp_extract(c, YEARS_AND_MONTHS_PATTERN, 2)
    else:
        years = F.regexp_extract(c, YEARS_PATTERN, 1)
        months = F.regexp_extract(c, MONTHS_PATTERN, 1)
    return years.try_cast("int") * 12 + months.try_cast("int")


def level_by_content(c: Column, levels: Iterable[tuple[str, int]]) -> Column:
    """Code of the first fragment the text contains, NULL when none is."""
    out = F.lit(None).cast("int")
    for fragment, code in reversed(list(levels)):
        out = F.when(c.contains(fragment), F.lit(code)).otherwise(out)
    return out


# An item of ``A, B, and C``: a run without comma that stops before a joining word.
_ITEM = r"(?:(?!\sand\s)[^,])+"
_JOINING = r"^\s*and\s"


def list_items(c: Column) -> Column:
    """Items of ``A, B, and C`` as an array, without the joining word; NULL has none."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_ITEM), F.lit(0))
    bare = F.transform(runs, lambda run: F.trim(F.regexp_replace(run, _JOINING, "")))
    return F.filter(bare, lambda item: item != "")


def item_count(items: Column, item: str) -> Column:
    """How often ``item`` occurs in an array of texts."""
    return F.size(F.filter(items, lambda x: x == item))
