"""Number columns: coercion, ranges, ratios, bins.

ANSI mode stays on, so everything that may fail per row uses a ``try_`` form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapmart.schemas import Range


def to_number(c: Column, dtype: str) -> Column:
    """Text to number, NULL when it is not one.

    Decimal text asked for as an integer is cut at the point, as a permissive
    cast does; the ANSI ``try_cast`` alone would give NULL.
    """
    if dtype in ("int", "bigint"):
        text = c.cast("string")
        whole = F.substring_index(text, ".", 1).try_cast(dtype)
        decimal = F.when(text.try_cast("double").isNotNull(), whole)
        return F.coalesce(text.try_cast(dtype), decimal)
    return c.try_cast(dtype)


def keep_in_range(c: Column, rule: Range) -> Column:
    """Value inside the range, NULL outside; open sides are not checked."""
    keep = F.lit(True)
    if rule.low is not None:
        keep = keep & ((c > rule.low) if rule.low_open else (c >= rule.low))
    if rule.high is not None:
        keep = keep & ((c < rule.high) if rule.high_open else (c <= rule.high))
    return F.when(keep, c)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division, NULL on NULL or zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def clip_low(c: Column, floor: float) -> Column:
    """Lower bound; NULL stays NULL (``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(floor)))


def fixed_bin(c: Column, edges: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """Right-closed bins ``(e0, e1], (e1, e2], ...``; outside is NULL.

    Returns the 0-based bin number, or its label. Spark ML's ``Bucketizer`` is
    left-closed and therefore no replacement.
    """
    out = F.lit(None)
    for i in range(len(edges) - 2, -1, -1):
        value = F.lit(labels[i] if labels else i)
        out = F.when((c > edges[i]) & (c <= edges[i + 1]), value).otherwise(out)
    return out


def quantile_bin(c: Column, edges: Sequence[float]) -> Column:
    """Right-closed bins whose lowest edge belongs to the first bin."""
    edges = sorted(set(edges))
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        low = (c >= edges[i]) if i == 0 else (c > edges[i])
        out = F.when(low & (c <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def half_up(c: Column, digits: int) -> Column:
    return F.round(c.cast("double"), digits)
