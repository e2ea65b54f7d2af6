"""Lenient dates and bins."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: accepted spellings of a publication date, tried in this order
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd",
    "dd/MM/yyyy", "MMMM d, yyyy", "MMM d, yyyy",
]


def lenient_timestamp(c: Column) -> Column:
    """First format that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(c.cast("string"), F.lit(f)) for f in DATE_FORMATS])


def age_days(ts: Column, reference: Column, unknown: int) -> Column:
    """Whole days from ts to the reference, rounded down."""
    days = F.floor((F.unix_timestamp(reference) - F.unix_timestamp(ts)) / F.lit(86400))
    return F.coalesce(days, F.lit(unknown)).cast("int")


def bin_edges(value: Column, edges: list[float], names: list[str]) -> Column:
    """Left-closed bins: a value on an edge belongs to the upper bin."""
    out = F.when(value < F.lit(edges[0]), F.lit(names[0]))
    for edge, name in zip(edges[1:], names[1:]):
        out = out.when(value < F.lit(edge), F.lit(name))
    return out.otherwise(F.lit(names[len(edges)]))
