"""Size tiers by area share. They differ at the lower end and for NaN, and stay apart for that reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIERS = ("tiny", "small", "medium", "large")
BUCKETS = ("small", "medium", "large")


def area_tier(c: str) -> Column:
    """Four tiers; areas that are missing or not finite are tiny."""
    a = F.col(c)
    return F.when(a.isNull() | F.isnan(a) | (F.abs(a) == float("inf")) | (a <= 0.05), "tiny").when(a < 0.15, "small").when(a < 0.30, "medium").otherwise("large")


def size_bucket(c: str) -> Column:
    """Three buckets; NaN and NULL are large."""
    a = F.col(c)
    return F.when(a < 0.15, "small").when(a < 0.30, "medium").otherwise("large")


def area_bucket(c: str) -> Column:
    """Four buckets without a guard: NaN and NULL are large."""
    a = F.col(c)
    return F.when(a <= 0.05, "tiny").when(a < 0.15, "small").when(a < 0.30, "medium").otherwise("large")
