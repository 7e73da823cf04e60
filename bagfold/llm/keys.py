"""Key tables that are broadcast while they are small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys of a few numbers each are broadcast up to so many rows (some 30 MB); beyond, both sides are shuffled.
BROADCAST_KEYS = 500_000


def few(keys: DataFrame) -> bool:
    """Whether ``keys`` (a written table) may be broadcast."""
    return keys.count() <= BROADCAST_KEYS


def small(keys: DataFrame) -> DataFrame:
    """``keys`` (a written table of a few numbers a row), marked for broadcast if they are few."""
    return F.broadcast(keys) if few(keys) else keys
