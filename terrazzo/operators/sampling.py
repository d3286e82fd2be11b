"""Samples that depend on ids and a seed only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reservoir(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """A uniform sample of `size` rows without replacement: those with the least hash of key and seed."""
    h = F.xxhash64(key, F.lit(seed))
    return df.orderBy(h, key).limit(size)


def bernoulli(df: DataFrame, ratio: float, seed: int = 42, key: str | None = None) -> DataFrame:
    """Every row with the probability `ratio`, told by a hash of its key, or of all its columns; equal rows go together."""
    h = F.xxhash64(*([key] if key else df.columns), F.lit(seed))
    return df.where(F.pmod(h, F.lit(1 << 30)) < int(ratio * (1 << 30)))
