"""Skew-safe joins.

``salted_join`` joins a large fact side to a lookup with one row per key, where the caller knows which keys are hot: their fact
rows are spread over ``salts`` partitions by a deterministic hash, and only those (few) lookup rows are
replicated ``salts`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000   # a key with this many fact rows is split over SALTS partitions
SALTS = 64


def salted_join(fact: DataFrame, lookup: DataFrame, keys: list[str], fact_hot: Column, lookup_hot: Column,
                salts: int = SALTS, spread_cols: list[str] | None = None) -> DataFrame:
    """Equi-join where the caller already knows which keys are hot on each side: hot fact rows get a
    deterministic salt in [0, salts), hot lookup rows are replicated ``salts`` times, others use salt 0."""
    spread = [F.col(c) for c in (spread_cols or [c for c in fact.columns if c not in keys])]
    f = fact.withColumn("_salt", F.when(fact_hot, F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0)))
    side = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(lookup_hot, F.lit(salts - 1)).otherwise(F.lit(0)))))
    return f.join(side, keys + ["_salt"]).drop("_salt")
