"""Running-total (cumulative) features without a day loop.

cum(entity, D) = latest cumulative value before the window start (seed, 0 if none) + sum of the
entity's daily values on days in [start, D]; an entity without a daily row on D gets no row for D.
The recurrence is one window partitioned by entity and ordered by day over *daily cells* (one row
per entity and day), so a partition holds at most one row per day of the window however hot the
entity is. NULL daily values count as 0 (Q6 decision).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.functions.columns import ts_literal
from riskweave.operators.windows import between_days, latest_per_key


def cumulative_feature(daily: DataFrame, daily_feature_id: str, start: _dt.date, end: _dt.date,
                       seed: DataFrame | None = None, cumulative_feature_id: str | None = None) -> DataFrame:
    """-> (entity_id, day, feature_value) for days in [start, end]."""
    rows = (daily.where(F.col("feature_id") == F.lit(daily_feature_id))
                 .where(between_days(daily, "timestamp", start, end))
                 .withColumn("day", F.to_date("timestamp")))
    cells = latest_per_key(rows, ["entity_id", "day"], ["timestamp"], ["feature_value"], tie_breaks=["feature_value"])
    w = Window.partitionBy("entity_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = cells.withColumn("_run", F.sum(F.coalesce(F.col("feature_value"), F.lit(0.0))).over(w))
    if seed is None:
        return running.select("entity_id", "day", F.col("_run").alias("feature_value"))
    prior = seed
    if cumulative_feature_id is not None:
        prior = prior.where(F.col("feature_id") == F.lit(cumulative_feature_id))
    prior = prior.where(F.col("timestamp") < ts_literal(start, seed.schema["timestamp"].dataType))
    last = latest_per_key(prior, ["entity_id"], ["timestamp"], ["feature_value"], tie_breaks=["feature_value"])
    return (running.join(last.select("entity_id", F.col("feature_value").alias("_seed")), "entity_id", "left")
                   .select("entity_id", "day", (F.coalesce("_seed", F.lit(0.0)) + F.col("_run")).alias("feature_value")))
