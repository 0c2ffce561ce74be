"""Long-format feature values (entity_id, feature_id, feature_name, feature_version, feature_value,
timestamp, comments): derivation from the event log, window scans (S1) and as-of reads (S2, J9).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.columns import ts_literal
from riskweave.operators.windows import between_days, latest_non_null_per_key, normalised

FEATURE_VALUE_SCHEMA = T.StructType([
    T.StructField("entity_id", T.StringType()),
    T.StructField("feature_id", T.StringType()),
    T.StructField("feature_name", T.StringType()),
    T.StructField("feature_version", T.StringType()),
    T.StructField("feature_value", T.DoubleType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("comments", T.StringType()),
])
FV_COLUMNS = [f.name for f in FEATURE_VALUE_SCHEMA.fields]


def daily_event_features(events: DataFrame, measure: str = "count", suffix: str | None = None,
                         start: _dt.date | None = None, end: _dt.date | None = None,
                         event_types: list[str] | None = None, include_any: bool = False,
                         version: str = "1") -> DataFrame:
    """Layer-1 daily features from an event log: one row per (user, event type, day).

    ``measure='count'`` -> ``<type>_count_daily_v1`` = number of events; ``'value'`` ->
    ``<type>_value_daily_v1`` = sum of ``value``. ``include_any`` adds ``any_<measure>_daily_v1``
    over all types (the denominator of Wilson scoring). Date bounds are applied to the raw ``ts``
    column, so they are pushed into the Parquet scan.
    """
    suffix = suffix or f"{measure}_daily"
    e = events.select("user_id", "event_type", "ts", "value")
    if start is not None:
        e = e.where(F.col("ts") >= ts_literal(start, e.schema["ts"].dataType))
    if end is not None:
        e = e.where(F.col("ts") < ts_literal(end + _dt.timedelta(days=1), e.schema["ts"].dataType))
    if event_types is not None:
        e = e.where(F.col("event_type").isin(list(event_types)))
    e = e.withColumn("day", F.to_date("ts"))
    agg = F.count(F.lit(1)).cast("double") if measure == "count" else F.sum("value")
    per_type = e.groupBy("user_id", "event_type", "day").agg(agg.alias("v"), F.max("ts").alias("mts"))
    frames = [per_type]
    if include_any:
        frames.append(e.groupBy("user_id", "day").agg(agg.alias("v"), F.max("ts").alias("mts"))
                      .withColumn("event_type", F.lit("any")).select(per_type.columns))
    out = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    name = F.concat(F.col("event_type"), F.lit("_" + suffix))
    return out.select(
        F.col("user_id").cast("string").alias("entity_id"),
        F.concat(name, F.lit("_v" + version)).alias("feature_id"),
        name.alias("feature_name"),
        F.lit(version).alias("feature_version"),
        F.col("v").cast("double").alias("feature_value"),
        F.col("mts").alias("timestamp"),
        F.lit("").alias("comments"),
    )


def event_feature_ids(events: DataFrame, measure: str = "count", version: str = "1") -> DataFrame:
    """Distinct feature ids of ``daily_event_features`` without building the daily cells: one
    distinct over the event-type column (pruned scan, partial aggregation)."""
    return events.select("event_type").distinct().select(
        F.concat(F.col("event_type"), F.lit(f"_{measure}_daily_v{version}")).alias("feature_id"),
        F.concat(F.col("event_type"), F.lit(f"_{measure}_daily")).alias("feature_name"))


def load_feature_values(fv: DataFrame, feature_ids: list[str], min_date: _dt.date, max_date: _dt.date) -> DataFrame:
    """Rows of the listed features with day in the closed range [min_date, max_date]; value as
    double, NaN as NULL; duplicates kept; rows with a NULL entity dropped (Q21)."""
    return normalised(fv.where(F.col("feature_id").isin(list(feature_ids)))
              .where(between_days(fv, "timestamp", min_date, max_date))
              .select("entity_id", "feature_id", F.col("feature_value").cast("double").alias("feature_value"),
                      "timestamp"))


def load_feature_values_asof(fv: DataFrame, feature_ids: list[str], as_of: _dt.date,
                             latest_only: bool = True) -> DataFrame:
    """All rows with day <= as_of; with ``latest_only`` the newest value per (entity, feature) that is neither NULL
    nor NaN (W3/Q5) and the newest timestamp; of rows at the same time the largest value (Q18)."""
    rows = normalised(fv.where(F.col("feature_id").isin(list(feature_ids)))
              .where(F.col("timestamp") < ts_literal(as_of + _dt.timedelta(days=1), fv.schema["timestamp"].dataType))
              .select("entity_id", "feature_id", "feature_name",
                      F.col("feature_value").cast("double").alias("feature_value"), "timestamp"))
    if not latest_only:
        return rows
    return latest_non_null_per_key(rows, ["entity_id", "feature_id"], "timestamp", ["feature_name", "feature_value"],
                                   tie_breaks=["feature_value"])


def missing_feature_ids(fv: DataFrame, feature_ids: list[str], as_of: _dt.date, spark=None) -> DataFrame:
    """Requested feature ids with zero rows as of the date (left anti against the found ids)."""
    spark = spark or fv.sparkSession
    requested = spark.createDataFrame([(f,) for f in feature_ids], "feature_id string")
    found = (fv.where(F.col("feature_id").isin(list(feature_ids)))
               .where(F.col("timestamp") < ts_literal(as_of + _dt.timedelta(days=1), fv.schema["timestamp"].dataType))
               .select("feature_id").distinct())
    return requested.join(found, "feature_id", "left_anti")
