"""Inputs by name in the session's catalog (S5), with a contract on their columns, and the consumer views.

A name may stand for any table the session's catalogs can read: a lake table, a landed stream, a relational table behind a
connector. What a job relies on is the contract: the columns it names, with their types. Others are dropped, so a
table may grow columns; a missing or differently typed column is an error before any data is read.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.functions.columns import r6
from riskweave.operators.master import latest_score_date, risk_buckets
from riskweave.operators.windows import between_days, latest_per_key, normalised


class ContractError(ValueError):
    """A table does not have the columns that a job relies on."""


def named_table(spark: SparkSession, name: str, contract: T.StructType | str) -> DataFrame:
    """The contract's columns of the table ``name`` (``[catalog.][schema.]table``)."""
    wanted = T.StructType.fromDDL(contract) if isinstance(contract, str) else contract
    table = spark.table(name)
    have = {f.name: f.dataType for f in table.schema.fields}
    problems = [f"{f.name} is missing" for f in wanted.fields if f.name not in have]
    problems += [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in wanted.fields
                 if f.name in have and have[f.name] != f.dataType]
    if problems:
        raise ContractError(f"{name}: " + "; ".join(problems))
    return table.select(*[f.name for f in wanted.fields])


STORE = "entity_id string, feature_id string, feature_name string, feature_value double, timestamp timestamp_ntz, ds string"
PLACES = "entity_id string, region string"


def consumer_views(spark: SparkSession, features: str, scores: str, places: str, start: _dt.date, end: _dt.date,
                   risk_id: str = "risk_score_v1", suffix: str = "") -> list[str]:
    """Define the three stable views over named tables, each with its columns spelt out once: ``entity_features`` (newest value of each
    feature in the window), ``entity_risk_summary`` (newest risk, its bucket, the number of features) and
    ``entity_risk_by_region``. The names of the views."""
    fv = normalised(named_table(spark, features, STORE)).where(F.col("feature_value").isNotNull())
    fv = fv.where(F.col("ds").between(start.isoformat(), end.isoformat()))
    newest = latest_per_key(fv.where(between_days(fv, "timestamp", start, end)), ["entity_id", "feature_id"], ["timestamp"], ["feature_value"],
                            tie_breaks=["feature_value"])
    values = newest.select("entity_id", "feature_id", "feature_value", F.col("timestamp").alias("value_time"))
    store = named_table(spark, scores, STORE)
    buckets = risk_buckets(store, risk_id)
    counted = values.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_features"))
    summary = buckets.join(counted, "entity_id", "left").select("entity_id", "risk_score", "risk_bucket", F.coalesce("n_features", F.lit(0)).alias("n_features"),
                                                                latest_score_date(store, risk_id).cast("string").alias("score_date"))
    where = named_table(spark, places, PLACES)
    region = buckets.join(where, "entity_id").groupBy("region").agg(
        F.count(F.lit(1)).alias("n_entities"), r6(F.avg("risk_score")).alias("avg_risk"), F.max("risk_score").alias("max_risk"),
        F.count_if(F.col("risk_bucket").isin("Critical", "High")).alias("n_high"))
    made = {"entity_features": values, "entity_risk_summary": summary, "entity_risk_by_region": region}
    for name, frame in made.items():
        frame.createOrReplaceTempView(name + suffix)
    return [name + suffix for name in made]
