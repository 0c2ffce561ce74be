"""A score store derived from the event log (Layer 2 and Layer 3 of the pipeline).

* ``<type>_score_v1``: for every (feature, day), the rank score (0..1, descending) of the daily
  event counts, written with 2 decimals and stamped at the day's midnight, as score writes are.
* ``risk_score_v1``: per (entity, day) the weighted average of that day's instance scores, absent
  scores counting 0.

``stored_scores`` keeps it as a table partitioned by (feature_id, ds), as the real store is: readers select features and
days by partition. The table is built once for a state of the events (their files, sizes and times) in an
application, and anew when they change.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.functions.columns import r2
from riskweave.operators.instance import rank_values
from riskweave.sources.feature_values import daily_event_features
from riskweave.sources.versioned import VersionedTable

# fixed weights of the derived risk score (also repeated in the oracle SQL)
RISK_WEIGHTS = {"click_score_v1": 1.0, "error_score_v1": 3.0, "purchase_score_v1": 2.0,
                "signup_score_v1": 1.0, "view_score_v1": 0.5}


def _store_rows(df: DataFrame, name_col, value_col, day_col) -> DataFrame:
    return df.select(
        "entity_id",
        F.concat(name_col, F.lit("_v1")).alias("feature_id"),
        name_col.alias("feature_name"),
        F.lit("1").alias("feature_version"),
        F.col(value_col).alias("feature_value"),
        F.col(day_col).cast("timestamp_ntz").alias("timestamp"),
        F.lit(None).cast("string").alias("comments"),
    )


def instance_score_store(events: DataFrame) -> DataFrame:
    fv = daily_event_features(events)
    cells = fv.select(F.to_date("timestamp").alias("target_date"), "feature_id", "entity_id", "feature_value")
    ranked = rank_values(cells, group_cols=["target_date", "feature_id"])
    name = F.regexp_replace(F.col("feature_id"), "_count_daily_v1$", "_score")
    return _store_rows(ranked.withColumn("_name", name).withColumn("_v", r2("score")), F.col("_name"), "_v", "target_date")


def _risk_rows(inst: DataFrame) -> DataFrame:
    total = sum(RISK_WEIGHTS.values())
    w = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in RISK_WEIGHTS.items()))
    risk = (inst.where(F.col("feature_id").isin(list(RISK_WEIGHTS)))
                .groupBy("entity_id", F.to_date("timestamp").alias("day"))
                .agg(F.sum(F.col("feature_value") * w[F.col("feature_id")]).alias("_s"))
                .withColumn("_v", r2(F.col("_s") / F.lit(total))))
    return _store_rows(risk, F.lit("risk_score"), "_v", "day")


def score_store(events: DataFrame) -> DataFrame:
    """Both layers as one plan."""
    inst = instance_score_store(events)
    return inst.unionByName(_risk_rows(inst))


def _with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ds", F.to_date("timestamp").cast("string"))


def build_store(events: DataFrame, table: VersionedTable) -> None:
    """Layer 2 is written first, and Layer 3 reads it back from the table."""
    table.append(_with_day(instance_score_store(events)))
    table.append(_with_day(_risk_rows(table.read(list(RISK_WEIGHTS)))))


_BUILT: dict[tuple[str, str], VersionedTable] = {}


def stored_scores(events: DataFrame, new_table: Callable[[], VersionedTable]) -> VersionedTable:
    """The table of the store of these events; ``new_table`` names a new one where there is none yet."""
    spark = events.sparkSession
    state = []
    for name in sorted({f.rsplit("/", 1)[0] for f in events.inputFiles()}):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        for status in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path):
            state.append(f"{status.getPath()} {status.getLen()} {status.getModificationTime()}")
    key = (spark.sparkContext.applicationId, hashlib.sha256("\n".join(sorted(state)).encode()).hexdigest())
    if key not in _BUILT:
        table = new_table()
        build_store(events, table)
        _BUILT[key] = table
    return _BUILT[key]
