"""Serving side: the nested per-entity document (M17), the serving-store push (S9) and stable
consumer views (P12)."""

from __future__ import annotations

import datetime as _dt
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.operators.windows import between_days, latest_per_key, normalised
from riskweave.sources.versioned import VersionedTable

ISO_LOCAL = "yyyy-MM-dd'T'HH:mm:ss"
FEATURE_T = "array<struct<feature_id:string,feature_value:double,description:string,last_updated:string>>"


def _map(d: dict):
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def serving_latest(fv: DataFrame, active_entities: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """Newest value per (entity, feature) over the window (pushing days oldest-first leaves the
    newest value), only for entities active in the master (left semi, J8). One write, no day loop."""
    w = normalised(fv.where(between_days(fv, "timestamp", start, end))).where(F.col("feature_value").isNotNull())
    last = latest_per_key(w, ["entity_id", "feature_id"], ["timestamp"], ["feature_value"], tie_breaks=["feature_value"])
    return last.join(active_entities.select("entity_id"), "entity_id", "left_semi")


SERVING_SCHEMA = "entity_id string, feature_value double, timestamp timestamp_ntz"


def push_serving(table: VersionedTable, fv: DataFrame, active_entities: DataFrame, feature_ids: list[str], start: _dt.date, end: _dt.date,
                 batch_id: str) -> int:
    """S9 + S14: the serving table's days of the window become the newest values of each day, for active entities only, and the
    features' high-water marks move to ``end`` if they are older: both in one commit. A push that fails
    leaves rows and marks as they were; the same batch id again changes nothing."""
    rows = normalised(fv.where(F.col("feature_id").isin(list(feature_ids))).where(between_days(fv, "timestamp", start, end)))
    rows = rows.where(F.col("feature_value").isNotNull()).withColumn("ds", F.to_date("timestamp").cast("string"))
    rows = rows.join(active_entities.select("entity_id").distinct(), "entity_id", "left_semi")
    daily = latest_per_key(rows, ["entity_id", "feature_id", "ds"], ["timestamp"], ["feature_value"], tie_breaks=["feature_value"])

    def advanced(notes: dict) -> dict:
        marks = dict(notes.get("marks", {}))
        for f in feature_ids:
            marks[f] = max(marks.get(f, ""), end.isoformat())
        return {**notes, "marks": marks}

    return table.replace_window(daily, list(feature_ids), start, end, source=batch_id, notes=advanced)


def pushed_values(table: VersionedTable) -> DataFrame:
    """What the serving side shows: the newest value of each (entity, feature) with its feature's mark."""
    last = latest_per_key(table.read(), ["entity_id", "feature_id"], ["ds", "timestamp"], ["feature_value"], tie_breaks=["feature_value"])
    marks = list((table.commit_info().get("notes") or {}).get("marks", {}).items())        # one for each feature
    marked = table.spark.createDataFrame(marks, "feature_id string, last_successful_run string")
    return last.join(F.broadcast(marked), "feature_id", "left")


def category_scores(scores: DataFrame, score_ids: dict[str, str]) -> DataFrame:
    """(entity_id, category_name, category_score) from the Layer-3 scores of one day, by ``score_ids`` (category -> feature id)."""
    names = _map({v: k for k, v in score_ids.items()})
    rows = normalised(scores).where(F.col("feature_id").isin(list(score_ids.values())))
    return rows.groupBy("entity_id", names[F.col("feature_id")].alias("category_name")).agg(F.max("feature_value").alias("category_score"))


def serving_document(latest: DataFrame, entities: DataFrame, feature_categories: dict[str, str],
                     descriptions: dict[str, str], category_names: list[str], zone_suffix: str = "+05:30",
                     category_scores: DataFrame | None = None) -> DataFrame:
    """One nested row per entity. Every configured category appears (``features: []`` and score 0
    when nothing exists); features newest first. ``category_scores`` (entity_id, category_name, category_score) are the Layer-3 scores;
    a category without one has 0. Timestamps are local times of the zone ``zone_suffix`` and are written as they are.

    latest: (entity_id, feature_id, feature_value, timestamp); entities: (entity_id, ro_name,
    overall_risk_score, last_packet_timestamp, risk_analysis_updated_at). Category mapping and
    descriptions are configuration literals (no join). Lists are bounded by the configured features
    per category, so no group grows with the data."""
    cat = _map(feature_categories)[F.col("feature_id")]
    feats = latest.where(cat.isNotNull()).select(
        "entity_id", cat.alias("category_name"),
        F.struct(F.col("timestamp").alias("_ts"), "feature_id", "feature_value",
                 _map(descriptions)[F.col("feature_id")].alias("description"),
                 F.concat(F.date_format("timestamp", ISO_LOCAL), F.lit(zone_suffix)).alias("last_updated")).alias("f"))
    per_cat = feats.groupBy("entity_id", "category_name").agg(
        F.sort_array(F.collect_list("f"), asc=False).alias("fs"))
    if category_scores is None:
        category_scores = latest.sparkSession.createDataFrame([], "entity_id string, category_name string, category_score double")
    scores = category_scores.select("entity_id", "category_name", F.col("category_score").alias("score"))
    grid = entities.select("entity_id", F.explode(F.array(*[F.lit(n) for n in sorted(category_names)])).alias("category_name"))
    full = grid.join(per_cat, ["entity_id", "category_name"], "left").join(scores, ["entity_id", "category_name"], "left").select(
        "entity_id", F.struct(
            "category_name", F.coalesce(F.col("score"), F.lit(0.0)).alias("category_score"),
            F.coalesce(F.transform("fs", lambda x: x.dropFields("_ts")), F.array().cast(FEATURE_T)).alias("features")).alias("c"))
    docs = full.groupBy("entity_id").agg(F.array_sort(F.collect_list("c")).alias("categories"))
    return entities.join(docs, "entity_id").select(
        F.col("entity_id").alias("operator_id"), "ro_name", "overall_risk_score", "last_packet_timestamp",
        "risk_analysis_updated_at", "categories")
