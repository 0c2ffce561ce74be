"""Entity-master refresh operators: risk buckets (M11), top anomaly (M12), latest sync from two
activity sources (M14), latest location with rejects (M15) and dimension enrichment (M16)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import constants as K
from riskweave.functions.columns import dms_to_decimal, r6, ts_literal, wkt_point
from riskweave.operators.ranking import with_rank_stats
from riskweave.operators.windows import day_of, latest_per_key, normalised


# ---------------------------------------------------------------------------------------- M11 / A12
def latest_score_date(scores: DataFrame, feature_id: str) -> Column:
    """The newest day with rows for ``feature_id`` as a scalar subquery (evaluated once,
    substituted as a literal -- no join, no driver round trip)."""
    return (scores.where(F.col("feature_id") == F.lit(feature_id))
                  .select(F.max(day_of(scores))).scalar())


def risk_buckets(scores: DataFrame, feature_id: str, since: Column | _dt.date | None = None) -> DataFrame:
    """Scores > 0.9 are 'Critical'; the rest ('General') by percent_rank descending: <= 0.01
    'High', <= 0.20 'Medium', else value > 0.01 'Low', else 'No'. NULL and NaN scores and rows without an entity are
    excluded before anything is ranked; one (latest) score per entity (Q11). percent_rank comes from exact rank
    statistics, not a global window."""
    since = latest_score_date(scores, feature_id) if since is None else since
    since_col = since if isinstance(since, Column) else F.lit(since)
    rows = normalised(scores.where(F.col("feature_id") == F.lit(feature_id)).where(day_of(scores) >= since_col))
    rows = rows.where(F.col("feature_value").isNotNull())
    latest = latest_per_key(rows, ["entity_id"], ["timestamp"], ["feature_value"], tie_breaks=["feature_value"])
    grouped = latest.withColumn(
        "score_class",
        F.when(F.col("feature_value") > F.lit(K.CRITICAL_SCORE), F.lit(K.BUCKET_CRITICAL)).otherwise(F.lit(K.BUCKET_GENERAL)))
    ranked = with_rank_stats(grouped, ["score_class"], "feature_value", groups=2)
    pct = F.when(F.col("_n") > 1, F.col("_n_greater") / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    bucket = (F.when(F.col("score_class") == F.lit(K.BUCKET_CRITICAL), F.lit(K.BUCKET_CRITICAL))
               .when(pct <= F.lit(K.HIGH_PERCENT_RANK), F.lit(K.BUCKET_HIGH))
               .when(pct <= F.lit(K.MEDIUM_PERCENT_RANK), F.lit(K.BUCKET_MEDIUM))
               .when(F.col("feature_value") > F.lit(K.LOW_SCORE), F.lit(K.BUCKET_LOW))
               .otherwise(F.lit(K.BUCKET_NO)))
    return ranked.select("entity_id", F.col("feature_value").alias("risk_score"), bucket.alias("risk_bucket"))


# ---------------------------------------------------------------------------------------- M12
def top_anomaly(scores: DataFrame, codes: list[str], day: Column | _dt.date, store: DataFrame,
                risk_feature_name: str = "risk_score") -> DataFrame:
    """M12 in one pass over day D (NaN counts as NULL): per entity, for every code with a non-NULL ``<code>_score`` the
    code score (NULL read as 0) and the risk score; keep the highest code score, ties to the earliest
    code in ``codes``; only entities present in ``store`` (opt_id, opt_ro, opt_district, opt_state).
    ``greatest`` over (score, -position, code) structs replaces a per-code loop, union and sort."""
    day_col = day if isinstance(day, Column) else F.lit(day)
    names = [f"{c}_score" for c in codes]
    rows = (normalised(scores.where(day_of(scores) == day_col))
            .where(F.col("feature_name").isin([risk_feature_name] + names)).withColumn("opt_id", F.upper("entity_id")))
    v0 = F.coalesce(F.col("feature_value"), F.lit(0.0))
    aggs = [F.max(F.when(F.col("feature_name") == F.lit(risk_feature_name), v0)).alias("risk_score")]
    for i, n in enumerate(names):
        aggs.append(F.max(F.when(F.col("feature_name") == F.lit(n), v0)).alias(f"_s{i}"))
        aggs.append(F.max(F.when((F.col("feature_name") == F.lit(n)) & F.col("feature_value").isNotNull(), F.lit(True)))
                    .alias(f"_h{i}"))
    per = rows.groupBy("opt_id").agg(*aggs)
    cands = [F.when(F.col(f"_h{i}"), F.struct(F.col(f"_s{i}").alias("s"), F.lit(-i).alias("p"), F.lit(c).alias("code")))
             for i, c in enumerate(codes)]
    best = F.greatest(*cands) if len(cands) > 1 else cands[0]
    top = per.select("opt_id", "risk_score", best.alias("_best")).where(F.col("_best").isNotNull())
    return top.join(store, "opt_id").select(
        "opt_id", "opt_ro", "opt_district", "opt_state", "risk_score",
        F.col("_best.s").alias("highest_anomaly_code_score"),
        F.col("_best.code").alias("anomaly_code_with_highest_score"))


# ---------------------------------------------------------------------------------------- M14 / M15
SYNC_COLUMNS = ["district", "pincode", "state", "latitude", "longitude", "machine_code", "event_timestamp",
                "client_version", "client_type"]


def _since(df: DataFrame, col: str, as_of: _dt.date, days: int) -> Column:
    """``ts >= date(as_of - n days)`` -- n days plus the partial current day, on the raw column."""
    return F.col(col) >= ts_literal(as_of - _dt.timedelta(days=days), df.schema[col].dataType)


def latest_sync(activity_a: DataFrame, activity_b: DataFrame, as_of: _dt.date, days: int = 30,
                b_client_type: str = "UC") -> DataFrame:
    """Newest sync row per entity from source A and source B. For B, rows of each (entity,
    session) are blended column-wise with ``max`` and only the entity's newest session is kept.
    Entity ids are upper-cased before any grouping (Q7). All "newest" picks are partial aggregates
    (skew-safe) with total-order tie-breaks."""
    a = (activity_a.where(_since(activity_a, "event_timestamp", as_of, days))
                   .select(F.upper("operator_id").alias("opt_id"), "district", "pincode", "state",
                           F.col("latitude").cast("string").alias("latitude"),
                           F.col("longitude").cast("string").alias("longitude"),
                           "machine_code", "event_timestamp", "client_version", "client_type"))
    b = (activity_b.where(_since(activity_b, "event_timestamp", as_of, days))
                   .withColumn("opt_id", F.upper("operator_id")))
    newest_session = latest_per_key(b, ["opt_id"], ["event_timestamp"], ["resident_sid"], tie_breaks=["resident_sid"])
    blended = b.groupBy("opt_id", "resident_sid").agg(
        F.max("district").alias("district"), F.max("pincode").alias("pincode"), F.max("state").alias("state"),
        F.max("latitude").alias("latitude"), F.max("longitude").alias("longitude"),
        F.max("station_machine_code").alias("machine_code"), F.max("event_timestamp").alias("event_timestamp"))
    uc = blended.join(newest_session.select("opt_id", "resident_sid"), ["opt_id", "resident_sid"]).select(
        "opt_id", "district", "pincode", "state", F.col("latitude").cast("string").alias("latitude"),
        F.col("longitude").cast("string").alias("longitude"), "machine_code", "event_timestamp",
        F.lit(None).cast("string").alias("client_version"), F.lit(b_client_type).alias("client_type"))
    both = a.unionByName(uc)
    return latest_per_key(both, ["opt_id"], ["event_timestamp"], SYNC_COLUMNS,
                          tie_breaks=["client_type", "machine_code", "district", "latitude", "longitude"])


def latest_location(activity_a: DataFrame, activity_b: DataFrame, as_of: _dt.date, days: int = 1) -> DataFrame:
    """M15 input: M14 over a short window with lat/lon only -> (opt_id, latitude, longitude, updated_at)."""
    s = latest_sync(activity_a, activity_b, as_of, days)
    return s.select("opt_id", "latitude", "longitude", F.col("event_timestamp").alias("updated_at"))


def _parsed_location(loc: DataFrame) -> DataFrame:
    return loc.withColumn("lat", dms_to_decimal("latitude")).withColumn("lon", dms_to_decimal("longitude"))


def _in_bounds() -> Column:
    return (F.col("lat").between(*K.ENTITY_LAT_RANGE)) & (F.col("lon").between(*K.ENTITY_LON_RANGE))


def location_points(loc: DataFrame) -> DataFrame:
    """DMS/decimal -> decimal degrees, bounds check, WKT point (latitude first)."""
    p = _parsed_location(loc).where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & _in_bounds())
    return p.select("opt_id", r6("lat").alias("lat"), r6("lon").alias("lon"), wkt_point("lat", "lon").alias("wkt"),
                    "updated_at")


def location_rejects(loc: DataFrame) -> DataFrame:
    """P9 side output: every rejected row with its reason (unparseable rows are counted too)."""
    p = _parsed_location(loc)
    reason = (F.when(F.col("lat").isNull() | F.col("lon").isNull(), F.lit("unparseable"))
               .when(~_in_bounds(), F.lit("out_of_bounds")))
    return p.select("opt_id", "latitude", "longitude", reason.alias("reason")).where(F.col("reason").isNotNull())


# ---------------------------------------------------------------------------------------- M16
def enrich_entities(users: DataFrame, organizations: DataFrame, contacts: DataFrame, offices: DataFrame) -> DataFrame:
    """Keep every user row; organisation looked up in two roles (ea, reg), contact phone/e-mail
    coalesced from two columns, regional office name. Organisations and regional offices are small by
    nature (one per office) and are broadcast; contacts grow with the users, so that join is left to
    the planner and AQE's runtime size check (broadcast only if the measured side is small)."""
    org = organizations.select("org_key", "org_name", "org_code")
    ea = org.select(F.col("org_key").alias("ea_key"), F.col("org_name").alias("ea_name"), F.col("org_code").alias("ea_code"))
    reg = org.select(F.col("org_key").alias("reg_key"), F.col("org_name").alias("reg_name"), F.col("org_code").alias("reg_code"))
    con = contacts.select(F.col("contact_key").alias("user_contact_key"),
                          F.coalesce("phone1", "phone2").alias("phone_number"),
                          F.coalesce("email_id1", "email_id2").alias("email"))
    ro = offices.select("ro_key", "ro_name")
    base = users.select(F.upper("user_code").alias("opt_id"), "user_name", "user_uid", "user_key",
                        F.col("user_org_key").alias("ea_key"), F.col("user_reg_org_key").alias("reg_key"),
                        "user_contact_key", "ro_key")
    out = (base.join(F.broadcast(ea), "ea_key", "left")
               .join(F.broadcast(reg), "reg_key", "left")
               .join(con, "user_contact_key", "left")
               .join(F.broadcast(ro), "ro_key", "left"))
    return out.select("opt_id", "user_name", "user_uid", "ea_name", "ea_code", "reg_name", "reg_code",
                      "phone_number", "email", "ro_name")
