"""Catalog, part 2: entity-master refresh, upserts, quality/gating, serving, backfill, cost and the
streaming upkeep. See ``catalog`` for conventions."""

from __future__ import annotations

import datetime as _dt
import os
import uuid

from pyspark.sql import functions as F

from riskweave.constants import DMS_PATTERN
from riskweave.functions.columns import r6
from riskweave.operators import instance as inst
from riskweave.operators import quality as q
from riskweave.operators.cost import job_cost_by_feature
from riskweave.operators.cumulative import cumulative_feature
from riskweave.operators.master import enrich_entities, latest_location, latest_score_date, latest_sync, location_points, location_rejects
from riskweave.operators.upsert import advance_watermark, compare_and_set, registry_mirror, upsert
from riskweave.operators.windows import DateSpan
from riskweave.plans.backfill import render_cumulative_day, score_rows, score_table, scratch_table_path
from riskweave.plans.catalog import _BUCKET_SQL
from riskweave.plans.catalog import CAT_W as _CAT_W
from riskweave.plans.catalog import (CLICK, DS, RISK_WEIGHTS, STORE_SQL, SUM30, D, _store, day_sql, entity_store, ev,
                                     fv, job)
from riskweave.plans.materialize import materialize
from riskweave.plans.serving import category_scores, serving_document, serving_latest
from riskweave.plans.sqlfrag import clip, dbl, fv_cte, r2 as s2, r6 as s6, score_store_cte
from riskweave.session import ensure_checkpoint_dir
from riskweave.sources import derived as dv
from riskweave.sources.feature_values import event_feature_ids, missing_feature_ids
from riskweave.sources.tables import read_table
from riskweave.streaming.sync_stream import run_sync_stream

NOW = "2024-01-30 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


# ------------------------------------------------------------------------------------------- step 9
def _sync_sql(since: str) -> str:
    return f"""{dv.ACTIVITY_A_SQL}, {dv.ACTIVITY_B_SQL},
sessions AS (SELECT upper(operator_id) AS opt_id, resident_sid, max(district) AS district, max(pincode) AS pincode, max(state) AS state,
                    max(latitude) AS latitude, max(longitude) AS longitude, max(event_timestamp) AS event_timestamp,
                    max(station_machine_code) AS machine_code
             FROM act_b WHERE event_timestamp >= TIMESTAMP '{since}' GROUP BY ALL),
last_session AS (SELECT DISTINCT ON (opt_id) * FROM sessions ORDER BY opt_id, event_timestamp DESC, resident_sid DESC NULLS LAST),
sync AS (SELECT DISTINCT ON (opt_id) *
         FROM (SELECT * EXCLUDE (resident_sid), CAST(NULL AS VARCHAR) AS client_version, 'UC' AS client_type
               FROM last_session WHERE resident_sid IS NOT NULL
               UNION ALL BY NAME
               SELECT upper(operator_id) AS opt_id, district, pincode, state, latitude, longitude, machine_code, event_timestamp,
                      client_version, client_type FROM act_a WHERE event_timestamp >= TIMESTAMP '{since}')
         ORDER BY opt_id, event_timestamp DESC, client_type DESC NULLS LAST, machine_code DESC NULLS LAST,
                  district DESC NULLS LAST, latitude DESC NULLS LAST, longitude DESC NULLS LAST)"""


SYNC_SQL = f"WITH {_sync_sql('2023-12-31 00:00:00')} SELECT * FROM sync"


@job("latest_sync", SYNC_SQL)
def _latest_sync(spark, sf):
    e = ev(spark, sf)
    return latest_sync(dv.activity_a(e), dv.activity_b(e), D, days=30)


_PAT = "'" + DMS_PATTERN.replace("'", "''") + "'"


def _dms_sql(c: str) -> str:
    s = f"trim({c})"
    dd = (f"(TRY_CAST(regexp_extract({s}, {_PAT}, 1) AS DOUBLE) + TRY_CAST(regexp_extract({s}, {_PAT}, 2) AS DOUBLE) / 60.0"
          f" + TRY_CAST(regexp_extract({s}, {_PAT}, 3) AS DOUBLE) / 3600.0)")
    return (f"(CASE WHEN {s} IS NULL OR {s} = '' THEN NULL WHEN regexp_extract({s}, {_PAT}, 1) <> '' THEN "
            f"(CASE WHEN upper(regexp_extract({s}, {_PAT}, 4)) IN ('S', 'W') THEN -{dd} ELSE {dd} END) "
            f"WHEN lower({s}) = 'nan' THEN NULL ELSE TRY_CAST({s} AS DOUBLE) END)")


LOC_SQL = f"""WITH {_sync_sql('2024-01-29 00:00:00')},
loc AS (SELECT opt_id, latitude, longitude, event_timestamp AS updated_at, {_dms_sql('latitude')} AS lat,
               {_dms_sql('longitude')} AS lon FROM sync)"""


@job("location_points", LOC_SQL + f"""
SELECT opt_id, {s6('lat')} AS lat, {s6('lon')} AS lon, printf('POINT(%.6f %.6f)', {s6('lat')}, {s6('lon')}) AS wkt, updated_at
FROM loc WHERE lat IS NOT NULL AND lon IS NOT NULL AND lat BETWEEN -90.0 AND 90.0 AND lon BETWEEN -180.0 AND 180.0""")
def _location_points(spark, sf):
    e = ev(spark, sf)
    return location_points(latest_location(dv.activity_a(e), dv.activity_b(e), D, days=1))


@job("location_rejects", LOC_SQL + """
SELECT opt_id, latitude, longitude, CASE WHEN lat IS NULL OR lon IS NULL THEN 'unparseable' ELSE 'out_of_bounds' END AS reason
FROM loc WHERE lat IS NULL OR lon IS NULL OR NOT (lat BETWEEN -90.0 AND 90.0 AND lon BETWEEN -180.0 AND 180.0)""")
def _location_rejects(spark, sf):
    e = ev(spark, sf)
    return location_rejects(latest_location(dv.activity_a(e), dv.activity_b(e), D, days=1))


@job("entity_enriched", f"""WITH {dv.DIMENSIONS_SQL}
SELECT upper(u.user_code) AS opt_id, u.user_name, u.user_uid, ea.org_name AS ea_name, ea.org_code AS ea_code,
       rg.org_name AS reg_name, rg.org_code AS reg_code, coalesce(c.phone1, c.phone2) AS phone_number,
       coalesce(c.email_id1, c.email_id2) AS email, o.ro_name
FROM usr u LEFT JOIN org ea ON ea.org_key = u.user_org_key LEFT JOIN org rg ON rg.org_key = u.user_reg_org_key
LEFT JOIN con c ON c.contact_key = u.user_contact_key LEFT JOIN ofc o ON o.ro_key = u.ro_key""")
def _entity_enriched(spark, sf):
    t = lambda n: read_table(spark, sf, n)
    return enrich_entities(dv.users(t("customer")), dv.organizations(t("nation")), dv.contacts(t("supplier")),
                           dv.offices(t("region")))


# ------------------------------------------------------------------------------------------- step 10
def _master(spark, sf):
    return dv.master_target(read_table(spark, sf, "customer")), dv.master_source(read_table(spark, sf, "supplier"))


def _upsert_sql(exprs: dict[str, str], join: str = "FULL OUTER JOIN", key="coalesce(t.id, s.id)") -> str:
    cols = ["name", "reg", "reg_code", "phone", "client_version", "risk_score", "updated_at"]
    sel = ", ".join(f"{exprs.get(c, 't.' + c)} AS {c}" for c in cols)
    return f"WITH {dv.MASTER_SQL} SELECT {key} AS id, {sel} FROM tgt t {join} src s ON t.id = s.id"


_IN_S = "s.id IS NOT NULL"


@job("upsert_overwrite", _upsert_sql({
    "name": f"CASE WHEN {_IN_S} THEN s.name ELSE t.name END",
    "risk_score": f"CASE WHEN {_IN_S} THEN s.risk_score ELSE t.risk_score END",
    "updated_at": f"CASE WHEN {_IN_S} THEN {NOW_SQL} ELSE t.updated_at END"}))
def _upsert_overwrite(spark, sf):
    t, s = _master(spark, sf)
    return upsert(t, s, "id", {"name": "overwrite", "risk_score": "overwrite"}, _now())


@job("upsert_keep_old", _upsert_sql({
    "name": f"CASE WHEN {_IN_S} THEN s.name ELSE t.name END",
    "client_version": f"CASE WHEN {_IN_S} THEN coalesce(s.client_version, t.client_version) ELSE t.client_version END",
    "updated_at": f"CASE WHEN {_IN_S} THEN {NOW_SQL} ELSE t.updated_at END"}))
def _upsert_keep_old(spark, sf):
    t, s = _master(spark, sf)
    return upsert(t, s, "id", {"name": "overwrite", "client_version": "keep_old"}, _now())


_MISS_REG = "(t.reg IS NULL OR t.reg IN ('None', 'Unknown'))"


@job("upsert_fill_missing", _upsert_sql({
    "name": f"CASE WHEN {_IN_S} AND (t.id IS NULL OR t.name IS NULL) THEN s.name ELSE t.name END",
    "phone": f"CASE WHEN {_IN_S} AND (t.id IS NULL OR t.phone IS NULL) THEN s.phone ELSE t.phone END",
    "reg": f"CASE WHEN {_IN_S} AND (t.id IS NULL OR {_MISS_REG}) THEN s.reg ELSE t.reg END",
    "reg_code": f"CASE WHEN {_IN_S} AND (t.id IS NULL OR {_MISS_REG}) THEN s.reg_code ELSE t.reg_code END",
    "updated_at": f"CASE WHEN {_IN_S} AND (t.id IS NULL OR t.name IS NULL OR t.phone IS NULL OR {_MISS_REG}) "
                  f"THEN {NOW_SQL} ELSE t.updated_at END"}))
def _upsert_fill_missing(spark, sf):
    t, s = _master(spark, sf)
    return upsert(t, s, "id", {"name": "fill_missing", "phone": "fill_missing", "reg": "fill_sentinel",
                               "reg_code": ("follow", "reg")}, _now(), touch="missing")


@job("update_matched_only", _upsert_sql({
    "risk_score": f"CASE WHEN {_IN_S} THEN s.risk_score ELSE t.risk_score END",
    "updated_at": f"CASE WHEN {_IN_S} THEN {NOW_SQL} ELSE t.updated_at END"}, join="LEFT JOIN", key="t.id"))
def _update_matched_only(spark, sf):
    t, s = _master(spark, sf)
    return upsert(t, s.select("id", "risk_score"), "id", {"risk_score": "overwrite"}, _now(), insert=False)


MARK = "2024-01-25 00:00:00"


def _per_type_history(spark, sf):
    """Per daily count feature: its name and the first/last daily-cell timestamp (one aggregate over
    the daily cells)."""
    f = fv(spark, sf)
    return f.groupBy("feature_id").agg(F.any_value("feature_name").alias("feature_name"),
                                       F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"))


@job("watermark_advance", f"""WITH {fv_cte()},
reg AS (SELECT feature_id, CASE WHEN starts_with(feature_id, 'view') THEN NULL
                                WHEN starts_with(feature_id, 'click') OR starts_with(feature_id, 'error') THEN max("timestamp")
                                ELSE min("timestamp") END AS old FROM fv GROUP BY feature_id)
SELECT feature_id, CASE WHEN old IS NULL OR old < TIMESTAMP '{MARK}' THEN TIMESTAMP '{MARK}' ELSE old END AS last_successful_run
FROM reg""")
def _watermark(spark, sf):
    f = _per_type_history(spark, sf)
    fid = F.col("feature_id")
    reg = f.select(
        "feature_id", F.when(fid.startswith("view"), F.lit(None)).when(fid.startswith("click") | fid.startswith("error"), F.col("max_ts"))
         .otherwise(F.col("min_ts")).alias("last_successful_run"))
    marks = reg.select("feature_id", F.lit(MARK).cast("timestamp_ntz").alias("last_successful_run"))
    return advance_watermark(reg, "feature_id", "last_successful_run", marks)


def _registry_text(fid):
    return F.concat(F.lit("[scoring_method:rank_scoring, feature_id:"), fid,
                    F.lit(", range_start:0, range_end:1, require_aggregation:True]"))


_REG_TEXT_SQL = "'[scoring_method:rank_scoring, feature_id:' || feature_id || ', range_start:0, range_end:1, require_aggregation:True]'"


@job("registry_migration", f"""WITH {fv_cte()},
ids AS (SELECT DISTINCT feature_id FROM fv),
reg AS (SELECT feature_id, {_REG_TEXT_SQL} AS dependent_features FROM ids),
mig AS (SELECT CASE WHEN starts_with(feature_id, 'view') THEN replace(feature_id, 'view', 'refund') ELSE feature_id END AS feature_id,
               CASE WHEN starts_with(feature_id, 'signup') THEN '[scoring_method:zscore]' ELSE '  ' || {_REG_TEXT_SQL} || ' ' END AS expected_old,
               replace({_REG_TEXT_SQL}, 'require_aggregation:True', 'require_aggregation:False') AS new FROM ids),
j AS (SELECT mig.*, reg.dependent_features AS current, reg.feature_id IS NOT NULL AS found FROM mig LEFT JOIN reg ON mig.feature_id = reg.feature_id),
o AS (SELECT *, CASE WHEN NOT found THEN 'skip_not_found' WHEN NOT coalesce(trim(current) = trim(expected_old), false) THEN 'skip_mismatch'
                     ELSE 'applied' END AS outcome FROM j)
SELECT feature_id, outcome, current, CASE WHEN outcome = 'applied' THEN new ELSE current END AS final_value FROM o""")
def _registry_migration(spark, sf):
    ids = event_feature_ids(ev(spark, sf)).select("feature_id")
    fid = F.col("feature_id")
    reg = ids.select("feature_id", _registry_text(fid).alias("dependent_features"))
    mig = ids.select(
        F.when(fid.startswith("view"), F.replace(fid, F.lit("view"), F.lit("refund"))).otherwise(fid).alias("feature_id"),
        F.when(fid.startswith("signup"), F.lit("[scoring_method:zscore]"))
         .otherwise(F.concat(F.lit("  "), _registry_text(fid), F.lit(" "))).alias("expected_old"),
        F.replace(_registry_text(fid), F.lit("require_aggregation:True"), F.lit("require_aggregation:False")).alias("new"))
    return compare_and_set(reg, mig, apply=True, force=False)


_MIRROR_SQL = f"""WITH reg AS (SELECT 'f' || p_partkey AS feature_id, p_name AS feature_name, CAST(p_size % 3 + 1 AS VARCHAR) AS version, 'about ' || p_name AS description,
        CASE WHEN p_partkey % 2 = 0 THEN 'double' END AS data_type, CASE WHEN p_partkey % 5 = 0 THEN 'DEV' ELSE 'PROD' END AS status,
        CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 2 = 0 END AS is_active, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 7 = 0 END AS is_risk,
        p_size || ' days' AS update_window, 'lake.' || p_type AS source_table, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE 'scores' END AS destination_table,
        'select ' || p_size AS query, [p_brand, 'v' || p_size] AS dependent_features,
        CASE WHEN p_partkey % 4 > 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_seconds(p_partkey) END AS created_at, 'ann' AS created_by,
        CASE WHEN p_partkey % 9 > 0 THEN TIMESTAMP '2024-01-02 00:00:00' + to_seconds(p_partkey) END AS updated_at, CAST(NULL AS VARCHAR) AS updated_by FROM part),
mirror AS (SELECT feature_id AS id, feature_name AS name, description, data_type, status, CAST(coalesce(is_active, false) AS INTEGER) AS is_active,
       CAST(coalesce(is_risk, false) AS INTEGER) AS is_risk, version, update_window, source_table, destination_table, query AS source_query,
       CAST(to_json(dependent_features) AS VARCHAR) AS dependent_features, '' AS category,
       strftime(coalesce(created_at, {NOW_SQL}), '%Y-%m-%d %H:%M:%S') AS created_at, created_by,
       strftime(coalesce(updated_at, {NOW_SQL}), '%Y-%m-%d %H:%M:%S') AS updated_at, updated_by FROM reg)"""


def _mirrored(spark, sf):
    """A registry with a row for every part, as the mirror has it."""
    p, key = read_table(spark, sf, "part"), F.col("p_partkey")
    size = F.col("p_size").cast("string")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    at = lambda days: base + F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), key)
    reg = p.select(
        F.concat(F.lit("f"), key.cast("string")).alias("feature_id"), F.col("p_name").alias("feature_name"), (F.col("p_size") % 3 + 1).cast("string").alias("version"),
        F.concat(F.lit("about "), "p_name").alias("description"), F.when(key % 2 == 0, F.lit("double")).alias("data_type"),
        F.when(key % 5 == 0, F.lit("DEV")).otherwise(F.lit("PROD")).alias("status"), F.when(key % 3 > 0, key % 2 == 0).alias("is_active"),
        F.when(key % 4 > 0, key % 7 == 0).alias("is_risk"), F.concat(size, F.lit(" days")).alias("update_window"),
        F.concat(F.lit("lake."), "p_type").alias("source_table"), F.when(key % 6 > 0, F.lit("scores")).alias("destination_table"),
        F.concat(F.lit("select "), size).alias("query"), F.array(F.col("p_brand"), F.concat(F.lit("v"), size)).alias("dependent_features"),
        F.when(key % 4 > 0, at(0)).alias("created_at"), F.lit("ann").alias("created_by"), F.when(key % 9 > 0, at(1)).alias("updated_at"),
        F.lit(None).cast("string").alias("updated_by"))
    return registry_mirror(reg, _now())


@job("registry_mirror", _MIRROR_SQL + " SELECT * FROM mirror")
def _registry_mirror(spark, sf):
    """The 18 columns of the mirror."""
    return _mirrored(spark, sf)


@job("registry_mirror_upsert", _MIRROR_SQL + """, held AS (SELECT * REPLACE ('old ' || name AS name, 'kept' AS category) FROM mirror WHERE CAST(id[2:] AS BIGINT) % 3 > 0
       UNION ALL SELECT * REPLACE ('gone' || id AS id) FROM mirror WHERE CAST(id[2:] AS BIGINT) % 10 = 0)
SELECT * FROM mirror UNION ALL SELECT * FROM held WHERE id NOT IN (SELECT id FROM mirror)""")
def _registry_mirror_upsert(spark, sf):
    """S17 + S10: the mirror written over an older one: its rows take all 18 columns, rows that the registry no longer has stay."""
    new = _mirrored(spark, sf)
    number = F.substr("id", F.lit(2)).cast("long")
    held = new.where(number % 3 > 0).withColumn("name", F.concat(F.lit("old "), "name")).withColumn("category", F.lit("kept"))
    held = held.unionByName(new.where(number % 10 == 0).withColumn("id", F.concat(F.lit("gone"), "id")))
    return upsert(held, new, "id", {c: "overwrite" for c in new.columns if c != "id"}, _now(), touch="never")


# ------------------------------------------------------------------------------------------- step 11
CUM = "click_count_cumulative_v1"
PF_START, PF_END = _dt.date(2024, 1, 25), _dt.date(2024, 2, 2)


def _cum_store(f):
    run = cumulative_feature(f, CLICK, _dt.date(2024, 1, 1), D)
    cum = run.select("entity_id", F.lit(CUM).alias("feature_id"), "feature_value",
                     (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(23), F.lit(59), F.lit(59)))
                     .alias("timestamp"))
    return cum.unionByName(f.select("entity_id", "feature_id", "feature_value", "timestamp"))


CUM_STORE_SQL = f"""{fv_cte()},
cum AS (SELECT entity_id, '{CUM}' AS feature_id,
               sum(feature_value) OVER (PARTITION BY entity_id ORDER BY {day_sql()} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS feature_value,
               CAST({day_sql()} AS TIMESTAMP) + INTERVAL 86399 SECOND AS "timestamp" FROM fv WHERE feature_id = '{CLICK}'),
cstore AS (SELECT entity_id, feature_id, feature_value, "timestamp" FROM cum
           UNION ALL SELECT entity_id, feature_id, feature_value, "timestamp" FROM fv)"""


def _series(a: _dt.date, b: _dt.date, name: str = "d") -> str:
    return f"(SELECT CAST(unnest(generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 DAY)) AS DATE) AS {name})"


@job("preflight_report", f"""WITH {CUM_STORE_SQL},
f AS (SELECT * FROM cstore WHERE feature_id = '{CUM}')
SELECT '{CUM}' AS feature_id, 'existing_rows' AS check_kind, CAST({day_sql()} AS VARCHAR) AS day, count(*) AS n_rows, false AS blocking
FROM f WHERE {day_sql()} BETWEEN DATE '{PF_START}' AND DATE '{PF_END}' GROUP BY {day_sql()}
UNION ALL SELECT '{CUM}', 'seed_history', CAST(max({day_sql()}) AS VARCHAR), count(DISTINCT entity_id), false
FROM f WHERE "timestamp" < TIMESTAMP '{PF_START} 00:00:00'
UNION ALL SELECT '{CUM}', 'later_rows', CAST(max({day_sql()}) AS VARCHAR), count(*), count(*) > 0
FROM f WHERE "timestamp" >= TIMESTAMP '{PF_END + _dt.timedelta(days=1)} 00:00:00'
UNION ALL SELECT '{CUM}', 'missing_daily', CAST(d AS VARCHAR), 0, true FROM {_series(PF_START, PF_END)}
WHERE d NOT IN (SELECT {day_sql()} FROM cstore WHERE feature_id = '{CLICK}')""")
def _preflight(spark, sf):
    store = materialize(_cum_store(fv(spark, sf, event_types=["click"])))     # the destination table
    out = q.preflight(store, CUM, CLICK, PF_START, PF_END)
    return out.withColumn("day", F.col("day").cast("string"))


MANY = [(f"{t}_score_v1", f"{t}_count_daily_v1") for t in ("click", "error", "purchase", "signup", "view", "refund")]
MANY_START, MANY_END = _dt.date(2023, 12, 28), _dt.date(2024, 1, 15)
WAIVERS = [(None, "later_rows"), ("error_score_v1", "missing_daily")]
_MANY_SQL = f"""WITH {score_store_cte(RISK_WEIGHTS)}, {fv_cte()},
every AS (SELECT feature_id, {day_sql()} AS day FROM store UNION ALL SELECT feature_id, {day_sql()} FROM fv),
feats(feature_id, daily) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in MANY)}),
perday AS (SELECT feature_id, day, count(*) AS n FROM every GROUP BY ALL),
own AS (SELECT p.* FROM perday p JOIN feats USING (feature_id)),
absent AS (SELECT f.feature_id, s.d FROM feats f, {_series(MANY_START, MANY_END)} s
           WHERE NOT EXISTS (SELECT 1 FROM perday p WHERE p.feature_id = f.daily AND p.day = s.d)),
islands AS (SELECT feature_id, d, d - CAST(row_number() OVER (PARTITION BY feature_id ORDER BY d) AS INTEGER) AS island FROM absent),
report AS (
  SELECT feature_id, 'existing_rows' AS check_kind, day AS first_day, day AS last_day, n, false AS blocks FROM own WHERE day BETWEEN DATE '{MANY_START}' AND DATE '{MANY_END}'
  UNION ALL SELECT feature_id, 'seed_history', max(day), max(day), arg_max(n, day), false FROM own WHERE day < DATE '{MANY_START}' GROUP BY feature_id
  UNION ALL SELECT feature_id, 'later_rows', min(day), max(day), CAST(sum(n) AS BIGINT), true FROM own WHERE day > DATE '{MANY_END}' GROUP BY feature_id
  UNION ALL SELECT feature_id, 'missing_daily', min(d), max(d), count(*), true FROM islands GROUP BY feature_id, island),
judged AS (SELECT *, blocks AND (check_kind = 'later_rows' OR (check_kind = 'missing_daily' AND feature_id = 'error_score_v1')) AS waived FROM report)"""


def _preflight_many(spark, sf):
    store = _store(spark, sf)
    both = store.select("feature_id", "timestamp").unionByName(fv(spark, sf).select("feature_id", "timestamp"))
    features = spark.createDataFrame(MANY, "feature_id string, daily_feature_id string")
    return q.preflight_many(both, features, MANY_START, MANY_END, spark.createDataFrame(WAIVERS, "feature_id string, check_kind string")), features


@job("preflight_many", _MANY_SQL + """
SELECT feature_id, check_kind, CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, n, blocks AND NOT waived AS blocking, waived FROM judged""")
def _preflight_many_job(spark, sf):
    """G1/J10 for six features at once, with waived and blocking findings."""
    report, _ = _preflight_many(spark, sf)
    return report.withColumn("first_day", F.col("first_day").cast("string")).withColumn("last_day", F.col("last_day").cast("string"))


@job("preflight_verdicts", _MANY_SQL + """
SELECT f.feature_id, coalesce(bool_or(blocks AND NOT waived), false) AS blocked, count(*) FILTER (WHERE waived) AS n_waived
FROM feats f LEFT JOIN judged j ON j.feature_id = f.feature_id GROUP BY f.feature_id""")
def _preflight_verdicts_job(spark, sf):
    return q.preflight_verdicts(*_preflight_many(spark, sf))


MD_START, MD_END = _dt.date(2023, 12, 30), _dt.date(2024, 1, 31)


@job("missing_days", f"""WITH {fv_cte()},
ids AS (SELECT DISTINCT feature_id FROM fv), present AS (SELECT DISTINCT feature_id, {day_sql()} AS d FROM fv)
SELECT ids.feature_id, CAST(s.d AS VARCHAR) AS day FROM ids, {_series(MD_START, MD_END)} s
WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.feature_id = ids.feature_id AND p.d = s.d)""")
def _missing_days(spark, sf):
    f = fv(spark, sf, start=MD_START, end=MD_END)
    return q.missing_days(f, ["feature_id"], MD_START, MD_END).withColumn("day", F.col("day").cast("string"))


REQUESTED = [CLICK, "error_count_daily_v1", "purchase_count_daily_v1", "signup_count_daily_v1", "view_count_daily_v1",
             "refund_count_daily_v1", "login_count_daily_v1"]


@job("missing_features", f"""WITH {fv_cte()}
SELECT feature_id FROM (VALUES {', '.join(f"('{r}')" for r in REQUESTED)}) t(feature_id)
WHERE feature_id NOT IN (SELECT feature_id FROM fv WHERE {day_sql()} <= {DS})""")
def _missing_features(spark, sf):
    return missing_feature_ids(fv(spark, sf, end=D), REQUESTED, D)


PLAN_FEATURES = [(f"{t}_score_v1", f"{t}_count_daily_v1") for t in ("click", "error", "purchase", "signup", "view", "refund")]
PLAN_START, PLAN_END = _dt.date(2024, 1, 27), _dt.date(2024, 2, 2)
_PF_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in PLAN_FEATURES)


@job("backfill_plan", f"""WITH {score_store_cte(RISK_WEIGHTS)}, {fv_cte()},
feats AS (SELECT * FROM (VALUES {_PF_VALUES}) t(feature_id, source_feature_id)),
ex AS (SELECT feature_id, {day_sql()} AS target_date, count(*) AS existing_rows FROM store GROUP BY 1, 2),
srcd AS (SELECT feature_id AS source_feature_id, {day_sql()} AS day, count(*) AS n FROM fv GROUP BY 1, 2),
j AS (SELECT f.feature_id, d.d AS target_date, CAST(coalesce(ex.existing_rows, 0) AS BIGINT) AS existing_rows,
             CAST(coalesce((SELECT sum(n) FROM srcd WHERE srcd.source_feature_id = f.source_feature_id
                            AND srcd.day BETWEEN d.d - 30 AND d.d), 0) AS BIGINT) AS source_rows
      FROM feats f CROSS JOIN {_series(PLAN_START, PLAN_END)} d
      LEFT JOIN ex ON ex.feature_id = f.feature_id AND ex.target_date = d.d)
SELECT feature_id, CAST(target_date AS VARCHAR) AS target_date, existing_rows, source_rows,
       CASE WHEN existing_rows > 0 THEN 'SKIP' WHEN source_rows = 0 THEN 'EMPTY' ELSE 'DRYRUN' END AS outcome FROM j""")
def _backfill_plan(spark, sf):
    feats = spark.createDataFrame(PLAN_FEATURES, "feature_id string, source_feature_id string")
    src = fv(spark, sf, start=PLAN_START - _dt.timedelta(days=30), end=PLAN_END)
    out = q.backfill_plan(feats, F.sequence(F.lit(PLAN_START), F.lit(PLAN_END)), _store(spark, sf), src, 30)
    return out.withColumn("target_date", F.col("target_date").cast("string"))


RP_START, RP_END = _dt.date(2024, 1, 1), _dt.date(2024, 2, 5)


@job("resume_points", f"""WITH {score_store_cte(RISK_WEIGHTS)},
feats AS (SELECT * FROM (VALUES {_PF_VALUES}) t(feature_id, source_feature_id)),
present AS (SELECT DISTINCT feature_id, {day_sql()} AS d FROM store),
gaps AS (SELECT f.feature_id, s.d FROM feats f, {_series(RP_START, RP_END)} s
         WHERE NOT EXISTS (SELECT 1 FROM present p WHERE p.feature_id = f.feature_id AND p.d = s.d))
SELECT f.feature_id, CAST(min(g.d) AS VARCHAR) AS resume_from FROM feats f LEFT JOIN gaps g ON f.feature_id = g.feature_id
GROUP BY f.feature_id""")
def _resume_points(spark, sf):
    feats = spark.createDataFrame(PLAN_FEATURES, "feature_id string, source_feature_id string")
    out = q.resume_points(_store(spark, sf), feats, RP_START, RP_END)
    return out.withColumn("resume_from", F.col("resume_from").cast("string"))


GATE_COLS = ["status", "cadence", "category"]


def _latest_status(spark, sf, cols=None):
    return q.latest_status(dv.status_log(read_table(spark, sf, "orders")), cols)


@job("status_latest", f"""WITH {dv.STATUS_SQL}
SELECT run_id, dag_id, task_key, category, status, cadence, written_at,
       length(left(error, 2000)) AS error_len, length(right(traceback, 4000)) AS traceback_len FROM latest_status""")
def _status_latest(spark, sf):
    return _latest_status(spark, sf).select(
        "run_id", "dag_id", "task_key", "category", "status", "cadence", "written_at",
        F.length("error").cast("long").alias("error_len"), F.length("traceback").cast("long").alias("traceback_len"))


@job("category_verdicts", f"""WITH {dv.STATUS_SQL},
r AS (SELECT *, (status IS NULL OR status <> 'skipped') AND (cadence IS NULL OR cadence <> 'hourly') AS relevant FROM latest_status)
SELECT run_id, category, count(*) FILTER (WHERE relevant) AS n_relevant,
       coalesce(count(*) FILTER (WHERE relevant) > 0 AND bool_and(CASE WHEN relevant THEN coalesce(status = 'success', false) END), false) AS valid
FROM r GROUP BY run_id, category""")
def _category_verdicts(spark, sf):
    return q.category_verdicts(_latest_status(spark, sf, GATE_COLS))


def _work(spark, sf):
    return dv.status_log(read_table(spark, sf, "orders")).select("run_id", "dag_id", "task_key", "category").distinct()


@job("pending_work", f"""WITH {dv.STATUS_SQL},
work AS (SELECT DISTINCT run_id, dag_id, task_key, category FROM slog2)
SELECT * FROM work w WHERE NOT EXISTS (SELECT 1 FROM latest_status s WHERE s.status = 'success' AND s.run_id = w.run_id
                                       AND s.dag_id = w.dag_id AND s.task_key = w.task_key)""")
def _pending_work(spark, sf):
    return q.pending_work(_work(spark, sf), _latest_status(spark, sf, GATE_COLS))


def _deps_col():
    dep = lambda d, t: F.struct(F.lit(d).alias("dag_id"), t.alias("task_key"))
    own = dep("dag_0", F.col("task_key"))
    cat = dep("dag_0", F.concat(F.col("category"), F.lit("_f0")))
    return (F.when(F.col("dag_id") == "dag_0", F.array().cast("array<struct<dag_id:string,task_key:string>>"))
             .when(F.col("category").isNull(), F.array(own)).otherwise(F.array(own, cat)))


@job("ready_work", f"""WITH {dv.STATUS_SQL},
work AS (SELECT DISTINCT run_id, dag_id, task_key, category FROM slog2),
deps AS (SELECT run_id, dag_id, task_key, 'dag_0' AS d_dag, task_key AS d_task FROM work WHERE dag_id <> 'dag_0'
         UNION ALL SELECT run_id, dag_id, task_key, 'dag_0', category || '_f0' FROM work WHERE dag_id <> 'dag_0' AND category IS NOT NULL),
succ AS (SELECT run_id, dag_id, task_key FROM latest_status WHERE status = 'success')
SELECT w.run_id, w.dag_id, w.task_key, count(d.d_task) AS n_deps, count(d.d_task) - count(s.task_key) AS n_missing,
       count(s.task_key) = count(d.d_task) AS ready
FROM work w LEFT JOIN deps d ON d.run_id = w.run_id AND d.dag_id = w.dag_id AND d.task_key = w.task_key
LEFT JOIN succ s ON s.run_id = d.run_id AND s.dag_id = d.d_dag AND s.task_key = d.d_task
GROUP BY w.run_id, w.dag_id, w.task_key""")
def _ready_work(spark, sf):
    return q.ready_work(_work(spark, sf).withColumn("dependencies", _deps_col()), _latest_status(spark, sf, GATE_COLS))


# ------------------------------------------------------------------------------------------- the master, end to end
MASTER_COLUMNS = ("id string, risk_score double, risk_bucket string, district string, machine_code string, client_version string, client_type string, "
                  "lat double, lon double, top_anomaly string, name string, ro string, is_active int, updated_at timestamp_ntz")


def master_before(customer):
    """A master that knows two of three customers, some of them without a name or office."""
    c = F.col("c_custkey")
    known = {"id": c.cast("string"), "name": F.when(c % 5 > 0, F.col("c_name")),
             "ro": F.when(c % 7 == 1, F.lit("Unknown")).when(c % 7 > 2, F.col("c_mktsegment")),
             "updated_at": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")}
    return customer.where(c % 3 > 0).select(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in (x.split() for x in MASTER_COLUMNS.split(", "))])


def master_steps(spark, sf, master):
    from riskweave.operators.master import risk_buckets, top_anomaly
    from riskweave.plans.catalog import ANOMALY_CODES
    from riskweave.plans.master_refresh import Step, users_to_refresh
    t = lambda n: read_table(spark, sf, n)
    store, e = _store(spark, sf), ev(spark, sf)
    a, b = dv.activity_a(e), dv.activity_b(e)
    users = dv.users(t("customer")).withColumn("user_code", F.col("user_key").cast("string")).withColumn(
        "last_updated_date", F.date_sub(F.lit(D), (F.col("user_key") % 10).cast("int")))
    users = users_to_refresh(users, master, D)
    meta = enrich_entities(users, dv.organizations(t("nation")), dv.contacts(t("supplier")), dv.offices(t("region")))
    status = t("customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_acctbal") > 0).cast("int").alias("is_active"))
    sync = latest_sync(a, b, D, days=30).select(F.col("opt_id").alias("id"), "district", "machine_code", "client_version", "client_type")
    points = location_points(latest_location(a, b, D, days=1)).select(F.col("opt_id").alias("id"), "lat", "lon")
    top = top_anomaly(store, ANOMALY_CODES, latest_score_date(store, "risk_score_v1"), entity_store(spark, sf)).select(
        F.col("opt_id").alias("id"), F.col("anomaly_code_with_highest_score").alias("top_anomaly"))
    over = lambda *names: dict.fromkeys(names, "overwrite")
    return [
        Step(risk_buckets(store, "risk_score_v1").withColumnRenamed("entity_id", "id"), over("risk_score", "risk_bucket")),
        Step(sync, {**over("district", "machine_code", "client_type"), "client_version": "keep_old"}),
        Step(points, over("lat", "lon"), insert=False),
        Step(top, over("top_anomaly"), insert=False),
        Step(meta.select(F.col("opt_id").alias("id"), F.col("user_name").alias("name"), F.col("ro_name").alias("ro")), {"name": "fill_missing", "ro": "fill_sentinel"}),
        Step(status, over("is_active"), insert=False),
    ]


def _master_sql() -> str:
    from riskweave.plans.catalog import _anomaly_sql
    points = LOC_SQL + f""" SELECT opt_id, {s6('lat')} AS lat, {s6('lon')} AS lon FROM loc
      WHERE lat IS NOT NULL AND lon IS NOT NULL AND lat BETWEEN -90.0 AND 90.0 AND lon BETWEEN -180.0 AND 180.0"""
    return f"""WITH b AS ({_BUCKET_SQL} SELECT * FROM bucketed), s AS ({SYNC_SQL}), p AS ({points}), t AS ({_anomaly_sql()}),
m AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS name,
             CASE WHEN c_custkey % 7 = 1 THEN 'Unknown' WHEN c_custkey % 7 > 2 THEN c_mktsegment END AS ro FROM customer WHERE c_custkey % 3 > 0),
u AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, r_name AS ro FROM customer LEFT JOIN region ON r_regionkey = c_custkey % 6
      WHERE c_custkey % 10 <= 7 OR (c_custkey % 3 > 0 AND c_custkey % 7 = 1)),
ids AS (SELECT id FROM m UNION SELECT entity_id FROM b UNION SELECT opt_id FROM s UNION SELECT id FROM u),
act AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CAST(c_acctbal > 0 AS INTEGER) AS is_active FROM customer),
out AS (SELECT ids.id, b.risk_score, b.risk_bucket, s.district, s.machine_code, s.client_version, s.client_type, p.lat, p.lon,
               t.anomaly_code_with_highest_score AS top_anomaly,
               CASE WHEN u.id IS NOT NULL AND m.name IS NULL THEN u.name ELSE m.name END AS name,
               CASE WHEN u.id IS NOT NULL AND (m.ro IS NULL OR m.ro = 'Unknown') THEN u.ro ELSE m.ro END AS ro,
               act.is_active, m.id IS NULL AS fresh, m.name AS old_name, m.ro AS old_ro
        FROM ids LEFT JOIN m USING (id) LEFT JOIN b ON b.entity_id = ids.id LEFT JOIN s ON s.opt_id = ids.id LEFT JOIN p ON p.opt_id = ids.id
        LEFT JOIN t ON t.opt_id = ids.id LEFT JOIN u ON u.id = ids.id LEFT JOIN act ON act.id = ids.id)
SELECT * EXCLUDE (fresh, old_name, old_ro), CASE WHEN fresh OR coalesce(risk_score::VARCHAR, risk_bucket, district, machine_code, client_version, client_type,
       lat::VARCHAR, lon::VARCHAR, top_anomaly, is_active::VARCHAR) IS NOT NULL OR name IS DISTINCT FROM old_name OR ro IS DISTINCT FROM old_ro
       THEN {NOW_SQL} ELSE TIMESTAMP '2024-01-01 00:00:00' END AS updated_at FROM out"""


@job("master_refresh", _master_sql())
def _master_refresh(spark, sf):
    """M11, M14, M15, M12, M16 and activeness into one master, twice: the second run, a day later, moves no ``updated_at``."""
    from riskweave.plans.master_refresh import refresh_master
    before = master_before(read_table(spark, sf, "customer"))
    once = materialize(refresh_master(before, master_steps(spark, sf, before), _now()))
    return refresh_master(once, master_steps(spark, sf, before), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


@job("master_second_run", f"SELECT CAST(0 AS BIGINT) AS n_changed, count(*) AS n_rows FROM ({_master_sql()})")
def _master_second_run(spark, sf):
    """Rows that a second run over the same inputs changes."""
    from riskweave.plans.master_refresh import changed_rows, refresh_master
    before = master_before(read_table(spark, sf, "customer"))
    once = materialize(refresh_master(before, master_steps(spark, sf, before), _now()))
    twice = refresh_master(once, master_steps(spark, sf, before), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return changed_rows(once, twice).agg(F.count(F.lit(1)).alias("n_changed")).crossJoin(once.agg(F.count(F.lit(1)).alias("n_rows")))


# ------------------------------------------------------------------------------------------- step 13
SERVE_START = _dt.date(2024, 1, 24)


@job("serving_latest", f"""WITH {fv_cte()},
w AS (SELECT * FROM fv WHERE {day_sql()} BETWEEN DATE '{SERVE_START}' AND {DS}),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, feature_id ORDER BY "timestamp" DESC, feature_value DESC) AS rn FROM w) WHERE rn = 1)
SELECT entity_id, feature_id, "timestamp", feature_value FROM l
WHERE entity_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)""")
def _serving_latest(spark, sf):
    active = read_table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").cast("string").alias("entity_id"))
    return serving_latest(fv(spark, sf, start=SERVE_START, end=D), active, SERVE_START, D)


PUSHED = ["click_count_daily_v1", "error_count_daily_v1", "purchase_count_daily_v1"]
PUSH_START = _dt.date(2024, 1, 20)


@job("serving_push", f"""WITH {fv_cte()},
w AS (SELECT *, {day_sql()} AS d FROM fv WHERE feature_id IN ({", ".join(f"'{p}'" for p in PUSHED)}) AND {day_sql()} BETWEEN DATE '{PUSH_START}' AND {DS}
      AND entity_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0))
SELECT entity_id, feature_id, CAST(d AS VARCHAR) AS ds, feature_value, '2024-01-30' AS last_successful_run FROM w
QUALIFY row_number() OVER (PARTITION BY entity_id, feature_id ORDER BY d DESC, "timestamp" DESC, feature_value DESC) = 1""")
def _serving_push(spark, sf):
    """S9 + S14: two overlapping pushes, the second one replayed, and one that fails: rows and marks are those of two pushes."""
    from riskweave.plans.serving import SERVING_SCHEMA, push_serving, pushed_values
    from riskweave.sources.versioned import VersionedTable
    active = read_table(spark, sf, "customer").where(F.col("c_acctbal") > 0).select(F.col("c_custkey").cast("string").alias("entity_id"))
    table = VersionedTable(spark, scratch_table_path(spark, "serving"), SERVING_SCHEMA)
    f = fv(spark, sf, start=PUSH_START, end=D)
    push_serving(table, f, active, PUSHED, PUSH_START, _dt.date(2024, 1, 27), "push-1")
    for _ in range(2):
        push_serving(table, f, active, PUSHED, _dt.date(2024, 1, 24), D, "push-2")
    return pushed_values(table).select("entity_id", "feature_id", "ds", "feature_value", "last_successful_run")


CATEGORY_OF = {"click_count_daily_v1": "Work Category", "error_count_daily_v1": "Sustxn Category",
               "purchase_count_daily_v1": "Bio Category", "signup_count_daily_v1": "Bio Category",
               "view_count_daily_v1": "Document Category"}
CATEGORY_NAMES = ["Work Category", "Sustxn Category", "Bio Category", "Document Category", "Hardware Category"]
DESCRIPTIONS = {k: "daily count of " + k.split("_")[0] + " events" for k in CATEGORY_OF}


CATEGORY_SCORE = {"Work Category": "click_score_v1", "Sustxn Category": "error_score_v1", "Bio Category": "signup_score_v1",
                  "Document Category": "view_score_v1"}


def _documents(spark, sf):
    e = ev(spark, sf)
    latest = serving_latest(fv(spark, sf, start=SERVE_START, end=D), read_table(spark, sf, "customer")
                            .select(F.col("c_custkey").cast("string").alias("entity_id")), SERVE_START, D)
    store = _store(spark, sf)
    day = latest_score_date(store, "risk_score_v1")
    newest = store.where(F.to_date("ds") == day)
    risk = newest.where(F.col("feature_id") == "risk_score_v1").select(
        "entity_id", F.col("feature_value").alias("overall_risk_score"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("risk_analysis_updated_at"))
    packets = e.groupBy(F.col("user_id").cast("string").alias("entity_id")).agg(
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_packet_timestamp"))
    ro = entity_store(spark, sf).select(F.col("opt_id").alias("entity_id"), F.col("opt_ro").alias("ro_name"))
    entities = risk.join(packets, "entity_id", "left").join(ro, "entity_id", "left")
    return serving_document(latest, entities, CATEGORY_OF, DESCRIPTIONS, CATEGORY_NAMES, category_scores=category_scores(newest, CATEGORY_SCORE))


_DOC_SQL = f"""WITH {score_store_cte(RISK_WEIGHTS)}, {fv_cte()}, {STORE_SQL},
newest AS (SELECT * FROM store WHERE CAST("timestamp" AS DATE) = (SELECT max(CAST("timestamp" AS DATE)) FROM store WHERE feature_id = 'risk_score_v1')),
vals AS (SELECT entity_id, feature_id, feature_value, "timestamp" FROM fv WHERE {day_sql()} BETWEEN DATE '{SERVE_START}' AND {DS}
         AND entity_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)
         QUALIFY row_number() OVER (PARTITION BY entity_id, feature_id ORDER BY "timestamp" DESC, feature_value DESC) = 1),
cats(category_name, score_id) AS (VALUES {", ".join(f"('{n}', '{CATEGORY_SCORE.get(n, '')}')" for n in CATEGORY_NAMES)}),
kinds(feature_id, category_name) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in CATEGORY_OF.items())}),
texts AS (SELECT entity_id, category_name, string_agg(feature_id || ' ' || printf('%.3f', feature_value) || ' daily count of ' || split_part(feature_id, '_', 1) || ' events '
                 || strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || '+05:30', ';' ORDER BY "timestamp" DESC, feature_id DESC) AS features
          FROM vals JOIN kinds USING (feature_id) GROUP BY ALL),
heads AS (SELECT n.entity_id, n.feature_value AS overall_risk_score, strftime(n."timestamp", '%Y-%m-%d %H:%M:%S') AS risk_analysis_updated_at,
                 o.opt_ro AS ro_name, (SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S') FROM events WHERE CAST(user_id AS VARCHAR) = n.entity_id) AS last_packet_timestamp
          FROM newest n LEFT JOIN ostore o ON o.opt_id = n.entity_id WHERE n.feature_id = 'risk_score_v1'),
docs AS (SELECT h.*, c.category_name, coalesce((SELECT max(feature_value) FROM newest s WHERE s.entity_id = h.entity_id AND s.feature_id = c.score_id), 0.0) AS score,
                coalesce(t.features, '') AS features
         FROM heads h CROSS JOIN cats c LEFT JOIN texts t ON t.entity_id = h.entity_id AND t.category_name = c.category_name)
SELECT entity_id AS operator_id, ro_name, overall_risk_score, last_packet_timestamp, risk_analysis_updated_at,
       string_agg(category_name || '=' || printf('%.3f', score) || '[' || features || ']', '|' ORDER BY category_name) AS categories
FROM docs GROUP BY ALL"""


@job("serving_document", _DOC_SQL)
def _serving_document(spark, sf):
    """The nested documents, their categories written out as one text (times in seconds)."""
    one = lambda f: F.concat(f["feature_id"], F.lit(" "), F.format_string("%.3f", f["feature_value"]), F.lit(" "), f["description"], F.lit(" "), f["last_updated"])
    text = F.transform("categories", lambda c: F.concat(c["category_name"], F.lit("="), F.format_string("%.3f", c["category_score"]), F.lit("["),
                                                        F.array_join(F.transform(c["features"], one), ";"), F.lit("]")))
    return _documents(spark, sf).withColumn("categories", F.array_join(text, "|"))


def _views(spark, sf) -> list[str]:
    """The three consumer views over tables that are known by name only."""
    from riskweave.sources.named import consumer_views
    suffix = "_" + uuid.uuid4().hex[:12]
    f = fv(spark, sf).withColumn("ds", F.to_date("timestamp").cast("string"))
    places = entity_store(spark, sf).select(F.col("opt_id").alias("entity_id"), F.col("opt_state").alias("region"))
    for name, frame in (("lake_features", f), ("lake_scores", _store(spark, sf)), ("master_places", places)):
        frame.createOrReplaceTempView(name + suffix)
    return consumer_views(spark, "lake_features" + suffix, "lake_scores" + suffix, "master_places" + suffix, SERVE_START, D, suffix=suffix)


_VIEW_FEATURES = f"""{fv_cte()},
vals AS (SELECT entity_id, feature_id, feature_value, "timestamp" AS value_time FROM fv WHERE {day_sql()} BETWEEN DATE '{SERVE_START}' AND {DS}
         QUALIFY row_number() OVER (PARTITION BY entity_id, feature_id ORDER BY "timestamp" DESC, feature_value DESC) = 1)"""


@job("view_entity_features", f"WITH {_VIEW_FEATURES} SELECT * FROM vals")
def _view_entity_features(spark, sf):
    """The features view, read by its name."""
    return spark.table(_views(spark, sf)[0])


@job("view_entity_risk_summary", _BUCKET_SQL + f""", {_VIEW_FEATURES}
SELECT b.entity_id, b.risk_score, b.risk_bucket, count(v.feature_id) AS n_features,
       (SELECT CAST(max(CAST("timestamp" AS DATE)) AS VARCHAR) FROM store WHERE feature_id = 'risk_score_v1') AS score_date
FROM bucketed b LEFT JOIN vals v ON v.entity_id = b.entity_id GROUP BY ALL""")
def _view_entity_risk_summary(spark, sf):
    return spark.table(_views(spark, sf)[1])


@job("view_entity_risk_by_region", _BUCKET_SQL + f""", {STORE_SQL}
SELECT o.opt_state AS region, count(*) AS n_entities, {s6('avg(b.risk_score)')} AS avg_risk, max(b.risk_score) AS max_risk,
       count(*) FILTER (WHERE b.risk_bucket IN ('Critical', 'High')) AS n_high
FROM bucketed b JOIN ostore o ON o.opt_id = b.entity_id GROUP BY o.opt_state""")
def _view_entity_risk_by_region(spark, sf):
    return spark.table(_views(spark, sf)[2])


@job("risk_by_region", f"""WITH {score_store_cte(RISK_WEIGHTS)}, {STORE_SQL},
r AS (SELECT upper(entity_id) AS opt_id, feature_value FROM store WHERE feature_id = 'risk_score_v1'
      AND {day_sql()} = (SELECT max({day_sql()}) FROM store WHERE feature_id = 'risk_score_v1'))
SELECT o.opt_state AS region, count(*) AS n_entities, {s6('avg(r.feature_value)')} AS avg_risk, max(r.feature_value) AS max_risk
FROM r JOIN ostore o ON r.opt_id = o.opt_id GROUP BY o.opt_state""")
def _risk_by_region(spark, sf):
    """A stable consumer view (explicit columns, one shared definition)."""
    store = _store(spark, sf)
    day = latest_score_date(store, "risk_score_v1")
    r = store.where((F.col("feature_id") == "risk_score_v1") & (F.to_date("ds") == day)).select(
        F.upper("entity_id").alias("opt_id"), "feature_value")
    view = (r.join(entity_store(spark, sf), "opt_id").groupBy(F.col("opt_state").alias("region"))
             .agg(F.count(F.lit(1)).alias("n_entities"), r6(F.avg("feature_value")).alias("avg_risk"),
                  F.max("feature_value").alias("max_risk")))
    view.createOrReplaceTempView("risk_by_region")
    return spark.table("risk_by_region")


# ------------------------------------------------------------------------------------------- step 14
RANGE = DateSpan(_dt.date(2024, 1, 24), D)
_RANGE_SCORE = clip("CASE WHEN n <= 1 OR mr <= 1 THEN 1.0 ELSE 1.0 - (r - 1) / (mr - 1) * 1.0 END", 0.0, 1.0)


@job("backfill_scores_range", f"""WITH {fv_cte()},
x AS (SELECT s.d AS target_date, f.entity_id, sum(f.feature_value) AS v FROM {_series(RANGE.start, RANGE.end)} s
      JOIN fv f ON f.feature_id = '{CLICK}' AND {day_sql('f."timestamp"')} BETWEEN s.d - 30 AND s.d GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY target_date ORDER BY v DESC) AS r, count(*) OVER (PARTITION BY target_date) AS n FROM x),
m AS (SELECT *, max(r) OVER (PARTITION BY target_date) AS mr FROM r)
SELECT CAST(target_date AS VARCHAR) AS target_date, entity_id, {s6(_RANGE_SCORE)} AS score FROM m""")
def _backfill_range(spark, sf):
    """Seven as-of dates in one job: cells fan out to the dates whose 30-day window holds them,
    then one rank per target date."""
    f = fv(spark, sf, start=RANGE.start - _dt.timedelta(days=30), end=RANGE.end, event_types=["click"])
    out = inst.rank_scoring(f, CLICK, RANGE, require_aggregation=True)
    return out.select(F.col("target_date").cast("string").alias("target_date"), "entity_id", r6("score").alias("score"))


_BR_SCORE = clip(f"CASE WHEN n <= 1 OR mr <= 1 THEN {dbl(1.0)} ELSE {dbl(1.0)} - (r - 1) / (mr - 1) * {dbl(1.0)} END", 0.0, 1.0)


@job("backfill_replace", f"""WITH {fv_cte()},
x AS ({SUM30}),
r AS (SELECT entity_id, rank() OVER (ORDER BY v DESC) AS r, count(*) OVER () AS n FROM x WHERE v IS NOT NULL),
m AS (SELECT *, max(r) OVER () AS mr FROM r)
SELECT entity_id, 'click_score_v1' AS feature_id, 'click_score' AS feature_name, '1' AS feature_version,
       {s2(_BR_SCORE)} AS feature_value, TIMESTAMP '2024-01-30 00:00:00' AS "timestamp", CAST(NULL AS VARCHAR) AS comments,
       '2024-01-30' AS ds FROM m""")
def _backfill_replace(spark, sf):
    """S7 + S8: write the slice twice; the table equals one write."""
    f = fv(spark, sf, start=D - _dt.timedelta(days=30), end=D, event_types=["click"])
    scores = inst.rank_scoring(f, CLICK, D, require_aggregation=True)
    rows = score_rows(scores, "click_score_v1", "click_score", 1)
    table = score_table(spark, scratch_table_path(spark, "score_store"))
    table.append(rows)
    table.append(rows)
    return table.read()


RW_START, RW_END = _dt.date(2024, 1, 10), _dt.date(2024, 1, 20)


@job("backfill_replace_window", f"""WITH {score_store_cte(RISK_WEIGHTS)}
SELECT entity_id, feature_id, feature_value, CAST("timestamp" AS DATE)::VARCHAR AS ds FROM store
WHERE NOT (feature_id IN ('click_score_v1', 'view_score_v1') AND CAST("timestamp" AS DATE) BETWEEN DATE '{RW_START}' AND DATE '{RW_END}')
UNION ALL SELECT entity_id, feature_id, feature_value + 1, CAST("timestamp" AS DATE)::VARCHAR FROM store
WHERE feature_id = 'click_score_v1' AND CAST("timestamp" AS DATE) BETWEEN DATE '{RW_START}' AND DATE '{RW_END}'
  AND day(CAST("timestamp" AS DATE)) % 2 = 0""")
def _backfill_replace_window(spark, sf):
    """In a window of two features the even days of one get other rows, its odd days and the other feature's days
    get none and go; all else stays. The same push under the same id changes nothing."""
    store = _store(spark, sf)
    table = score_table(spark, scratch_table_path(spark, "replaced"))
    table.append(store)
    inside = F.col("ds").between(RW_START.isoformat(), RW_END.isoformat()) & (F.day(F.to_date("ds")) % 2 == 0)
    rows = store.where((F.col("feature_id") == "click_score_v1") & inside).withColumn("feature_value", F.col("feature_value") + 1)
    for _ in range(2):
        table.replace_window(rows, ["click_score_v1", "view_score_v1"], RW_START, RW_END, source="push-1")
    return table.read().select("entity_id", "feature_id", "feature_value", "ds")


@job("cumulative_sql_day", f"""WITH {fv_cte()},
run AS (SELECT entity_id, {day_sql()} AS day,
               sum(feature_value) OVER (PARTITION BY entity_id ORDER BY {day_sql()} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
        FROM fv WHERE feature_id = '{CLICK}')
SELECT entity_id, '{CUM}' AS feature_id, v AS feature_value, TIMESTAMP '2024-01-30 23:59:59' AS "timestamp" FROM run WHERE day = {DS}""")
def _cumulative_sql_day(spark, sf):
    """The rendered insert-select for D, reading the cumulative history written before D."""
    f = fv(spark, sf, start=D, end=D, event_types=["click"])
    hist = _cum_store(fv(spark, sf, end=D - _dt.timedelta(days=1), event_types=["click"]))
    return render_cumulative_day(spark, f, hist, CLICK, CUM, D)


def _template_sql(category: str | None, keep: str) -> str:
    day = D if category == "work" else D - _dt.timedelta(days=1)
    return f"""WITH {fv_cte()},
run AS (SELECT entity_id, {day_sql()} AS day,
               sum(feature_value) OVER (PARTITION BY entity_id ORDER BY {day_sql()} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v
        FROM fv WHERE feature_id = '{CLICK}'),
prior AS (SELECT entity_id, arg_max(v, day) AS total FROM run WHERE day < DATE '{day}' GROUP BY entity_id),
daily AS (SELECT entity_id, feature_value AS v FROM fv WHERE feature_id = '{CLICK}' AND {day_sql()} = DATE '{day}' AND {keep})
SELECT d.entity_id, '{CUM}' AS feature_id, 'click_count_cumulative' AS feature_name, '1' AS feature_version, coalesce(p.total, 0.0) + d.v AS feature_value,
       TIMESTAMP '2024-01-30 23:59:59' AS "timestamp", '' AS comments FROM daily d LEFT JOIN prior p USING (entity_id)"""


def _template_job(category, condition):
    def build(spark, sf):
        """S18 with P5 and P6: the template's eight markers bound by Spark; work reads day D, bio the day before."""
        from riskweave.plans.template import CUMULATIVE_DAY, run_template
        day = D if category == "work" else D - _dt.timedelta(days=1)
        f = fv(spark, sf, event_types=["click"])
        history = _cum_store(fv(spark, sf, end=day - _dt.timedelta(days=1), event_types=["click"]))
        return run_template(spark, CUMULATIVE_DAY, f, history, "click_count_cumulative", 1, D, dependent_feature_id=CLICK, category=category,
                            filter_condition=condition)
    return build


job("cumulative_template", _template_sql("work", "true"))(_template_job("work", None))
job("cumulative_template_bio", _template_sql("bio", "feature_value >= 2 AND entity_id NOT LIKE '%7'"))(
    _template_job("bio", "feature_value >= 2 AND entity_id NOT LIKE '%7'"))


# ------------------------------------------------------------------------------------------- step 15
@job("job_cost_by_feature", f"""WITH st AS (SELECT l_orderkey * 10 + l_linenumber AS stage_id,
        CASE WHEN l_linenumber = 7 THEN [l_orderkey, l_orderkey + 1] ELSE [l_orderkey] END AS job_ids,
        CAST(floor(l_extendedprice * 1000) AS BIGINT) AS cpu, CAST(floor(l_quantity * 1048576) AS BIGINT) AS mem FROM lineitem),
pj AS (SELECT stage_id, unnest(job_ids) AS job_id, cpu, mem FROM st),
tags AS (SELECT o_orderkey AS job_id, o_orderpriority AS feature FROM orders)
SELECT feature, {s6('sum(cpu) / 1e9')} AS cpu_seconds, max(mem) AS peak_memory_bytes, count(DISTINCT stage_id) AS n_stages,
       count(DISTINCT pj.job_id) AS n_jobs FROM pj JOIN tags ON pj.job_id = tags.job_id GROUP BY feature""")
def _job_cost(spark, sf):
    li = read_table(spark, sf, "lineitem")
    stages = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("stageId"),
        F.when(F.col("l_linenumber") == 7, F.array("l_orderkey", F.col("l_orderkey") + 1))
         .otherwise(F.array("l_orderkey")).alias("jobIds"),
        F.floor(F.col("l_extendedprice") * 1000).alias("executorCpuTime"),
        F.floor(F.col("l_quantity") * 1048576).alias("peakMemory"))
    tags = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("jobId"), F.col("o_orderpriority").alias("feature"))
    out = job_cost_by_feature(stages, tags)
    return out.withColumn("cpu_seconds", r6("cpu_seconds"))


# ------------------------------------------------------------------------------------------- step 16
@job("latest_sync_stream", SYNC_SQL)
def _latest_sync_stream(spark, sf):
    """M14 maintained by Structured Streaming (foreachBatch folding into versioned state); must equal
    the batch ``latest_sync``."""
    root = os.path.join(ensure_checkpoint_dir(spark), "streams", f"sync-{uuid.uuid4().hex}")
    # written as a glob, the source may be one file or a folder of part files
    return run_sync_stream(spark, os.path.join(sf, "{events}.parquet"), os.path.join(root, "state"), os.path.join(root, "checkpoint"),
                           D, days=30, files_per_batch=100)


# ------------------------------------------------------------------------------------------- step 12
def registry_texts(f):
    """A registry whose ``dependent_features`` texts are built from the feature ids present, covering
    the mini-language's shapes: scalars, no spaces, a list, a map, quoted items, a comma inside a
    filter, a list last, and an empty text."""
    fid = F.col("feature_id")
    t = (F.when(fid.startswith("click"), F.concat(F.lit("[scoring_method:rank_scoring, feature_id:"), fid,
                                                  F.lit(", range_start:0.5, range_end:1, require_aggregation:True, is_inverse:False]")))
          .when(fid.startswith("error"), F.concat(F.lit("[scoring_method:wilson_fraud_scoring,feature_id_numerator:"), fid,
                                                  F.lit(",feature_id_denominator:any_count_daily_v1,period_in_days:30]")))
          .when(fid.startswith("purchase"), F.concat(F.lit("[scoring_method:rank_scoring, feature_id:["), fid,
                                                     F.lit(", click_count_daily_v1], weights:{"), fid,
                                                     F.lit(":2, click_count_daily_v1:3}, method:weighted_average]")))
          .when(fid.startswith("signup"), F.lit("['scoring_function:softmax_scoring', 'risk_weightage:{a:1, b:2.5}', 'softmax_weightage:0.9']"))
          .when(fid.startswith("view"), F.concat(F.lit("[scoring_method:zscore, feature_id:"), fid,
                                                 F.lit(", filter_condition:x in (1, 2), is_multiple_col:False, feature_ids:[a, b]]")))
          .otherwise(F.lit("")))
    return f.select("feature_id").distinct().select("feature_id", t.alias("dependent_features"))


def _ids_with_any(spark, sf):
    """Feature ids of the count features plus the all-events feature, from the event types alone."""
    types = ev(spark, sf).select(F.explode(F.array(F.col("event_type"), F.lit("any"))).alias("event_type"))
    return event_feature_ids(types).select("feature_id")


def part_registry(part):
    """A registry with a row for every part and texts of every shape of the mini-language: scalars, quoted items with commas
    and escapes, nested lists and maps (also last), brackets in quotes, an open quote, an apostrophe, blanks, an empty text and NULL."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    shapes = [
        F.concat(F.lit("[scoring_method:rank_scoring, feature_id:f"), key, F.lit(", range_start:0.5, require_aggregation:True, is_inverse:False, period_in_days:"), size, F.lit("]")),
        F.concat(F.lit("['scoring_method:zscore', 'filter_condition:x in ("), size, F.lit(", 2)', 'feature_id:f"), key, F.lit("']")),
        F.concat(F.lit("[a:["), key, F.lit(", b, c], weights:{x:"), size, F.lit(", y:2.5}]")),
        F.concat(F.lit("[weights:{w"), key, F.lit(":1, f2:[p, q], f3:{z:1, w:2}}, feature_ids:[a, b]]")),
        F.concat(F.lit('["note:it\'s, ok", \'say:\\\'hi, "you"\\\'\', n:-'), size, F.lit("]")),
        F.concat(F.lit("[note:it's fine, other:'open, n:+"), size, F.lit("]")),
        F.concat(F.lit("  [ 'k:[1, "), size, F.lit("]' ,  plain , k2: v2 ,, ]  ")),
        F.concat(F.lit("['bracket:a]b[, c', deep:[[1, 2], 3], n:"), size, F.lit("]")),
        F.lit(""), F.lit(None).cast("string"),
        F.concat(F.lit("scoring_function:max_scoring, risk_weightage:{a:1, a:"), size, F.lit("}")),
    ]
    text = F.get(F.array(*shapes), (F.col("p_partkey") % len(shapes)).cast("int"))
    return part.select(F.concat(F.lit("f"), key).alias("feature_id"), text.alias("dependent_features"))


def _parsed_sql() -> str:
    """The items that each shape must give, typed by hand: (pos, param, kind, value, list, map) with K for the part key and Z for its size."""
    shapes = [
        [(0, "scoring_method", "text", "rank_scoring"), (1, "feature_id", "text", "fK"), (2, "range_start", "text", "0.5"),
         (3, "require_aggregation", "bool", "True"), (4, "is_inverse", "bool", "False"), (5, "period_in_days", "int", "Z")],
        [(0, "scoring_method", "text", "zscore"), (1, "filter_condition", "text", "x in (Z, 2)"), (2, "feature_id", "text", "fK")],
        [(0, "a", "list", "[K, b, c]", "K|b|c"), (1, "weights", "map", "{x:Z, y:2.5}", None, "x=Z|y=2.5")],
        [(0, "weights", "map", "{wK:1, f2:[p, q], f3:{z:1, w:2}}", None, "f2=[p, q]|f3={z:1, w:2}|wK=1"), (1, "feature_ids", "list", "[a, b]", "a|b")],
        [(0, "note", "text", "it''s, ok"), (1, "say", "text", "''hi, \"you\"''"), (2, "n", "int", "-Z")],
        [(0, "note", "text", "it''s fine"), (1, "other", "text", "''open"), (2, "n", "int", "+Z")],
        [(0, "k", "list", "[1, Z]", "1|Z"), (2, "k2", "text", "v2")],
        [(0, "bracket", "text", "a]b[, c"), (1, "deep", "list", "[[1, 2], 3]", "[1|2]|3"), (2, "n", "int", "Z")],
        [], [],
        [(0, "scoring_function", "text", "max_scoring"), (1, "risk_weightage", "map", "{a:1, a:Z}", None, "a=Z")],
    ]
    rows = []
    for shape, items in enumerate(shapes):
        for item in items:
            pos, param, kind, value, listed, mapped = (*item, None, None)[:6]
            texts = ", ".join("NULL" if x is None else f"'{x}'" for x in (value, listed, mapped))
            rows.append(f"({shape}, {pos}, '{param}', '{kind}', {texts})")
    put = lambda c: f"replace(replace({c}, 'Z', CAST(p_size AS VARCHAR)), 'K', CAST(p_partkey AS VARCHAR))"
    key = "'f' || p_partkey"
    return f"""WITH e(shape, pos, param, kind, v, l, m) AS (VALUES {", ".join(rows)})
SELECT {key} AS feature_id, CAST(pos AS INTEGER) AS pos, param, kind, {put('v')} AS value_text, {put('l')} AS list_text,
       array_to_string(list_sort(string_split({put('m')}, '|')), '|') AS map_text
FROM part JOIN e ON shape = p_partkey % {len(shapes)}"""


@job("registry_parsed", _parsed_sql())
def _registry_parsed(spark, sf):
    """F12 over a registry of all parts: typed rows, lists and maps as texts."""
    from riskweave.sources.registry import parse_dependent_features
    parsed = parse_dependent_features(part_registry(read_table(spark, sf, "part")))
    entries = F.array_sort(F.transform(F.map_entries("map_value"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return parsed.select("feature_id", "pos", "param", "kind", "value_text", F.array_join("list_value", "|").alias("list_text"),
                         F.array_join(entries, "|").alias("map_text"))


@job("registry_lookup", """WITH reg AS (SELECT p_type AS feature_name, CAST(p_size % 5 AS VARCHAR) AS version, 'f' || p_partkey AS feature_id, p_name AS note FROM part),
wanted AS (SELECT DISTINCT p_type AS feature_name, CAST(s AS VARCHAR) AS version FROM part, (VALUES (0), (3), (9)) t(s))
SELECT w.feature_name, w.version, min(feature_id) AS feature_id, arg_min(note, feature_id) AS note, count(feature_id) AS n_found
FROM wanted w LEFT JOIN reg r ON r.feature_name = w.feature_name AND r.version = w.version GROUP BY ALL""")
def _registry_lookup(spark, sf):
    """S3/O3: many lookups by name and version at once; of several rows the first by id, of none NULLs."""
    from riskweave.sources.registry import registry_rows
    part = read_table(spark, sf, "part")
    reg = part.select(F.col("p_type").alias("feature_name"), (F.col("p_size") % 5).alias("version"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("feature_id"),
                      F.col("p_name").alias("note"))
    wanted = part.select(F.col("p_type").alias("feature_name"), F.explode(F.array(F.lit(0), F.lit(3), F.lit(9))).alias("version"))
    return registry_rows(reg, wanted).select("feature_name", "version", "feature_id", "note", "n_found")


# ------------------------------------------------------------------------------------------- coverage additions
@job("backfill_outcomes", f"""WITH {score_store_cte(RISK_WEIGHTS)}, {fv_cte()},
feats AS (SELECT * FROM (VALUES {_PF_VALUES}) t(feature_id, source_feature_id)),
ex AS (SELECT feature_id, {day_sql()} AS target_date, count(*) AS existing_rows FROM store GROUP BY 1, 2),
srcd AS (SELECT feature_id AS source_feature_id, {day_sql()} AS day, count(*) AS n FROM fv GROUP BY 1, 2),
j AS (SELECT coalesce(ex.existing_rows, 0) AS existing_rows,
             coalesce((SELECT sum(n) FROM srcd WHERE srcd.source_feature_id = f.source_feature_id
                       AND srcd.day BETWEEN d.d - 30 AND d.d), 0) AS source_rows
      FROM feats f CROSS JOIN {_series(PLAN_START, PLAN_END)} d LEFT JOIN ex ON ex.feature_id = f.feature_id AND ex.target_date = d.d)
SELECT CASE WHEN existing_rows > 0 THEN 'SKIP' WHEN source_rows = 0 THEN 'EMPTY' ELSE 'DRYRUN' END AS outcome, count(*) AS n_jobs
FROM j GROUP BY 1""")
def _backfill_outcomes(spark, sf):
    """Outcome counts of the backfill plan (the run summary)."""
    return _backfill_plan(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("n_jobs"))


@job("update_activeness", f"""WITH {dv.MASTER_SQL},
st AS (SELECT CAST(c_custkey * 2 AS VARCHAR) AS id, CASE WHEN CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END = '1' THEN 1 ELSE 0 END AS is_active
       FROM customer)
SELECT t.id, t.name, CASE WHEN st.id IS NOT NULL THEN st.is_active END AS is_active,
       CASE WHEN st.id IS NOT NULL THEN {NOW_SQL} ELSE t.updated_at END AS updated_at
FROM tgt t LEFT JOIN st ON t.id = st.id""")
def _update_activeness(spark, sf):
    """P8 + S13: user status '1' -> 1 else 0, applied to existing master rows only (no insert)."""
    t, _ = _master(spark, sf)
    c = read_table(spark, sf, "customer")
    status = F.when(F.col("c_acctbal") > 0, F.lit("1")).otherwise(F.lit("0"))
    st = c.select((F.col("c_custkey") * 2).cast("string").alias("id"),
                  F.when(status == F.lit("1"), F.lit(1)).otherwise(F.lit(0)).alias("is_active"))
    base = t.select("id", "name", F.lit(None).cast("int").alias("is_active"), "updated_at")
    return upsert(base, st, "id", {"is_active": "overwrite"}, _now(), insert=False)


@job("master_cleanup", """WITH m AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN ' ' || c_custkey || ' ' ELSE CAST(c_custkey AS VARCHAR) END AS id,
            r_name AS ro FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
          UNION ALL SELECT CAST(s_suppkey AS VARCHAR) || ' ', 'EUROPE' FROM supplier WHERE s_suppkey % 11 = 0),
c AS (SELECT trim(id) AS id, id <> trim(id) AS trimmed, CASE WHEN ro = 'EUROPE' THEN 'EU' ELSE ro END AS ro FROM m)
SELECT id, ro, bool_or(trimmed) AS was_trimmed, count(*) AS n_rows, count(*) > 1 AS key_collision FROM c GROUP BY id, ro""")
def _master_cleanup(spark, sf):
    """P10: rename one value, trim ids, and surface keys that collide after trimming (counted, not
    silently merged)."""
    c = read_table(spark, sf, "customer")
    n = read_table(spark, sf, "nation")
    r = read_table(spark, sf, "region")
    s = read_table(spark, sf, "supplier")
    ck = F.col("c_custkey").cast("string")
    m = (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
          .select(F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit(" "), ck, F.lit(" "))).otherwise(ck).alias("id"),
                  F.col("r_name").alias("ro")))
    m = m.unionByName(s.where(F.col("s_suppkey") % 11 == 0).select(
        F.concat(F.col("s_suppkey").cast("string"), F.lit(" ")).alias("id"), F.lit("EUROPE").alias("ro")))
    cleaned = m.select(F.trim("id").alias("id"), (F.col("id") != F.trim("id")).alias("trimmed"),
                       F.when(F.col("ro") == "EUROPE", F.lit("EU")).otherwise(F.col("ro")).alias("ro"))
    return cleaned.groupBy("id", "ro").agg(F.bool_or("trimmed").alias("was_trimmed"), F.count(F.lit(1)).alias("n_rows")) \
                  .withColumn("key_collision", F.col("n_rows") > 1)


def _registry_with_status(f):
    fid = F.col("feature_id")
    reg = registry_texts(f)
    return reg.withColumn("status", F.when(fid.startswith("view"), F.lit("DEV")).otherwise(F.lit("PROD")))


@job("scoring_features", f"""WITH {fv_cte(include_any=True)},
ids AS (SELECT DISTINCT feature_id FROM fv),
reg AS (SELECT feature_id, CASE WHEN starts_with(feature_id, 'view') THEN 'DEV' ELSE 'PROD' END AS status,
               CASE WHEN starts_with(feature_id, 'click') OR starts_with(feature_id, 'error') OR starts_with(feature_id, 'purchase')
                         OR starts_with(feature_id, 'view') THEN 'scoring_method'
                    WHEN starts_with(feature_id, 'signup') THEN 'scoring_function' ELSE '' END AS marker FROM ids)
SELECT feature_id, status FROM reg WHERE status = 'PROD' AND marker <> ''""")
def _scoring_features(spark, sf):
    """PROD registry rows naming a scoring method or function."""
    from riskweave.sources.registry import scoring_features
    return scoring_features(_registry_with_status(_ids_with_any(spark, sf))).select("feature_id", "status")


@job("status_log_json", f"""WITH {dv.STATUS_SQL}
SELECT run_id, dag_id, task_key, status, cadence FROM latest_status WHERE seq % 13 <> 0""")
def _status_log_json(spark, sf):
    """S16 write + S6 read: latest status records written as JSON under run/dag folders; a share of the log is
    unreadable and skipped."""
    from riskweave.sources.status import read_layer_status, write_status_records
    latest = _latest_status(spark, sf, ["category", "status", "error", "traceback", "cadence"])
    path = scratch_table_path(spark, "status")
    write_status_records(latest.where("seq % 13 <> 0"), path, "20240130T0000-a")
    torn = latest.where("seq % 13 = 0").select("run_id", "dag_id", F.concat(F.lit('{"task_key": "'), "task_key", F.lit('", "stat')).alias("value"))
    torn.write.partitionBy("run_id", "dag_id").text(f"{path}/records/attempt=20240130T0000-b")
    return read_layer_status(spark, path).select("run_id", "dag_id", "task_key", "status", "cadence")


@job("status_two_writes", f"""WITH {dv.STATUS_SQL},
passes AS (SELECT run_id, dag_id, task_key, status, written_at, error, seq, 1 AS pass FROM latest_status
         UNION ALL SELECT run_id, dag_id, task_key, 'retried', written_at, NULL, seq, 2 FROM latest_status WHERE seq % 3 = 0)
SELECT run_id, dag_id, task_key, status, written_at, length(left(error, 2000)) AS error_len FROM passes
QUALIFY row_number() OVER (PARTITION BY run_id, dag_id, task_key ORDER BY written_at DESC, pass DESC) = 1""")
def _status_two_writes(spark, sf):
    """The tasks of each run are written in two attempts, then a third of them again at the same time, then the log is
    compacted twice: each task's newest record is there once."""
    from riskweave.sources.status import compact, read_layer_status, write_status_records
    latest = _latest_status(spark, sf, ["category", "status", "error", "traceback", "cadence"])
    path = scratch_table_path(spark, "status")
    write_status_records(latest.where("seq % 2 = 0"), path, "20240130T0000-a")
    write_status_records(latest.where("seq % 2 <> 0"), path, "20240130T0001-a")
    again = latest.where("seq % 3 = 0").withColumn("status", F.lit("retried")).drop("error")
    write_status_records(again, path, "20240130T0002-a")
    compact(spark, path, "20240130T0003-c")
    compact(spark, path, "20240130T0004-c")
    return read_layer_status(spark, path).select("run_id", "dag_id", "task_key", "status", F.col("written_at").cast("timestamp_ntz").alias("written_at"),
                                                 F.length("error").cast("long").alias("error_len"))


@job("category_gated_work", f"""WITH {dv.STATUS_SQL},
r AS (SELECT *, (status IS NULL OR status <> 'skipped') AND (cadence IS NULL OR cadence <> 'hourly') AS relevant FROM latest_status),
v AS (SELECT run_id, category FROM r GROUP BY run_id, category
      HAVING coalesce(count(*) FILTER (WHERE relevant) > 0 AND bool_and(CASE WHEN relevant THEN coalesce(status = 'success', false) END), false)),
work AS (SELECT DISTINCT run_id, 'dag_next' AS dag_id, category FROM slog2 WHERE category IS NOT NULL)
SELECT w.* FROM work w WHERE EXISTS (SELECT 1 FROM v WHERE v.run_id = w.run_id AND v.category = w.category)""")
def _category_gated_work(spark, sf):
    """Next-layer work limited to the categories whose verdict is valid for the run."""
    verdicts = q.category_verdicts(_latest_status(spark, sf, GATE_COLS)).where("valid")
    work = (dv.status_log(read_table(spark, sf, "orders")).where(F.col("category").isNotNull())
              .select("run_id", F.lit("dag_next").alias("dag_id"), "category").distinct())
    return work.join(verdicts.select("run_id", "category"), ["run_id", "category"], "left_semi")


@job("registry_drift", f"""WITH {fv_cte()},
ids AS (SELECT DISTINCT feature_id FROM fv),
reg AS (SELECT feature_id, {_REG_TEXT_SQL} AS dependent_features FROM ids),
exp AS (SELECT feature_id, CASE WHEN starts_with(feature_id, 'signup') THEN '[scoring_method:zscore]' ELSE {_REG_TEXT_SQL} END AS expected_old,
               '' AS new FROM ids)
SELECT exp.feature_id, CASE WHEN trim(reg.dependent_features) = trim(expected_old) THEN 'dry_run' ELSE 'skip_mismatch' END AS outcome,
       reg.dependent_features AS current, reg.dependent_features AS final_value FROM exp JOIN reg ON exp.feature_id = reg.feature_id""")
def _registry_drift(spark, sf):
    """Current vs expected registry text per row, no write (dry run)."""
    ids = event_feature_ids(ev(spark, sf)).select("feature_id")
    fid = F.col("feature_id")
    reg = ids.select("feature_id", _registry_text(fid).alias("dependent_features"))
    exp = ids.select("feature_id", F.when(fid.startswith("signup"), F.lit("[scoring_method:zscore]"))
                     .otherwise(_registry_text(fid)).alias("expected_old"), F.lit("").alias("new"))
    return compare_and_set(reg, exp, apply=False)


CAT_RANGE = DateSpan(_dt.date(2024, 1, 20), _dt.date(2024, 2, 1))


@job("category_scores_range", f"""WITH {score_store_cte(RISK_WEIGHTS)},
lt AS (SELECT * FROM (SELECT s.d AS target_date, st.entity_id, st.feature_id, st.feature_value,
                             row_number() OVER (PARTITION BY s.d, st.entity_id, st.feature_id ORDER BY st."timestamp" DESC) AS rn
                      FROM {_series(CAT_RANGE.start, CAT_RANGE.end)} s JOIN store st
                        ON st.feature_id IN ({", ".join(repr(k) for k in _CAT_W)}) AND st.feature_value IS NOT NULL
                       AND CAST(st."timestamp" AS DATE) <= s.d) WHERE rn = 1)
SELECT CAST(target_date AS VARCHAR) AS target_date, entity_id,
       {s6(f"sum(feature_value * CASE feature_id {' '.join(f"WHEN '{k}' THEN {dbl(v)}" for k, v in _CAT_W.items())} END / {dbl(sum(_CAT_W.values()))})")} AS risk_value
FROM lt GROUP BY 1, 2""")
def _category_scores_range(spark, sf):
    """M9 as of each of 13 dates in one job (the span runs past the data, so carried-in values)."""
    from riskweave.operators import category as cat
    out = cat.weighted_average(_store(spark, sf), CAT_RANGE, _CAT_W)
    return out.select(F.col("target_date").cast("string").alias("target_date"), "entity_id", r6("risk_value").alias("risk_value"))


BF_SPAN = DateSpan(_dt.date(2024, 1, 28), D)


def _backfill_registry(f):
    """Two scoring features registered against the daily features present."""
    fid = F.col("feature_id")
    reg = f.select("feature_id").distinct().where(fid.isin(CLICK, "error_count_daily_v1"))
    text = (F.when(fid == CLICK, F.concat(F.lit("[scoring_method:rank_scoring, feature_id:"), fid,
                                          F.lit(", range_start:0.5, range_end:1, require_aggregation:True, is_inverse:False]")))
             .otherwise(F.concat(F.lit("[scoring_method:log_based_scoring, feature_id:"), fid, F.lit(", period_in_days:30]"))))
    name = F.regexp_replace(fid, "_count_daily_v1$", "_backfill_score")
    return reg.select(F.concat(name, F.lit("_v1")).alias("feature_id"), name.alias("feature_name"),
                      F.lit("1").alias("version"), text.alias("dependent_features"))


def _bf_sql() -> str:
    rank = clip(f"CASE WHEN n <= 1 OR mr <= 1 THEN {dbl(1.0)} ELSE {dbl(1.0)} - (r - 1) / (mr - 1) * {dbl(0.5)} END", 0.5, 1.0)
    logs = clip(f"{dbl(0.0)} + {dbl(1.0)} * (ln(1 + v) / ln(1 + mx))", 0.0, 1.0)
    return f"""WITH {fv_cte()},
x AS (SELECT s.d AS target_date, f.feature_id, f.entity_id, sum(f.feature_value) AS v FROM {_series(BF_SPAN.start, BF_SPAN.end)} s
      JOIN fv f ON f.feature_id IN ('{CLICK}', 'error_count_daily_v1') AND {day_sql('f."timestamp"')} BETWEEN s.d - 30 AND s.d
      GROUP BY 1, 2, 3),
rk AS (SELECT *, rank() OVER (PARTITION BY target_date ORDER BY v DESC) AS r, count(*) OVER (PARTITION BY target_date) AS n
       FROM x WHERE feature_id = '{CLICK}'),
rm AS (SELECT *, max(r) OVER (PARTITION BY target_date) AS mr FROM rk),
lg AS (SELECT *, CASE WHEN max(v) OVER (PARTITION BY target_date) <= 0 THEN 1.0 ELSE max(v) OVER (PARTITION BY target_date) END AS mx
       FROM x WHERE feature_id = 'error_count_daily_v1' AND v > 0),
sc AS (SELECT target_date, entity_id, 'click_backfill_score' AS feature_name, {rank} AS score FROM rm
       UNION ALL SELECT target_date, entity_id, 'error_backfill_score', {logs} FROM lg)
SELECT entity_id, feature_name || '_v1' AS feature_id, feature_name, '1' AS feature_version, {s2('score')} AS feature_value,
       CAST(target_date AS TIMESTAMP) AS "timestamp", CAST(NULL AS VARCHAR) AS comments, CAST(target_date AS VARCHAR) AS ds
FROM sc WHERE score IS NOT NULL AND NOT isnan(score)"""


@job("registry_backfill", _bf_sql())
def _registry_backfill(spark, sf):
    """Registry-driven backfill of three dates (parse -> dispatch -> store rows), one plan."""
    from riskweave.plans.backfill import backfill_from_registry
    f = fv(spark, sf, start=BF_SPAN.start - _dt.timedelta(days=30), end=BF_SPAN.end, event_types=["click", "error"])
    reg = _backfill_registry(event_feature_ids(ev(spark, sf)))
    return backfill_from_registry(reg, f, None, BF_SPAN)


RUN_SPAN = DateSpan(_dt.date(2024, 1, 28), D)


def _run_registry(ids):
    """Registry rows of every outcome: two that can be scored, one of a source without rows, one of an unknown method,
    one of no method, one whose weights sum to zero; built from the features present."""
    fid, kind = F.col("feature_id"), F.regexp_replace("feature_id", "_count_daily_v1$", "")
    text = (F.when(kind == "click", F.concat(F.lit("[scoring_method:rank_scoring, feature_id:"), fid, F.lit(", require_aggregation:True]")))
             .when(kind.isin("error", "purchase", "refund"), F.concat(F.lit("[scoring_method:log_based_scoring, feature_id:"), fid, F.lit("]")))
             .when(kind == "signup", F.concat(F.lit("[scoring_method:rank_scoring, feature_id:["), fid, F.lit("], method:weighted_average, weights:{"), fid,
                                              F.lit(":0}]")))
             .when(kind == "view", F.concat(F.lit("[scoring_method:magic_scoring, feature_id:"), fid, F.lit("]"))).otherwise(F.lit("[note:all events]")))
    every = ids.select("feature_id").unionByName(ids.select(F.regexp_replace("feature_id", "^click", "refund").alias("feature_id")).where(
        F.col("feature_id").startswith("refund")))
    return every.select(F.concat(kind, F.lit("_run_score_v1")).alias("feature_id"), F.concat(kind, F.lit("_run_score")).alias("feature_name"),
                        F.lit("1").alias("version"), text.alias("dependent_features"))


_RUN_SQL = f"""WITH {fv_cte()},
days AS {_series(RUN_SPAN.start, RUN_SPAN.end)},
w AS (SELECT s.d, replace(f.feature_id, '_count_daily_v1', '') AS kind, f.entity_id, sum(f.feature_value) AS v FROM days s
      JOIN fv f ON {day_sql('f."timestamp"')} BETWEEN s.d - 30 AND s.d GROUP BY ALL),
n AS (SELECT d, kind, count(*) AS k FROM w WHERE kind = 'click' OR v > 0 GROUP BY ALL),
kinds AS (SELECT * FROM (VALUES ('click'), ('error'), ('purchase'), ('refund'), ('signup'), ('view'), ('any')) t(kind)),
jobs AS (SELECT 'main' AS run_id, d, kind FROM days, kinds WHERE kind <> 'purchase' UNION ALL SELECT 'dry', d, 'purchase' FROM days),
told AS (SELECT run_id, d, kind, coalesce(k, 0) AS k, kind = 'error' AND d = DATE '2024-01-29' AS held FROM jobs LEFT JOIN n USING (d, kind)),
run AS (SELECT run_id, kind || '_run_score_v1' AS feature_id, CAST(d AS VARCHAR) AS target_date, CAST(CASE WHEN held THEN k ELSE 0 END AS BIGINT) AS existing_rows,
               CASE WHEN held OR kind = 'any' THEN 'SKIP' WHEN kind IN ('signup', 'view') THEN 'FAIL' WHEN k = 0 THEN 'EMPTY'
                    WHEN run_id = 'dry' THEN 'DRYRUN' ELSE 'OK' END AS outcome, k FROM told)"""


def _backfill_outcome_table(spark, sf):
    from riskweave.plans.outcomes import Ledger, run_backfill
    f = fv(spark, sf)
    ids = _ids_with_any(spark, sf)
    registry = _run_registry(ids)
    root = scratch_table_path(spark, "run")
    table, ledger = score_table(spark, f"{root}/scores"), Ledger(spark, f"{root}/ledger")
    error = registry.where("feature_name = 'error_run_score'")
    run_backfill(error, f, table, _dt.date(2024, 1, 29), ledger, "before")
    main = run_backfill(registry.where("feature_name <> 'purchase_run_score'"), f, table, RUN_SPAN, ledger, "main")
    dry = run_backfill(registry.where("feature_name = 'purchase_run_score'"), f, table, RUN_SPAN, ledger, "dry", dry_run=True)
    return main.unionByName(dry)


@job("backfill_run", _RUN_SQL + """
SELECT run_id, feature_id, target_date, outcome, existing_rows, CAST(CASE WHEN outcome = 'OK' THEN k ELSE 0 END AS BIGINT) AS rows_written,
       CAST(0 AS BIGINT) AS rows_dropped FROM run""")
def _backfill_run(spark, sf):
    """OK, EMPTY, SKIP, DRYRUN and FAIL in one table; features that cannot be scored do not stop the others."""
    out = _backfill_outcome_table(spark, sf)
    return out.select("run_id", "feature_id", F.col("target_date").cast("string").alias("target_date"), "outcome", "existing_rows", "rows_written", "rows_dropped")


@job("backfill_run_summary", _RUN_SQL + """
SELECT outcome, count(*) AS n_jobs, CAST(sum(CASE WHEN outcome = 'OK' THEN k ELSE 0 END) AS BIGINT) AS rows_written, CAST(0 AS BIGINT) AS rows_dropped
FROM run GROUP BY outcome""")
def _backfill_run_summary(spark, sf):
    """The counts a run ends with."""
    from riskweave.plans.outcomes import summary
    return summary(_backfill_outcome_table(spark, sf))


@job("backfill_summary", f"""WITH b AS ({_bf_sql()})
SELECT feature_id, count(*) AS rows_written, CAST(0 AS BIGINT) AS rows_dropped FROM b GROUP BY feature_id""")
def _backfill_summary(spark, sf):
    """The per-feature run summary of writing the registry backfill (rows written, NULL/NaN
    scores dropped), counted by Observations on the writes."""
    from riskweave.operators.instance import log_based_scoring, rank_scoring
    from riskweave.plans.backfill import write_scores
    f = fv(spark, sf, start=BF_SPAN.start - _dt.timedelta(days=30), end=BF_SPAN.end, event_types=["click", "error"])
    table = score_table(spark, scratch_table_path(spark, "score_store"))
    summary = [
        write_scores(rank_scoring(f, CLICK, BF_SPAN, range_start=0.5, range_end=1, require_aggregation=True), table,
                     "click_backfill_score_v1", "click_backfill_score", 1),
        write_scores(log_based_scoring(f, "error_count_daily_v1", BF_SPAN, period_in_days=30), table,
                     "error_backfill_score_v1", "error_backfill_score", 1),
    ]
    return spark.createDataFrame(summary, "feature_id string, rows_written long, rows_dropped long")


@job("column_helpers", """WITH t AS (SELECT o_orderkey AS k, CASE o_orderkey % 8 WHEN 0 THEN ' TRUE ' WHEN 1 THEN 'yes' WHEN 2 THEN '1' WHEN 3 THEN 'no' WHEN 4 THEN NULL
         WHEN 5 THEN 'true' WHEN 6 THEN '' ELSE o_orderstatus END AS flag,
       CASE o_orderkey % 6 WHEN 0 THEN ' 1.5 ' WHEN 1 THEN 'x1' WHEN 2 THEN NULL WHEN 3 THEN '-2e3' WHEN 4 THEN '' ELSE CAST(o_totalprice AS VARCHAR) END AS num,
       CASE WHEN o_orderkey % 3 = 0 THEN 'hourly' END AS freq, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS is_daily FROM orders)
SELECT k, coalesce(lower(trim(flag)) IN ('true', '1', 'yes'), false) AS wide_flag, coalesce(lower(trim(flag)) = 'true', false) AS strict_flag,
       coalesce(lower(trim(flag)) IN ('true', '1', 'yes'), true) AS wide_flag_default, coalesce(TRY_CAST(trim(num) AS DOUBLE), 7.0) AS number,
       coalesce(freq, CASE WHEN coalesce(is_daily, true) THEN 'daily' ELSE 'always' END) AS cadence FROM t""")
def _column_helpers(spark, sf):
    """F4 in both variants, F5 and F14 over every order."""
    from riskweave.functions.columns import cadence_default, parse_bool, parse_bool_strict, to_float
    k = F.col("o_orderkey")
    flag = (F.when(k % 8 == 0, F.lit(" TRUE ")).when(k % 8 == 1, F.lit("yes")).when(k % 8 == 2, F.lit("1")).when(k % 8 == 3, F.lit("no"))
             .when(k % 8 == 4, F.lit(None)).when(k % 8 == 5, F.lit("true")).when(k % 8 == 6, F.lit("")).otherwise(F.col("o_orderstatus")))
    num = (F.when(k % 6 == 0, F.lit(" 1.5 ")).when(k % 6 == 1, F.lit("x1")).when(k % 6 == 2, F.lit(None)).when(k % 6 == 3, F.lit("-2e3"))
            .when(k % 6 == 4, F.lit("")).otherwise(F.col("o_totalprice").cast("string")))
    t = read_table(spark, sf, "orders").select(k.alias("k"), flag.alias("flag"), num.alias("num"), F.when(k % 3 == 0, F.lit("hourly")).alias("freq"),
                                               F.when(k % 4 == 0, F.lit(None)).otherwise(k % 4 > 1).alias("is_daily"))
    return t.select("k", parse_bool("flag").alias("wide_flag"), parse_bool_strict("flag").alias("strict_flag"), parse_bool("flag", True).alias("wide_flag_default"),
                    to_float("num", 7.0).alias("number"), cadence_default("freq", "is_daily").alias("cadence"))
