"""Inputs of the master/registry/status jobs, derived from the driver tables.

The reference reads activity streams, an entity master, dimension tables, a feature registry and a
status log that the driver does not ship; each is derived here from the given tables by a fixed
rule (so its size grows with them), with the same rule repeated as SQL for the oracle
(``*_SQL`` constants, DuckDB dialect).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave import constants as K
from riskweave.functions.columns import infer_category

_K = r'"k": (\d+)'


def _opid(user_id: Column) -> Column:
    """Mixed-case operator ids (even users lower case) so that key normalisation matters."""
    return F.when(user_id % 2 == 0, F.concat(F.lit("op"), user_id.cast("string"))).otherwise(
        F.concat(F.lit("OP"), user_id.cast("string")))


def activity_a(events: DataFrame) -> DataFrame:
    """Source A: non-view events; latitude/longitude as DMS text, plain decimals or junk."""
    e = events.where(F.col("event_type") != F.lit("view"))
    u, eid, v, t = F.col("user_id"), F.col("event_id"), F.col("value"), F.col("event_type")
    dms_lat = F.format_string("%d°%d'%.2f\" %s", u % 90, eid % 60, v % 60, F.when(eid % 2 == 0, F.lit("N")).otherwise(F.lit("S")))
    dms_lon = F.format_string("%d°%d'%.2f\" %s", u % 180, eid % 60, v % 60, F.when(eid % 3 == 0, F.lit("W")).otherwise(F.lit("E")))
    lat = (F.when(t == "click", dms_lat).when(t == "error", F.lit("n/a"))
            .when(t == "purchase", F.format_string("%.2f", v * 10)).otherwise(F.format_string("%.4f", v - 50)))
    lon = F.when(t == "click", dms_lon).otherwise(F.format_string("%.4f", v * 3))
    return e.select(
        _opid(u).alias("operator_id"), t.alias("district"), F.regexp_extract("props", _K, 1).alias("pincode"),
        F.concat(F.lit("S"), (u % 7).cast("string")).alias("state"), lat.alias("latitude"), lon.alias("longitude"),
        F.concat(F.lit("M"), (eid % 13).cast("string")).alias("machine_code"), F.col("ts").alias("event_timestamp"),
        F.when(eid % 5 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("v"), (eid % 3).cast("string"))).alias("client_version"),
        F.lit("A").alias("client_type"))


ACTIVITY_A_SQL = """act_a AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'op' || user_id ELSE 'OP' || user_id END AS operator_id,
    event_type AS district, regexp_extract(props, '"k": (\\d+)', 1) AS pincode, 'S' || (user_id % 7) AS state,
    CASE WHEN event_type = 'click' THEN printf('%d°%d''%.2f" %s', user_id % 90, event_id % 60, value % 60, CASE WHEN event_id % 2 = 0 THEN 'N' ELSE 'S' END)
         WHEN event_type = 'error' THEN 'n/a' WHEN event_type = 'purchase' THEN printf('%.2f', value * 10)
         ELSE printf('%.4f', value - 50) END AS latitude,
    CASE WHEN event_type = 'click' THEN printf('%d°%d''%.2f" %s', user_id % 180, event_id % 60, value % 60, CASE WHEN event_id % 3 = 0 THEN 'W' ELSE 'E' END)
         ELSE printf('%.4f', value * 3) END AS longitude,
    'M' || (event_id % 13) AS machine_code, ts AS event_timestamp,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'v' || (event_id % 3) END AS client_version, 'A' AS client_type
  FROM events WHERE event_type <> 'view')"""


def activity_b(events: DataFrame) -> DataFrame:
    """Source B: view events with a session id (NULL for some) taken from props.k."""
    e = events.where(F.col("event_type") == F.lit("view"))
    u, eid, v = F.col("user_id"), F.col("event_id"), F.col("value")
    k = F.regexp_extract("props", _K, 1).cast("long")
    return e.select(
        _opid(u).alias("operator_id"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("s"), (k % 4).cast("string"))).alias("resident_sid"),
        F.concat(F.lit("D"), (eid % 5).cast("string")).alias("district"), k.cast("string").alias("pincode"),
        F.concat(F.lit("S"), (u % 7).cast("string")).alias("state"),
        F.format_string("%.4f", v % 90).alias("latitude"), F.format_string("%.4f", v * 2).alias("longitude"),
        F.concat(F.lit("M"), (eid % 13).cast("string")).alias("station_machine_code"), F.col("ts").alias("event_timestamp"))


ACTIVITY_B_SQL = """act_b AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'op' || user_id ELSE 'OP' || user_id END AS operator_id,
    CASE WHEN CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) % 10 = 0 THEN NULL
         ELSE 's' || (CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) % 4) END AS resident_sid,
    'D' || (event_id % 5) AS district, CAST(CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS VARCHAR) AS pincode,
    'S' || (user_id % 7) AS state, printf('%.4f', value % 90) AS latitude, printf('%.4f', value * 2) AS longitude,
    'M' || (event_id % 13) AS station_machine_code, ts AS event_timestamp
  FROM events WHERE event_type = 'view')"""


# ------------------------------------------------------------------------------------------ dimensions
def users(customer: DataFrame) -> DataFrame:
    c = F.col("c_custkey")
    return customer.select(
        F.concat(F.lit("u"), c.cast("string")).alias("user_code"), F.col("c_name").alias("user_name"),
        (c * 7).cast("string").alias("user_uid"), c.alias("user_key"), F.col("c_nationkey").alias("user_org_key"),
        ((F.col("c_nationkey") + 3) % 25).alias("user_reg_org_key"), (c % 100).alias("user_contact_key"),
        (c % 6).cast("int").alias("ro_key"))


def organizations(nation: DataFrame) -> DataFrame:
    return nation.select(F.col("n_nationkey").alias("org_key"), F.col("n_name").alias("org_name"),
                         F.concat(F.lit("ORG"), F.col("n_nationkey").cast("string")).alias("org_code"))


def contacts(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    return supplier.select(
        s.alias("contact_key"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("p"), s.cast("string"))).alias("phone1"),
        F.concat(F.lit("alt"), s.cast("string")).alias("phone2"),
        F.when(F.col("s_acctbal") > 1000, F.concat(F.lower("s_name"), F.lit("@example.org"))).alias("email_id1"),
        F.concat(F.lit("e"), s.cast("string"), F.lit("@example.org")).alias("email_id2"))


def offices(region: DataFrame) -> DataFrame:
    return region.select(F.col("r_regionkey").cast("int").alias("ro_key"), F.col("r_name").alias("ro_name"))


DIMENSIONS_SQL = """usr AS (SELECT 'u' || c_custkey AS user_code, c_name AS user_name, CAST(c_custkey * 7 AS VARCHAR) AS user_uid,
    c_custkey AS user_key, c_nationkey AS user_org_key, (c_nationkey + 3) % 25 AS user_reg_org_key,
    c_custkey % 100 AS user_contact_key, CAST(c_custkey % 6 AS INTEGER) AS ro_key FROM customer),
org AS (SELECT n_nationkey AS org_key, n_name AS org_name, 'ORG' || n_nationkey AS org_code FROM nation),
con AS (SELECT s_suppkey AS contact_key, CASE WHEN s_acctbal > 0 THEN 'p' || s_suppkey END AS phone1, 'alt' || s_suppkey AS phone2,
    CASE WHEN s_acctbal > 1000 THEN lower(s_name) || '@example.org' END AS email_id1, 'e' || s_suppkey || '@example.org' AS email_id2
  FROM supplier),
ofc AS (SELECT CAST(r_regionkey AS INTEGER) AS ro_key, r_name AS ro_name FROM region)"""


# ------------------------------------------------------------------------------------------ master
def master_target(customer: DataFrame) -> DataFrame:
    """Entity master keyed by id (from customer) with NULLs and sentinels in the fill-able columns."""
    c = F.col("c_custkey")
    reg = (F.when(c % 7 == 0, F.lit("None")).when(c % 7 == 1, F.lit("Unknown")).when(c % 7 == 2, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("R"), F.col("c_nationkey").cast("string"))))
    return customer.select(
        c.cast("string").alias("id"),
        F.when(c % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("name"),
        reg.alias("reg"), F.concat(F.lit("RC"), F.col("c_nationkey").cast("string")).alias("reg_code"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("ph"), c.cast("string"))).alias("phone"),
        F.when(c % 3 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("v"), (c % 4).cast("string"))).alias("client_version"),
        (F.col("c_acctbal") / F.lit(10000.0)).alias("risk_score"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))


def master_source(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    return supplier.select(
        s.cast("string").alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("reg"),
        F.concat(F.lit("NC"), F.col("s_nationkey").cast("string")).alias("reg_code"),
        F.when(F.col("s_acctbal") > 500, F.concat(F.lit("sp"), s.cast("string"))).alias("phone"),
        F.when(s % 2 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("sv"), s.cast("string"))).alias("client_version"),
        (F.col("s_acctbal") / F.lit(10000.0)).alias("risk_score"))


MASTER_SQL = """tgt AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS name,
    CASE WHEN c_custkey % 7 = 0 THEN 'None' WHEN c_custkey % 7 = 1 THEN 'Unknown' WHEN c_custkey % 7 = 2 THEN NULL
         ELSE 'R' || c_nationkey END AS reg, 'RC' || c_nationkey AS reg_code,
    CASE WHEN c_acctbal > 0 THEN 'ph' || c_custkey END AS phone,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'v' || (c_custkey % 4) END AS client_version,
    c_acctbal / 10000.0 AS risk_score, TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM customer),
src AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, 'N' || s_nationkey AS reg, 'NC' || s_nationkey AS reg_code,
    CASE WHEN s_acctbal > 500 THEN 'sp' || s_suppkey END AS phone,
    CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'sv' || s_suppkey END AS client_version,
    s_acctbal / 10000.0 AS risk_score FROM supplier)"""


# ------------------------------------------------------------------------------------------ status log
_STATUS = {"F": K.STATUS_SUCCESS, "O": K.STATUS_FAILED, "P": K.STATUS_SKIPPED}


def status_log(orders: DataFrame) -> DataFrame:
    """Run-status records (S16 shape) from orders: run = order month, dag = customer mod 3, task key
    = category prefix + feature number, status from the order status, cadence from the order key;
    several records per (run, dag, task) -- the newest one wins."""
    ck, ok = F.col("o_custkey"), F.col("o_orderkey")
    prefix = F.lit(None).cast("string")
    for i, p in reversed(list(enumerate(K.CATEGORY_PREFIXES))):
        prefix = F.when(ck % len(K.CATEGORY_PREFIXES) == i, F.lit(p)).otherwise(prefix)
    task = F.when(ck % 20 == 19, F.lit("risk_score")).otherwise(F.concat(prefix, F.lit("_f"), (ck % 20).cast("string")))
    status = F.when(ok % 97 == 0, F.lit(None).cast("string"))
    for code, word in _STATUS.items():
        status = status.when(F.col("o_orderstatus") == F.lit(code), F.lit(word))
    cadence = (F.when(ok % 4 == 0, F.lit("hourly")).when(ok % 4 == 1, F.lit("daily")).when(ok % 4 == 2, F.lit("weekly")))
    error = F.when(F.col("o_orderstatus") == "O", F.repeat(F.lit("e"), (ok % 3000).cast("int")))
    tb = F.when(F.col("o_orderstatus") == "O", F.repeat(F.lit("t"), (ok % 5000).cast("int")))
    written = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (ok % 86400).cast("int"))
    out = orders.select(
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"),
        F.concat(F.lit("dag_"), (ck % 3).cast("string")).alias("dag_id"),
        task.alias("task_key"), status.alias("status"), cadence.alias("cadence"),
        error.alias("error"), tb.alias("traceback"), written.alias("written_at"), ok.alias("seq"))
    return out.withColumn("category", infer_category("task_key"))


STATUS_SQL = """slog AS (SELECT strftime(o_orderdate, '%Y-%m') AS run_id, 'dag_' || (o_custkey % 3) AS dag_id,
    CASE WHEN o_custkey % 20 = 19 THEN 'risk_score'
         ELSE (CASE o_custkey % 6 WHEN 0 THEN 'sustxn' WHEN 1 THEN 'auth' WHEN 2 THEN 'hardware' WHEN 3 THEN 'work'
                                  WHEN 4 THEN 'bio' ELSE 'document' END) || '_f' || (o_custkey % 20) END AS task_key,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'success' WHEN o_orderstatus = 'O' THEN 'failed'
         WHEN o_orderstatus = 'P' THEN 'skipped' END AS status,
    CASE WHEN o_orderkey % 4 = 0 THEN 'hourly' WHEN o_orderkey % 4 = 1 THEN 'daily' WHEN o_orderkey % 4 = 2 THEN 'weekly' END AS cadence,
    CASE WHEN o_orderstatus = 'O' THEN repeat('e', CAST(o_orderkey % 3000 AS INTEGER)) END AS error,
    CASE WHEN o_orderstatus = 'O' THEN repeat('t', CAST(o_orderkey % 5000 AS INTEGER)) END AS traceback,
    o_orderdate + to_seconds(o_orderkey % 86400) AS written_at, o_orderkey AS seq FROM orders),
slog2 AS (SELECT *, CASE WHEN task_key = 'sustxn' OR starts_with(task_key, 'sustxn_') THEN 'sustxn'
    WHEN task_key = 'auth' OR starts_with(task_key, 'auth_') THEN 'auth' WHEN task_key = 'hardware' OR starts_with(task_key, 'hardware_') THEN 'hardware'
    WHEN task_key = 'work' OR starts_with(task_key, 'work_') THEN 'work' WHEN task_key = 'bio' OR starts_with(task_key, 'bio_') THEN 'bio'
    WHEN task_key = 'document' OR starts_with(task_key, 'document_') THEN 'document' END AS category FROM slog),
latest_status AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, dag_id, task_key
    ORDER BY written_at DESC, seq DESC) AS rn FROM slog2) WHERE rn = 1)"""
