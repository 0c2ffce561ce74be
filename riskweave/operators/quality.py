"""Data-quality, planning and gating jobs (G1-G8): tables in, tables out, no driver loops.

Date spines are generated on executors from the (configured) window; joins against them are
equi-joins on (feature, day).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave import constants as K
from riskweave.functions.columns import ts_literal
from riskweave.operators.windows import between_days, day_of, latest_per_key


def _day(c="timestamp"):
    return F.to_date(c)


def day_spine(keys: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """(keys..., day) for every day of [start, end] -- keys is a small configuration set."""
    return keys.withColumn("day", F.explode(F.sequence(F.lit(start), F.lit(end))))


def missing_days(rows: DataFrame, keys: list[str], start: _dt.date, end: _dt.date,
                 expected_keys: DataFrame | None = None) -> DataFrame:
    """Expected (key, day) in [start, end] with no row (left anti against present days)."""
    day = day_of(rows)
    near = rows.where(day.between(F.lit(start), F.lit(end))) if "ds" in rows.columns else rows.where(between_days(rows, "timestamp", start, end))
    present = near.select(*keys, day.alias("day")).distinct()
    exp = expected_keys if expected_keys is not None else rows.select(*keys).distinct()
    return day_spine(exp, start, end).join(present, keys + ["day"], "left_anti")


def preflight(store: DataFrame, feature_id: str, daily_feature_id: str | None, start: _dt.date, end: _dt.date) -> DataFrame:
    """G1: one DQ table (feature_id, check_kind, day, n_rows, blocking): existing rows per day in the
    window (will be replaced), seed history before the window, rows after the window (blocking),
    days of the window without daily input (blocking)."""
    f = store.where(F.col("feature_id") == F.lit(feature_id))
    ts_t = store.schema["timestamp"].dataType
    existing = (f.where(between_days(f, "timestamp", start, end)).groupBy(_day().alias("day"))
                 .agg(F.count(F.lit(1)).alias("n_rows"))
                 .select(F.lit("existing_rows").alias("check_kind"), "day", "n_rows", F.lit(False).alias("blocking")))
    seed = (f.where(F.col("timestamp") < ts_literal(start, ts_t))
             .agg(F.max(_day()).alias("day"), F.count_distinct("entity_id").alias("n_rows"))
             .select(F.lit("seed_history").alias("check_kind"), "day", "n_rows", F.lit(False).alias("blocking")))
    later = (f.where(F.col("timestamp") >= ts_literal(end + _dt.timedelta(days=1), ts_t))
              .agg(F.max(_day()).alias("day"), F.count(F.lit(1)).alias("n_rows"))
              .select(F.lit("later_rows").alias("check_kind"), "day", "n_rows", (F.col("n_rows") > 0).alias("blocking")))
    parts = [existing, seed, later]
    if daily_feature_id is not None:
        d = store.where(F.col("feature_id") == F.lit(daily_feature_id))
        keys = store.sparkSession.range(1).select(F.lit(daily_feature_id).alias("feature_id"))
        gaps = missing_days(d, ["feature_id"], start, end, expected_keys=keys).select(
            F.lit("missing_daily").alias("check_kind"), "day", F.lit(0).cast("long").alias("n_rows"), F.lit(True).alias("blocking"))
        parts.append(gaps)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(feature_id).alias("feature_id"), "*")


def preflight_many(store: DataFrame, features: DataFrame, start: _dt.date, end: _dt.date, waivers: DataFrame | None = None) -> DataFrame:
    """G1/J10 for many features (feature_id, daily_feature_id) in one plan: (feature_id, check_kind, first_day, last_day, n,
    blocking, waived).

    ``existing_rows`` per day of the window, ``seed_history`` (the last day before it), ``later_rows`` after it
    (blocking), ``missing_daily`` per run of days of the window on which the daily input has no row (blocking). Runs
    come from neighbouring present days (``lead``), not from a list of all days. ``waivers`` (feature_id or NULL
    for all, check_kind) take a check's blocking away."""
    days = store.groupBy("feature_id", day_of(store).alias("day")).agg(F.count(F.lit(1)).alias("n")).where("day IS NOT NULL")
    own = days.join(features.select("feature_id").distinct(), "feature_id")
    one = [F.col("day").alias("first_day"), F.col("day").alias("last_day")]
    existing = own.where(F.col("day").between(F.lit(start), F.lit(end))).select("feature_id", F.lit("existing_rows").alias("check_kind"), *one, "n",
                                                                                F.lit(False).alias("blocking"))
    seed = own.where(F.col("day") < F.lit(start)).groupBy("feature_id").agg(F.max("day").alias("day"), F.max_by("n", "day").alias("n")).select(
        "feature_id", F.lit("seed_history").alias("check_kind"), *one, "n", F.lit(False).alias("blocking"))
    later = own.where(F.col("day") > F.lit(end)).groupBy("feature_id").agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("n")).select(
        "feature_id", F.lit("later_rows").alias("check_kind"), "first_day", "last_day", "n", F.lit(True).alias("blocking"))
    inputs = features.where(F.col("daily_feature_id").isNotNull()).select("feature_id", "daily_feature_id").distinct()
    present = days.where(F.col("day").between(F.lit(start), F.lit(end))).select(F.col("feature_id").alias("daily_feature_id"), "day")
    edges = inputs.select("feature_id", F.explode(F.array(F.lit(start - _dt.timedelta(days=1)), F.lit(end + _dt.timedelta(days=1)))).alias("day"))
    seen = inputs.join(present, "daily_feature_id").select("feature_id", "day").unionByName(edges)
    following = F.lead("day").over(Window.partitionBy("feature_id").orderBy("day"))         # at most the days of the window
    runs = seen.withColumn("next", following).withColumn("n", (F.datediff("next", "day") - 1).cast("long")).where("n > 0")
    gaps = runs.select("feature_id", F.lit("missing_daily").alias("check_kind"), F.date_add("day", 1).alias("first_day"),
                       F.date_sub("next", 1).alias("last_day"), "n", F.lit(True).alias("blocking"))
    report = existing.unionByName(seed).unionByName(later).unionByName(gaps)
    if waivers is None:
        return report.withColumn("waived", F.lit(False))
    every = waivers.where("feature_id IS NULL").select("check_kind", F.lit(True).alias("for_all")).distinct()
    named = waivers.where("feature_id IS NOT NULL").select("feature_id", "check_kind", F.lit(True).alias("for_one")).distinct()
    marked = report.join(F.broadcast(every), "check_kind", "left").join(named, ["feature_id", "check_kind"], "left")
    waived = F.col("blocking") & (F.coalesce("for_all", F.lit(False)) | F.coalesce("for_one", F.lit(False)))
    return marked.select("feature_id", "check_kind", "first_day", "last_day", "n", (F.col("blocking") & ~waived).alias("blocking"), waived.alias("waived"))


def preflight_verdicts(report: DataFrame, features: DataFrame) -> DataFrame:
    """Per feature whether a check blocks it, and how many blocking findings were waived."""
    found = report.groupBy("feature_id").agg(F.bool_or("blocking").alias("blocked"), F.count_if("waived").alias("n_waived"))
    return features.select("feature_id").distinct().join(found, "feature_id", "left").select(
        "feature_id", F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("n_waived", F.lit(0)).alias("n_waived"))


def backfill_plan(features: DataFrame, spine, destination: DataFrame, source: DataFrame,
                  lookback_days: int, dry_run: bool = True, force: bool = False) -> DataFrame:
    """Features (feature_id, source_feature_id) x dates (``spine`` is an array<date> column such as
    ``sequence(start, end)``) -> outcome SKIP (rows exist, not forced) /
    EMPTY (no source rows in the window) / DRYRUN / OK, with existing and source row counts (A16).
    Counts are aggregated per (feature, day) first; the per-date window sum is a bounded range
    aggregation over those daily counts."""
    jobs = features.withColumn("target_date", F.explode(spine))
    existing = destination.groupBy("feature_id", day_of(destination).alias("target_date")).agg(F.count(F.lit(1)).alias("existing_rows"))
    src_daily = source.groupBy(F.col("feature_id").alias("source_feature_id"), _day().alias("day")).agg(
        F.count(F.lit(1)).alias("_n"))
    src = (src_daily.withColumn("target_date", F.explode(F.sequence(F.col("day"), F.date_add("day", int(lookback_days)))))
                    .groupBy("source_feature_id", "target_date").agg(F.sum("_n").alias("source_rows")))
    j = (jobs.join(existing, ["feature_id", "target_date"], "left").join(src, ["source_feature_id", "target_date"], "left")
             .fillna(0, ["existing_rows", "source_rows"]))
    outcome = (F.when((F.col("existing_rows") > 0) & F.lit(not force), F.lit("SKIP"))
                .when(F.col("source_rows") == 0, F.lit("EMPTY"))
                .when(F.lit(dry_run), F.lit("DRYRUN")).otherwise(F.lit("OK")))
    return j.select("feature_id", "target_date", "existing_rows", "source_rows", outcome.alias("outcome"))


def resume_points(destination: DataFrame, features: DataFrame, start: _dt.date, end: _dt.date) -> DataFrame:
    """Per feature the first day of [start, end] without rows (resume start); NULL when complete."""
    gaps = missing_days(destination, ["feature_id"], start, end, expected_keys=features.select("feature_id"))
    first = gaps.groupBy("feature_id").agg(F.min("day").alias("resume_from"))
    return features.select("feature_id").join(first, "feature_id", "left")


# ------------------------------------------------------------------------------------------ status plane
def truncate_status_text(status_log: DataFrame) -> DataFrame:
    """S16 write rule: error keeps its first 2000 characters, the traceback its last 4000."""
    out = status_log
    if "error" in out.columns:
        out = out.withColumn("error", F.left("error", F.lit(K.ERROR_MAX_CHARS)))
    if "traceback" in out.columns:
        out = out.withColumn("traceback", F.right("traceback", F.lit(K.TRACEBACK_MAX_CHARS)))
    return out


def latest_status(status_log: DataFrame, value_cols: list[str] | None = None) -> DataFrame:
    """Last write wins per (run, dag, task). Only ``value_cols`` travel through the
    newest-per-key reduction (the packed struct is not pruned by the optimizer, so long error and
    traceback texts are carried only when asked for), already truncated as written."""
    keys, order = ["run_id", "dag_id", "task_key"], ["written_at", "seq"]
    cols = value_cols or [c for c in status_log.columns if c not in keys + order]
    slim = truncate_status_text(status_log.select(*keys, *order, *cols))
    return latest_per_key(slim, keys, order, cols)


def category_verdicts(latest: DataFrame, category_key: str = "category", exclude_cadences=K.EXCLUDED_CADENCES) -> DataFrame:
    """relevant = not skipped and cadence not excluded (missing status/cadence count as
    relevant, Q9); a category is valid iff it has a relevant record and all relevant ones succeeded."""
    st, cad = F.col("status"), F.col("cadence")
    relevant = (st.isNull() | (st != F.lit(K.STATUS_SKIPPED))) & (cad.isNull() | ~cad.isin(*exclude_cadences))
    ok = F.coalesce(st == F.lit(K.STATUS_SUCCESS), F.lit(False))
    g = latest.groupBy("run_id", F.col(category_key).alias("category")).agg(
        F.count_if(relevant).alias("n_relevant"), F.bool_and(F.when(relevant, ok)).alias("_all"))
    return g.select("run_id", "category", "n_relevant",
                    F.coalesce((F.col("n_relevant") > 0) & F.col("_all"), F.lit(False)).alias("valid"))


def successes(latest: DataFrame) -> DataFrame:
    return latest.where(F.col("status") == F.lit(K.STATUS_SUCCESS)).select("run_id", "dag_id", "task_key")


def pending_work(work: DataFrame, latest: DataFrame) -> DataFrame:
    """Work items without a success record for their run (left anti)."""
    return work.join(successes(latest), ["run_id", "dag_id", "task_key"], "left_anti")


def ready_work(work: DataFrame, latest: DataFrame) -> DataFrame:
    """Work items (with ``dependencies`` array<struct<dag_id, task_key>>) whose every
    dependency succeeded in the same run."""
    deps = work.select("run_id", "dag_id", "task_key", F.explode_outer("dependencies").alias("d"))
    ok = successes(latest).select("run_id", F.col("dag_id").alias("d_dag"), F.col("task_key").alias("d_task"),
                                  F.lit(1).alias("_ok"))
    j = deps.join(ok, (deps.run_id == ok.run_id) & (F.col("d.dag_id") == ok.d_dag) & (F.col("d.task_key") == ok.d_task), "left")
    g = j.groupBy(deps.run_id, deps.dag_id, deps.task_key).agg(
        F.count("d").alias("n_deps"), F.count("_ok").alias("n_ok"))
    return g.select("run_id", "dag_id", "task_key", "n_deps", (F.col("n_deps") - F.col("n_ok")).alias("n_missing"),
                    (F.col("n_ok") == F.col("n_deps")).alias("ready"))
