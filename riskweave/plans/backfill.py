"""Backfill writes: score rows in store shape (S7), written to versioned tables (S8), one day of a cumulative
feature (S18) and multi-date scoring over a date span in one job.

Tables are written under the shared folder named by ``spark.checkpoint.dir`` (tests) or any table
location a caller passes (production) -- never a machine-local temporary folder.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import constants as K
from riskweave.functions.columns import r2, ts_literal
from riskweave.operators.cumulative import cumulative_feature
from riskweave.operators.windows import latest_per_key
from riskweave.plans.dispatch import Spec, groups_of, score_group, spec_of
from riskweave.session import ensure_checkpoint_dir
from riskweave.sources.versioned import VersionedTable

def score_rows(scores: DataFrame, feature_id: str, feature_name: str, feature_version, value_col: str = "score",
               date_col: str | None = "target_date", as_of: _dt.date | None = None) -> DataFrame:
    """Drop NULL/NaN scores, round to 2 decimals, stamp the target day at local midnight,
    comments NULL; plus the ``ds`` partition column."""
    day = F.col(date_col) if date_col else F.lit(as_of)
    v = F.col(value_col)
    return scores.where(v.isNotNull() & ~F.isnan(v)).select(
        F.col("entity_id").cast("string").alias("entity_id"), F.lit(feature_id).alias("feature_id"),
        F.lit(feature_name).alias("feature_name"), F.lit(str(feature_version)).alias("feature_version"),
        r2(v).alias("feature_value"), day.cast("timestamp_ntz").alias("timestamp"),
        F.lit(None).cast("string").alias("comments"), day.cast("string").alias("ds"))


STORE_SCHEMA = ("entity_id string, feature_name string, feature_version string, feature_value double, timestamp timestamp_ntz, "
                "comments string")


def score_table(spark: SparkSession, path: str) -> VersionedTable:
    """A table of score rows whose (feature_id, ds) slices are replaced by versions."""
    return VersionedTable(spark, path, STORE_SCHEMA)


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A fresh table folder inside the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")


def render_cumulative_day(spark: SparkSession, daily: DataFrame, store: DataFrame, daily_id: str,
                          cumulative_id: str, as_of: _dt.date, category: str | None = None,
                          filter_condition: str | None = None) -> DataFrame:
    """The rows to insert for a cumulative feature on day D, stamped D 23:59:59 (no wall clock): one
    step of ``cumulative_feature`` with the stored history as its seed. Days are half-open ranges on the
    raw timestamp, so they reach the scan; a NULL daily value counts as 0, as there.

    P5: the daily input is read from the category's window -- work ``[D, D+1)``, bio and unlisted categories
    ``[D-1, D)``; without a category D itself.
    P6: an optional registry predicate (trusted registry text) is a DataFrame filter on the daily input."""
    input_day = as_of + _dt.timedelta(days=0 if category is None else K.CATEGORY_INPUT_DAY_OFFSET.get(category, -1))
    if filter_condition:
        daily = daily.where(F.expr(filter_condition))
    # the history up to D, also where the input is of the day before
    history = store.where((F.col("timestamp") < ts_literal(as_of, store.schema["timestamp"].dataType))
                          & (F.col("feature_id") == F.lit(cumulative_id)))
    seed = latest_per_key(history, ["entity_id"], ["timestamp"], ["feature_value"], tie_breaks=["feature_value"])
    step = cumulative_feature(daily, daily_id, input_day, input_day)
    return (step.join(seed.select("entity_id", F.col("feature_value").alias("_before")), "entity_id", "left")
                .select("entity_id", F.lit(cumulative_id).alias("feature_id"),
                        (F.coalesce("_before", F.lit(0.0)) + F.col("feature_value")).alias("feature_value"),
                        F.lit(f"{as_of} 23:59:59").cast("timestamp_ntz").alias("timestamp")))


def typed_params(parsed_rows) -> dict:
    """Parameters of one registry row from its parsed items (kind-typed): bool, int, list, map
    (numeric values as float where they parse), text."""
    out = {}
    for r in sorted(parsed_rows, key=lambda r: r["pos"]):
        kind, text = r["kind"], r["value_text"]
        if kind == "bool":
            out[r["param"]] = text == "True"
        elif kind == "int":
            out[r["param"]] = int(text)
        elif kind == "list":
            out[r["param"]] = list(r["list_value"])
        elif kind == "map":
            m = {}
            for k, v in dict(r["map_value"]).items():
                try:
                    m[k] = float(v)
                except ValueError:
                    m[k] = v
            out[r["param"]] = m
        else:
            out[r["param"]] = text
    return out


MOST_PARAMETERS = 1_000_000


def registry_specs(registry: DataFrame) -> list[Spec]:
    """The specs of registry rows (feature_id, feature_name, version, dependent_features), one for each row. Only parsed
    parameters come to the driver, which are configuration; more than ``MOST_PARAMETERS`` are an error."""
    from riskweave.sources.registry import parse_dependent_features

    parsed = parse_dependent_features(registry).limit(MOST_PARAMETERS + 1).collect()
    if len(parsed) > MOST_PARAMETERS:
        raise ValueError(f"the registry names more than {MOST_PARAMETERS} parameters")
    by_feature: dict[str, list] = {}
    for r in parsed:
        by_feature.setdefault(r["feature_id"], []).append(r)
    out = []
    for row in registry.select("feature_id", "feature_name", "version").distinct().limit(MOST_PARAMETERS).collect():
        try:
            params = typed_params(by_feature.get(row["feature_id"], []))
        except (ValueError, TypeError) as e:
            out.append(Spec(row["feature_id"], row["feature_name"], str(row["version"]), problem=f"unreadable parameters: {e}"))
        else:
            out.append(spec_of(row["feature_id"], row["feature_name"], row["version"], params))
    return sorted(out, key=lambda s: s.feature_id)


def store_rows(scored: DataFrame, specs: list[Spec]) -> DataFrame:
    """S7/P11 for many features: (out_id, target_date, entity_id, score) as store rows with ``ds``; NULL and NaN scores go."""
    meta = scored.sparkSession.createDataFrame([(s.feature_id, s.feature_name, s.version) for s in specs],
                                               "out_id string, feature_name string, feature_version string")
    v = F.col("score")
    return scored.where(v.isNotNull() & ~F.isnan(v)).join(F.broadcast(meta), "out_id").select(
        F.col("entity_id").cast("string").alias("entity_id"), F.col("out_id").alias("feature_id"), "feature_name", "feature_version",
        r2(v).alias("feature_value"), F.col("target_date").cast("timestamp_ntz").alias("timestamp"),
        F.lit(None).cast("string").alias("comments"), F.col("target_date").cast("string").alias("ds"))


def backfill_from_registry(registry: DataFrame, feature_values: DataFrame, score_store: DataFrame | None,
                           targets) -> DataFrame:
    """The score backfill as one plan: registry -> specs -> one sub-plan for each (method, parameters) -> store rows for every
    target date of the span. A row that cannot be scored is an error here; ``plans.outcomes`` records it instead."""
    specs = registry_specs(registry)
    bad = [f"{s.feature_id}: {s.problem}" for s in specs if s.problem is not None]
    if bad:
        raise ValueError("; ".join(bad[:5]))
    if not specs:
        raise ValueError("no registry row names a known scoring method or function")
    parts = [store_rows(score_group(g, feature_values, score_store, targets), g) for g in groups_of(specs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_scores(scores: DataFrame, table: VersionedTable, feature_id: str, feature_name: str, feature_version,
                 value_col: str = "score", date_col: str = "target_date") -> dict:
    """S7 + S8 + P11/A18: write one feature's scores as store rows, in place of the slices of the same days, and return the
    run summary -- rows written and NULL/NaN scores dropped -- counted with an ``Observation`` on the
    write itself (no extra job)."""
    from pyspark.sql import Observation

    v = F.col(value_col)
    bad = v.isNull() | F.isnan(v)
    obs = Observation(f"write_{feature_id}")
    observed = scores.observe(obs, F.count(F.lit(1)).alias("rows_in"), F.count_if(bad).alias("rows_dropped"))
    rows = score_rows(observed, feature_id, feature_name, feature_version, value_col, date_col)
    table.append(rows)
    m = obs.get
    return {"feature_id": feature_id, "rows_written": int(m["rows_in"] - m["rows_dropped"]),
            "rows_dropped": int(m["rows_dropped"])}
