"""Backfill runs with an outcome for every (feature, date): G2, A17, and G3's resumption.

A run scores the requested registry rows for a span of dates, group by group (``plans.dispatch``), and writes each group's
slices in one version of the score table. What happens to a feature is recorded, never raised:

* ``SKIP``    not in the registry, no scoring method or function, or rows exist and ``force`` is off
* ``FAIL``    unknown method, unusable parameters, or an error while its plan was made or run; the others go on
* ``EMPTY``   nothing was computed (no source rows in the window); existing rows stay
* ``DRYRUN``  computed and counted, nothing written
* ``OK``      written; existing rows of the date are replaced in the same version

When a group fails, its halves are tried alone, down to the features that fail by themselves.

The ledger is a Parquet table of outcomes by run. It gets a group's rows after the group's version is committed, so a run that
is started again under its id leaves out what is done (OK, EMPTY, SKIP, DRYRUN) and tries again what failed; a
crash between the two writes costs one group's work, not its rows, since a commit carries the id of its attempt.
"""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave import constants as K
from riskweave.operators.windows import as_span
from riskweave.plans.backfill import registry_specs, store_rows
from riskweave.plans.dispatch import Spec, groups_of, score_group
from riskweave.plans.materialize import materialize
from riskweave.sources.versioned import VersionedTable

OUTCOME = ("run_id string, feature_id string, target_date date, outcome string, reason string, existing_rows long, "
           "rows_written long, rows_dropped long")
COLUMNS = [c.split()[0] for c in OUTCOME.split(", ")]
DONE = ["OK", "EMPTY", "SKIP", "DRYRUN"]


class Ledger:
    """The outcomes of runs: ``<path>/run_id=<run>/part-*``; of several for one (feature, date) the last counts."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def add(self, outcomes: DataFrame) -> None:
        numbered = outcomes.withColumn("attempt", F.lit(self._attempts()).cast("long"))
        numbered.coalesce(1).write.mode("append").partitionBy("run_id").parquet(self.path)

    def _attempts(self) -> int:
        rows = self._rows()
        return 0 if rows is None else (rows.agg(F.max("attempt")).first()[0] or 0) + 1

    def _rows(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(OUTCOME + ", attempt long").parquet(self.path)
        except AnalysisException:
            return None                         # no run has written yet

    def read(self, run_id: str) -> DataFrame:
        rows = self._rows()
        if rows is None:
            return self.spark.createDataFrame([], OUTCOME)
        rows = rows.where(F.col("run_id") == F.lit(run_id))
        last = F.max_by(F.struct(*[F.col(c) for c in COLUMNS[3:]]), "attempt").alias("o")
        return rows.groupBy("run_id", "feature_id", "target_date").agg(last).select("run_id", "feature_id", "target_date", "o.*")


def _reason(e: BaseException) -> str:
    """The first line of what went wrong."""
    text = e.desc if isinstance(e, AnalysisException) and getattr(e, "desc", None) else str(e)
    return f"{type(e).__name__}: {(text.strip().splitlines() or [''])[0]}"[:K.ERROR_MAX_CHARS]


def run_backfill(registry: DataFrame, feature_values: DataFrame, table: VersionedTable, targets, ledger: Ledger, run_id: str,
                 scores: DataFrame | None = None, requested: DataFrame | None = None, dry_run: bool = False, force: bool = False) -> DataFrame:
    """The outcomes of the run, one row per (feature, date), as the ledger has them afterwards.

    ``requested`` (feature_name, version) limits the run to these registry rows; without it all rows are scored. ``scores`` is what
    category methods read; by default the table as it was at the start."""
    spark, span = table.spark, as_span(targets)
    rows = registry.select("feature_id", "feature_name", F.col("version").cast("string").alias("version"), "dependent_features")
    unknown: list[Spec] = []
    if requested is not None:
        asked = requested.select("feature_name", F.col("version").cast("string").alias("version")).distinct()
        for r in asked.join(rows, ["feature_name", "version"], "left_anti").collect():     # of the request, configuration
            unknown.append(Spec(f"{r['feature_name']}_v{r['version']}", r["feature_name"], r["version"], problem="not found in registry", skip=True))
        rows = rows.join(asked, ["feature_name", "version"], "left_semi")
    specs = registry_specs(rows) + unknown
    if not specs:
        return ledger.read(run_id)
    scores = table.read() if scores is None else scores

    days = spark.range(1).select(F.explode(F.sequence(F.lit(span.start), F.lit(span.end))).alias("target_date"))
    ids = spark.createDataFrame([(s.feature_id,) for s in specs], "feature_id string")
    done = ledger.read(run_id).where(F.col("outcome").isin(DONE)).select("feature_id", "target_date")
    existing = table.manifest().groupBy("feature_id", F.to_date("ds").alias("target_date")).agg(F.sum("n_rows").alias("existing_rows"))
    pairs = ids.crossJoin(F.broadcast(days)).join(done, ["feature_id", "target_date"], "left_anti")     # features by dates asked for
    pairs = materialize(pairs.join(existing, ["feature_id", "target_date"], "left").fillna(0, ["existing_rows"]))

    def recorded(frame: DataFrame) -> DataFrame:
        kinds = dict(x.split() for x in OUTCOME.split(", "))
        return frame.select(*[(F.lit(run_id) if c == "run_id" else F.col(c) if c in frame.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in COLUMNS])

    # decided without scoring; existing rows come before any problem of the parameters
    problems = spark.createDataFrame([(s.feature_id, "SKIP" if s.skip else "FAIL", s.problem) for s in specs if s.problem is not None],
                                     "feature_id string, outcome string, reason string")
    held = F.col("existing_rows") > 0 if not force else F.lit(False)
    early = pairs.join(F.broadcast(problems), "feature_id", "left").withColumn(
        "outcome", F.when(held, F.lit("SKIP")).otherwise(F.col("outcome"))).withColumn(
        "reason", F.when(held, F.concat(F.col("existing_rows").cast("string"), F.lit(" rows already present"))).otherwise(F.col("reason")))
    early = early.where(F.col("outcome").isNotNull()).withColumn("rows_written", F.lit(0)).withColumn("rows_dropped", F.lit(0))
    ledger.add(recorded(early))
    todo = materialize(pairs.join(early.select("feature_id", "target_date"), ["feature_id", "target_date"], "left_anti"))
    pending = {r["feature_id"] for r in todo.select("feature_id").distinct().collect()}         # at most the specs

    def attempt(group: list[Spec]) -> None:
        own = todo.where(F.col("feature_id").isin([s.feature_id for s in group]))
        try:
            outcomes = _score_and_write(group, own)
        except Exception as e:  # noqa: BLE001 - whatever stops a feature is its outcome
            if len(group) > 1:
                attempt(group[:len(group) // 2])
                attempt(group[len(group) // 2:])
                return
            outcomes = own.select("*", F.lit("FAIL").alias("outcome"), F.lit(_reason(e)).alias("reason"), F.lit(0).alias("rows_written"),
                                  F.lit(0).alias("rows_dropped"))
        ledger.add(recorded(outcomes))

    def _score_and_write(group: list[Spec], own: DataFrame) -> DataFrame:
        scored = score_group(group, feature_values, scores, span)
        scored = materialize(scored.join(own.select(F.col("feature_id").alias("out_id"), "target_date"), ["out_id", "target_date"], "left_semi"))
        v = F.col("score")
        counts = scored.groupBy(F.col("out_id").alias("feature_id"), "target_date").agg(
            F.count(F.lit(1)).alias("computed"), F.count_if(v.isNotNull() & ~F.isnan(v)).alias("good"))
        result = own.join(counts, ["feature_id", "target_date"], "left").fillna(0, ["computed", "good"])
        outcome = F.when(F.col("computed") == 0, F.lit("EMPTY")).when(F.lit(dry_run), F.lit("DRYRUN")).otherwise(F.lit("OK"))
        reason = (F.when(F.col("computed") == 0, F.lit("computed 0 rows, nothing written"))
                   .when(F.lit(dry_run), F.concat(F.lit("would write "), F.col("good").cast("string"), F.lit(" rows"))))
        result = materialize(result.select("feature_id", "target_date", "existing_rows", outcome.alias("outcome"), reason.alias("reason"),
                                           F.when(outcome == "OK", F.col("good")).otherwise(F.lit(0)).alias("rows_written"),
                                           (F.col("computed") - F.col("good")).alias("rows_dropped")))
        if not dry_run:
            replaced = result.where(F.col("outcome") == "OK").select("feature_id", F.col("target_date").cast("string").alias("ds"))
            names = ",".join(s.feature_id for s in group)
            source = f"{run_id}/{hashlib.sha256(names.encode()).hexdigest()[:16]}/{table.version()}"
            table.commit([table.stage(store_rows(scored, group))], replaced, source=source)
        return result

    for group in groups_of([replace(s) for s in specs if s.feature_id in pending]):
        attempt(group)
    return ledger.read(run_id)


def summary(outcomes: DataFrame) -> DataFrame:
    """How many (feature, date) pairs had each outcome, and the rows written and dropped."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_jobs"), F.sum("rows_written").alias("rows_written"),
                                           F.sum("rows_dropped").alias("rows_dropped"))
