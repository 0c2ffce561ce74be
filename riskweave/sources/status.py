"""Status log as JSON records (S16 write, S6 read), append only.

Every write is an attempt of its own: ``<root>/records/attempt=<name>/run_id=<run>/dag_id=<dag>/part-*``. Nothing that
another write recorded is touched, so the tasks of a run may be written one by one, and a replayed attempt
replaces only itself. The newest record of a (run, dag, task) is found when the log is read: by ``written_at``, then
``try_number``, then the name of the attempt (names should sort by time). Records that cannot be parsed are
skipped.

``compact`` rewrites the newest records as one attempt and notes which attempts that one covers; these are deleted by
the next compaction, so a reader that listed them before still finds them. In between records stand
twice, which the choice of the newest does not mind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave import constants as K
from riskweave.functions.columns import sanitize_run_id
from riskweave.operators.windows import latest_per_key
from riskweave.sources.versioned import Files

KEYS = ["run_id", "dag_id", "task_key"]
FIELDS = {"task_key": "string", "category": "string", "status": "string", "error": "string", "error_type": "string", "traceback": "string",
          "cadence": "string", "log_url": "string", "try_number": "int", "written_at": "string", "origin": "string"}
STATUS_JSON_SCHEMA = ", ".join(f"{c} {t}" for c, t in FIELDS.items()) + ", attempt string, run_id string, dag_id string"


def _field(records: DataFrame, name: str) -> Column:
    """The column as it is stored; NULL where the writer has none. Long texts are cut here: an error keeps its beginning,
    a traceback its end."""
    value = F.col(name) if name in records.columns else F.lit(None)
    if name == "written_at" and dict(records.dtypes).get(name, "string") != "string":
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(name)
    if name == "error":
        value = F.left(value.cast("string"), F.lit(K.ERROR_MAX_CHARS))
    if name == "traceback":
        value = F.right(value.cast("string"), F.lit(K.TRACEBACK_MAX_CHARS))
    return value.cast(FIELDS[name]).alias(name)


def write_status_records(records: DataFrame, path: str, attempt: str) -> None:
    """Add one JSON object per record under the attempt's name. A record may lack any column but run_id, dag_id and task_key."""
    payload = F.to_json(F.struct(*[_field(records, c) for c in FIELDS]))
    out = records.select(sanitize_run_id("run_id").alias("run_id"), "dag_id", payload.alias("value"))
    # records come together by folder; a folder that is too large for one writer is split
    out.hint("rebalance", "run_id", "dag_id").write.mode("overwrite").partitionBy("run_id", "dag_id").text(f"{path}/records/attempt={attempt}")


def status_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of every attempt that can be parsed."""
    rows = spark.read.schema(STATUS_JSON_SCHEMA).option("mode", "DROPMALFORMED").option("basePath", f"{path}/records").json(f"{path}/records")
    return rows.withColumn("attempt", F.coalesce("origin", "attempt"))


def read_layer_status(spark: SparkSession, path: str, run_id: str | None = None, dag_id: str | None = None) -> DataFrame:
    """The newest record of each task; of one run or DAG by its folders alone."""
    rows = status_records(spark, path)
    for name, value in (("run_id", run_id), ("dag_id", dag_id)):
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    carried = [c for c in FIELDS if c not in (*KEYS, "written_at", "try_number", "origin")]
    return latest_per_key(rows, KEYS, ["written_at", "try_number", "attempt"], carried)


def compact(spark: SparkSession, path: str, attempt: str) -> int:
    """Write the newest records as the attempt ``attempt``, and delete the attempts that an earlier compaction covered. The
    number of attempts this one covers."""
    files = Files(spark, path)
    before = files.names("records")
    expired = {line for n in files.names("compacted") for line in files.text(f"compacted/{n}").split("\n") if line}
    newest = read_layer_status(spark, path).withColumnRenamed("attempt", "origin")
    write_status_records(newest, path, attempt)
    covered = [n for n in before if n != f"attempt={attempt}" and n not in expired]
    files.create(f"compacted/{attempt}.txt", "\n".join(covered))
    for name in expired & set(before):
        files.delete(f"records/{name}")
    return len(covered)
