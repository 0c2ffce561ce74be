"""Incremental M14: keep the newest-sync-per-entity state up to date with Structured Streaming.

Both parts of the state are associative reductions by day, so partial aggregates of micro-batches can be folded in any grouping,
and the window of an as-of date is applied when the state is read (a later as-of date sees exactly what the batch job would):

* ``a_latest``   newest source-A row per (entity, day)  (max over (event_timestamp, tie-breaks, payload))
* ``b_sessions`` per (entity, session, day) the column-wise max of source-B rows

The view = newest of (A row, blend of the entity's newest session) over the days of the window.

A micro-batch writes its partial aggregates as a delta, ``<state>/<part>/delta/b=<batch id>``, so what it writes follows
the batch and not the state. Every ``compact_every`` batches the deltas are folded into the base, a versioned table with one slice
per day: only the days that the deltas touch are read and replaced, and days older than ``keep_days`` before the newest
event expire in the same version. Deltas go when the compaction after next has covered them.

Exactly once: a replayed batch rewrites its own delta, and a replayed compaction finds its id in the table's history. The view
reads what the stream's commit log says is done: the newest base not past it, and the deltas after that base. A restart without
new files returns the view as it was; before the first file the view is empty.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.operators.master import SYNC_COLUMNS
from riskweave.operators.windows import latest_per_key
from riskweave.sources.derived import activity_a, activity_b
from riskweave.sources.versioned import VersionedTable

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
A_TIES = ["client_type", "machine_code", "district", "latitude", "longitude"]
B_COLS = ["district", "pincode", "state", "latitude", "longitude", "machine_code", "event_timestamp"]


def _newest_a(df: DataFrame, *keys: str) -> DataFrame:
    return latest_per_key(df, list(keys), ["event_timestamp"], SYNC_COLUMNS, tie_breaks=A_TIES)


def _blend_b(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in B_COLS])


def _fold_a(df: DataFrame) -> DataFrame:
    return _newest_a(df, "opt_id", "day")


def _fold_b(df: DataFrame) -> DataFrame:
    return _blend_b(df, "opt_id", "resident_sid", "day")


def _by_day(activity: DataFrame) -> DataFrame:
    return activity.withColumn("opt_id", F.upper("operator_id")).withColumn("day", F.to_date("event_timestamp"))


def _a_partial(events: DataFrame) -> DataFrame:
    return _fold_a(_by_day(activity_a(events)))


def _b_partial(events: DataFrame) -> DataFrame:
    return _fold_b(_by_day(activity_b(events)).withColumnRenamed("station_machine_code", "machine_code"))


class StatePart:
    """One part of the state: deltas by batch id and the base by day."""

    def __init__(self, spark: SparkSession, state_dir: str, name: str, partial, folder):
        self.spark, self.name, self.partial, self.folder = spark, name, partial, folder
        self.schema = partial(spark.createDataFrame([], EVENTS_SCHEMA)).schema
        columns = T.StructType([f for f in self.schema.fields if f.name != "day"])
        self.base = VersionedTable(spark, os.path.join(state_dir, name), columns)

    def add(self, events: DataFrame, batch_id: int) -> None:
        self.partial(events).write.mode("overwrite").parquet(f"{self.base.path}/delta/b={batch_id}")

    def _deltas(self, first: int, last: int) -> DataFrame | None:
        paths = [f"{self.base.path}/delta/b={i}" for i in range(first, last + 1)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else None

    def _base(self, upto: int) -> tuple[int, int]:
        """The newest version of the base that holds no batch after ``upto``, and the last batch it holds."""
        for version in range(self.base.version(), 0, -1):
            last = self.base.commit_info(version)["notes"]["upto"]
            if last <= upto:
                return version, last
        return 0, -1

    def _held(self, version: int) -> DataFrame:
        rows = self.base.read(version=version) if version else self.base.read(version=0)
        return rows.withColumn("day", F.to_date("ds")).select(self.schema.names)

    def compact(self, batch_id: int, keep_days: int | None) -> None:
        """Fold the deltas up to ``batch_id`` into the base: the days they touch, and no others."""
        version, last = self._base(batch_id)
        if last >= batch_id:
            return
        fresh = self._deltas(last + 1, batch_id)
        days = fresh.select(F.col("day").cast("string").alias("touched")).distinct()
        old = self.base.read(version=version).join(F.broadcast(days), F.col("ds") == F.col("touched"), "left_semi")     # partition values
        old = old.withColumn("day", F.to_date("ds")).select(self.schema.names)
        folded = self.folder(old.unionByName(fresh)).where("day IS NOT NULL").withColumn("ds", F.col("day").cast("string")).withColumn("feature_id", F.lit(self.name))
        batch = self.base.stage(folded)
        slices = self.base.staged(batch).select("feature_id", "ds")
        if keep_days is not None:
            every = self.base.manifest(version).select("feature_id", "ds").unionByName(slices)
            newest = every.agg(F.max(F.to_date("ds"))).first()[0]
            if newest is not None:
                old_days = self.base.manifest(version).select("feature_id", "ds").where(F.col("ds") < (newest - _dt.timedelta(days=keep_days)).isoformat())
                slices = slices.unionByName(old_days).distinct()
        self.base.commit([batch], slices, source=f"{self.name}-{batch_id}", notes=lambda _: {"upto": batch_id})
        for name in self.base.files.names("delta"):
            if int(name.removeprefix("b=")) <= last:            # covered by the base before this one
                self.base.files.delete(f"delta/{name}")

    def read(self, upto: int) -> DataFrame:
        """Rows whose fold is the part as of batch ``upto``."""
        version, last = self._base(upto)
        fresh = self._deltas(last + 1, upto)
        held = self._held(version)
        return held if fresh is None else held.unionByName(fresh)


def state_parts(spark: SparkSession, state_dir: str) -> list[StatePart]:
    return [StatePart(spark, state_dir, "a_latest", _a_partial, _fold_a), StatePart(spark, state_dir, "b_sessions", _b_partial, _fold_b)]


def state_view(a: DataFrame, b: DataFrame, as_of: _dt.date, days: int, b_client_type: str = "UC") -> DataFrame:
    """The M14 result over the days of the window from the two parts of the state."""
    in_window = F.col("day") >= F.lit(as_of - _dt.timedelta(days=days))
    a = _newest_a(a.where(in_window), "opt_id")
    b = _blend_b(b.where(in_window), "opt_id", "resident_sid")
    newest = latest_per_key(b, ["opt_id"], ["event_timestamp"], ["resident_sid"], tie_breaks=["resident_sid"])
    uc = b.join(newest.select("opt_id", "resident_sid"), ["opt_id", "resident_sid"]).select(
        "opt_id", "district", "pincode", "state", "latitude", "longitude", "machine_code", "event_timestamp",
        F.lit(None).cast("string").alias("client_version"), F.lit(b_client_type).alias("client_type"))
    both = a.select("opt_id", *SYNC_COLUMNS).unionByName(uc)
    return _newest_a(both, "opt_id")


def last_committed(spark: SparkSession, checkpoint_dir: str) -> int | None:
    """The last batch id in the stream's commit log (one small file a batch), None before the first."""
    log = spark.read.format("binaryFile").load(os.path.join(checkpoint_dir, "commits"))
    return log.agg(F.max(F.regexp_extract("path", r"/(\d+)$", 1).try_cast("long"))).first()[0]


def run_sync_stream(spark: SparkSession, source_dir: str, state_dir: str, checkpoint_dir: str,
                    as_of: _dt.date, days: int = 30, glob: str = "*.parquet", files_per_batch: int = 1, compact_every: int = 8,
                    keep_days: int | None = None) -> DataFrame:
    """Process every available event file (``trigger(availableNow=True)``) and return the view."""
    stream = (spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", glob)
                   .option("maxFilesPerTrigger", files_per_batch).parquet(source_dir))
    parts = state_parts(spark, state_dir)

    def fold(batch: DataFrame, batch_id: int) -> None:
        batch.persist()                                   # both parts read it
        for part in parts:
            part.add(batch, batch_id)
            if (batch_id + 1) % compact_every == 0:
                part.compact(batch_id, keep_days)
        batch.unpersist()

    q = (stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint_dir)
               .trigger(availableNow=True).start())
    q.awaitTermination()
    done = last_committed(spark, checkpoint_dir)
    return state_view(*[part.read(-1 if done is None else done) for part in parts], as_of, days)
