"""Tables whose slices are replaced by an atomic switch of versions.

Files of a table are never changed in place::

    <table>/data/batch=<id>/feature_id=../ds=../part-*   one folder for each write
    <table>/manifest/<id>/                               Parquet: the slices of a version and where they are
    <table>/commits/<version>.json                       what a version consists of; the highest one counts

A write puts its rows into a batch of its own, derives the next manifest from the present one and renames a whole commit
file to its place, which fails if another writer has made that version meanwhile; then the manifest alone is derived again. So
deleted and new slices appear together, a reader never sees half of a write, a failed write leaves the table as it
was, and a reader of an older version keeps its files until ``vacuum``.

The rename must be atomic and must not replace a file: so it is on HDFS and, within one process, on local file systems,
not on object stores.

The manifest holds one row per slice with its row count, so the newest day and the number of rows of a
slice are known without reading data.
"""

from __future__ import annotations

import datetime as _dt
import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = ("feature_id", "ds")
_MANIFEST = "feature_id string, ds string, batch string, n_rows long"
#: Slices that may be sent to every task to select them; more are joined as the planner sees fit.
BROADCAST_SLICES = 50_000
_TRIES = 20
_ONE_BY_ONE = threading.Lock()


class Conflict(RuntimeError):
    """Other writers were faster each time."""


def day_text(day: _dt.date | str) -> str:
    return day if isinstance(day, str) else day.isoformat()


@dataclass
class Files:
    """The few calls to the file system of a folder that Spark has no reader or writer for."""

    spark: SparkSession
    root: str
    _fs: object = field(default=None, repr=False)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    @property
    def fs(self):
        if self._fs is None:
            self._fs = self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self._fs

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        if not self.fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path) if not s.getPath().getName().startswith((".", "_")))

    def create(self, name: str, text: str) -> bool:
        """Put a new file in place, whole; False if there is one of that name."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        draft, target = self._path(f"drafts/{uuid.uuid4().hex}"), self._path(name)
        out = self.fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(target.getParent())
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            with _ONE_BY_ONE:                   # local file systems look for the target and rename in two steps
                hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, options)
        except Exception as e:  # noqa: BLE001 - a target that exists is the one expected reason
            if not self.fs.exists(target):
                raise e
            self.fs.delete(draft, False)
            return False
        return True

    def text(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class VersionedTable:
    """A table partitioned by (feature_id, ds). ``schema`` are the columns beside these two."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.files = Files(spark, self.path)

    # ------------------------------------------------------------------------------------ versions
    def version(self) -> int:
        """The newest version; 0 before the first write."""
        names = [int(n.removesuffix(".json")) for n in self.files.names("commits") if n.endswith(".json")]
        return max(names, default=0)

    def commit_info(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self.files.text(f"commits/{version:012d}.json")) if version else {}

    def manifest(self, version: int | None = None) -> DataFrame:
        """(feature_id, ds, batch, n_rows) of every slice of a version."""
        name = self.commit_info(version).get("manifest")
        if name is None:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{name}")

    def applied(self, source: str) -> bool:
        """Whether a commit of the source id ``source`` is part of the table's history."""
        if not self.files.names("commits"):
            return False
        said = self.spark.read.schema("source string").json(f"{self.path}/commits")
        return not said.where(F.col("source") == F.lit(source)).isEmpty()

    # ------------------------------------------------------------------------------------ reading
    def read(self, feature_ids: list[str] | None = None, start=None, end=None, version: int | None = None) -> DataFrame:
        """The rows of a version with feature_id and ds. Features and days select partitions before any file is listed
        as a task; slices that a later batch replaced are left out by a semi-join on partition values."""
        info = self.commit_info(version)
        columns = [f.name for f in self.schema.fields] + list(SLICE)
        full = T.StructType([*self.schema.fields, *[T.StructField(c, T.StringType()) for c in (*SLICE, "batch")]])
        if not info.get("batches"):
            return self.spark.createDataFrame([], full).select(*columns)
        wanted = _selected(self.manifest(version), feature_ids, start, end)
        rows = self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(
            *[f"{self.path}/data/batch={b}" for b in info["batches"]])
        rows = _selected(rows, feature_ids, start, end)
        if info.get("partly"):
            keys = wanted.select(*SLICE, "batch")
            keys = F.broadcast(keys) if info["slices"] <= BROADCAST_SLICES else keys
            rows = rows.join(keys, [*SLICE, "batch"], "left_semi")
        return rows.select(*columns)

    def newest(self, feature_id: str):
        """The newest day of a feature, from the partition values of the manifest, as a scalar subquery."""
        return self.manifest().where(F.col("feature_id") == F.lit(feature_id)).select(F.max("ds")).scalar()

    # ------------------------------------------------------------------------------------ writing
    def stage(self, rows: DataFrame) -> str:
        """Write rows (with feature_id and ds) as a batch that no version holds yet; its id."""
        batch = uuid.uuid4().hex
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        out = rows.select(*columns, *[F.col(c).cast("string").alias(c) for c in SLICE])
        out.hint("rebalance", *SLICE).write.partitionBy(*SLICE).parquet(f"{self.path}/data/batch={batch}")
        return batch

    def staged(self, batch: str) -> DataFrame:
        """The slices of a batch, counted from its files."""
        full = T.StructType([*self.schema.fields, *[T.StructField(c, T.StringType()) for c in SLICE]])
        rows = self.spark.read.schema(full).parquet(f"{self.path}/data/batch={batch}")
        return rows.groupBy(*SLICE).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 0").select(
            *SLICE, F.lit(batch).alias("batch"), "n_rows")

    def commit(self, batches: list[str], drop, source: str | None = None, notes: Callable[[dict], dict] | None = None) -> int:
        """Make the next version: the present slices without those that ``drop`` (a condition on feature_id and ds, or a
        frame of slices) holds for, and the slices of ``batches``. With a ``source`` id that was committed before nothing changes.
        ``notes`` makes the notes of the version (a small dict, kept in the commit file) from those before. The new version."""
        if source is not None and self.applied(source):
            return self.version()
        fresh = None
        for b in batches:
            own = self.staged(b)
            fresh = own if fresh is None else fresh.unionByName(own)
        for _ in range(_TRIES):
            version = self.version()
            before = self.manifest(version)
            kept = (before.join(drop.select(*SLICE), list(SLICE), "left_anti") if isinstance(drop, DataFrame)
                    else before.where(~F.coalesce(drop, F.lit(False))))
            made = kept if fresh is None else kept.unionByName(fresh)
            name = uuid.uuid4().hex
            made.coalesce(8).write.parquet(f"{self.path}/manifest/{name}")
            listed = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/{name}")
            live = listed.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()      # one row per live write
            written = {**self.commit_info(version).get("written", {}), **{b: None for b in batches}}
            written = {r["batch"]: r["n"] if written.get(r["batch"]) is None else written[r["batch"]] for r in live}
            info = {"manifest": name, "batches": sorted(written), "written": written, "slices": sum(r["n"] for r in live),
                    "partly": any(written[r["batch"]] != r["n"] for r in live), "source": source, "notes": notes(self._notes(version)) if notes else self._notes(version)}
            if self.files.create(f"commits/{version + 1:012d}.json", json.dumps(info)):
                return version + 1
            if source is not None and self.applied(source):
                return self.version()
        raise Conflict(f"{self.path}: {_TRIES} other versions were committed meanwhile")

    def _notes(self, version: int) -> dict:
        return self.commit_info(version).get("notes") or {}

    def replace_window(self, rows: DataFrame, feature_ids: list[str], start, end, source: str | None = None,
                       notes: Callable[[dict], dict] | None = None) -> int:
        """The slices of the features on the days ``start`` to ``end`` become exactly ``rows``: days that got no row are
        gone, other slices stay, and both show at once. Rows outside the window are an error, before anything shows."""
        first, last = day_text(start), day_text(end)
        inside = F.col("feature_id").isin(list(feature_ids)) & F.col("ds").between(first, last)
        if source is not None and self.applied(source):
            return self.version()
        batch = self.stage(rows)
        stray = self.staged(batch).where(~F.coalesce(inside, F.lit(False))).limit(3).collect()
        if stray:
            self.files.delete(f"data/batch={batch}")
            raise ValueError(f"rows outside the window to replace: {[(r['feature_id'], r['ds']) for r in stray]}")
        return self.commit([batch], inside, source, notes)

    def append(self, rows: DataFrame, source: str | None = None) -> int:
        """Replace the slices that ``rows`` has, whatever they are."""
        batch = self.stage(rows)
        return self.commit([batch], self.staged(batch), source)

    def vacuum(self, keep: int = 1) -> int:
        """Delete what only versions before the newest ``keep`` need, and batches of writes that never committed. To
        be run when no write is under way. The number of deleted batches."""
        newest = self.version()
        infos = [self.commit_info(v) for v in range(max(1, newest - keep + 1), newest + 1)]
        live = {f"batch={b}" for i in infos for b in i["batches"]}
        gone = [n for n in self.files.names("data") if n not in live]
        for n in gone:
            self.files.delete(f"data/{n}")
        manifests = {i["manifest"] for i in infos}
        for n in self.files.names("manifest"):
            if n not in manifests:
                self.files.delete(f"manifest/{n}")
        return len(gone)


def _selected(frame: DataFrame, feature_ids, start, end) -> DataFrame:
    if feature_ids is not None:
        frame = frame.where(F.col("feature_id").isin(list(feature_ids)))
    if start is not None:
        frame = frame.where(F.col("ds") >= F.lit(day_text(start)))
    if end is not None:
        frame = frame.where(F.col("ds") <= F.lit(day_text(end)))
    return frame
