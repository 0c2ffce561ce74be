"""Where intermediate tables of the operators go, and how they are written.

Everything that outlives one job is written below the folder that ``spark.checkpoint.dir`` names, as
Parquet, so that a lost executor costs a re-read and never a re-computation of the whole job. Only a
``local`` master may run without that setting (then a scratch folder is made for the session).
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_SCRATCH: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _SCRATCH:
            _SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="riskweave-llm-")
        path = _SCRATCH[app]
    return path.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and keeps column pruning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for the steps of a loop; its files go when the frame is dropped."""
    df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Partitions that a table of a few bytes a row is written in: so many for each core, and the least of them.
PARTS_A_CORE, LEAST_PARTS = 4, 64


def narrow(df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than keep all cores busy, for a table of a few bytes a row that is written: otherwise it takes a
    file for each shuffle partition, however small, and on a local folder Hadoop starts a process for each (chmod). No shuffle."""
    return df.coalesce(max(LEAST_PARTS, PARTS_A_CORE * df.sparkSession.sparkContext.defaultParallelism))


def lean(run):
    """A task's function that gives its memory back to the system when it ends: workers live on, and one that keeps what
    its largest task took leaves less for the executor."""
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def release() -> None:
    import ctypes

    import pyarrow as pa

    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass                                    # not a GNU C library


_SHIPPED: set[str] = set()
#: Bytes of texts in one Arrow batch, where the session names no bound of its own (Spark's is 64 MB, which takes about
#: four times as much beside the heap of an executor for each of its tasks).
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application: they need not share the
    driver's path. Bounds the Arrow batches of the session, unless it sets them itself."""
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    bundle = Path(tempfile.mkdtemp(prefix="riskweave-code-")) / "riskweave_code.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, str(source.relative_to(root.parent)))
    spark.sparkContext.addPyFile(str(bundle))
    _SHIPPED.add(app)
