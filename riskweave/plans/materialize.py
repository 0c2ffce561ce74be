"""Cutting lineage: a derived table that several plans read is materialised once with a reliable
checkpoint into the shared folder named by ``spark.checkpoint.dir`` (never a machine-local temp
folder on a cluster, never a local checkpoint -- both lose data with an executor)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from riskweave.session import ensure_checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
